"""Projection, cleaning and filter queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import pricing as P
from .registry import query

_CLEAN = "case when trim({0}) not in ('','NULL','null','N/A','NA','none','NONE') then regexp_replace(trim({0}), '\\s+', ' ', 'g') end"
_UNIT = "coalesce(case upper(trim(uom)) when 'EACH' then 'EA' when 'EACHES' then 'EA' when 'CASE' then 'CA' when 'CS' then 'CA' when 'BOX' then 'BX' when '' then null else upper(trim(uom)) end, 'EA')"


@query("PRJ-01", f"select row_id, {_CLEAN.format('vendor')} as vendor, {_CLEAN.format('item_id')} as item_id from consumption")
def clean(d):
    return d.consumption.select("row_id", C.clean_string(F.col("vendor")).alias("vendor"), C.clean_string(F.col("item_id")).alias("item_id"))


@query("PRJ-02", f"select row_id, upper({_CLEAN.format('description')}) as description from consumption")
def upper(d):
    return d.consumption.select("row_id", C.clean_upper(F.col("description")).alias("description"))


@query("PRJ-03", "select p_partkey, try_cast(p_name as double) as bad, cast(round(p_retailprice) as int) as whole, try_cast(cast(p_size as string) as double) as size from part")
def casts(d):
    return d.part.select("p_partkey", C.safe_double(F.col("p_name")).alias("bad"), C.safe_int(F.col("p_retailprice").cast("string")).alias("whole"), C.safe_double(F.col("p_size").cast("string")).alias("size"))


@query("PRJ-04", "select row_id, md5(concat_ws('||', row_id, cast(log_id as string), coalesce(item_id, ''), coalesce(vendor, ''))) as row_hash, 'consumption' as source_file from consumption")
def audit(d):
    return d.consumption.select("row_id", C.row_hash(*(F.col(c) for c in ("row_id", "log_id", "item_id", "vendor"))).alias("row_hash"), F.lit("consumption").alias("source_file"))


@query("PRJ-05", "select item_id, description, manufacturer, manufacturer_part, unspsc from item_master")
def exclude(d):
    return d.item_master.drop("vendor_part", "unspsc_text", "price", "qoe", "active")


@query("PRJ-06", "select item_id as sku, manufacturer as maker, description as label, price / qoe as unit_cost from item_master")
def rename(d):
    return d.item_master.select(F.col("item_id").alias("sku"), F.col("manufacturer").alias("maker"), F.col("description").alias("label"), (F.col("price") / F.col("qoe")).alias("unit_cost"))


@query("PRJ-07", f"select row_id, {_UNIT} as unit from consumption")
def unit(d):
    return d.consumption.select("row_id", C.standard_unit(F.col("uom")).alias("unit"))


@query("PRJ-08", "select row_id, unit_price * quantity as line_spend, service_date, strftime(service_date, '%Y-%m') as service_month from consumption")
def spend(d):
    return d.consumption.select("row_id", (F.col("unit_price") * F.col("quantity")).alias("line_spend"), "service_date", F.date_format("service_date", "yyyy-MM").alias("service_month"))


@query("PRJ-09", "select row_id, coalesce(unit_price > 0, false) as good_price, coalesce(quantity > 0, false) as good_quantity, service_date is not null as good_date from consumption")
def flags(d):
    return d.consumption.select("row_id", F.coalesce(F.col("unit_price") > 0, F.lit(False)).alias("good_price"), F.coalesce(F.col("quantity") > 0, F.lit(False)).alias("good_quantity"), F.col("service_date").isNotNull().alias("good_date"))


_ERRORS = {"NO_ITEM": "item_id = ''", "NO_VENDOR": "trim(vendor) = ''", "NO_DATE": "service_date is null", "BAD_QUANTITY": "quantity <= 0"}
_COUNT = " + ".join(f"case when {x} then 1 else 0 end" for x in _ERRORS.values())


@query("PRJ-10", f"select row_id, {_COUNT} as errors, concat({', '.join(f'''case when {x} then ';{n}' else '' end''' for n, x in _ERRORS.items())}) as codes from consumption")
def errors(d):
    count = reduce(lambda a, b: a + b, (F.when(F.expr(x), 1).otherwise(0) for x in _ERRORS.values()))
    return d.consumption.select("row_id", count.alias("errors"), F.concat(*(F.when(F.expr(x), f";{n}").otherwise("") for n, x in _ERRORS.items())).alias("codes"))


@query("PRJ-11", f"select row_id, case when item_id = '' or service_date is null then 'INELIGIBLE' when ({_COUNT}) > 0 then 'REVIEW_REQUIRED' else 'ELIGIBLE' end as eligibility from consumption")
def eligibility(d):
    any_error = reduce(lambda a, b: a | b, (F.coalesce(F.expr(x), F.lit(False)) for x in _ERRORS.values()))
    return d.consumption.select("row_id", F.when((F.col("item_id") == "") | F.col("service_date").isNull(), "INELIGIBLE").when(any_error, "REVIEW_REQUIRED").otherwise("ELIGIBLE").alias("eligibility"))


_LINES = """lines as (select c.row_id, c.unit_price, c.quantity, c.unit_price * c.quantity as spend, c.uom, k.contract_number, k.price, k.each_price, k.uom as contract_uom, k.qoe
    from consumption c left join (select * from contracts qualify row_number() over (partition by item_id, vendor order by price nulls last, contract_number, starts) = 1) k
    on c.item_id = k.item_id and c.vendor = k.vendor)"""
_VARIANCE = f"case when price > 0 then (unit_price - case when {_UNIT} = contract_uom then price else coalesce(each_price * qoe, 0) end) * quantity else 0 end"


def lines(d, *more):
    """Lines with the cheapest contract of their item and vendor, and more columns of consumption."""
    from ..operators.windows import pick

    k = pick(d.contracts, ["item_id", "vendor"], [F.col("price").asc_nulls_last(), F.col("contract_number"), F.col("starts")])
    k = k.select("item_id", "vendor", "contract_number", "price", "each_price", F.col("uom").alias("contract_uom"), "qoe")
    c = d.consumption.select("row_id", "item_id", "vendor", "unit_price", "quantity", (F.col("unit_price") * F.col("quantity")).alias("spend"), C.standard_unit(F.col("uom")).alias("unit"), *more)
    same = F.col("unit") == F.col("contract_uom")
    out = c.join(k, ["item_id", "vendor"], "left")
    return out.withColumn("variance", P.variance(F.col("unit_price"), F.col("quantity"), F.col("price"), F.col("each_price"), F.col("qoe"), same))


@query("PRJ-12", f"with {_LINES} select row_id, {_VARIANCE} as variance from lines")
def variance(d):
    return lines(d).select("row_id", "variance")


@query("PRJ-13", "select c.row_id, (c.unit_price - coalesce(c.client_contract_price, m.price, c.unit_price)) * c.quantity as variance from consumption c left join item_master m on c.item_id = m.item_id")
def variance_item_price(d):
    m = d.item_master.select("item_id", "price")
    price = F.coalesce("client_contract_price", "price", "unit_price")
    return d.consumption.join(m, "item_id", "left").select("row_id", ((F.col("unit_price") - price) * F.col("quantity")).alias("variance"))


@query("PRJ-14", f"with {_LINES} select row_id, coalesce((unit_price - price) * quantity, 0) as variance_plain, {_VARIANCE} as variance_unit from lines")
def variance_pair(d):
    return lines(d).select("row_id", F.coalesce((F.col("unit_price") - F.col("price")) * F.col("quantity"), F.lit(0.0)).alias("variance_plain"), F.col("variance").alias("variance_unit"))


@query("PRJ-15", f"with {_LINES}, v as (select *, {_VARIANCE} as variance, contract_number is not null as on_contract from lines) select row_id, greatest(variance, 0e0) as overpayment, case when on_contract then greatest(variance, 0e0) else spend * 15e-2 end as savings, on_contract and abs(variance) <= spend * 5e-3 as compliant from v")
def saved(d):
    on, v, s = F.col("contract_number").isNotNull(), F.col("variance"), F.col("spend")
    return lines(d).select("row_id", P.overpayment(v).alias("overpayment"), P.savings(on, v, s).alias("savings"), P.compliant(on, v, s).alias("compliant"))


@query("PRJ-16", f"with {_LINES} select row_id, case when contract_number is null then 'OFF' else 'ON' end as status, case when contract_number is null then 'N' else 'Y' end as has_contract, case when {_UNIT} = contract_uom then 'Y' else 'N' end as unit_match from lines")
def status(d):
    yes = lambda c: F.when(c, "Y").otherwise("N")
    has = F.col("contract_number").isNotNull()
    return lines(d).select("row_id", F.when(has, "ON").otherwise("OFF").alias("status"), yes(has).alias("has_contract"), yes(F.col("unit") == F.col("contract_uom")).alias("unit_match"))


_CLASS = "case " + " ".join("when " + " or ".join(f"upper({{0}}) like '%{w}%'" for w in words) + f" then '{name}'" for name, words in C.KEYWORD_CLASSES) + f" else coalesce(nullif(trim({{1}}), ''), '{C.UNCLASSIFIED}') end"


@query("PRJ-17", f"select item_id, {_CLASS.format('description', 'unspsc_text')} as class from item_master")
def classes(d):
    return d.item_master.select("item_id", C.keyword_class(F.col("description"), F.col("unspsc_text")).alias("class"))


@query("PRJ-18", f"""select item_id, {_CLASS.format("(description || ' ' || unspsc_text)", "upper(left(unspsc_text, 1)) || lower(substr(unspsc_text, 2))")} as class from item_master""")
def classes_both(d):
    both = F.concat_ws(" ", "description", "unspsc_text")
    return d.item_master.select("item_id", C.keyword_class(both, F.initcap("unspsc_text")).alias("class"))


@query("PRJ-19", "select item_id, cast(100 - case when item_id <> '' then 0 else 20 end - case when manufacturer is not null then 0 else 20 end - case when unspsc is not null then 0 else 10 end as int) as score from item_master")
def scores(d):
    return d.item_master.select("item_id", C.quality_score(F.col("item_id") != "", F.col("manufacturer").isNotNull(), F.col("unspsc").isNotNull()).alias("score"))


@query("PRJ-20", "select contract_number, item_id, vendor, price, case when qoe > 0 then price / qoe end as unit_contract_price from contracts")
def unit_contract(d):
    return d.contracts.select("contract_number", "item_id", "vendor", "price", F.when(F.col("qoe") > 0, F.col("price") / F.col("qoe")).alias("unit_contract_price"))


@query("PRJ-21", "select row_id, case when description like '%plate%' or description like '%bolt%' then 'ORTHO' when description like 'small%' then 'MINOR' else 'GENERAL' end as procedure_group from consumption")
def groups(d):
    x = F.col("description")
    return d.consumption.select("row_id", F.when(x.like("%plate%") | x.like("%bolt%"), "ORTHO").when(x.like("small%"), "MINOR").otherwise("GENERAL").alias("procedure_group"))


@query("PRJ-22", "select row_id, trim(split_part(drg_code, '|', 1)) as primary_drg from consumption")
def drg(d):
    return d.consumption.select("row_id", C.primary_drg(F.col("drg_code")).alias("primary_drg"))


@query("PRJ-23", "with t as (select row_id, upper(description) || case when log_id % 2 = 0 then ', LAPAROSCOPIC' else '' end as p from consumption) select row_id, case when log_id2 = 0 then 'LAPAROSCOPIC ' || upper(description) else upper(description) end as procedure_name from (select row_id, log_id % 2 as log_id2, description from consumption)")
def procedures(d):
    text = F.concat("description", F.when(F.col("log_id") % 2 == 0, ", Laparoscopic").otherwise(""))
    return d.consumption.select("row_id", C.procedure_name(text).alias("procedure_name"))


_GROUPS = {"ECONOMY": "Standard Surgery", "STANDARD": "Standard Surgery", "PROMO": "Minor Surgery", "SMALL": "Minor Surgery"}


@query("PRJ-24-TYPES", "select row_id, case item_type when 'ECONOMY' then 'Standard Surgery' when 'STANDARD' then 'Standard Surgery' when 'PROMO' then 'Minor Surgery' when 'SMALL' then 'Minor Surgery' else item_type || ' Surgery' end as procedure_group from consumption")
def consolidated(d):
    known = F.create_map(*(F.lit(x) for pair in _GROUPS.items() for x in pair))
    text = F.regexp_replace(F.concat("item_type", F.lit(" Surgery Surgery")), " Surgery Surgery$", " Surgery")
    return d.consumption.select("row_id", F.coalesce(F.try_element_at(known, F.col("item_type")), text).alias("procedure_group"))


@query("PRJ-25", "select row_id, 'T1' as tenant, 'T1|' || row_id as tenant_key from consumption")
def tenant(d):
    return d.consumption.select("row_id", F.lit("T1").alias("tenant"), F.concat_ws("|", F.lit("T1"), "row_id").alias("tenant_key"))


_FACTOR = "case when i.factor > 0 then i.factor when upper(trim(i.uom)) in ('EA', 'EACH') then 1e0 when p.factor > 0 then p.factor else 1e0 end"
_RULE = "case when i.factor > 0 then 'EXPLICIT' when upper(trim(i.uom)) in ('EA', 'EACH') then 'EACH' when p.factor > 0 then 'FROM_PO' else 'DEFAULT' end"


def invoice_lines(d):
    p = d.purchase_orders.select("po_number", "po_line", F.col("factor").alias("po_factor"), F.col("quantity").alias("po_quantity"), F.col("unit_price").alias("po_price"))
    each = F.upper(F.trim("uom")).isin("EA", "EACH")
    out = d.invoices.join(p, ["po_number", "po_line"], "left")
    return out.withColumn("each_factor", F.when(F.col("factor") > 0, F.col("factor")).when(each, 1.0).when(F.col("po_factor") > 0, F.col("po_factor")).otherwise(1.0)).withColumn(
        "rule", F.when(F.col("factor") > 0, "EXPLICIT").when(each, "EACH").when(F.col("po_factor") > 0, "FROM_PO").otherwise("DEFAULT")
    )


@query("PRJ-26", f"select i.invoice_number, i.po_line, {_FACTOR} as each_factor, {_RULE} as rule from invoices i left join purchase_orders p on i.po_number = p.po_number and i.po_line = p.po_line")
def invoice_factor(d):
    return invoice_lines(d).select("invoice_number", "po_line", "each_factor", "rule")


@query("PRJ-27-LINES", f"select i.invoice_number, i.po_line, i.quantity * {_FACTOR} as each_quantity, i.unit_price / nullif({_FACTOR}, 0) as each_price, coalesce(i.unit_price, p.unit_price) as price_used, i.quantity / nullif(p.quantity, 0) as filled from invoices i left join purchase_orders p on i.po_number = p.po_number and i.po_line = p.po_line")
def each_level(d):
    f = F.col("each_factor")
    return invoice_lines(d).select("invoice_number", "po_line", (F.col("quantity") * f).alias("each_quantity"), (F.col("unit_price") / F.nullif(f, F.lit(0.0))).alias("each_price"), F.coalesce("unit_price", "po_price").alias("price_used"), (F.col("quantity") / F.nullif(F.col("po_quantity"), F.lit(0.0))).alias("filled"))


_NAMES_OF_GROUPS = sorted(C.PROCEDURE_GROUPS)
_RAW_GROUP = f"case when log_id % 70 < {len(_NAMES_OF_GROUPS)} then ' ' || list_extract({_NAMES_OF_GROUPS}, cast(log_id % 70 + 1 as int)) when log_id % 70 = 69 then ' ' when log_id % 70 = 68 then null else item_type end"


@query("PRJ-24", f"""with x as (select row_id, trim({_RAW_GROUP}) as g from consumption) select row_id, case when g is null or g = '' then '{C.UNGROUPED}'
    {' '.join(f"when g = '{k}' then '{v}'" for k, v in C.PROCEDURE_GROUPS.items())} else g end as procedure_group from x""")
def procedure_groups(d):
    n = F.col("log_id") % 70
    names = F.array(*map(F.lit, _NAMES_OF_GROUPS))
    raw = F.when(n < len(_NAMES_OF_GROUPS), F.concat(F.lit(" "), F.try_element_at(names, (n + 1).cast("int")))).when(n == 69, " ").when(n != 68, F.col("item_type"))
    return d.consumption.select("row_id", C.procedure_group(raw).alias("procedure_group"))


_ROUND = "floor({} * 100 + 0.501) / 100"
_EACH_SQL = f"""with r as (select i.po_number, i.po_line, nullif(i.uom, '') as uom, i.quantity, i.unit_price,
        case when i.factor > 0 then i.factor when upper(trim(i.uom)) = 'EA' then 1e0 when i.uom = p.uom and abs(i.unit_price - p.factor) <= 0.1e0 * p.factor and p.factor > 0 then p.factor else 1e0 end as f,
        case when i.factor > 0 then 'invoice_factor' else 'ea_factor_1' end as rule from invoices i left join purchase_orders p on i.po_number = p.po_number and i.po_line = p.po_line),
    a as (select po_number, po_line, max(uom) as uom, max(f) as f, max(rule) as rule, sum(quantity * f) as q, avg(unit_price / f) as mean, max(unit_price / f) filter (top) as last
        from (select *, unit_price = max(unit_price) over (partition by po_number, po_line) as top from r) group by 1, 2)
    select p.po_number, p.po_line, coalesce(a.uom, nullif(p.uom, ''), 'EA') as invoice_uom, coalesce(a.f, p.factor) as invoice_ea_factor, coalesce(a.rule, 'ea_factor_1') as invoice_ea_factor_rule,
        {_ROUND.format('coalesce(a.q, p.quantity * p.factor)')} as invoice_qty_total_ea, {_ROUND.format('coalesce(a.mean, p.unit_price / p.factor)')} as invoice_avg_unit_price_ea,
        {_ROUND.format('coalesce(a.last, p.unit_price / p.factor)')} as invoice_last_unit_price_ea, p.factor as po_ea_factor, 'ea_factor_1' as po_ea_factor_rule, {_ROUND.format('(p.unit_price / p.factor)')} as po_unit_price_ea,
        {_ROUND.format('(p.quantity * p.factor)')} as po_quantity_ea, {_ROUND.format('(k.price / p.factor)')} as contract_price_ea, {_ROUND.format('(k.price / p.factor)')} as current_contract_price_ea
    from purchase_orders p left join a on a.po_number = p.po_number and a.po_line = p.po_line left join (select item_id, vendor, min(price) as price from contracts group by 1, 2) k on k.item_id = p.item_id and k.vendor = p.vendor"""


@query("PRJ-27", _EACH_SQL)
def each_level_orders(d):
    """The twelve each-level columns of order lines. Orders take their contract's price first; then they and the invoices are shuffled once
    to their line, where an order meets its invoices in one row."""
    line = ["po_number", "po_line"]
    k = d.contracts.groupBy("item_id", "vendor").agg(F.min("price").alias("k_price"))
    p = d.purchase_orders.select(*line, "item_id", "vendor", "uom", "factor", "quantity", "unit_price").join(k, ["item_id", "vendor"], "left").drop("item_id", "vendor")
    p = p.withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    i = d.invoices.repartition(*line).groupBy(*line).agg(F.collect_list(F.struct("uom", "quantity", "unit_price", "factor")).alias("found"))
    near = lambda x: (x["uom"] == F.col("uom")) & (F.abs(x["unit_price"] - F.col("factor")) <= 0.1 * F.col("factor")) & (F.col("factor") > 0)
    f = lambda x: F.when(x["factor"] > 0, x["factor"]).when(F.upper(F.trim(x["uom"])) == "EA", 1.0).when(near(x), F.col("factor")).otherwise(1.0)
    rule = lambda x: F.when(x["factor"] > 0, "invoice_factor").otherwise("ea_factor_1")
    each = F.transform("found", lambda x: F.struct(F.nullif(x["uom"], F.lit("")).alias("uom"), f(x).alias("f"), rule(x).alias("rule"), x["quantity"].alias("quantity"), x["unit_price"].alias("unit_price")))
    every = lambda g: F.transform("each", g)
    total = lambda g: F.aggregate(F.filter(every(g), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    known = lambda g: F.size(F.filter(every(g), lambda x: x.isNotNull()))
    price, quantity = lambda x: x["unit_price"] / x["f"], lambda x: x["quantity"] * x["f"]
    rows = p.join(i, line, "left").withColumn("each", each).drop("found")
    rows = rows.withColumns({
        "i_uom": F.array_max(every(lambda x: x["uom"])), "i_f": F.array_max(every(lambda x: x["f"])), "i_rule": F.array_max(every(lambda x: x["rule"])), "i_q": F.when(known(quantity) > 0, total(quantity)),
        "i_sum": total(price), "i_n": known(price), "i_last": F.array_max(every(lambda x: F.struct(x["unit_price"].alias("unit_price"), price(x).alias("each")))),
    }).drop("each")
    own = W.partitionBy(*line)  # a line's orders are one, but if there are more they share their invoices
    rows = rows.withColumns({c: F.max(c).over(own) for c in ("i_uom", "i_f", "i_rule", "i_last")} | {c: F.sum(c).over(own) for c in ("i_q", "i_sum", "i_n")})
    rows = rows.withColumn("i_mean", F.when(F.col("i_n") > 0, F.col("i_sum") / F.col("i_n")))
    two = lambda c, name: (F.floor(c * 100 + 0.501) / 100.0).alias(name)
    price, quantity, contract = F.col("unit_price") / F.col("factor"), F.col("quantity") * F.col("factor"), F.col("k_price") / F.col("factor")
    return rows.select(
        *line, F.coalesce("i_uom", F.nullif("uom", F.lit("")), F.lit("EA")).alias("invoice_uom"), F.coalesce("i_f", "factor").alias("invoice_ea_factor"), F.coalesce("i_rule", F.lit("ea_factor_1")).alias("invoice_ea_factor_rule"),
        two(F.coalesce("i_q", quantity), "invoice_qty_total_ea"), two(F.coalesce("i_mean", price), "invoice_avg_unit_price_ea"), two(F.coalesce("i_last.each", price), "invoice_last_unit_price_ea"),
        F.col("factor").alias("po_ea_factor"), F.lit("ea_factor_1").alias("po_ea_factor_rule"), two(price, "po_unit_price_ea"), two(quantity, "po_quantity_ea"), two(contract, "contract_price_ea"), two(contract, "current_contract_price_ea"),
    )


@query("PRJ-28", "select alias, regexp_replace(trim(upper(alias)), '\\s+', ' ', 'g') as vendor_key from aliases")
def keys(d):
    return d.aliases.select("alias", C.vendor_key(F.col("alias")).alias("vendor_key"))


@query("PRJ-29", "select row_id, case when service_date is null then 'MISSING' when log_id % 5 = 0 then 'INVALID' else 'VALID' end as status, case when log_id % 5 <> 0 then service_date end as parsed from consumption")
def dates(d):
    us = F.date_format("service_date", "MM/dd/yyyy")
    raw = F.when(F.col("service_date").isNull(), "").when(F.col("log_id") % 5 == 0, "31.12.x").when(F.col("log_id") % 2 == 0, us).otherwise(F.col("service_date").cast("string"))
    return d.consumption.select("row_id", raw.alias("raw")).select("row_id", C.date_status(F.col("raw")).alias("status"), C.parse_date(F.col("raw")).alias("parsed"))


@query("PRJ-30", "select p_partkey, p_retailprice * 1000 // 1 as value from part")
def numbers(d):
    whole = F.floor(F.col("p_retailprice") * 1000)
    return d.part.select("p_partkey", C.parse_number(F.format_number(whole, 0)).alias("value"))


@query("PRJ-31")
def hashes(d):
    return d.consumption.select("row_id", F.xxhash64(*d.consumption.columns).alias("row_hash"))


@query("PRJ-32", "select row_id, trim(coalesce(item_id, '')) as item_key, regexp_replace(trim(upper(coalesce(vendor, ''))), '\\s+', ' ', 'g') as vendor_key, case when trim(item_id) = '' or trim(vendor) = '' then 'MISSING_MAPPING_KEY' when service_date is null then 'INVALID_CONSUMPTION_DATE' else 'ELIGIBLE' end as status from consumption")
def base(d):
    item, vendor = C.item_key(F.col("item_id")), C.vendor_key(F.col("vendor"))
    return d.consumption.select("row_id", item.alias("item_key"), vendor.alias("vendor_key"), F.when((item == "") | (vendor == ""), "MISSING_MAPPING_KEY").when(F.col("service_date").isNull(), "INVALID_CONSUMPTION_DATE").otherwise("ELIGIBLE").alias("status"))


@query("PRJ-33", f"with {_LINES} select row_id, case when price is null or price = 0 then 'NOT_COMPARABLE' when (unit_price - price) / price * 100 > 10 then 'ABOVE_10_PERCENT' else 'WITHIN' end as flag from lines")
def compared(d):
    return lines(d).select("row_id", P.comparison_flag(F.col("unit_price"), F.col("price"), 10.0).alias("flag"))


@query("PRJ-34", f"select row_id, concat_ws('; ', {', '.join(f'''case when {x} then '{n}' end''' for n, x in _ERRORS.items())}) as reasons from consumption")
def reasons(d):
    return d.consumption.select("row_id", F.concat_ws("; ", *(F.when(F.expr(x), n) for n, x in _ERRORS.items())).alias("reasons"))


@query("PRJ-35", "select contract_number, item_id, vendor, price, case when starts > date '2000-01-01' then 'FUTURE' when ends is null then 'OPEN' when ends < date '2000-01-01' then 'EXPIRED' else 'CURRENT' end as label, case when ends is null then 'open ended from ' || strftime(starts, '%Y-%m-%d') else 'ends ' || strftime(ends, '%Y-%m-%d') end as reason from contracts")
def labels(d):
    at = F.lit("2000-01-01").cast("date")
    label = F.when(F.col("starts") > at, "FUTURE").when(F.col("ends").isNull(), "OPEN").when(F.col("ends") < at, "EXPIRED").otherwise("CURRENT")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return d.contracts.select("contract_number", "item_id", "vendor", "price", label.alias("label"), F.when(F.col("ends").isNull(), F.concat(F.lit("open ended from "), day("starts"))).otherwise(F.concat(F.lit("ends "), day("ends"))).alias("reason"))


@query("PRJ-36", "select contract_number, item_id, vendor, price, nullif(regexp_extract(category, '^(\\d{6,8})', 1), '') as code, trim(regexp_replace(category, '^\\d{6,8}\\s*-?\\s*', '')) as label from contracts")
def categories(d):
    return d.contracts.select("contract_number", "item_id", "vendor", "price", C.category_code(F.col("category")).alias("code"), C.category_text(F.col("category")).alias("label"))


@query("FLT-01", "select contract_number, item_id, vendor, price from contracts where trim(contract_number) is not null and item_id <> '' and price is not null")
def required(d):
    return d.contracts.where("trim(contract_number) is not null and item_id <> '' and price is not null").select("contract_number", "item_id", "vendor", "price")


@query("FLT-02", "select contract_number, item_id, vendor, starts, ends, price from contracts where ends is null or ends >= starts")
def ordered(d):
    return d.contracts.where("ends is null or ends >= starts").select("contract_number", "item_id", "vendor", "starts", "ends", "price")


@query("FLT-03", "select row_id from consumption where upper(trim(item_id)) not in ('', 'N/A', 'NA', 'NULL', 'NONE')")
def keyed(d):
    return d.consumption.where(~F.upper(F.trim("item_id")).isin("", "N/A", "NA", "NULL", "NONE")).select("row_id")


@query("FLT-04", "select item_id, description from item_master where item_id ilike '%11%' or description ilike '%11%' or manufacturer ilike '%11%'")
def searched(d):
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).cast("string").ilike("%11%"), F.lit(False)) for c in ("item_id", "description", "manufacturer")))
    return d.item_master.where(hit).select("item_id", "description")


@query("FLT-05", "select row_id from consumption where facility = '1-URGENT' and patient_type = 'F' and quantity > 0")
def filtered(d):
    return d.consumption.where((F.col("facility") == "1-URGENT") & (F.col("patient_type") == "F") & (F.col("quantity") > 0)).select("row_id")


@query("FLT-06", f"with {_LINES} select row_id from lines where contract_number is null or unit_price > price * 3")
def exceptions(d):
    return lines(d).where(F.col("contract_number").isNull() | (F.col("unit_price") > F.col("price") * 3)).select("row_id")


@query("FLT-07", "select 'negative_quantity' as rule, count(*) as rows from consumption where quantity < 0 union all select 'no_item', count(*) from consumption where item_id = '' union all select 'spike', count(*) from consumption where unit_price > 10 * client_contract_price")
def asserted(d):
    rules = {"negative_quantity": "quantity < 0", "no_item": "item_id = ''", "spike": "unit_price > 10 * client_contract_price"}
    one = d.consumption.agg(*(F.count_if(F.expr(x)).alias(n) for n, x in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules))).alias("x")).select("x.*")
