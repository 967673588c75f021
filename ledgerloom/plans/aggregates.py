"""Aggregation and mart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import cents
from ..operators import windows as O
from ..operators.quality import differs, several
from .projections import _LINES, _VARIANCE, invoice_lines, lines
from .registry import query

R = "floor(({0}) * 100 + 501e-3) / 100e0"


def r(x: str) -> str:
    return R.format(x)


_SUMS = f"{r('sum(unit_price * quantity)')} as spend, count(*) as lines, min(quantity) as least, max(quantity) as most"


@query("AGG-01", f"select facility, {_SUMS} from consumption group by 1")
def sums(d):
    return d.consumption.groupBy("facility").agg(cents(F.sum(F.col("unit_price") * F.col("quantity"))).alias("spend"), F.count("*").alias("lines"), F.min("quantity").alias("least"), F.max("quantity").alias("most"))


@query("AGG-02", "select facility, count(distinct item_id) as items, count(distinct log_id) as logs from consumption group by 1")
def distinct(d):
    return d.consumption.groupBy("facility").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("log_id").alias("logs"))


@query("AGG-03", f"select vendor, count(*) filter (item_id = '') as unmapped, {r('sum(case when quantity < 0 then unit_price * quantity else 0 end)')} as returned from consumption group by 1")
def conditional(d):
    back = F.when(F.col("quantity") < 0, F.col("unit_price") * F.col("quantity")).otherwise(0.0)
    return d.consumption.groupBy("vendor").agg(F.count_if(F.col("item_id") == "").alias("unmapped"), cents(F.sum(back)).alias("returned"))


@query("AGG-04", "select vendor, count(*) filter (item_id <> '') * 1e0 / nullif(count(*), 0) as match_rate from consumption group by 1")
def ratio(d):
    return d.consumption.groupBy("vendor").agg((F.count_if(F.col("item_id") != "") * F.lit(1.0) / F.nullif(F.count("*"), F.lit(0))).alias("match_rate"))


@query("AGG-05", "select vendor, manufacturer as top_manufacturer from (select vendor, manufacturer, row_number() over (partition by vendor order by count(*) desc, manufacturer) as n from consumption group by 1, 2) where n = 1")
def mode(d):
    return O.mode(d.consumption, ["vendor"], "manufacturer", "top_manufacturer")


@query("AGG-06", "select po_number, arg_max(invoice_number, {'paid': paid, 'n': invoice_number}) as last_invoice from invoices group by 1")
def arg_max(d):
    return d.invoices.where("invoice_number is not null").groupBy("po_number").agg(F.max_by("invoice_number", F.struct("paid", "invoice_number")).alias("last_invoice"))


@query("AGG-07", f"select vendor, max(nullif(item_id, '')) as last_item, {r('avg(unit_price / nullif(client_contract_price, 0))')} as price_ratio from consumption group by 1")
def nullifs(d):
    return d.consumption.groupBy("vendor").agg(F.max(F.nullif("item_id", F.lit(""))).alias("last_item"), cents(F.avg(F.col("unit_price") / F.nullif("client_contract_price", F.lit(0.0)))).alias("price_ratio"))


@query("AGG-08", f"select manufacturer, {r('median(unit_price)')} as middle, {r('avg(unit_price)')} as mean, {r('min(unit_price)')} as least, {r('max(unit_price)')} as most from consumption group by 1")
def median(d):
    x = "unit_price"
    return d.consumption.groupBy("manufacturer").agg(cents(F.median(x)).alias("middle"), cents(F.avg(x)).alias("mean"), cents(F.min(x)).alias("least"), cents(F.max(x)).alias("most"))


@query("AGG-09", f"select manufacturer, {r('quantile_cont(unit_price, 25e-2)')} as q1, {r('quantile_cont(unit_price, 5e-1)')} as q2, {r('quantile_cont(unit_price, 75e-2)')} as q3 from consumption group by 1")
def quartiles(d):
    q = d.consumption.groupBy("manufacturer").agg(F.percentile("unit_price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("manufacturer", *(cents(F.col("q")[i]).alias(f"q{i + 1}") for i in range(3)))


@query("AGG-10", f"select count(*) as lines, count(distinct log_id) as logs, {r('sum(unit_price * quantity)')} as spend, count(*) filter (item_id <> '') as mapped from consumption")
def kpis(d):
    return d.consumption.agg(F.count("*").alias("lines"), F.count_distinct("log_id").alias("logs"), cents(F.sum(F.col("unit_price") * F.col("quantity"))).alias("spend"), F.count_if(F.col("item_id") != "").alias("mapped"))


@query("AGG-11", f"select service_line, {r('avg(unit_price / nullif(client_contract_price, 0))')} as ratio, {r('sum(unit_price * quantity)')} as spend from consumption group by 1")
def ratios(d):
    return d.consumption.groupBy("service_line").agg(cents(F.avg(F.col("unit_price") / F.nullif("client_contract_price", F.lit(0.0)))).alias("ratio"), cents(F.sum(F.col("unit_price") * F.col("quantity"))).alias("spend"))


@query("AGG-12", "select service_date, count(*) as lines from consumption where service_date is not null group by 1")
def daily(d):
    return d.consumption.where("service_date is not null").groupBy("service_date").agg(F.count("*").alias("lines"))


@query("AGG-13", "select facility, date_diff('day', min(service_date), max(service_date)) + 1 - count(distinct service_date) as gap_days from consumption group by 1")
def gaps(d):
    return d.consumption.groupBy("facility").agg((F.datediff(F.max("service_date"), F.min("service_date")) + 1 - F.count_distinct("service_date")).alias("gap_days"))


@query("AGG-14", f"select vendor, count(*) as lines, {r('sum(quantity)')} as quantity from consumption group by 1")
def partial(d):
    return d.consumption.groupBy("vendor").agg(F.count("*").alias("lines"), cents(F.sum("quantity")).alias("quantity"))


@query("AGG-15", "select unspsc, count(*) as items from item_master group by 1")
def null_group(d):
    return d.item_master.groupBy("unspsc").agg(F.count("*").alias("items"))


@query("AGG-16", "with v as (select distinct item_id, vendor from contracts), n as (select *, row_number() over (partition by item_id order by vendor) as n, count(*) over (partition by item_id) as k from v) select item_id, string_agg(vendor, '|' order by vendor) filter (n <= 3) || case when max(k) > 3 then ' ...' else '' end as vendors from n group by 1")
def joined(d):
    every = F.sort_array(F.collect_set("vendor"))
    out = d.contracts.groupBy("item_id").agg(every.alias("v"))
    return out.select("item_id", F.concat(F.array_join(F.slice("v", 1, 3), "|"), F.when(F.size("v") > 3, " ...").otherwise("")).alias("vendors"))


@query("AGG-17", "select item_id, string_agg(contract_number || '@' || vendor, '; ' order by contract_number, vendor, starts) as candidates from contracts where price is not null group by 1")
def ordered_text(d):
    rows = F.sort_array(F.collect_list(F.struct("contract_number", "vendor", "starts")))
    out = d.contracts.where("price is not null").groupBy("item_id").agg(rows.alias("x"))
    return out.select("item_id", F.array_join(F.transform("x", lambda s: F.concat(s["contract_number"], F.lit("@"), s["vendor"])), "; ").alias("candidates"))


@query("AGG-18", "select item_id, count(distinct coalesce(round(each_price, 6), -round(price, 6))) as prices from contracts where price is not null group by 1")
def price_keys(d):
    return d.contracts.where("price is not null").groupBy("item_id").agg(F.count_distinct(F.coalesce(F.round("each_price", 6), -F.round("price", 6))).alias("prices"))


@query("AGG-19", "select item_id, first(contract_number order by starts, contract_number) as first_contract, first(contract_number order by starts desc, contract_number desc) as last_contract from contracts group by 1")
def first_last(d):
    key = F.struct("starts", "contract_number")
    return d.contracts.groupBy("item_id").agg(F.min_by("contract_number", key).alias("first_contract"), F.max_by("contract_number", key).alias("last_contract"))


@query("AGG-20", "select vendor, item_id, n from (select vendor, item_id, count(*) as n from consumption where item_id <> '' group by 1, 2) qualify row_number() over (partition by vendor order by n desc, item_id) = 1")
def most_frequent(d):
    c = d.consumption.where("item_id <> ''").groupBy("vendor", "item_id").agg(F.count("*").alias("n"))
    return O.pick(c, ["vendor"], [F.desc("n"), F.col("item_id")])


@query("AGG-21", f"select facility, {', '.join(r(f'''sum(case when patient_type = '{x}' then quantity else 0 end)''') + f' as {x}' for x in 'FOP')} from consumption group by 1")
def pivot(d):
    out = d.consumption.groupBy("facility").pivot("patient_type", ["F", "O", "P"]).sum("quantity").na.fill(0.0)
    return out.select("facility", *(cents(F.col(x)).alias(x) for x in "FOP"))


_V = f"v as (select l.*, c.*, {_VARIANCE} as variance from lines l join (select row_id as id, vendor, service_date, item_id, facility, manufacturer, patient_type, description from consumption) c on l.row_id = c.id)"


def detailed(d):
    return lines(d, "service_date", "facility", "manufacturer", "patient_type", "description")


@query("AGG-22-LINES", f"with {_LINES}, {_V} select vendor, strftime(service_date, '%Y-%m') as month, count(*) as lines, count(*) filter (item_id <> '') as eligible, count(contract_number) as matched, {r('sum(spend)')} as spend, {r('sum(variance)')} as variance, count(contract_number) filter (item_id <> '') * 1e0 / nullif(count(*) filter (item_id <> ''), 0) as match_rate from v group by 1, 2")
def summary(d):
    ok = F.col("item_id") != ""
    return detailed(d).groupBy("vendor", F.date_format("service_date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("lines"), F.count_if(ok).alias("eligible"), F.count("contract_number").alias("matched"), cents(F.sum("spend")).alias("spend"), cents(F.sum("variance")).alias("variance"),
        (F.count(F.when(ok, F.col("contract_number"))) * F.lit(1.0) / F.nullif(F.count_if(ok), F.lit(0))).alias("match_rate"),
    )


@query("AGG-23-LINES", f"with {_LINES} select count(*) as lines, count(contract_number) as matched, count(*) - count(contract_number) as unmatched, {r('sum(spend)')} as spend, count(*) = count(contract_number) + count(*) filter (contract_number is null) as reconciles from lines")
def kpi_row(d):
    n, m = F.count("*"), F.count("contract_number")
    return lines(d).agg(n.alias("lines"), m.alias("matched"), (n - m).alias("unmatched"), cents(F.sum("spend")).alias("spend"), (n == m + F.count_if(F.col("contract_number").isNull())).alias("reconciles"))


_PROFILE = {"rows": "count(*)", "contracts": "count(distinct contract_number)", "items": "count(distinct item_id)", "vendors": "count(distinct vendor)", "no_price": "count(case when price is null then 1 end)", "open_ended": "count(case when ends is null then 1 end)", "backwards": "count(case when ends < starts then 1 end)", "boxes": "count(case when uom = 'BX' then 1 end)"}


@query("AGG-24-BASIC", f"select unnest([{', '.join(f'''{{'metric': '{k}', 'value': {v}}}''' for k, v in _PROFILE.items())}], recursive := true) from contracts")
def contract_profile(d):
    one = d.contracts.agg(*(F.expr(v).alias(k) for k, v in _PROFILE.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in _PROFILE))).alias("x")).select("x.*")


@query("AGG-25-BASIC", "select count(*) as rows, count(*) filter (item_id = '') as no_item, count(*) filter (trim(vendor) = '') as no_vendor, count(*) filter (service_date is null) as no_date, count(*) filter (client_contract_price is null) as no_client_price, count(distinct uom) as units from consumption")
def consumption_profile(d):
    n = lambda x: F.count_if(F.expr(x))
    return d.consumption.agg(F.count("*").alias("rows"), n("item_id = ''").alias("no_item"), n("trim(vendor) = ''").alias("no_vendor"), n("service_date is null").alias("no_date"), n("client_contract_price is null").alias("no_client_price"), F.count_distinct("uom").alias("units"))


_SCENARIO = "case when n = 1 then 'A_SINGLE' when numbers > 1 and prices > 1 then 'B_CONTRACTS_AND_PRICES' when numbers > 1 then 'C_CONTRACTS' when prices > 1 then 'D_PRICES' when starts > 1 then 'E_STARTS' else 'F_COPIES' end"


@query("AGG-26-SHAPES", f"with g as (select vendor, item_id, count(*) as n, count(distinct contract_number) as numbers, count(distinct price) as prices, count(distinct starts) as starts from contracts group by 1, 2) select {_SCENARIO} as scenario, count(*) as combos from g group by 1")
def scenarios(d):
    """Only whether a key has several values counts, so its least and greatest one do: no row is copied for each distinct count."""
    counts = [F.when(differs(c), 2).otherwise(1).alias(n) for n, c in (("numbers", "contract_number"), ("prices", "price"), ("starts", "starts"))]
    g = d.contracts.groupBy("vendor", "item_id").agg(F.count("*").alias("n"), *several("contract_number"), *several("price"), *several("starts")).select("n", *counts)
    return g.groupBy(F.expr(_SCENARIO).alias("scenario")).agg(F.count("*").alias("combos"))


_RULES = {"latest_start": "starts desc", "earliest_start": "starts", "latest_end": "ends desc nulls last", "lowest_price": "price", "highest_price": "price desc", "least_number": "contract_number"}


@query("AGG-27", " union all ".join(f"select '{k}' as rule, {r('avg(case when abs(price - p) <= p * 3e-1 then 1e0 else 0e0 end)')} as hit_rate from (select c.price, m.price as p from contracts c join item_master m on c.item_id = m.item_id where c.price is not null qualify row_number() over (partition by c.item_id order by {'c.' + v}, c.contract_number, c.vendor, c.starts, c.price) = 1)" for k, v in _RULES.items()))
def rules(d):
    """One pass: the row that each rule takes of an item's contracts, by grouped minima, then an average for each rule."""
    both = d.contracts.where("price is not null").join(d.item_master.select("item_id", F.col("price").alias("p")), "item_id")
    first = {}
    for name, order in _RULES.items():
        column = order.split()[0]
        c = F.unix_date(column) if column in ("starts", "ends") else F.col(column)
        lead = [c.isNull().alias("none"), (-c if "desc" in order else c).alias("lead")]
        first[name] = F.min_by("price", F.struct(*lead, "contract_number", "vendor", "starts", F.col("price").alias("own"))).alias(name)
    chosen = both.groupBy("item_id").agg(F.first("p").alias("p"), *first.values())  # an item has one p
    near = lambda c: F.avg(F.when(F.abs(F.col(c) - F.col("p")) <= F.col("p") * 0.3, 1.0).otherwise(0.0))
    one = chosen.agg(*(cents(near(n)).alias(n) for n in _RULES))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("hit_rate")) for n in _RULES))).alias("x")).select("x.*")


def _columns(sql: str, names: list[str]) -> str:
    return " union all ".join(sql.format(n) for n in names)


_ITEM_COLUMNS = ["item_id", "description", "manufacturer", "unspsc", "vendor_part"]


@query("AGG-28", _columns("select '{0}' as column_name, count(*) as rows, count(*) - count({0}) as nulls, count(distinct {0}) as distinct_values from item_master", _ITEM_COLUMNS))
def profile(d):
    from ..operators.profile import column_profile

    return column_profile(d.item_master, _ITEM_COLUMNS)


@query("AGG-29", _columns("select '{0}' as column_name, (select count(*) filter ({0} is null) * 100e0 / count(*) from before) as before_null, (select count(*) filter ({0} is null) * 100e0 / count(*) from after) as after_null", ["description", "price", "manufacturer"]))
def null_drift(d):
    from ..operators.profile import null_drift

    return null_drift(d.before, d.after, ["description", "price", "manufacturer"])


@query("AGG-30", _columns("select '{0}' as column_name, count(*) filter (b.{0} is distinct from a.{0}) as modified from before b join after a on b.item_id = a.item_id", ["description", "price", "manufacturer"]))
def modified(d):
    from ..operators.profile import modified_fields

    return modified_fields(d.before, d.after, "item_id", ["description", "price", "manufacturer"])


@query("AGG-31", f"select {r('b.m')} as before_mean, {r('a.m')} as after_mean, {r('b.q')} as before_median, {r('a.q')} as after_median, abs(a.m - b.m) / nullif(abs(b.m), 0) * 100 > 15 as alert from (select avg(price) as m, median(price) as q from before) b, (select avg(price) as m, median(price) as q from after) a")
def number_drift(d):
    from ..operators.profile import number_drift

    return number_drift(d.before, d.after, "price", 15.0)


@query("AGG-32", f"with {_LINES} select case when contract_number is null then 'OFF_CONTRACT' when price is null then 'NO_PRICE' else 'ON_CONTRACT' end as gap_code, count(*) as lines, {r('sum(spend)')} as spend from lines group by 1")
def gap_codes(d):
    code = F.when(F.col("contract_number").isNull(), "OFF_CONTRACT").when(F.col("price").isNull(), "NO_PRICE").otherwise("ON_CONTRACT")
    return lines(d).groupBy(code.alias("gap_code")).agg(F.count("*").alias("lines"), cents(F.sum("spend")).alias("spend"))


@query("AGG-33", "select action, status, count(*) as events, count(distinct user_id) as users from logs group by 1, 2")
def log_metrics(d):
    return d.logs.groupBy("action", "status").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


@query("AGG-34-TOTALS", f"with x as (select count(*) as n, sum(total_value) as v from purchase_orders), y as (select count(*) as n, sum(unit_price * quantity) as v from purchase_orders) select {r('x.v')} as left_value, {r('y.v')} as right_value, x.n = y.n and abs(x.v - y.v) <= abs(x.v) * 1e-6 as equal from x, y")
def parity(d):
    p = d.purchase_orders
    both = p.agg(F.count("*").alias("n"), F.sum("total_value").alias("v"), F.sum(F.col("unit_price") * F.col("quantity")).alias("w"))
    return both.select(cents(F.col("v")).alias("left_value"), cents(F.col("w")).alias("right_value"), (F.abs(F.col("v") - F.col("w")) <= F.abs("v") * 1e-6).alias("equal"))


_MART = f"count(*) as lines, {r('sum(spend)')} as spend, {r('sum(case when contract_number is not null then spend else 0 end)')} as on_contract_spend, {r('sum(greatest(variance, 0e0))')} as overpayment, {r('sum(case when contract_number is not null then greatest(variance, 0e0) else spend * 15e-2 end)')} as savings, count(distinct item_id) as items"


def mart(df, *keys):
    on = F.col("contract_number").isNotNull()
    over = F.greatest(F.col("variance"), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("lines"), cents(F.sum("spend")).alias("spend"), cents(F.sum(F.when(on, F.col("spend")).otherwise(0.0))).alias("on_contract_spend"),
        cents(F.sum(over)).alias("overpayment"), cents(F.sum(F.when(on, over).otherwise(F.col("spend") * 0.15))).alias("savings"), F.count_distinct("item_id").alias("items"),
    )




@query("MART-GAP", f"with {_LINES}, {_V} select facility, patient_type, {_MART} from v group by 1, 2")
def gap_mart(d):
    return mart(detailed(d), "facility", "patient_type")


@query("MART-CONSUMPTION", f"with {_LINES}, {_V} select manufacturer, vendor, {_MART} from v group by 1, 2")
def consumption_mart(d):
    return mart(detailed(d), "manufacturer", "vendor")


_INV = "case when i.factor > 0 then i.factor when upper(trim(i.uom)) in ('EA', 'EACH') then 1e0 when p.factor > 0 then p.factor else 1e0 end"


@query("MART-PO", f"with x as (select p.facility, p.vendor, p.total_value, i.quantity * i.unit_price as invoiced, i.quantity * {_INV} as each_quantity, i.invoice_number from purchase_orders p left join invoices i on p.po_number = i.po_number and p.po_line = i.po_line) select facility, vendor, count(*) as lines, {r('sum(total_value)')} as ordered, {r('coalesce(sum(invoiced), 0)')} as invoiced, {r('coalesce(sum(each_quantity), 0)')} as each_quantity, count(invoice_number) as invoices from x group by 1, 2")
def po_mart(d):
    i = invoice_lines(d).select("po_number", "po_line", (F.col("quantity") * F.col("unit_price")).alias("invoiced"), (F.col("quantity") * F.col("each_factor")).alias("each_quantity"), "invoice_number")
    p = d.purchase_orders.select("po_number", "po_line", "facility", "vendor", "total_value").join(i, ["po_number", "po_line"], "left")
    zero = F.lit(0.0)
    return p.groupBy("facility", "vendor").agg(F.count("*").alias("lines"), cents(F.sum("total_value")).alias("ordered"), cents(F.coalesce(F.sum("invoiced"), zero)).alias("invoiced"), cents(F.coalesce(F.sum("each_quantity"), zero)).alias("each_quantity"), F.count("invoice_number").alias("invoices"))


@query("MART-TENANT", f"with {_LINES}, {_V} select 'T1' as tenant, 'T1|' || facility as tenant_key, {_MART} from v group by facility")
def tenant_mart(d):
    return mart(detailed(d).withColumns({"tenant": F.lit("T1"), "tenant_key": F.concat_ws("|", F.lit("T1"), "facility")}), "tenant", "tenant_key")
