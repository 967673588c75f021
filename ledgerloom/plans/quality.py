"""Data-quality profiles of contracts and usage, and scenarios of ambiguity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from .registry import query

_DATE = "cast(coalesce(try_strptime(substr({0}, 1, 10), '%Y-%m-%d'), try_strptime({0}, '%m/%d/%Y')) as date)"
_STATE = "case when {0} is null or trim({0}) = '' then 'MISSING' when " + _DATE + " is null then 'INVALID' else 'VALID' end"
_KEY = "regexp_replace(trim(upper(coalesce(vendor, ''))), '\\s+', ' ', 'g')"
_CLEAN = f"""c as (select regexp_replace({_KEY}, ' INC$', '') as vendor, {_KEY} as spelling, trim(coalesce(item_id, '')) as item_id, contract_number, upper(trim(coalesce(uom, ''))) as uom, price, each_price,
        {_DATE.format('start_text')} as starts, {_STATE.format('start_text')} as start_status, {_DATE.format('end_text')} as ends, {_STATE.format('end_text')} as end_status,
        upper(trim(coalesce(tier, ''))) as tier, trim(coalesce(category, '')) as category, trim(coalesce(vendor_code, '')) as vendor_code from raw_contracts),
    r as (select distinct vendor, item_id, contract_number, starts, ends, uom, price, each_price, tier from c), d as (select * from r where vendor <> '' and item_id <> ''),
    s as (select *, starts <= max(coalesce(ends, date '2999-12-31')) over (partition by vendor, item_id order by starts, ends nulls last, contract_number, uom, price nulls first, each_price nulls first, tier rows between unbounded preceding and 1 preceding) as hit from d where starts is not null)"""


def _several(by: str, what: str, of: str = "d") -> str:
    return f"(select count(*) from (select 1 from {of} group by {by} having count(distinct {what}) > 1))"


_MEASURES = {
    "raw_records": "(select count(*) from c)", "exact_duplicates": "(select count(*) from c) - (select count(*) from r)", "usable_records": "(select count(*) from d)",
    "missing_vendor_or_item": "(select count(*) from c where vendor = '' or item_id = '')",
    "missing_start": "(select count(*) from c where start_status = 'MISSING')", "invalid_start": "(select count(*) from c where start_status = 'INVALID')",
    "missing_end": "(select count(*) from c where end_status = 'MISSING')", "invalid_end": "(select count(*) from c where end_status = 'INVALID')",
    "start_before_2000": "(select count(*) from c where year(starts) < 2000)", "end_before_start": "(select count(*) from d where ends < starts)",
    "missing_price": "(select count(*) from c where price is null)", "missing_each_price": "(select count(*) from c where each_price is null)",
    "missing_category": "(select count(*) from c where category = '')", "items_with_several_categories": _several("item_id", "category", "(select * from c where vendor <> '' and item_id <> '' and category <> '')"),
    "missing_tier": "(select count(*) from c where tier = '')", "distinct_tiers": "(select count(distinct tier) from c)", "missing_vendor_code": "(select count(*) from c where vendor_code = '')",
    "spellings_with_several_codes": _several("spelling", "vendor_code", "(select * from c where vendor_code <> '')"), "codes_with_several_spellings": _several("vendor_code", "spelling", "(select * from c where vendor_code <> '')"),
    "distinct_spellings": "(select count(distinct spelling) from c)", "standard_vendors": "(select count(distinct vendor) from d)", "vendor_item_keys": "(select count(distinct (vendor, item_id)) from d)",
    "items": "(select count(distinct item_id) from d)", "items_with_several_contracts": _several("item_id", "contract_number"), "keys_with_several_contracts": _several("vendor, item_id", "contract_number"),
    "keys_with_several_prices": _several("vendor, item_id", "price"), "keys_with_several_each_prices": _several("vendor, item_id", "each_price"), "keys_with_several_units": _several("vendor, item_id", "uom"),
    "key_units_with_several_prices": _several("vendor, item_id, uom", "price"), "overlapping_records": "(select count(*) from s where hit)", "keys_with_overlaps": "(select count(distinct (vendor, item_id)) from s where hit)",
}


@query("AGG-24", f"with {_CLEAN} " + " union all ".join(f"select '{k}' as metric, cast({v} as bigint) as value" for k, v in _MEASURES.items()))
def contracts(d):
    return Q.contract_profile(Q.clean_contracts(d.raw_contracts, F.regexp_replace("spelling", " INC$", "")))


_ALIASES = """al as (select distinct vendor as name, case when vendor in ('V7', 'V8') then 'V6' else vendor end as standard, case when vendor = 'V9' then 'NO_MATCH' when vendor in ('V7', 'V8') then 'ITEM_OVERLAP' else 'EXACT' end as method,
    case when vendor in ('V7', 'V8', 'V9') then 'Y' else 'N' end as needs_review from contracts)"""
_DAY = "case when log_id % 43 = 0 then 'n/a' when log_id % 47 = 0 then '' else cast(service_date as varchar) end"
_ITEM = "case when log_id % 6 = 0 then '00' || item_id when log_id % 6 = 1 then 'X' || item_id else item_id end"
_U = f"""{_ALIASES}, u0 as (select {_KEY} as spelling, trim(coalesce({_ITEM}, '')) as item_id, {_DAY} as day, case when log_id % 53 = 0 then -unit_price when log_id % 59 = 0 then null else unit_price end as price from consumption),
    u as (select u0.*, coalesce(al.standard, spelling) as vendor, {_STATE.format('day')} as state from u0 left join al on al.name = spelling),
    i as (select item_id, count(*) as n, min(nullif(trim(unspsc), '')) as a, max(nullif(trim(unspsc), '')) as b from (select item_id, unspsc from item_master union all select item_id, '49999999' from item_master where cast(item_id as int) % 21 = 0) group by 1)"""
_USAGE = {
    "rows": "count(*)", "blank_item": "count(*) filter (item_id = '')", "blank_vendor": "count(*) filter (spelling = '')", "blank_day": "count(*) filter (state = 'MISSING')", "invalid_day": "count(*) filter (state = 'INVALID')",
    "blank_price": "count(*) filter (price is null)", "price_not_positive": "count(*) filter (price <= 0)", "item_not_numeric": "count(*) filter (item_id <> '' and not regexp_full_match(item_id, '\\d+'))",
    "item_with_leading_zero": "count(*) filter (item_id like '0_%')", "items": "count(distinct nullif(item_id, ''))", "vendor_item_keys": "count(distinct (vendor, item_id)) filter (vendor <> '' and item_id <> '')",
    "spellings": "count(distinct nullif(spelling, ''))", "standard_vendors": "count(distinct nullif(vendor, ''))",
}
_ITEMS = {"rows": "sum(n)", "items": "count(*)", "several_classes": "count(*) filter (a <> b)", "without_class": "count(*) filter (a is null)", "duplicate_rows": "sum(n - 1)"}
_NAMES = {"spellings": "count(*)", "renamed": "count(*) filter (name <> standard)", "needs_review": "count(*) filter (needs_review = 'Y')", "no_match": "count(*) filter (method = 'NO_MATCH')"}
_ROWS = [f"select '{k}' as dataset, '{m}' as metric, cast({v} as bigint) as value from {t}" for k, t, x in (("usage", "u", _USAGE), ("items", "i", _ITEMS), ("aliases", "al", _NAMES)) for m, v in x.items()]


@query("AGG-25", f"with {_U} " + " union all ".join(_ROWS))
def usage(d):
    n, name = F.col("log_id"), F.col("vendor")
    item = F.when(n % 6 == 0, F.concat(F.lit("00"), "item_id")).when(n % 6 == 1, F.concat(F.lit("X"), "item_id")).otherwise(F.col("item_id"))
    day = F.when(n % 43 == 0, "n/a").when(n % 47 == 0, "").otherwise(F.col("service_date").cast("string"))
    price = F.when(n % 53 == 0, -F.col("unit_price")).when(n % 59 != 0, F.col("unit_price"))
    moved = name.isin("V7", "V8")
    aliases = d.contracts.select(name.alias("name"), F.when(moved, "V6").otherwise(name).alias("standard"), F.when(name == "V9", "NO_MATCH").when(moved, "ITEM_OVERLAP").otherwise("EXACT").alias("method"), F.when(moved | (name == "V9"), "Y").otherwise("N").alias("needs_review")).distinct()
    items = d.item_master.select("item_id", "unspsc")
    items = items.unionAll(items.where(F.col("item_id").cast("int") % 21 == 0).withColumn("unspsc", F.lit("49999999")))
    return Q.usage_profile(d.consumption.select("vendor", item.alias("item_id"), day.alias("day"), price.alias("price")), items, aliases)


_TIED = """k as (select distinct vendor, item_id, contract_number, starts, ends, uom, price, each_price, case when contract_number like '%B' then 'T2' when cast(item_id as int) % 2 = 0 then 'T1' else '' end as tier from contracts),
    a as (select vendor, item_id, service_date as day, count(*) as lines, min(uom) as unit from consumption group by 1, 2, 3),
    l as (select a.*, k.* exclude (vendor, item_id) from a join k using (vendor, item_id) where starts <= day and (ends is null or ends >= day)),
    t as (select *, round(each_price, 6) as ea, concat_ws('|', round(price, 6), coalesce(cast(round(each_price, 6) as varchar), ''), uom) as pack, case upper(trim(unit)) when 'EACH' then 'EA' when 'CASE' then 'CA' when 'BOX' then 'BX' else '?' end = uom as fits
        from (select *, max(starts) over (partition by vendor, item_id, day) as latest from l) where starts = latest and price is not null),
    x as (select vendor, item_id, day, tier, count(distinct ea) as n from t group by 1, 2, 3, 4), y as (select vendor, item_id, day, max(n) as n from x group by 1, 2, 3),
    g as (select t.vendor, t.item_id, t.day, max(lines) as lines, count(distinct ea) as eas, count(distinct tier) as tiers, count(distinct pack) filter (fits) as fit, count(distinct contract_number) as numbers, count(distinct coalesce(ends, date '2999-12-31')) as ends,
        max(y.n) as per_tier from t join y on y.vendor = t.vendor and y.item_id = t.item_id and y.day = t.day group by 1, 2, 3 having count(distinct pack) > 1)"""
_CASES = {"A": "true", "B": "eas = 1", "C": "eas <> 1 and fit = 1", "D": "eas <> 1 and tiers > 1 and per_tier = 1", "E": "eas <> 1 and per_tier > 1", "F": "eas <> 1"}


def _tied(d):
    tier = F.when(F.col("contract_number").endswith("B"), "T2").when(F.col("item_id").cast("int") % 2 == 0, "T1").otherwise("")
    return Q.ambiguity(d.consumption.select("vendor", "item_id", F.col("service_date").alias("day"), F.col("uom").alias("unit")), d.contracts.select("vendor", "item_id", "contract_number", "starts", "ends", "uom", "price", "each_price", tier.alias("tier")))


@query("AGG-26", f"with {_TIED} " + " union all ".join(f"select '{k}' as scenario, cast(coalesce(sum(lines) filter ({v}), 0) as bigint) as lines, count(*) filter ({v}) as combos, cast(floor(coalesce(sum(lines) filter ({v}) * 1e4 / sum(lines), 0) + 0.501) as bigint) as basis_points from g" for k, v in _CASES.items()))
def scenarios(d):
    return _tied(d)[0]


@query("AGG-26-DRIVERS", f"""with {_TIED} select case when numbers > 1 then 'DIFFERENT_CONTRACT_NUMBERS' when tiers > 1 then 'DIFFERENT_PRICING_TIER' when ends > 1 then 'SAME_CONTRACT_AND_TIER_DIFFERENT_END_DATE' else 'SAME_CONTRACT_TIER_AND_END_DATE' end as driver,
    cast(sum(lines) as bigint) as lines, count(*) as combos from g where eas <> 1 group by 1""")
def drivers(d):
    return _tied(d)[1]
