"""The contract mapper over two deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mapper as M
from ..sources.shared import place
from ..sources.sinks import Versions
from .registry import query

_ALIASES = [("V7", "V6"), ("V8", "V6")]


def deliveries(d, after: bool) -> tuple[DataFrame, ...]:
    """usage, contracts, items and aliases before or after: rows come, go and change in every feed, and an alias is added."""
    c, n = d.consumption, F.col("log_id")
    price = F.when(n % 17 == 1, F.col("unit_price") * 1.5).otherwise(F.col("unit_price")) if after else F.col("unit_price")
    item = F.when(n % 6 == 0, F.concat(F.lit("00"), "item_id")).when(n % 6 == 1, F.concat(F.lit("X"), "item_id")).otherwise(F.col("item_id"))
    usage = c.where(n % 31 != 5 if after else n % 10 != 0).select("row_id", item.alias("item_id"), "vendor", F.col("service_date").alias("day"), price.alias("supply_price"), F.col("client_contract_price").alias("client_price"))
    i = F.col("item_id").try_cast("int")
    k = d.contracts.select("contract_number", "vendor", "item_id", "uom", "price", "each_price", "starts", "ends")
    k = k.where(i % 13 != 4).withColumn("each_price", F.when(i % 11 == 5, F.col("each_price") + 1).otherwise(F.col("each_price"))) if after else k.where(i % 7 != 3)
    code = F.when(i % 19 == 0, "50000000").otherwise(F.col("unspsc")) if after else F.col("unspsc")
    items = d.item_master.where(i % 23 != 1 if after else i % 29 != 1).select("item_id", code.alias("unspsc"))
    return usage, k, items, d.spark.createDataFrame(_ALIASES if after else _ALIASES[1:], "name string, standard string")


_AFTER = """with al as (select * from (values ('V7', 'V6'), ('V8', 'V6')) as t(name, standard)),
    u0 as (select row_id, trim(coalesce(case when log_id % 6 = 0 then '00' || item_id when log_id % 6 = 1 then 'X' || item_id else item_id end, '')) as item_id,
        regexp_replace(trim(upper(coalesce(vendor, ''))), '\\s+', ' ', 'g') as spelling, service_date as day, case when log_id % 17 = 1 then unit_price * 1.5e0 else unit_price end as supply_price, client_contract_price as client_price from consumption where log_id % 31 <> 5),
    u as (select u0.*, coalesce(al.standard, spelling) as vendor from u0 left join al on al.name = spelling),
    k as (select distinct contract_number, coalesce(al.standard, vendor) as vendor, item_id, upper(trim(coalesce(uom, ''))) as uom, price, case when cast(item_id as int) % 11 = 5 then each_price + 1 else each_price end as each_price, starts, ends
        from contracts left join al on al.name = vendor where cast(item_id as int) % 13 <> 4),
    i as (select item_id, count(distinct code) as n, min(code) as code from (select item_id, case when cast(item_id as int) % 19 = 0 then '50000000' else unspsc end as code from item_master where cast(item_id as int) % 23 <> 1) group by 1),
    q as (select distinct vendor, item_id, day from u where item_id <> '' and vendor <> '' and day is not null),
    p as (select q.*, k.contract_number, k.uom, k.price, k.each_price, k.starts, k.ends, k.starts <= q.day and (k.ends is null or k.ends >= cast(q.day - interval 6 month as date)) as near,
        k.starts <= q.day and (k.ends is null or k.ends >= q.day) as live, coalesce(round(k.each_price, 6), -round(k.price, 6)) as pk,
        case when k.starts > q.day then k.starts - q.day when k.ends < q.day then q.day - k.ends end as gap from q join k using (vendor, item_id)),
    l as (select *, max(case when live then starts end) over (partition by vendor, item_id, day) as latest from p),
    t as (select *, live and starts = latest as tie from l),
    g as (select vendor, item_id, day, count(*) filter (near) as candidates, count(*) filter (live) as active, count(*) filter (tie) as tied, count(distinct pk) filter (tie and price is not null) as prices,
        count(distinct contract_number) filter (tie and price is not null) as numbers, count(distinct (round(price, 6), coalesce(round(each_price, 6), -1), uom)) filter (tie and price is not null) as packs,
        arg_min(contract_number, (uom <> 'EA', contract_number, uom, price)) filter (tie and price is not null) as first_number, arg_min(each_price, (uom <> 'EA', contract_number, uom, price)) filter (tie and price is not null) as first_each,
        arg_min(case when starts > day then 'NOT_ACTIVE_NOT_YET_STARTED' when ends < cast(day - interval 6 month as date) then 'NOT_ACTIVE_EXPIRED_BEFORE_LOOKBACK' when ends < day then 'NOT_ACTIVE_EXPIRED_WITHIN_LOOKBACK' else 'NOT_ACTIVE_NO_END_DATE' end,
            (gap is null, coalesce(gap, 0), contract_number)) as kind from t group by 1, 2, 3),
    s as (select q.*, g.* exclude (vendor, item_id, day), case when g.active is null then 'NOT_FOUND' when g.active = 0 then 'NOT_ACTIVE' when prices = 0 then 'PRICE_MISSING' when prices > 1 and numbers > 1 then 'AMBIGUOUS_MULTIPLE_CONTRACTS'
            when prices > 1 then 'AMBIGUOUS_MULTIPLE_PRICES' else 'MATCHED' end as status, q.vendor in (select vendor from k) as v, q.item_id in (select item_id from k) as ki
        from q left join g on g.vendor = q.vendor and g.item_id = q.item_id and g.day = q.day),
    d as (select *, case status when 'NOT_FOUND' then case when not v and not ki then 'VENDOR_AND_ITEM_NOT_IN_CONTRACTS' when not v then 'VENDOR_NOT_IN_CONTRACTS' when not ki then 'ITEM_NOT_IN_CONTRACTS' else 'VENDOR_ITEM_PAIR_NOT_IN_CONTRACTS' end
            when 'NOT_ACTIVE' then kind when 'PRICE_MISSING' then 'CONTRACT_PRICE_MISSING' when 'MATCHED' then null else status end as gap_code,
        case when status = 'NOT_FOUND' then 'NO_CONTRACT_FOR_VENDOR_AND_ITEM' when status = 'NOT_ACTIVE' and candidates > 0 then 'CONTRACT_IN_LOOKBACK_BUT_NOT_ACTIVE_ON_CONSUMPTION_DATE'
            when status = 'NOT_ACTIVE' then 'VENDOR_ITEM_IN_CONTRACTS_BUT_NONE_IN_LOOKBACK_WINDOW_OR_START_DATE_INVALID' when status = 'PRICE_MISSING' then 'ACTIVE_CONTRACT_HAS_NO_PRICE'
            when status = 'AMBIGUOUS_MULTIPLE_CONTRACTS' then 'TIE_ON_LATEST_START_DATE_ACROSS_MULTIPLE_CONTRACTS_WITH_DIFFERENT_PRICES' when status = 'AMBIGUOUS_MULTIPLE_PRICES' then 'MULTIPLE_DIFFERENT_PRICES_ON_LATEST_ACTIVE_CONTRACT'
            when packs > 1 then 'SAME_EACH_PRICE_ACROSS_TIED_RECORDS_PACK_UOM_DIFFERS' when active = 1 then 'SINGLE_ACTIVE_CONTRACT' when tied = 1 then 'LATEST_START_DATE_AMONG_ACTIVE_CONTRACTS'
            else 'TIE_ON_LATEST_START_DATE_SAME_PRICE_LOWEST_CONTRACT_NUMBER_REPORTED' end as reason from s),
    m as (select u.*, case when item_id = '' or u.vendor = '' then 'MISSING_MAPPING_KEY' when day is null then 'INVALID_CONSUMPTION_DATE' else 'ELIGIBLE' end as eligibility from u),
    f as (select m.*, d.status as c_status, d.* exclude (vendor, item_id, day, status), i.n as codes, i.code, b.item_id is not null as bare_known, case when d.status = 'MATCHED' then first_each end as mapped
        from m left join d on d.vendor = m.vendor and d.item_id = m.item_id and d.day = m.day left join i on i.item_id = m.item_id left join i b on b.item_id = ltrim(m.item_id, '0')),
    r as (select *, case when item_id = '' then 'MISSING_ITEM_ID' when codes is null and bare_known and ltrim(item_id, '0') <> item_id then 'ITEM_NOT_IN_ITEM_MASTER_LEADING_ZEROS' when codes is null and not regexp_full_match(item_id, '\\d+') then 'ITEM_NOT_IN_ITEM_MASTER_NONNUMERIC_ID'
            when codes is null then 'ITEM_NOT_IN_ITEM_MASTER' when codes = 0 then 'UNSPSC_MISSING_IN_ITEM_MASTER' when codes > 1 then 'AMBIGUOUS_UNSPSC' end as item_gap_code,
        case when eligibility = 'ELIGIBLE' then gap_code when item_id = '' and vendor = '' then 'MISSING_ITEM_AND_VENDOR' when item_id = '' then 'MISSING_ITEM_ID' when vendor = '' then 'MISSING_VENDOR' else 'INVALID_CONSUMPTION_DATE' end as gap from f)
    select row_id, vendor, strftime(day, '%Y-%m') as month, eligibility, coalesce(c_status, eligibility) as status, coalesce(reason, 'ROW_NOT_ELIGIBLE_FOR_CONTRACT_MAPPING') as reason, cast(candidates as int) as candidates, cast(active as int) as active, cast(tied as int) as tied, cast(prices as int) as prices,
        case when c_status = 'MATCHED' then first_number end as contract_number, mapped as mapped_price, gap as gap_code, case when codes = 1 then code end as unspsc,
        case when item_id = '' then 'MISSING_ITEM_ID' when codes is null then 'NOT_FOUND' when codes = 0 then 'UNSPSC_MISSING' when codes > 1 then 'AMBIGUOUS_UNSPSC' else 'MATCHED' end as item_status, item_gap_code,
        case when mapped is null or mapped = 0 or client_price is null then 'NOT_COMPARABLE' when abs((client_price - mapped) / abs(mapped)) > 0.2e0 then 'ABOVE_20_PERCENT' else 'WITHIN_THRESHOLD' end as client_flag,
        case when mapped is null or mapped = 0 or supply_price is null then 'NOT_COMPARABLE' when abs((supply_price - mapped) / abs(mapped)) > 0.2e0 then 'ABOVE_20_PERCENT' else 'WITHIN_THRESHOLD' end as supply_flag,
        nullif(concat_ws('; ', 'CONTRACT:' || gap, 'ITEM_MASTER:' || item_gap_code), '') as unmapped_code from r"""


@query("API-11", _AFTER)
def mapped(d):
    """Two deliveries; the second one maps anew only what they touch. The SQL maps the last state in full."""
    m = M.Mapper(Versions(d.spark, place(d.spark, "mapper")))
    m.run(*deliveries(d, after=False))
    m.run(*deliveries(d, after=True))
    out = m.store.read("mapped")
    none = F.col("eligibility") != "ELIGIBLE"
    counts = [F.when(~none, F.col(c)).alias(c) for c in ("candidates", "active", "tied", "prices")]
    found = out.withColumns({c: F.when(F.col("status") == "NOT_FOUND", None).otherwise(F.col(c)) for c in ("candidates", "active", "tied", "prices")})
    return found.select("row_id", "vendor", F.date_format("day", "yyyy-MM").alias("month"), "eligibility", "status", "reason", *counts, "contract_number", "mapped_price", "gap_code", "unspsc", "item_status", "item_gap_code", "client_flag", "supply_flag", "unmapped_code")


@query("API-11-RUN")
def counted(d):
    """What the second delivery found new, changed, deleted, mapped anew and reused."""
    m = M.Mapper(Versions(d.spark, place(d.spark, "mapper")))
    m.run(*deliveries(d, after=False))
    counts = m.run(*deliveries(d, after=True))
    return d.spark.createDataFrame(sorted(counts.items()), "what string, rows long")


@query("API-11-CURRENT", """with k as (select distinct contract_number, vendor, item_id, upper(trim(coalesce(uom, ''))) as uom, price, each_price, starts, ends from contracts),
    q as (select distinct regexp_replace(trim(upper(coalesce(vendor, ''))), '\\s+', ' ', 'g') as vendor, trim(item_id) as item_id from consumption),
    l as (select *, coalesce(round(each_price, 6), -round(price, 6)) as pk from k where starts <= date '1998-06-01' and (ends is null or ends >= date '1998-06-01')),
    o as (select vendor, item_id, count(distinct pk) filter (price is not null) as n, arg_min((contract_number, price, each_price), (uom <> 'EA', vendor, contract_number, uom, price)) filter (price is not null) as x
        from (select * from l qualify starts = max(starts) over (partition by vendor, item_id)) group by 1, 2),
    a as (select item_id, count(distinct pk) filter (price is not null) as n, arg_min((contract_number, price, each_price), (uom <> 'EA', vendor, contract_number, uom, price)) filter (price is not null) as x
        from (select * from l qualify starts = max(starts) over (partition by item_id)) group by 1),
    h as (select item_id, bool_or(starts <= date '1998-06-01' and coalesce(ends < date '1998-06-01', false)) as past, bool_or(starts > date '1998-06-01') as later from k group by 1),
    z as (select q.*, case when o.n is not null then 'SAME_VENDOR' when a.n is not null then 'OTHER_VENDOR' end as scope, coalesce(o.n, a.n) as n, case when o.n is not null then o.x else a.x end as x, h.past, h.later, h.item_id is not null as there
        from q left join o on o.vendor = q.vendor and o.item_id = q.item_id left join a on a.item_id = q.item_id left join h on h.item_id = q.item_id)
    select vendor, item_id, case when item_id = '' then 'NOT_ASSESSED' when n = 1 then 'CONTRACTED' when n > 1 then 'CONTRACTED_PRICE_AMBIGUOUS' when scope is not null then 'CONTRACTED_NO_PRICE' else 'NON-CONTRACTED' end as current_status, scope,
        case when n = 1 then x[1] end as current_number, case when n = 1 then x[2] end as current_price, case when n = 1 then x[3] end as current_each_price, cast(n as int) as price_count,
        case when item_id = '' then 'MISSING_ITEM_ID' when scope is not null then null when not there then 'NO_CONTRACT_RECORD_FOR_ITEM' when past then 'ALL_CONTRACTS_EXPIRED' when later then 'ONLY_FUTURE_CONTRACTS' else 'NO_VALID_CONTRACT_DATES' end as no_contract_code from z""")
def current(d):
    none = d.spark.createDataFrame([], "name string, standard string")
    keys = d.consumption.select(M.vendor_key(F.col("vendor")).alias("vendor"), M.item_key(F.col("item_id")).alias("item_id")).distinct()
    return M.current_contracts(keys, M.usable_contracts(d.contracts, none), "1998-06-01")


_STATES = {"contract_not_found": "NOT_FOUND", "contract_not_active": "NOT_ACTIVE", "ambiguous_contracts": "AMBIGUOUS_MULTIPLE_CONTRACTS", "ambiguous_prices": "AMBIGUOUS_MULTIPLE_PRICES", "active_contract_without_price": "PRICE_MISSING",
           "missing_mapping_key": "MISSING_MAPPING_KEY", "invalid_consumption_date": "INVALID_CONSUMPTION_DATE"}
_COUNTS = {
    "consumption_rows": "count(*)", "eligible_rows": "count(*) filter (eligibility = 'ELIGIBLE')", "matched_rows": "count(*) filter (status = 'MATCHED')", **{k: f"count(*) filter (status = '{v}')" for k, v in _STATES.items()},
    "client_price_above_threshold_rows": "count(*) filter (client_flag like 'ABOVE%')", "supply_price_above_threshold_rows": "count(*) filter (supply_flag like 'ABOVE%')", "item_master_unmatched": "count(*) filter (item_status <> 'MATCHED')",
    "unmatched_eligible": "count(*) filter (eligibility = 'ELIGIBLE' and status <> 'MATCHED')", "ambiguous_total": "count(*) filter (status like 'AMBIGUOUS%')",
}
_SUMMARY = f"""with x as ({_AFTER}) select {{0}}, {', '.join(f'{v} as {k}' for k, v in _COUNTS.items())},
    case when count(*) filter (eligibility = 'ELIGIBLE') > 0 then floor(count(*) filter (status = 'MATCHED') * 1000000e0 / count(*) filter (eligibility = 'ELIGIBLE') + 0.501) / 10000 end as match_rate_pct from x group by 1"""


@query("AGG-22", _SUMMARY.format("vendor as standard_vendor"))
def by_vendor(d):
    return M.summary(M.map_all(*deliveries(d, after=True)), F.col("vendor")).withColumnRenamed("key", "standard_vendor")


@query("AGG-22-MONTH", _SUMMARY.format("month"))
def by_month(d):
    return M.summary(M.map_all(*deliveries(d, after=True)), F.date_format("day", "yyyy-MM")).withColumnRenamed("key", "month")


@query("AGG-23", f"with x as ({_AFTER}), s as (select {', '.join(f'{v} as {k}' for k, v in _COUNTS.items())} from x) unpivot s on columns(*) into name metric value value")
def kpis(d):
    feeds = deliveries(d, after=True)
    return M.kpis(M.map_all(*feeds), feeds[0])
