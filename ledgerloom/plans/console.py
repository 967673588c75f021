"""Queries behind a console."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import console as O
from ..sources.shared import place, written
from . import marts
from .aggregates import cents, r
from .registry import query

_COLUMNS = ["row_id", "vendor", "description", "facility", "item_id", "manufacturer"]
_HIT = f"facility like '3%' and ({' or '.join(f'''coalesce({c} ilike '%v3%', false)''' for c in _COLUMNS)})"


@query("API-01", f"""select (select count(*) from consumption) as total, (select count(*) from consumption where {_HIT}) as filtered, {', '.join(_COLUMNS)} from consumption
    where {_HIT} order by description desc, {', '.join(f'{c} nulls first' for c in _COLUMNS)} limit 25 offset 25""")
def page(d):
    rows = d.consumption.select(*_COLUMNS)
    facility = rows.where("facility like '3%'").agg(F.min("facility")).first()[0]
    got = O.table_page(rows, search="v3", equal={"facility": facility, "no such column": "x"}, sort="description", descending=True, start=25, length=25)
    return got.rows.select(F.lit(got.total).cast("long").alias("total"), F.lit(got.filtered).cast("long").alias("filtered"), *_COLUMNS)


@query("API-01-DOWNLOAD", f"select {', '.join(_COLUMNS[:3])} from consumption where manufacturer = 'Brand#3'")
def downloaded(d):
    path = place(d.spark, "download")
    O.download(d.consumption.where("manufacturer = 'Brand#3'").select(*_COLUMNS[:3]), path)
    return d.spark.read.option("header", True).option("escape", '"').schema("row_id string, vendor string, description string").csv(path)


_FACT = f"with {marts._CHOSEN}, {marts._FLAGS}"


@query("API-06", f"{_FACT} " + " union all ".join(f"select '{n}' as figure, count(*) filter ({c}) as rows, {r(f'sum(case when {c} then {m} else 0 end)')} as total from fact" for n, (c, m) in O.FIGURES.items()))
def figures(d):
    totals, _ = O.drill(marts.consumption_fact(d), "row_id")  # one pass
    return totals.select("figure", "rows", cents(F.col("total")).alias("total"))


@query("API-06-ROWS", f"{_FACT} " + " union all ".join(f"select * from (select '{n}' as figure, row_id as key, {m} as measure from fact where {c} order by {m} desc, row_id limit 50)" for n, (c, m) in O.FIGURES.items()))
def rows_behind(d):
    used = ["row_id", "is_contract_matched", "line_spend", "savings_opportunity", "overpayment_amount"]
    return O.drill(written(marts.consumption_fact(d).select(*used), "fact"), "row_id")[1]


@query("API-07", f"""{_FACT}, gap as (select 1 from fact group by primary_procedure_group, service_line, facility, patient_type),
    v as (select (select {r('sum(line_spend)')} from fact) as spend, (select {r('sum(coalesce(unit_price * quantity, 0))')} from consumption) as raw, (select count(*) from fact) as n, (select count(*) from consumption) as raw_n,
        (select 100e0 * count(*) filter (item_known) / count(*) from f) as known, (select count(*) from consumption where unit_price < 0 or quantity < 0) as negative, (select {r('sum(total_value)')} from purchase_orders) as po,
        (select count(*) from fact where is_contract_matched and contract_match_tier not in (1, 2, 3, 4)) as tiers, (select count(*) from consumption where service_line = 'MACHINERY') as tenants, (select count(*) from gap) as gaps)
    select 'TEST_FIN_001' as id, spend as value, case when spend = raw then 'PASS' else 'FAIL' end as status from v union all select 'TEST_CARD_002', n, case when n = raw_n then 'PASS' else 'FAIL' end from v
    union all select 'TEST_FK_003', floor(known * 100 + 0.501) / 100, case when known >= 85 then 'PASS' else 'FAIL' end from v union all select 'TEST_VAL_004', negative, case when negative = 0 then 'PASS' else 'FAIL' end from v
    union all select 'TEST_PO_005', po, 'PASS' from v union all select 'TEST_MATCH_006', tiers, case when tiers = 0 then 'PASS' else 'FAIL' end from v
    union all select 'TEST_TENANT_007', tenants, case when tenants = 0 then 'PASS' else 'FAIL' end from v union all select 'TEST_GAP_008', gaps, case when gaps >= 1 then 'PASS' else 'FAIL' end from v""")
def suite(d):
    """Eight assertions; some lines have negative quantities, and one service line no tenant, so those two fail."""
    keys = ["primary_procedure_group", "service_line", "facility", "patient_type"]
    fact = written(marts.consumption_fact(d).select(*keys, "line_spend", "is_item_master_matched", "is_contract_matched", "contract_match_tier"), "fact")
    gaps = fact.select(*keys).distinct()
    client = F.when(F.col("service_line") != "MACHINERY", F.col("service_line"))
    tenants = d.consumption.select(client.alias("client_id"), F.lit("client").alias("client_name"), F.lit("provider").alias("client_type"))
    out = O.assertions(d.consumption, d.purchase_orders, fact, marts.purchase_fact(d), gaps, tenants)
    return out.select("id", cents(F.col("value")).alias("value"), "status")


@query("API-05-COLUMNS", " union all ".join(f"select '{c}' as column_name, count(*) as rows, count(*) - count({c}) as nulls, min(cast({c} as varchar)) as least, max(cast({c} as varchar)) as most from item_master" for c in ("item_id", "description", "manufacturer", "unspsc", "qoe")))
def stats(d):
    return O.column_stats(d.item_master.select("item_id", "description", "manufacturer", "unspsc", "qoe"))
