"""Queries that a user of the console asks, sources and user-defined functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.cleaning import cents
from ..operators import windows as O
from .aggregates import _V, detailed, r
from .projections import _LINES, lines
from .registry import query


@query("SRC-06", "select vendor, item_id, count(*) as rows from consumption group by 1, 2")
def projected(d):
    return d.consumption.groupBy("vendor", "item_id").agg(F.count("*").alias("rows"))


@query("SRC-07", "select l_orderkey, l_partkey from lineitem where l_shipdate < timestamp '1996-01-01 00:00:00'")
def pruned(d):
    return d.lineitem.where("l_shipdate < timestamp_ntz '1996-01-01 00:00:00'").select("l_orderkey", "l_partkey")


@query("SRC-08", "select distinct p_type, p_brand from part")
def lookup(d):
    return d.part.select("p_type", "p_brand").distinct()


#: Units of measure, their standard unit and the eaches in it.
UNIT_SEED = [("EA", "EA", 1.0), ("EACH", "EA", 1.0), ("BX", "BX", 10.0), ("BOX", "BX", 10.0), ("CA", "CA", 50.0), ("CASE", "CA", 50.0), ("CS", "CA", 50.0), ("DZ", "DZ", 12.0), ("PK", "PK", 5.0)]


@query("SRC-12", f"""with seed(code, standard, factor) as (values {', '.join(f"('{a}', '{b}', {c}e0)" for a, b, c in UNIT_SEED)})
    select standard, count(*) as lines, cast(sum(quantity * factor) as bigint) as eaches from consumption join seed on upper(trim(uom)) = code group by 1""")
def seeds(d):
    """An inline seed joined to the lines."""
    seed = d.spark.createDataFrame(UNIT_SEED, "code string, standard string, factor double")
    rows = d.consumption.select(F.upper(F.trim("uom")).alias("code"), "quantity").join(F.broadcast(seed), "code")
    return rows.groupBy("standard").agg(F.count("*").alias("lines"), F.sum(F.col("quantity") * F.col("factor")).cast("long").alias("eaches"))


@query("SRC-13", """with m as (select date_trunc('month', service_date) as m, count(*) as n from consumption where service_date is not null and month(service_date) <> 2 group by 1),
    s as (select unnest(generate_series(min(m), max(m), interval 1 month)) as m from m) select strftime(s.m, '%Y-%m') as month, coalesce(n, 0) as lines from s left join m on s.m = m.m""")
def months(d):
    """A series of all months between the first and the last one, with the lines of each; months without lines have 0."""
    n = d.consumption.where("service_date is not null and month(service_date) <> 2").groupBy(F.trunc("service_date", "month").alias("m")).agg(F.count("*").alias("n"))
    series = n.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return series.join(n, "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("lines"))


@query("SRC-16", "select item_id, price from item_master")
def empty(d):
    """A feed beside one whose file is missing, which counts as no rows of its columns."""
    from ..sources import readers
    from ..sources.shared import place

    more = readers.or_empty(d.spark, place(d.spark, "no_such_feed"), ["item_id", "price"])
    return d.item_master.select("item_id", "price").unionByName(more.withColumn("price", F.col("price").cast("double")))


@query("API-01-SEARCH", "select row_id, vendor, description from consumption where vendor ilike '%v3%' or description ilike '%v3%' order by row_id limit 50 offset 50")
def page(d):
    c = d.consumption.select("row_id", "vendor", "description")
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(x).ilike("%v3%"), F.lit(False)) for x in ("vendor", "description")))
    return c.where(hit).orderBy("row_id").offset(50).limit(50)


_X = _V.replace("v as (", "x as (", 1)


@query("API-02", " union all ".join(f"select * from (with {_LINES}, {_X} select '{k}' as by, {k} as name, {r('sum(greatest(variance, 0e0))')} as savings from x group by 2 order by 3 desc, 2 limit 5)" for k in ("manufacturer", "vendor", "description")))
def top_savings(d):
    keys = F.array(*(F.struct(F.lit(k).alias("by"), F.col(k).alias("name")) for k in ("manufacturer", "vendor", "description")))
    over = detailed(d).select(F.explode(keys).alias("x"), F.greatest("variance", F.lit(0.0)).alias("over"))  # one pass for the three
    sums = over.groupBy("x.by", "x.name").agg(cents(F.sum("over")).alias("savings"))
    return O.pick(sums, ["by"], [F.desc("savings"), F.col("name")], 5)


@query("API-03", f"select strftime(service_date, '%Y-%m') as month, count(*) as lines, {r('sum(unit_price * quantity)')} as spend, count(*) filter (item_id = '') as unmapped from consumption group by 1")
def trend(d):
    return d.consumption.groupBy(F.date_format("service_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("lines"), cents(F.sum(F.col("unit_price") * F.col("quantity"))).alias("spend"), F.count_if(F.col("item_id") == "").alias("unmapped"))


@query("API-04", f"select description, {r('sum(unit_price * quantity)')} as spend from consumption group by 1 order by 2 desc, 1 limit 8")
def top_groups(d):
    return d.consumption.groupBy("description").agg(cents(F.sum(F.col("unit_price") * F.col("quantity"))).alias("spend")).orderBy(F.desc("spend"), "description").limit(8)


@query("API-05", "select row_id, description from consumption where item_id = ''")
def unmapped(d):
    return d.consumption.where("item_id = ''").select("row_id", "description")


@query("API-06-VENDORS", f"with {_LINES}, {_X} select vendor, {r('sum(spend)')} as spend, count(contract_number) * 1e0 / count(*) as match_rate, {r('sum(greatest(variance, 0e0))')} as overpayment from x group by 1")
def drill(d):
    return detailed(d).groupBy("vendor").agg(cents(F.sum("spend")).alias("spend"), (F.count("contract_number") * F.lit(1.0) / F.count("*")).alias("match_rate"), cents(F.sum(F.greatest("variance", F.lit(0.0)))).alias("overpayment"))


@query("API-08", "select action, count(*) filter (status = 'FAILED') * 1e0 / count(*) as failure_rate from logs group by 1")
def observed(d):
    return d.logs.groupBy("action").agg((F.count_if(F.col("status") == "FAILED") * F.lit(1.0) / F.count("*")).alias("failure_rate"))


@query("API-09", f"with {_LINES} select row_id, unit_price, price from lines where price > 0 and unit_price / price >= 3 order by unit_price / price desc, row_id limit 25")
def spikes(d):
    ratio = F.col("unit_price") / F.col("price")
    return lines(d).where((F.col("price") > 0) & (ratio >= 3)).orderBy(F.desc(ratio), "row_id").limit(25).select("row_id", "unit_price", "price")


@query("UDF-03", "select c.row_id, upper(c.description) as label from consumption c")
def once_per_value(d):
    known = d.consumption.select("description").distinct().withColumn("label", F.upper("description"))
    return d.consumption.select("row_id", "description").join(known, "description").select("row_id", "label")


@query("UDF-04-RULES", "select description, case when description like '%plate%' or description like '%bolt%' then 'ORTHO' else 'GENERAL' end as procedure_group from (select distinct description from consumption)")
def grouped(d):
    from ..functions.grouping import group_values, rules

    return group_values(d.consumption.select(F.col("description").alias("value")), rules).select(F.col("value").alias("description"), F.col("label").alias("procedure_group"))


@query("FN-JSON", "select event_id, cast(props ->> '$.k' as int) as k from events")
def from_json(d):
    return d.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("FN-DML", "select item_id, case when price > 1500 then 1500e0 else price end as price from item_master where active = 'Y' union all select 'NEW', 1e0")
def rewritten(d):
    kept = d.item_master.where("active = 'Y'").select("item_id", F.when(F.col("price") > 1500, 1500.0).otherwise(F.col("price")).alias("price"))
    return kept.unionAll(d.spark.createDataFrame([("NEW", 1.0)], "item_id string, price double"))
