"""Queries over what outlives a run: publication, resumed stages, the catalog, parity of stores, bad rows, cached labels."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.grouping import LabelCache
from ..operators.catalog import Catalog
from ..operators.profile import parity
from ..operators.stages import Run, Stage
from ..sources import publish, readers
from ..sources.shared import place
from ..sources.sinks import Versions
from .registry import query


def _local(d, name: str) -> str:
    return place(d.spark, name)


@query("SNK-05", 'select item_id as "ITEM_ID", description as "DESCRIPTION", price as "PRICE", timestamp \'2024-05-06 07:08:09\' as "AT" from after')
def published(d):
    """Publish, publish anew with a task that fails, which leaves the first table, publish again, read back."""
    at = F.to_timestamp_ntz(F.lit("2024-05-06 07:08:09"))
    uri, columns = _local(d, "published"), ["item_id", "description", "price", at.alias("at")]
    publish.publish(d.before.select(*columns), uri, chunk=100)
    first = publish.current(uri)
    try:
        publish.publish(d.after.select(*columns).withColumn("item_id", F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("item_id"))), uri)
    except Exception as e:  # the task's error
        if "lost" not in str(e):
            raise
    if publish.current(uri) != first:
        raise AssertionError("a failed publication changed the table")
    publish.publish(d.after.select(*columns), uri, chunk=100)
    return publish.read_published(d.spark, uri)


def _stages(d, broken: bool) -> list[Stage]:
    def fail(lines):
        if broken:
            raise RuntimeError("stage failed")
        return lines.groupBy("vendor").agg(F.sum("rows").alias("rows"))

    return [
        Stage("clean", lambda: d.consumption.select("row_id", "item_id", F.upper(F.trim("vendor")).alias("vendor"))),
        Stage("count", lambda clean: clean.groupBy("vendor", "item_id").agg(F.count("*").alias("rows")), ("clean",)),
        Stage("mart", fail, ("count",)),
    ]


@query("INC-17", "select upper(trim(vendor)) as vendor, count(*) as rows, 'mart' as ran from consumption group by 1")
def resumed(d):
    """A run of three stages whose last one fails, and a second one that only repeats that."""
    path = _local(d, "run")
    try:
        Run(d.spark, path, _stages(d, broken=True)).resume()
    except RuntimeError:
        pass
    run = Run(d.spark, path, _stages(d, broken=False))
    ran = run.resume()
    return run.read("mart").withColumn("ran", F.lit(",".join(ran)))


_LOGS = "select action as entity, cast(event_id as varchar) as name, ts as arrived, event_id % 2 as batch from logs"


def catalogue(d) -> Catalog:
    """All deliveries of logs registered in two batches; the files of one entity are merged."""
    files = d.logs.select(F.col("action").alias("entity"), F.col("event_id").cast("string").alias("name"), F.col("ts").alias("arrived"), F.col("user_id").alias("rows"), (F.col("event_id") % 2).alias("batch"))
    out = Catalog(Versions(d.spark, place(d.spark, "catalog")))
    for batch in (0, 1):
        out.register(files.where(F.col("batch") == batch).drop("batch"))
    import datetime

    out.merged("error", "all-errors", datetime.datetime(2030, 1, 1), 1)
    return out


@query("INC-11", f"""with x as ({_LOGS}), v as (select entity, name, cast(row_number() over (partition by entity order by batch, arrived, name) as int) as version from x)
    select entity, name, version, case when entity = 'error' then 'SUPERSEDED' else 'ACTIVE' end as status, case when entity = 'error' then 'all-errors' end as merged_into from v
    union all select 'error', 'all-errors', cast(1 + (select count(*) from x where entity = 'error') as int), 'MERGED_CONSOLIDATED', null""")
def catalogued(d):
    return catalogue(d).files().select("entity", "name", "version", "status", "merged_into")


@query("API-10", f"with x as ({_LOGS}) select entity, count(*) as files from x where entity <> 'error' group by 1 having count(*) > 1")
def to_merge(d):
    return catalogue(d).candidates()


_SIDE = "select count(*) as lines, sum(total_value) as value, count(distinct po_number) as orders, sum(quantity) as quantity, avg(unit_price) as mean_price from {}"


@query("AGG-34", f"""with p as (select po_number, quantity, unit_price, case when po_number like '%77' then total_value * 1.01e0 else total_value end as total_value from purchase_orders where po_number not like '%123'),
    a as ({_SIDE.format('purchase_orders')}), b as ({_SIDE.format('p')}),
    m as ({' union all '.join(f"select '{n}' as metric, cast(a.{n} as double) as left_value, cast(b.{n} as double) as right_value, {t} as tolerance from a, b" for n, t in (('lines', '0e0'), ('value', '1e-6'), ('orders', '0e0'), ('quantity', '1e-2'), ('mean_price', '5e-2')))})
    select metric, floor(left_value * 100 + 0.501) / 100 as left_value, floor(right_value * 100 + 0.501) / 100 as right_value, abs(left_value - right_value) <= tolerance * abs(left_value) as equal from m""")
def stores(d):
    """The raw feed, as text, against a published table in which some orders lack and some values differ."""
    columns = ["po_number", "quantity", "unit_price", "total_value"]
    raw = _local(d, "raw_orders")
    d.purchase_orders.select(*columns).write.option("header", True).option("sep", "|").csv(raw)
    left = readers.delimited(d.spark, raw, columns)
    left = left.select("po_number", *(F.col(c).cast("double").alias(c) for c in columns[1:]))
    uri = _local(d, "orders")
    n = F.col("po_number")
    planted = d.purchase_orders.select(*columns).where(~n.endswith("123")).withColumn("total_value", F.when(n.endswith("77"), F.col("total_value") * 1.01).otherwise(F.col("total_value")))
    publish.publish(planted, uri)
    found = parity(left, publish.read_published(d.spark, uri), {
        "lines": (F.count("*"), 0.0), "value": (F.sum("total_value"), 1e-6), "orders": (F.count_distinct("po_number"), 0.0), "quantity": (F.sum("quantity"), 1e-2), "mean_price": (F.avg("unit_price"), 5e-2),
    })
    cents = lambda c: (F.floor(F.col(c) * 100 + 0.501) / 100.0).alias(c)
    return found.select("metric", cents("left_value"), cents("right_value"), "equal")


@query("SRC-01", """with x as (select cast(item_id as int) as n, item_id, description, manufacturer_part from item_master)
    select item_id, description, case when n % 5 = 1 then null else manufacturer_part end as manufacturer_part, null as bad from x where n % 7 <> 2 and n % 11 <> 3
    union all select null, null, null, case when n % 7 = 2 then item_id || '|' || description || '|' || manufacturer_part || '|more' else item_id || '|"' || description || '|' || manufacturer_part end from x where n % 7 = 2 or n % 11 = 3""")
def quarantined(d):
    """A piped feed with short rows, which are filled, and with long and broken ones, which are set aside."""
    n, path = F.col("item_id").cast("int"), _local(d, "piped")
    line = F.when(n % 7 == 2, F.concat_ws("|", "item_id", "description", "manufacturer_part", F.lit("more"))).when(n % 11 == 3, F.concat_ws("|", "item_id", F.concat(F.lit('"'), "description"), "manufacturer_part"))
    line = line.when(n % 5 == 1, F.concat_ws("|", "item_id", "description")).otherwise(F.concat_ws("|", "item_id", "description", "manufacturer_part"))
    columns = ["item_id", "description", "manufacturer_part"]
    d.item_master.select(line.alias("|".join(columns))).write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\x01").csv(path)
    rows, bad = readers.quarantined(d.spark, path, columns)
    none = F.lit(None).cast("string")
    return rows.withColumn("bad", none).unionByName(bad.select(*(none.alias(c) for c in columns), F.col("_bad").alias("bad")))


def stub(values: list[str]) -> str:
    """Answers as a service may: an object with an array in a fence, and nothing about some values."""
    return "Here you are:\n```json\n" + json.dumps({"labels": [{"value": v, "label": v.split(" ")[-1].upper()} for v in values if not v.startswith("hot")]}) + "\n```"


@query("UDF-04", """with v as (select distinct description as value from consumption), s as (select value, value like 'hot%' as unanswered from v)
    select value, case when not unanswered then upper(string_split(value, ' ')[-1]) when value like '%plate%' or value like '%bolt%' then 'ORTHO' else 'GENERAL' end as label, case when unanswered then 'RULE' else 'CLIENT' end as source,
        (select count(*) from s) as asked_first, (select count(*) from s where unanswered) as asked_again from s""")
def labelled(d):
    """Two runs over one cache: the second one asks only for what the first got no answer to."""
    cache = LabelCache(Versions(d.spark, place(d.spark, "labels")), stub)
    values = d.consumption.select(F.col("description").alias("value"))
    first, again = cache.run(values), cache.run(values)
    return cache.known().select("value", "label", "source", F.lit(first["asked"]).cast("long").alias("asked_first"), F.lit(again["asked"]).cast("long").alias("asked_again"))
