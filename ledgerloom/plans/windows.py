"""Window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import windows as O
from .registry import query


@query("WIN-01", "select po_number, po_line, updated from (select *, row_number() over (partition by po_number order by updated desc nulls last, po_line) as n from purchase_orders) where n = 1")
def latest(d):
    return O.latest(d.purchase_orders, ["po_number"], "updated", "po_line").select("po_number", "po_line", "updated")


@query("WIN-02", "select manufacturer_part, item_id from (select *, row_number() over (partition by manufacturer_part order by case when active = 'Y' then 1 else 0 end desc, price desc nulls last, item_id) as n from item_master) where n = 1")
def active_first(d):
    order = [F.desc(F.when(F.col("active") == "Y", 1).otherwise(0)), F.col("price").desc_nulls_last(), F.col("item_id")]
    return O.pick(d.item_master, ["manufacturer_part"], order).select("manufacturer_part", "item_id")


_PRIORITY = "partition by item_id order by case when uom = 'EA' then 1 else 2 end, ends desc nulls last, contract_number, price nulls last"


@query("WIN-03", f"select item_id, contract_number, price from (select *, row_number() over ({_PRIORITY}) as n from contracts) where n = 1")
def priority(d):
    order = [F.when(F.col("uom") == "EA", 1).otherwise(2), F.col("ends").desc_nulls_last(), F.col("contract_number"), F.col("price").asc_nulls_last()]
    return O.pick(d.contracts, ["item_id"], order).select("item_id", "contract_number", "price")


@query("WIN-04", "select vendor, row_id from consumption qualify row_number() over (partition by vendor order by unit_price * quantity desc, row_id) = 1")
def qualify(d):
    return O.pick(d.consumption, ["vendor"], [F.desc(F.col("unit_price") * F.col("quantity")), F.col("row_id")]).select("vendor", "row_id")


@query("WIN-05", "select row_id, row_number() over (order by log_id, row_id) as row_number from consumption")
def numbered(d):
    return O.row_ids(d.consumption.select("row_id", "log_id"), ["log_id", "row_id"]).select("row_id", F.col("row_number").cast("long").alias("row_number"))


@query("WIN-06", "select contract_number, item_id, vendor, price, max(starts) over (partition by vendor, item_id) as latest_start from contracts")
def group_max(d):
    return d.contracts.select("contract_number", "item_id", "vendor", "price", F.max("starts").over(W.partitionBy("vendor", "item_id")).alias("latest_start"))


@query("WIN-07", "with c as (select vendor, manufacturer, count(*) as n from consumption group by all) select vendor, manufacturer, n, n * 1e0 / sum(n) over (partition by vendor) as share from c")
def share(d):
    c = d.consumption.groupBy("vendor", "manufacturer").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") * F.lit(1.0) / F.sum("n").over(W.partitionBy("vendor")))


@query("WIN-08", "select contract_number, item_id, vendor, price, max(ends) over (partition by vendor, item_id order by starts, ends nulls last, contract_number, price nulls last rows between unbounded preceding and 1 preceding) as previous_end from contracts")
def overlap(d):
    w = W.partitionBy("vendor", "item_id").orderBy("starts", F.col("ends").asc_nulls_last(), "contract_number", F.col("price").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return d.contracts.select("contract_number", "item_id", "vendor", "price", F.max("ends").over(w).alias("previous_end"))


@query("WIN-09", "select po_number, po_line, invoice_number from (select p.po_number, p.po_line, i.invoice_number, row_number() over (partition by p.po_number, p.po_line order by abs(date_diff('day', p.po_date, i.paid)), i.paid desc, i.invoice_number, i.po_line) as n from purchase_orders p join invoices i on p.po_number = i.po_number) where n = 1")
def nearest_day(d):
    i = d.invoices.select("po_number", "invoice_number", "paid", F.col("po_line").alias("i_line"))
    both = d.purchase_orders.select("po_number", "po_line", "po_date").join(i, "po_number")
    order = [F.abs(F.datediff("paid", "po_date")), F.desc("paid"), F.col("invoice_number"), F.col("i_line")]
    return O.pick(both, ["po_number", "po_line"], order).select("po_number", "po_line", "invoice_number")


@query("WIN-10", "select contract_number, item_id, vendor, price, first_value(price) over (partition by vendor, item_id order by starts desc, contract_number, price nulls last) as first_price from contracts")
def first_in_order(d):
    w = W.partitionBy("vendor", "item_id").orderBy(F.desc("starts"), "contract_number", F.col("price").asc_nulls_last())
    return d.contracts.select("contract_number", "item_id", "vendor", "price", F.first("price").over(w).alias("first_price"))


@query("SRT-01", "select manufacturer, sum(quantity) as quantity from consumption group by 1 order by 2 desc, 1 limit 5")
def top(d):
    return d.consumption.groupBy("manufacturer").agg(F.sum("quantity").alias("quantity")).orderBy(F.desc("quantity"), "manufacturer").limit(5)


@query("SRT-02", "select item_id, price from item_master order by price desc, item_id limit 20 offset 40")
def page(d):
    return d.item_master.select("item_id", "price").orderBy(F.desc("price"), "item_id").offset(40).limit(20)


@query("SRT-03", "select item_id, min(contract_number) as contract_number from contracts where starts = (select min(starts) from contracts c where c.item_id = contracts.item_id) group by 1")
def first_per_key(d):
    return O.pick(d.contracts, ["item_id"], [F.col("starts"), F.col("contract_number")]).select("item_id", "contract_number")


@query("SRT-04")
def sample(d):
    return d.consumption.select("row_id").limit(100)


@query("SRT-05", "select item_id, row_number() over (order by unspsc nulls last, item_id) as place from item_master")
def nulls_last(d):
    return O.row_ids(d.item_master.select("item_id", "unspsc"), ["unspsc", "item_id"], "place").select("item_id", F.col("place").cast("long").alias("place"))


@query("SET-01", "select item_id, vendor from consumption union all select item_id, vendor from purchase_orders")
def union_all(d):
    return d.consumption.select("item_id", "vendor").unionAll(d.purchase_orders.select("item_id", "vendor"))


@query("SET-02", "select item_id, price, null as vendor from before union all select item_id, null, vendor from contracts")
def union_by_name(d):
    return d.before.select("item_id", "price").unionByName(d.contracts.select("item_id", "vendor"), allowMissingColumns=True)


@query("SET-03", "select distinct vendor, manufacturer from consumption")
def distinct(d):
    return d.consumption.select("vendor", "manufacturer").distinct()


@query("SET-04", "select vendor, item_id, min(contract_number) as contract_number from contracts group by 1, 2")
def drop_duplicates(d):
    return O.pick(d.contracts, ["vendor", "item_id"], [F.col("contract_number"), F.col("price").asc_nulls_last()]).select("vendor", "item_id", "contract_number")


@query("SET-05", "(select item_id, description, price, 'REMOVED' as side from before except all select item_id, description, price, 'REMOVED' from after) union all (select item_id, description, price, 'ADDED' from after except all select item_id, description, price, 'ADDED' from before)")
def symmetric_difference(d):
    b, a = (x.select("item_id", "description", "price") for x in (d.before, d.after))
    return b.exceptAll(a).withColumn("side", F.lit("REMOVED")).unionAll(a.exceptAll(b).withColumn("side", F.lit("ADDED")))


@query("SET-06", "select row_id, vendor in (select vendor from contracts) as known from consumption")
def membership(d):
    known = d.contracts.select("vendor").distinct().withColumn("known", F.lit(True))
    return d.consumption.join(known, "vendor", "left").select("row_id", F.coalesce("known", F.lit(False)).alias("known"))
