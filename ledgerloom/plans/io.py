"""Sources, sinks, catalogs and remaining queries: what is written is read back, so SQL can state the result."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import pricing as P
from ..operators import incremental as I
from ..operators import manifest as N
from ..operators import windows as O
from ..sources import readers, shared, sinks
from .registry import query


def place(d, name: str) -> str:
    """A new path in the shared folder."""
    return shared.place(d.spark, name)


_TEXT = "select item_id, description, coalesce(manufacturer, '') as manufacturer, manufacturer_part from item_master"


def items_as_text(d, sep: str = "|", **options):
    path = place(d, "items")
    w = d.item_master.select("item_id", "description", F.coalesce("manufacturer", F.lit("")).alias("manufacturer"), "manufacturer_part").write.option("header", True).option("sep", sep)
    for k, v in options.items():
        w = w.option(k, v)
    w.csv(path)
    return path


_COLUMNS = ["item_id", "description", "manufacturer", "manufacturer_part"]


@query("SRC-01-PIPES", _TEXT.replace("coalesce(manufacturer, '') as manufacturer", "manufacturer"))
def pipes(d):
    return readers.delimited(d.spark, items_as_text(d), _COLUMNS).withColumn("manufacturer", F.nullif("manufacturer", F.lit("")))


@query("SRC-02", "select item_id, description || chr(10) || 'x' as description from item_master")
def relaxed(d):
    path = place(d, "quoted")
    d.item_master.select("item_id", F.concat("description", F.lit("\nx")).alias("description")).write.option("header", True).option("sep", "|").option("quote", '"').option("escape", '"').csv(path)
    return readers.delimited(d.spark, path, ["item_id", "description"], relaxed=True)


@query("SRC-03", "select item_id, price from item_master")
def explicit(d):
    path = place(d, "typed")
    d.item_master.select("item_id", "price").write.option("header", True).csv(path)
    return d.spark.read.option("header", True).schema("item_id string, price double").csv(path)


@query("SRC-04", "select cast(p_partkey as int) as p_partkey, p_size from part")
def inferred(d):
    path = place(d, "inferred")
    d.part.select("p_partkey", "p_size").write.option("header", True).csv(path)
    return readers.inferred(d.spark, path)


@query("SRC-05", _TEXT)
def blanks(d):
    return readers.delimited(d.spark, items_as_text(d), _COLUMNS, keep_blanks=True)


@query("SRC-10", "select item_id, description, case cast(item_id as int) % 3 when 0 then 0 when 1 then 1 else 2 end as part from item_master")
def in_parts(d):
    """Three parts of a feed, one with its columns in another order; part_10 comes last."""
    path, n = place(d, "parts"), F.col("item_id").cast("int") % 3
    for name, rest, columns in (("part_1", 0, ["item_id", "description"]), ("part_2", 1, ["description", "item_id"]), ("part_10", 2, ["item_id", "description"])):
        d.item_master.where(n == rest).select(*columns).write.option("header", True).csv(f"{path}/{name}")
    rows = readers.parts(d.spark, f"{path}/missing_*/*.csv", f"{path}/part_*/*.csv")
    folder = F.regexp_extract("_source_file", "/part_([0-9]+)/", 1)
    order = rows.groupBy(folder.alias("folder")).agg(F.min("_source_index").alias("first"))
    place_of = order.select("folder", (F.row_number().over(W.orderBy("first")) - 1).alias("part"))  # three rows
    return rows.withColumn("folder", folder).join(F.broadcast(place_of), "folder").select("item_id", "description", "part")


@query("SRC-14", "select '|' as delimiter")
def sniffed(d):
    return d.spark.createDataFrame([(readers.sniff(d.spark, items_as_text(d)),)], "delimiter string")


@query("SRC-15", "select count(*) as lines from item_master")
def counted(d):
    return d.spark.read.text(items_as_text(d, header="false")).agg(F.count("*").alias("lines"))


@query("SNK-01", "select manufacturer, count(*) as items from item_master group by 1")
def table_as(d):
    path = place(d, "table")
    d.item_master.groupBy("manufacturer").agg(F.count("*").alias("items")).write.mode("overwrite").parquet(path)
    return d.spark.read.parquet(path)


@query("SNK-02", _TEXT)
def csv(d):
    return d.spark.read.option("header", True).schema(readers.strings(_COLUMNS)).csv(items_as_text(d, sep=",")).na.fill("")


@query("SNK-03", "select item_id from item_master")
def parts(d):
    path = place(d, "parts")
    sinks.csv_parts(d.item_master.select("item_id"), path, rows_per_file=500)
    return d.spark.read.option("header", True).schema("item_id string").csv(path)


@query("SNK-04", "select 'items' as sheet, count(*) as rows from item_master union all select 'contracts', count(*) from contracts")
def sheets(d):
    n = lambda df, name: df.agg(F.lit(name).alias("sheet"), F.count("*").alias("rows"))
    return n(d.item_master, "items").unionAll(n(d.contracts, "contracts"))


@query("SNK-05-NAMES", 'select item_id as "ITEM_ID", description as "DESCRIPTION", price as "PRICE" from item_master')
def published(d):
    return sinks.published(d.item_master.select("item_id", "description", "price"))


@query("SNK-06", "select item_id, price from after")
def replaced(d):
    store = sinks.Versions(d.spark, place(d, "store"))
    store.commit({"items": d.before.select("item_id", "price")})
    store.commit({"items": d.after.select("item_id", "price")})
    return store.read("items")


@query("SNK-07", "select item_id, price from before")
def committed(d):
    store = sinks.Versions(d.spark, place(d, "store"))
    store.commit({"items": d.before.select("item_id", "price")})
    try:
        store.commit({"items": d.after.select("item_id", "price")}, check=lambda name, df: df.where("price is null").isEmpty())
    except ValueError:
        pass  # the version that fails its check is never seen
    return store.read("items")


@query("SNK-08", "select (select count(*) from item_master) as total, item_id from item_master order by item_id limit 20 offset 20")
def paged(d):
    got = sinks.page(d.item_master.select("item_id"), ["item_id"], 20, 20)
    return d.spark.createDataFrame([(got["total"], r["item_id"]) for r in got["rows"]], "total long, item_id string")


_FILES = "select cast(event_id as varchar) as name, user_id as bytes, event_id % 3 as modified, md5(props) as hash from logs"


@query("INC-01", f"""with b as ({_FILES} where event_id % 7 <> 1), a as (select name, bytes + case when cast(name as int) % 11 = 2 then 1 else 0 end as bytes, modified + case when cast(name as int) % 5 = 0 then 1 else 0 end as modified,
    case when cast(name as int) % 10 = 5 then 'x' else hash end as hash from ({_FILES} where event_id % 9 <> 1))
    select coalesce(b.name, a.name) as name, case when b.name is null then 'NEW' when a.name is null then 'GONE' when a.bytes = b.bytes and (a.modified = b.modified or a.hash = b.hash) then 'UNCHANGED' else 'CHANGED' end as state
    from b full join a on b.name = a.name""")
def files(d):
    """Deliveries as files of two manifests: some come, some go, some have another size, time or content."""
    n = F.col("event_id")
    f = lambda keep, bytes_, time, text: d.logs.where(keep).select(n.cast("string").alias("name"), bytes_.alias("bytes"), time.alias("modified"), text.alias("sha256"))
    size, time, text = F.col("user_id"), n % 3, F.md5("props")
    before = f(n % 7 != 1, size, time, text)
    after = f(n % 9 != 1, size + F.when(n % 11 == 2, 1).otherwise(0), time + F.when(n % 5 == 0, 1).otherwise(0), F.when(n % 10 == 5, "x").otherwise(text))
    return N.file_states(before, after)


@query("INC-02", """with b as (select vendor, count(*) as n, sum(cast(item_id as bigint)) as s, count(price) as p from contracts where vendor <> 'V3' group by 1), a as (select vendor, count(*) as n, sum(cast(item_id as bigint)) as s, count(price) as p from contracts where cast(item_id as int) % 500 <> 7 group by 1)
    select a.vendor, b.vendor is null as missing, b.vendor is null or b.n <> a.n or b.s <> a.s or b.p <> a.p as rebuild from a left join b on a.vendor = b.vendor""")
def rebuild(d):
    """Vendors whose contracts have another fingerprint than when they were mapped, or none, must be mapped in full."""
    def prints(k):
        return k.groupBy("vendor").agg(F.md5(F.concat_ws("|", F.count("*"), F.sum(F.col("item_id").cast("long")), F.count("price"))).alias("print"))

    was = prints(d.contracts.where("vendor <> 'V3'")).withColumnRenamed("print", "was")
    now = prints(d.contracts.where(F.col("item_id").cast("int") % 500 != 7))
    return now.join(was, "vendor", "left").select("vendor", F.col("was").isNull().alias("missing"), (~F.col("was").eqNullSafe(F.col("print"))).alias("rebuild"))


_ALL = "select action as entity, cast(event_id as string) as name, ts as arrived from logs"


def deliveries(d):
    return d.logs.select(F.col("action").alias("entity"), F.col("event_id").cast("string").alias("name"), F.col("ts").alias("arrived"))


@query("INC-11-ALL", f"with x as ({_ALL}) select entity, name, cast(row_number() over (partition by entity order by arrived, name) as int) as version, case when entity = 'error' then 'MERGED_CONSOLIDATED' when row_number() over (partition by entity order by arrived desc, name desc) = 1 then 'ACTIVE' else 'SUPERSEDED' end as status from x")
def catalogued_all(d):
    """Versions and states in one pass, without a persisted catalog."""
    x = deliveries(d)
    return N.catalog(x, x.where("entity = 'error'").select("entity")).drop("arrived")


@query("API-10-ALL", f"with x as ({_ALL}) select entity, count(*) as versions from x group by 1")
def versions_all(d):
    return N.catalog(deliveries(d)).groupBy("entity").agg(F.count("*").alias("versions"))


_FEED_NAMES = ["site_PO_", "Invoice-", "contracts ", "Item_Master_", "consumption", "readme"]
_FEED_NAME = f"list_extract({_FEED_NAMES}, cast(event_id % 6 + 1 as int)) || cast(event_id as varchar) || '.csv'"


@query("GRD-13", f"""with x as (select lower({_FEED_NAME}) as f from logs) select case {' '.join(f"when regexp_matches(f, '{p}') then '{k}'" for k, p in readers.FILE_NAMES.items())} else 'unknown' end as kind, count(*) as files from x group by 1""")
def kinds(d):
    """Deliveries by the kind that their file name tells."""
    name = F.concat(F.try_element_at(F.array(*map(F.lit, _FEED_NAMES)), (F.col("event_id") % 6 + 1).cast("int")), F.col("event_id").cast("string"), F.lit(".csv"))
    return d.logs.groupBy(readers.kind_of_file(name).alias("kind")).agg(F.count("*").alias("files"))


@query("GRD-14", "select item_id, description, cast(null as varchar) as list_price from item_master")
def stub(d):
    """Items with the prices of a feed that is missing: a stub without rows stands for it."""
    prices = readers.or_empty(d.spark, place(d, "nowhere"), ["item_id", "list_price"])
    return d.item_master.select("item_id", "description").join(prices, "item_id", "left")


@query("UDF-01", "select item_id, upper(description) as label from item_master")
def model(d):
    step = lambda df: df.select("item_id", F.upper("description").alias("label"))
    return d.item_master.transform(step)


@query("UDF-07")
def similarity(d):
    from ..operators.matching import fuzzy_vendors

    names = d.aliases.select(F.regexp_replace(F.upper("alias"), "SUPPLIER", "SUPPLER").alias("name"))
    return fuzzy_vendors(names, d.supplier.select(F.upper("s_name").alias("standard")).distinct())


_GOOD = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


@query("UDF-09", f"""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where {_GOOD}),
    p as (select a.vec_id, k.vec_id as near, 1 - list_cosine_similarity(a.e, k.e) as dist from v a, v k where k.vec_id < 64 and a.vec_id >= 64)
    select cast(vec_id as varchar) as name, cast(near as varchar) as nearest from p where dist < 15e-1 qualify row_number() over (partition by vec_id order by dist, cast(near as varchar)) = 1""")
def signature(d):
    """Vectors as signatures, the first 64 as known ones."""
    good = d.embeddings.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    named = good.select("vec_id", F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("vector"))
    return N.nearest_signature(named.where("vec_id >= 64"), named.where("vec_id < 64"), most=1.5).select("name", "nearest")


@query("DOC-02", "select c.row_id, min(m.item_id) as item_id from consumption c join item_master m on regexp_replace(upper(c.catalog_number), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(m.manufacturer_part), '[^A-Z0-9]', '', 'g') group by 1")
def bare_catalog(d):
    bare = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "").alias("k")
    known = d.item_master.groupBy(bare("manufacturer_part")).agg(F.min("item_id").alias("item_id"))
    return d.consumption.select("row_id", bare("catalog_number")).join(known, "k").select("row_id", "item_id")


@query("DOC-05", "select po_number, po_line from purchase_orders qualify row_number() over (partition by po_number order by updated desc, po_date desc, po_line) = 1")
def latest_by_both(d):
    return O.pick(d.purchase_orders, ["po_number"], [F.desc("updated"), F.desc("po_date"), F.col("po_line")]).select("po_number", "po_line")


@query("DOC-07", "select count(*) filter (price < 0) as negative_prices, count(*) filter (manufacturer is null) * 100e0 / count(*) > 10 as null_spike, (select count(*) from (select distinct facility from consumption) where facility not in ('1-URGENT', '2-HIGH', '3-MEDIUM')) as unknown_facilities from item_master")
def lexicon(d):
    known = d.spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",)], "facility string")
    unknown = d.consumption.select("facility").distinct().join(known, "facility", "left_anti").agg(F.count("*").alias("unknown_facilities"))
    one = d.item_master.agg(F.count_if(F.col("price") < 0).alias("negative_prices"), (F.count_if(F.col("manufacturer").isNull()) * F.lit(100.0) / F.count("*") > 10).alias("null_spike"))
    return one.join(F.broadcast(unknown))


@query("DOC-10", "select row_id, case when unit_price / nullif(client_contract_price, 0) between 95e-1 and 105e-1 then unit_price / 10 else unit_price end as price from consumption")
def corrected(d):
    ratio = F.col("unit_price") / F.nullif("client_contract_price", F.lit(0.0))
    return d.consumption.select("row_id", F.when(ratio.between(9.5, 10.5), F.col("unit_price") / 10).otherwise(F.col("unit_price")).alias("price"))


@query("DOC-11", "select row_id, unit_price / 10 as each_price, (unit_price / 10 - client_contract_price) * quantity as each_savings from consumption where upper(trim(uom)) in ('BX', 'BOX')")
def each_price(d):
    box = d.consumption.where(F.upper(F.trim("uom")).isin("BX", "BOX"))
    each = F.col("unit_price") / P.pack_factor(F.lit("BX/10"))
    return box.select("row_id", each.alias("each_price"), ((each - F.col("client_contract_price")) * F.col("quantity")).alias("each_savings"))


@query("API-11-STATES", "select status, count(*) as rows from (select case when trim(item_id) = '' or trim(vendor) = '' then 'MISSING_MAPPING_KEY' when service_date is null then 'INVALID_CONSUMPTION_DATE' else 'MAPPED' end as status from consumption) group by 1")
def one_shot(d):
    """The mapper end to end: base rows, historical contracts for the eligible ones, a count per state."""
    from ..operators.matching import historical

    item, vendor = C.item_key(F.col("item_id")), C.vendor_key(F.col("vendor"))
    status = F.when((item == "") | (vendor == ""), "MISSING_MAPPING_KEY").when(F.col("service_date").isNull(), "INVALID_CONSUMPTION_DATE").otherwise("MAPPED")
    rows = d.consumption.select("row_id", item.alias("item_id"), vendor.alias("vendor"), F.col("service_date").alias("day"), status.alias("status"))
    mapped = historical(rows.where("status = 'MAPPED'"), d.contracts, "row_id").select(F.lit("MAPPED").alias("status"))
    return rows.where("status <> 'MAPPED'").select("status").unionAll(mapped).groupBy("status").agg(F.count("*").alias("rows"))


@query("INC-17-STATE", "select item_id, price from before")
def resumed(d):
    """A run's state is a committed version: reading it back resumes where it was."""
    store = sinks.Versions(d.spark, place(d, "run"))
    states = I.row_states(d.before, d.before, "item_id", ["price"])
    store.commit({"results": d.before.select("item_id", "price"), "states": states})
    return store.read("results").join(store.read("states").where("state = 'UNCHANGED'").select("item_id"), "item_id", "left_semi")
