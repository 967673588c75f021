"""Files and their versions as tables: manifest, catalog, fingerprints, checkpoints of runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, modified, sha256) of the files under a path, hashed where they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def file_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, state): NEW, CHANGED, UNCHANGED or GONE; a file of the same size and time isn't compared by content."""
    b = before.select("name", F.col("bytes").alias("b_bytes"), F.col("modified").alias("b_modified"), F.col("sha256").alias("b_sha"))
    same = (F.col("bytes") == F.col("b_bytes")) & ((F.col("modified") == F.col("b_modified")) | (F.col("sha256") == F.col("b_sha")))
    state = F.when(F.col("b_bytes").isNull(), "NEW").when(F.col("bytes").isNull(), "GONE").when(same, "UNCHANGED").otherwise("CHANGED")
    return b.join(after, "name", "full_outer").select("name", state.alias("state"))


def catalog(deliveries: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """deliveries (entity, name, arrived) with version and status: the last of an entity is ACTIVE, others SUPERSEDED, and all of
    merged (entity) MERGED_CONSOLIDATED. Versions are places in range partitions plus the entity's rows in those before, so an
    entity of many deliveries is split."""
    parts = int(deliveries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: partition ids must agree below
    deliveries = deliveries.select("entity", "name", "arrived")  # both uses of the ranges below read the same columns
    ranged = deliveries.repartitionByRange(parts, "entity", "arrived", "name").withColumn("_part", F.spark_partition_id())
    placed = ranged.withColumn("_place", F.row_number().over(W.partitionBy("_part", "entity").orderBy("arrived", "name")))
    sizes = placed.groupBy("_part", "entity").agg(F.max("_place").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("entity").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_part").alias("_p"), F.col("entity").alias("_e"), before.alias("_before"), F.sum("_n").over(W.partitionBy("entity")).alias("_last"))
    status = F.when(F.col("version") == F.col("_last"), "ACTIVE").otherwise("SUPERSEDED")
    if merged is not None:
        sizes = sizes.join(merged.select(F.col("entity").alias("_e"), F.lit(True).alias("_merged")).distinct(), "_e", "left")
        status = F.when(F.col("_merged"), "MERGED_CONSOLIDATED").otherwise(status)
    out = placed.join(sizes, (F.col("_part") == F.col("_p")) & F.col("entity").eqNullSafe(F.col("_e")))
    out = out.withColumn("version", (F.col("_before") + F.col("_place")).cast("int"))
    return out.withColumn("status", status).select("entity", "name", "arrived", "version", "status")


def fingerprint(settings: dict) -> str:
    """Equal settings have equal fingerprints, however they are ordered."""
    import hashlib

    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def must_rebuild(stored: str | None, settings: dict, snapshots_there: bool) -> bool:
    return stored != fingerprint(settings) or not snapshots_there


#: Most seed vectors that a column is compared with.
SEEDS = 4096


def nearest_signature(columns: DataFrame, known: DataFrame, most: float = 0.45) -> DataFrame:
    """(name, nearest, distance): each column's nearest known signature by cosine distance of vectors, if near enough.

    known is a seed table of at most SEEDS rows, which is gone over in full for each column, so no near one is missed; a longer
    table is an error.
    """
    seeds = known.select("name", F.col("vector").cast("array<double>")).orderBy("name").limit(SEEDS + 1).collect()
    if len(seeds) > SEEDS:
        raise ValueError(f"over {SEEDS} known signatures")
    if not seeds:
        return columns.sparkSession.createDataFrame([], "name string, nearest string, distance double")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda a: F.sqrt(dot(a, a))
    table = columns.sparkSession.createDataFrame([(seeds,)], "seeds array<struct<nearest:string,b:array<double>>>")
    rows = columns.select("name", F.col("vector").cast("array<double>").alias("a")).join(F.broadcast(table))  # one row
    away = F.transform("seeds", lambda s: F.struct((1 - dot(F.col("a"), s["b"]) / (size(F.col("a")) * size(s["b"]))).alias("distance"), s["nearest"].alias("nearest")))
    rows = rows.select("name", F.array_min(F.filter(away, lambda x: x["distance"] < most)).alias("x")).where("x is not null")
    return rows.groupBy("name").agg(F.min("x").alias("x")).select("name", "x.nearest", "x.distance")
