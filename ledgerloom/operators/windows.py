"""Window operators: de-duplication, priority picks, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def pick(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; order must be total for a defined result."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def latest(df: DataFrame, keys: list[str], by: str, *ties: str) -> DataFrame:
    """De-duplicate: the row with the latest ``by`` of each key, nulls last."""
    return pick(df, keys, [F.col(by).desc_nulls_last(), *(F.col(t) for t in ties)])


def previous_end(df: DataFrame, keys: list[str], start: str, end: str, *ties: str) -> DataFrame:
    """With previous_end: the greatest end of the rows before, in the order of (start, end)."""
    w = W.partitionBy(*keys).orderBy(F.col(start), F.col(end).asc_nulls_last(), *(F.col(t) for t in ties)).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("previous_end", F.max(end).over(w))


def mode(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """The most frequent non-null value of each key, ties to the smallest."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counted.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col("count"), F.col(value))).alias(alias))


def row_ids(df: DataFrame, keys: list[str], alias: str = "row_number") -> DataFrame:
    """Numbers from 1 in the order of keys, nulls last, without gathering the rows in one task: positions inside range partitions
    plus the sizes of the partitions before. Columns other than the keys break no ties; equal rows get numbers in any order.

    The ranges are drawn by a sample, so the ranged rows are written once: numbers and sizes must be of the same ranges.
    """
    part, place, n, before = (_unused(x, df, alias) for x in ("part", "place", "n", "before"))
    order = [F.col(k).asc_nulls_last() for k in keys]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(part).agg(F.count("*").alias(n))
    running = F.sum(n).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))  # over as many rows as there are partitions
    sizes = sizes.select(part, F.coalesce(running, F.lit(0)).alias(before))
    placed = ranged.withColumn(place, F.row_number().over(W.partitionBy(part).orderBy(*order)))
    return placed.join(F.broadcast(sizes), part).withColumn(alias, F.col(before) + F.col(place)).drop(part, place, before)


def _unused(name: str, df: DataFrame, *more: str) -> str:
    taken = {c.lower() for c in (*df.columns, *more)}
    while name in taken:
        name += "_"
    return name
