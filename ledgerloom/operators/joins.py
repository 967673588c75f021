"""Join operators beyond plain equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import pick


def blank_equal(left: Column, right: Column) -> Column:
    """Null equals blank."""
    return F.coalesce(left, F.lit("")) == F.coalesce(right, F.lit(""))


def valid_on(day: Column, start: Column, end: Column) -> Column:
    """Within the interval; an open end never ends."""
    return (day >= start) & (day <= F.coalesce(end, F.lit("2099-12-31").cast("date")))


def anti_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys are no row of right; null equals null."""
    r = right.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return left.join(r, reduce(lambda a, b: a & b, (left[k].eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti")


def join_spread(left: DataFrame, right: DataFrame, key: str, how: str, by: str, n: int = 64) -> DataFrame:
    """An inner or left join on key that deals left's many blank keys out over n tasks, by a hash of the column ``by``; right's rows with a
    blank key, if there are any, go to all of them."""
    blank = F.col(key) == ""
    left = left.withColumn("_part", F.when(blank, F.pmod(F.xxhash64(by), F.lit(n)).cast("int")).otherwise(0))
    right = right.withColumn("_part", F.explode(F.when(blank, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_part"], how).drop("_part")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], day: str, other_day: str, within: int, left_key: list[str], ties: list[str]) -> DataFrame:
    """As-of join: each left row with the right row of its keys whose day is nearest, at most ``within`` days away; a later day, then ties,
    decide. Rows with one left key have the same keys.

    Right rows become one row for their keys, in which each left row picks its own; so both sides are shuffled once, by keys,
    and pairs are neither made nor shuffled.
    """
    order = [other_day, *ties, *(c for c in right.columns if c not in (other_day, *keys, *ties))]
    rows = right.where(F.col(other_day).isNotNull()).repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct(*order)).alias("_rows"))
    gap = lambda r: F.abs(F.datediff(r[other_day], F.col(day)))
    near = F.transform(F.filter("_rows", lambda r: gap(r) <= within), lambda r: F.struct(gap(r).alias("day_gap"), (-F.unix_date(r[other_day])).alias("_late"), *(r[c].alias(c) for c in order)))
    both = left.join(rows, keys).select(*left.columns, F.array_min(near).alias("_one")).where("_one is not null")
    both = both.select(*left.columns, *(F.col(f"_one.{c}") for c in order), "_one.day_gap")
    return pick(both, [*keys, *left_key], [F.col("day_gap"), F.col(other_day).desc(), *(F.col(t) for t in ties)])


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): ADDED, REMOVED, CHANGED or SAME by a full outer join with null-safe comparison."""
    b = before.select(F.col(key).alias("_b"), *(F.col(f).alias(f"_b_{f}") for f in fields))
    a = after.select(F.col(key).alias("_a"), *(F.col(f).alias(f"_a_{f}") for f in fields))
    same = reduce(lambda x, y: x & y, (F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}")) for f in fields))
    change = F.when(F.col("_b").isNull(), "ADDED").when(F.col("_a").isNull(), "REMOVED").when(~same, "CHANGED").otherwise("SAME")
    return b.join(a, F.col("_b") == F.col("_a"), "full_outer").select(F.coalesce("_b", "_a").alias(key), change.alias("change"))
