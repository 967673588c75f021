"""Data profiles and drift: one pass of aggregates a table, then a small unpivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import cents


def _rows(one: DataFrame, structs: list[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, rows, nulls, distinct_values)."""
    one = df.agg(F.count("*").alias("rows"), *(F.count(c).alias(f"n_{c}") for c in columns), *(F.count_distinct(c).alias(f"d_{c}") for c in columns))
    return _rows(one, [F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("rows"), (F.col("rows") - F.col(f"n_{c}")).alias("nulls"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])


def null_drift(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, before_null, after_null) in percent."""
    rate = lambda df, p: df.agg(*((F.count_if(F.col(c).isNull()) * F.lit(100.0) / F.count("*")).alias(f"{p}_{c}") for c in columns))
    both = rate(before, "b").join(F.broadcast(rate(after, "a")))  # one row each
    return _rows(both, [F.struct(F.lit(c).alias("column_name"), F.col(f"b_{c}").alias("before_null"), F.col(f"a_{c}").alias("after_null")) for c in columns])


def modified_fields(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column_name, modified) over the rows of both."""
    a = after.select(key, *(F.col(c).alias(f"a_{c}") for c in columns))
    one = before.join(a, key).agg(*(F.count_if(~F.col(c).eqNullSafe(F.col(f"a_{c}"))).alias(f"m_{c}") for c in columns))
    return _rows(one, [F.struct(F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("modified")) for c in columns])


def number_drift(before: DataFrame, after: DataFrame, column: str, percent: float) -> DataFrame:
    """Means and medians of a column and whether the mean moved by more than percent."""
    one = lambda df, p: df.agg(F.avg(column).alias(f"{p}m"), F.median(column).alias(f"{p}q"))
    both = one(before, "b").join(F.broadcast(one(after, "a")))
    moved = F.abs(F.col("am") - F.col("bm")) / F.nullif(F.abs("bm"), F.lit(0.0)) * 100 > percent
    return both.select(cents(F.col("bm")).alias("before_mean"), cents(F.col("am")).alias("after_mean"), cents(F.col("bq")).alias("before_median"), cents(F.col("aq")).alias("after_median"), moved.alias("alert"))


def parity(left: DataFrame, right: DataFrame, metrics: dict[str, tuple[Column, float]]) -> DataFrame:
    """(metric, left_value, right_value, difference, tolerance, equal) of two stores of one table: each metric is an aggregate with the
    share of the left value by which the right one may differ. One pass over each side."""
    names = list(metrics)
    l, r = (df.agg(*(metrics[n][0].cast("double").alias(n) for n in names)).first() for df in (left, right))
    rows = []
    for n in names:
        a, b = (float(x[n] or 0.0) for x in (l, r))
        rows.append((n, a, b, abs(a - b), metrics[n][1], abs(a - b) <= metrics[n][1] * abs(a)))
    return left.sparkSession.createDataFrame(rows, "metric string, left_value double, right_value double, difference double, tolerance double, equal boolean")
