"""Incremental operators: change windows, reuse or recompute, merges of deliveries, versions, late mutations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import anti_null_safe
from .windows import pick


def change_windows(before: DataFrame, after: DataFrame, keys: list[str], start: str, end: str, lookback_months: int = 6) -> DataFrame:
    """(keys, since, until): the days whose results a changed contract row may change; an open end has no until."""
    columns = after.columns
    moved = anti_null_safe(before, after, columns).unionByName(anti_null_safe(after, before, columns))
    until = F.when(F.count_if(F.col(end).isNull()) > 0, F.lit(None).cast("date")).otherwise(F.add_months(F.max(end), lookback_months))
    return moved.groupBy(*keys).agg(F.min(start).alias("since"), until.alias("until"))


def touched(rows: DataFrame, windows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Rows in a change window of their keys."""
    inside = (F.col(day) >= F.col("since")) & (F.col("until").isNull() | (F.col(day) <= F.col("until")))
    return rows.join(windows, keys).where(inside).select(*rows.columns).distinct()


def row_states(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, state) by a hash of the fields: NEW, CHANGED, UNCHANGED or DELETED."""
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields)))
    b, a = before.select(key, digest.alias("b")), after.select(key, digest.alias("a"))
    state = F.when(F.col("b").isNull(), "NEW").when(F.col("a").isNull(), "DELETED").when(F.col("a") != F.col("b"), "CHANGED").otherwise("UNCHANGED")
    return b.join(a, key, "full_outer").select(key, state.alias("state"))


def reuse(results: DataFrame, fresh: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Results of unchanged rows as they were, of new and changed rows as computed anew; deleted rows are gone."""
    kept = results.join(states.where("state = 'UNCHANGED'").select(key), key, "left_semi")
    return kept.unionByName(fresh.join(states.where("state in ('NEW', 'CHANGED')").select(key), key, "left_semi"))


def merge(deliveries: list[DataFrame], keys: list[str], strategy: str) -> DataFrame:
    """Deliveries in order of arrival: latest_wins keeps the last row of each key, union_distinct distinct rows,
    additive_append every row, new_keys only rows whose key is new."""
    if strategy == "new_keys":
        return reduce(lambda a, b: a.unionByName(b.join(a.select(*keys).distinct(), keys, "left_anti")), deliveries)
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x.withColumn("_version", F.lit(i)) for i, x in enumerate(deliveries)))
    if strategy == "additive_append":
        return every.drop("_version")
    if strategy == "union_distinct":
        return every.drop("_version").distinct()
    if strategy == "latest_wins":
        others = [c for c in every.columns if c not in (*keys, "_version")]
        return pick(every, keys, [F.desc("_version"), *(F.col(c).asc_nulls_last() for c in others)]).drop("_version")
    raise ValueError(strategy)


def scd2(history: DataFrame, delivery: DataFrame, keys: list[str], fields: list[str], at: Column) -> DataFrame:
    """History (keys, fields, valid_from, valid_to) after a delivery at a time: changed and missing rows are closed, new and
    changed ones opened."""
    now = history.where("valid_to is null")
    d = delivery.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_there"))
    both = now.join(d, keys, "left")
    differs = reduce(lambda a, b: a | b, (~F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields))
    ends = F.col("_there").isNull() | differs
    closed = both.withColumn("valid_to", F.when(ends, at)).select(history.columns)
    same = now.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_known"))
    opened = delivery.select(*keys, *fields).join(same, keys, "left").where(F.col("_known").isNull() | differs)
    opened = opened.withColumns({"valid_from": at, "valid_to": F.lit(None).cast(history.schema["valid_to"].dataType)}).select(history.columns)
    return history.where("valid_to is not null").unionByName(closed).unionByName(opened)


def mutate(current: DataFrame, late: DataFrame, keys: list[str], mode: str | None) -> DataFrame:
    """Late rows under a mode, with record_status. UPSERT_OVERWRITE: late rows replace; SPLIT_AUDIT_TRAIL: replaced rows stay as
    SUPERSEDED; PRESERVE_HISTORIC_RECORD: known keys keep their row and the late one is LEDGERED. Without a mode every row of a
    key that would change is REVIEW_REQUIRED."""
    hit = late.select(*keys).distinct()
    known = current.select(*keys).distinct()
    tag = lambda df, s: df.withColumn("record_status", F.lit(s))
    others, replaced = current.join(hit, keys, "left_anti"), current.join(hit, keys, "left_semi")
    fresh, again = late.join(known, keys, "left_anti"), late.join(known, keys, "left_semi")
    parts = {
        "UPSERT_OVERWRITE": [(others, "ACTIVE"), (late, "ACTIVE")],
        "SPLIT_AUDIT_TRAIL": [(others, "ACTIVE"), (replaced, "SUPERSEDED"), (late, "ACTIVE")],
        "PRESERVE_HISTORIC_RECORD": [(current, "ACTIVE"), (fresh, "ACTIVE"), (again, "LEDGERED")],
        None: [(others, "ACTIVE"), (replaced, "REVIEW_REQUIRED"), (fresh, "ACTIVE"), (again, "REVIEW_REQUIRED")],
    }[mode]
    return reduce(lambda a, b: a.unionByName(b), (tag(df, s) for df, s in parts))


def schema_drift(expected: dict[str, str], df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, change, severity): MISSING is high, RETYPED medium, NEW low."""
    have = dict(df.dtypes)
    out = [(c, "MISSING", "HIGH") for c in expected if c not in have]
    out += [(c, "RETYPED", "MEDIUM") for c, t in expected.items() if c in have and have[c] != t]
    return sorted(out + [(c, "NEW", "LOW") for c in have if c not in expected])
