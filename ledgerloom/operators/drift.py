"""The record-drift report of two deliveries of a feed: volume, churn, changed fields, null rates, numbers and samples, as long rows.

Churn and changed fields come from one full outer join and one aggregate of it, null rates and numbers from one aggregate of each
delivery; medians from counts of values by ranges, so that no task holds a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

REPORT = "section string, name string, before double, after double, change double, severity string"
NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


def median(df: DataFrame, column: str) -> float | None:
    """The exact median: values with their counts by ranges, the range with the middle by sums, and the middle inside that range."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counted.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "values")
    sizes = sorted(ranged.groupBy("part").agg(F.sum("n")).collect())  # a row for each range
    total = sum(n for _, n in sizes)
    if not total:
        return None
    found = []
    for at in {(total - 1) // 2, total // 2}:
        before = 0
        for part, n in sizes:
            if before + n > at:
                upto = F.sum("n").over(W.orderBy("v"))
                row = ranged.where(F.col("part") == part).withColumn("upto", upto).where(F.col("upto") > at - before).agg(F.min("v")).first()
                found.append(row[0])
                break
            before += n
    return sum(found) / len(found)


def _round(x: float, digits: int) -> float:
    return round(x + (1e-9 if x >= 0 else -1e-9), digits)


def report(before: DataFrame, after: DataFrame, keys: list[str], top: int = 8, samples: int = 15) -> tuple[DataFrame, DataFrame]:
    """(REPORT rows, samples of changed fields (key, field, before, after)) of two deliveries with some columns in common.

    Severity of volume: LOW under 5 %, MEDIUM under 20 %, else HIGH; of a field by the share of common rows that changed (5, 20 %); of a
    null rate STABLE, WARNING over 3 points more, SEVERE over 10; of a number ALERT if its mean moves by over half or its
    greatest value more than five times. Fields and null rates are the ``top`` by change. Keys should be unique.
    """
    spark = before.sparkSession
    both = [c for c in before.columns if c in after.columns]
    keys = [k for k in keys if k in both] or both[:1]
    fields = [c for c in both if c not in keys]
    numbers = [c for c in fields if dict(after.dtypes)[c].startswith((*NUMERIC, "decimal")) and dict(before.dtypes)[c].startswith((*NUMERIC, "decimal"))]
    x = lambda c: F.col(c).cast("double")

    def facts(df: DataFrame) -> dict:
        parts = [F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in both)]
        parts += [f(x(c)).alias(f"{n} {c}") for c in numbers for n, f in (("mean", F.avg), ("max", F.max))]
        return df.agg(*parts).first().asDict()

    b, a = facts(before), facts(after)
    left = before.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.struct(*fields).alias("b") if fields else F.lit(True).alias("b"))
    right = after.select(*(F.col(k).alias(f"q{i}") for i, k in enumerate(keys)), F.struct(*fields).alias("a") if fields else F.lit(True).alias("a"))
    on = [F.col(f"k{i}") == F.col(f"q{i}") for i in range(len(keys))]
    joined = left.join(right, on, "full_outer")
    common = F.col("b").isNotNull() & F.col("a").isNotNull()
    differ = {f: common & ~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")) for f in fields}
    some = F.lit(False)
    for d in differ.values():
        some = some | d
    churn = joined.agg(
        F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("dropped"), F.count_if(some).alias("modified"), F.count_if(common).alias("common"),
        *(F.count_if(d).alias(f"field {f}") for f, d in differ.items()),
    ).first().asDict()
    out = []
    delta = a["rows"] - b["rows"]
    share = _round(delta / max(1, b["rows"]) * 100, 2)
    out.append(("volume", "rows", b["rows"], a["rows"], share, "LOW" if abs(share) < 5 else "MEDIUM" if abs(share) < 20 else "HIGH"))
    for name, n, of in (("added", churn["added"], a["rows"]), ("modified", churn["modified"], a["rows"]), ("dropped", churn["dropped"], b["rows"]), ("unchanged", churn["common"] - churn["modified"], a["rows"])):
        out.append(("churn", name, None, n, _round(n / max(1, of) * 100, 1), None))
    changed = sorted(((-churn[f"field {f}"], i, f) for i, f in enumerate(fields) if churn[f"field {f}"]))[:top]
    for n, _, f in changed:
        share = _round(-n / max(1, churn["common"]) * 100, 1)
        out.append(("field", f, None, -n, share, "HIGH" if share > 20 else "MEDIUM" if share > 5 else "LOW"))
    rates = []
    for i, c in enumerate(both):
        p, q = (_round(t[f"null {c}"] / max(1, t["rows"]) * 100, 2) for t in (b, a))
        d = _round(q - p, 2)
        if abs(d) >= 1 or q > 10:
            rates.append((-abs(d), i, ("null_rate", c, p, q, d, "SEVERE" if d > 10 else "WARNING" if d > 3 else "STABLE")))
    out += [r for *_, r in sorted(rates)[:top]]
    for c in numbers:
        (m, most), (m2, most2) = ((_round(t[f"mean {c}"] or 0.0, 2), _round(t[f"max {c}"] or 0.0, 2)) for t in (b, a))
        moved = _round((m2 - m) / max(0.001, abs(m)) * 100, 1) if m else 0.0
        alert = abs(moved) > 50 or (most > 0 and most2 > 5 * most)
        out.append(("mean", c, m, m2, moved, "ALERT" if alert else "STABLE"))
        out.append(("max", c, most, most2, _round((most2 - most) / max(1.0, most) * 100, 1), None))
        out.append(("median", c, *(_round(median(df, c) or 0.0, 2) for df in (before, after)), None, None))
    rows = [(s, n, *(None if v is None else float(v) for v in (p, q, d)), e) for s, n, p, q, d, e in out]
    shown = F.filter(F.array(*(F.when(d, F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("before"), F.col(f"a.{f}").cast("string").alias("after"))) for f, d in list(differ.items())[:5])), lambda v: v.isNotNull()) if fields else F.array()
    sample = joined.where(some).orderBy(*(f"k{i}" for i in range(len(keys)))).limit(samples).select(F.col("k0").cast("string").alias("key"), F.explode(shown).alias("x")).select("key", "x.*")
    return spark.createDataFrame(rows, REPORT), sample
