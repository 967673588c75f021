"""Mixing sources to target weights (operator 11), in DataFrame functions only.

Capped water-filling: the mix has ``share`` times the corpus' words. Sources share them by weight; a source whose share is above
``epochs`` times its size is clamped there, and the excess goes to the others by weight until none is above. In the order of
size / weight the clamped sources come first, so running sums find the common level at once: with c the clamped sources' caps and
W the others' weights, it is (share * total - c) / W. Sums and comparisons are of integers, so targets don't depend on any order.

A source's target is taken as whole repetitions of all its documents and a fractional one: documents in a seeded order (MD5 of
seed and doc_id), as far as the words go; the one where they end gives only its first words. So a source's taken words are its
target, rounded, and reruns agree, however the rows are partitioned.

Scale: words are counted once and narrow rows written once. The place where a source's fractional repetition ends is found by
sums over prefixes of the order's key: twice 2 hexadecimal digits (256 buckets a source each time), inside the bucket where it ends
whole keys, inside the one key where it ends (rows with equal doc_id and size) 2 and 2 digits of the row's own key, then the row. No step has a
source's rows in one task, however many of them are of one source, one doc_id or one text. The order of sources is of range
partitions and their running sums.

Defined cases: a null or empty text has size 0 and is taken 0 times; a source without words has target 0; null is a source of its
own, the last; repeated rows are documents each, and of equal ones any may be the one that is cut; other columns are ignored, or
carried along as they are; no rows give no rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, fresh, parallelism

WORD = r"[^\x20\x09-\x0D]+"
#: A word and the white space before it.
WITH_SPACE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Lengths of the prefixes of a row's key: two of buckets, doc_id and size, two of buckets among equals, row.
LEVELS = (2, 4, 52, 54, 56, 104)
BIG = "decimal(38,0)"


def running(scratch: Scratch, df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with columns of the sums over all rows before each, in an order that must be total: range partitions, written once, and
    the sums of the ranges before."""
    part = fresh("range", df)
    ranged = scratch.cut(df.repartitionByRange(parallelism(scratch.spark), *order).withColumn(part, F.spark_partition_id()), "ranges")
    of_range = ranged.groupBy(part).agg(*(F.sum(c.cast(BIG)).alias(n) for n, c in sums.items()))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # as many rows as there are ranges
    of_range = of_range.select(F.col(part).alias("_r"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = ranged.withColumns({n: F.coalesce(F.sum(c.cast(BIG)).over(inside), F.lit(0)) for n, c in sums.items()})
    rows = rows.join(F.broadcast(of_range), F.col(part) == F.col("_r"))  # a row for each range
    return rows.withColumns({n: (F.col(n) + F.col(f"_{n}")).cast(BIG) for n in sums}).select(*df.columns, *sums)


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...], share: Fraction, epochs: int) -> DataFrame:
    """sizes (source, source_size) with weight and target."""
    code = F.col("source").cast("binary")  # bytes of UTF-8 are in the order of code points
    ranked = running(scratch, sizes, [code.asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = ranked.select("source", "source_size", weight.alias("weight"))
    common = math.lcm(*weights)
    ratio = F.col("source_size").cast(BIG) * (F.lit(common) / F.col("weight")).cast("long")
    filled = running(scratch, ranked, [ratio, code.asc_nulls_last()], {"words": F.col("source_size"), "weights": F.col("weight")})
    filled = scratch.cut(filled, "filled")
    total, all_weights = filled.agg(F.sum(F.col("source_size").cast(BIG)), F.sum(F.col("weight").cast(BIG))).first()
    total, all_weights = int(total or 0), int(all_weights or 0)
    # in units of 1 / share.denominator; clamped if weight * (budget - caps before) / weights left >= cap
    budget, unit = share.numerator * total, share.denominator
    cap = F.col("source_size").cast(BIG) * (epochs * unit)
    rest = F.lit(budget).cast(BIG) - F.col("words") * (epochs * unit)
    left = F.lit(all_weights).cast(BIG) - F.col("weights")
    free = filled.where(rest * F.col("weight") < cap * left)  # the first of them gives the level
    level = free.agg(F.max(F.struct(left.alias("left"), rest.alias("rest"))).alias("x")).select("x.left", "x.rest").first()
    most = (F.col("source_size") * epochs).cast("double")
    if level["left"] is None:
        target = most
    else:
        target = F.least(most, (F.col("weight") * F.lit(int(level["rest"])).cast(BIG)).cast("double") / F.lit(float(int(level["left"]) * unit)))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def _ends(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (_source, need > 0) with the key where each source's fractional repetition ends and the words left for it there."""
    state = wanted.select("_source", F.lit("").alias("end"), F.col("need").alias("left"))
    for long, before in zip(LEVELS, (0, *LEVELS)):
        inside = rows.join(state, (rows.source_key == state._source) & (F.substring("key", 1, before) == state.end))
        sums = inside.groupBy("_source", "left", F.substring("key", 1, long).alias("head")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("_source").orderBy("head"))
        sums = sums.withColumn("upto", upto).where("upto >= left")
        state = sums.groupBy("_source").agg(F.min(F.struct("head", (F.col("left") - F.col("upto") + F.col("words")).alias("left"))).alias("x")).select("_source", F.col("x.head").alias("end"), "x.left")
    return state


def mix(docs: DataFrame, carry: bool = False, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), epochs: int = 2, seed: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, whole (repetitions of the whole text), part
    (words of one more, from the start), taken (words in all); with carry also doc, a struct of all columns of docs."""
    scratch = scratch or Scratch(docs.sparkSession)
    name = lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit(""))  # noqa: E731  a key without nulls
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    doc = [F.struct(*docs.columns).alias("doc")] if carry else []
    counted = docs.select("doc_id", F.col("source").cast("string").alias("source"), size, *doc)
    rows = scratch.cut(counted.withColumn("row", F.monotonically_increasing_id()), "words")  # once written, a row's id stays
    order = F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), F.lpad(F.col("size").cast("string"), 20, "0"))
    key = F.concat(order, F.md5(F.col("row").cast("string")), F.lpad(F.col("row").cast("string"), 20, "0"))
    rows = rows.withColumns({"source_key": name(F.col("source")), "key": key})
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(scratch, sizes, weights, share, epochs)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    need = quota - whole * F.col("source_size")
    wanted = scratch.cut(wanted.select(name(F.col("source")).alias("_source"), "source_size", "target", whole.alias("whole"), need.alias("need")), "targets")
    ends = _ends(rows, wanted.where("need > 0")).withColumnRenamed("_source", "_s")
    wanted = scratch.cut(wanted.join(ends, F.col("_source") == F.col("_s"), "left").drop("_s"), "ends")
    out = rows.join(wanted, rows.source_key == wanted._source)
    part = F.when(F.col("end").isNull() | (F.col("key") > F.col("end")), 0).when(F.col("key") < F.col("end"), F.col("size")).otherwise(F.col("left"))
    out = out.withColumn("part", part.cast("long"))
    taken = (F.col("whole") * F.col("size") + F.col("part")).alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", "whole", "part", taken, *(["doc"] if carry else []))


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: docs' columns for each repetition, with ``repetition`` (from 0; ``repetition_`` if that is taken); the text of
    a part has its first words, with the white space between them."""
    rows = mix(docs, carry=True, **settings)
    times = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    again = rows.where(times > 0).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    cut = (F.col("turn") == F.col("whole")) & (F.col("part") < F.col("size"))
    first = F.slice(F.regexp_extract_all("doc.text", F.lit(WITH_SPACE), F.lit(0)), 1, F.col("part").cast("int"))
    text = F.when(cut, F.array_join(first, "")).otherwise(F.col("doc.text"))
    return again.select(*((text if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns), F.col("turn").alias(fresh("repetition", docs)))
