"""Quality classifier by importance resampling (operator 10).

Two generative models, bags of hashed n-grams, are counted: one of target text (rows labelled as good, of a bounded sample)
and one of the raw text (all documents). A document's importance is the ratio of its probabilities under both, so its logarithm
is the sum of its n-grams' log ratios. The target's counts are smoothed by ``PRIOR`` n-grams of raw text, so that an n-gram that a
small sample lacks says little. Documents are sampled without replacement by Gumbel top-k: the k greatest values of log importance
plus standard Gumbel noise that depends on doc_id and seed. k is ``share`` of all documents, by default the share of good ones
among the labelled.

The noise is of a few units, log importances of good and bad texts of some length are tens to thousands apart: it decides among
short and mixed documents around the k-th, in proportion to their importance, and leaves clear cases alone.

N-grams are of tokens (runs of letters and digits, or of ASCII punctuation): each token's hash, and shapes (upper, title,
lower, digits, other, which punctuation, repetition of the token before) in twos and threes, hashed to ``BUCKETS``.

Scale: two passes over the texts; counts are summed by bucket with partial aggregation, so the driver sees BUCKETS rows; the
k-th value is found by counts of ``CLASSES`` ranges of values, each round within the range before that holds it, and a sort of
what is left when that is little.

Defined cases: null and empty texts have no n-grams and an importance of 1; equal values are ordered by doc_id; each row of repeated
doc_ids is scored, and gets the same noise; ``resample`` drops all rows of a doc_id of which one is not drawn; a null doc_id gets
the noise of id -1; without usable labels of both kinds every row is kept; other columns, whatever their names, are ignored by
``score`` and kept by ``resample``; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, SPACE, Scratch, _cuts, _POWERS, fresh, large, mix, placed, slices

BUCKETS = 1 << 15
PRIOR = 1e4
#: Ranges of values in a round of the search for the k-th, and so few rows are sorted.
CLASSES, SORTED = 1 << 14, 10_000
_CLASS = np.ones(256, np.uint8)
_CLASS[PUNCTUATION] = 2
_CLASS[SPACE] = 0
_SCORES = pa.schema([("doc_id", pa.int64()), ("ratio", pa.float64()), ("n", pa.int64())])


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DOWN = _bytes("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _bytes("0123456789")
_HIGH = np.arange(256) >= 128


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and the text that each belongs to."""
    data, ends = large(column)
    token, shape, begin = [], [], []
    for a, b in _cuts(data, ends):
        part = data[a:b]
        kind = _CLASS[part]
        first = np.ones(len(part), bool)
        first[1:] = kind[1:] != kind[:-1]
        inner = ends[np.searchsorted(ends, a, "left") : np.searchsorted(ends, b, "left")] - a
        first[inner] = True
        start = np.flatnonzero(first)
        hashed = mix(np.add.reduceat(placed(part, start)[0], start))
        sort = kind[start]
        upper, down, digit, high = (np.add.reduceat(x[part].astype(np.int32), start) for x in (_UPPER, _DOWN, _DIGIT, _HIGH))
        title = _UPPER[part[start]]
        form = np.select([(upper >= 2) & (down == 0), title, digit > 0, down + high > 0], [1, 2, 3, 4], 5).astype(np.uint64)
        form = np.where(sort == 2, hashed, form)
        keep = sort > 0
        token.append(hashed[keep])
        shape.append(form[keep])
        begin.append(start[keep] + a)
    if not token:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    token, shape, begin = np.concatenate(token), np.concatenate(shape), np.concatenate(begin)
    doc = np.searchsorted(ends, begin, "right") - 1
    shape[1:] = np.where((token[1:] == token[:-1]) & (doc[1:] == doc[:-1]), np.uint64(6), shape[1:])
    out, whose = [token ^ np.uint64(0x5851F42D4C957F2D)], [doc]
    for k in (2, 3):
        n = len(shape) - k + 1
        if n > 0:
            gram = np.full(n, k, np.uint64)
            for j in range(k):
                gram += (shape[j : j + n] + np.uint64(11)) * _POWERS[7 * k + j]
            inside = doc[: n] == doc[k - 1 :]
            out.append(mix(gram)[inside])
            whose.append(doc[:n][inside])
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(whose)


def _count(good: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in slices(whole):
                bucket, doc = ngrams(batch.column(1))
                raw += np.bincount(bucket, minlength=BUCKETS)
                is_good = np.array([good.get(i) == 1 for i in batch.column(0).to_pylist()], bool)
                if is_good.any():
                    target += np.bincount(bucket[is_good[doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return run


def _score(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                bucket, doc = ngrams(batch.column(1))
                n = np.bincount(doc, minlength=batch.num_rows)
                total = np.bincount(doc, ratio[bucket], batch.num_rows)
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(total, pa.float64()), pa.array(n, pa.int64())], schema=_SCORES)

    return run


def score(docs: DataFrame, labels: DataFrame, share: float | None = None, most_labels: int = 20_000, seed: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, log_weight, value, n_ngrams, keep) per row; value is log_weight plus noise; keep: among the k greatest.

    labels: (doc_id, quality), 1 for target text and 0 for other; at most ``most_labels`` of them are used for the target's
    model, those with the smallest hashes of doc_id. share: k over the number of documents.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = known.agg(F.avg("quality")).first()[0] or 0.0
    usable = 0 < good < 1
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).collect()
    counted = docs.mapInArrow(_count({int(i): int(q) for i, q in sample}), "bucket int, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, x, y in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[bucket], target[bucket] = x, y
    part = np.maximum(raw, 1) / max(1.0, raw.sum())
    ratio = np.log((target + PRIOR * part) / (target.sum() + PRIOR) / part) if usable else np.zeros(BUCKETS)
    scores = scratch.cut(docs.mapInArrow(_score(ratio), "doc_id long, ratio double, n long"), "scores")
    uniform = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    noise = -F.log(-F.log(uniform))
    valued = scores.select("doc_id", F.col("ratio").alias("log_weight"), F.col("n").alias("n_ngrams"), (F.col("ratio") + noise).alias("value"))
    return _top(scratch, valued, math.ceil((good if share is None else share) * scores.count()) if usable else None)


def _top(scratch: Scratch, valued: DataFrame, k: int | None) -> DataFrame:
    """With keep: whether the row is among the k greatest values, ties to the smaller doc_id."""
    low, high, n = valued.agg(F.min("value"), F.max("value"), F.count("*")).first()
    if k is None or k >= n:
        return valued.withColumn("keep", F.lit(True))
    if not k:
        return valued.withColumn("keep", F.lit(False))
    above, inside = 0, n
    while inside > SORTED and high > low:  # of rows from low to high, all above high are kept
        step = (high - low) / CLASSES
        at = F.least(F.floor((F.col("value") - low) / step), F.lit(CLASSES - 1))
        counts = valued.where(F.col("value").between(low, high)).groupBy(at.alias("at")).agg(F.count("*"), F.min("value"), F.max("value")).collect()
        for _, many, least, most in sorted(counts, reverse=True):
            if above + many >= k:
                if (low, high) == (least, most):
                    step = 0
                low, high, inside = least, most, many
                break
            above += many
        if not step:
            break
    order = F.desc("value"), F.asc_nulls_first("doc_id")
    last = valued.where(F.col("value").between(low, high)).orderBy(*order).limit(k - above)
    own = F.struct("value", (-F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("id"))
    last = last.agg(F.min(own).alias("x")).first()["x"]
    return valued.withColumn("keep", own >= F.struct(F.lit(last["value"]).alias("value"), F.lit(last["id"]).alias("id")))


def resample(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The sampled rows of docs with all columns."""
    scratch, out = Scratch(docs.sparkSession), fresh("rejected", docs)
    rejected = scratch.cut(score(docs, labels, scratch=scratch, **how).where("not keep").select(F.col("doc_id").alias(out)).distinct(), "rejected")
    return docs.join(rejected.hint("merge"), docs["doc_id"].eqNullSafe(F.col(out)), "left_anti")
