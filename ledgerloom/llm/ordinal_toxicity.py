"""Toxicity by cumulative-link ordinal regression (operator 8).

Grades 0 to K are ordered. The model has one weight per feature, shared by all K thresholds: P(grade >= k) =
sigmoid(w x - theta_k) with theta_1 <= ... <= theta_K. The expected severity is the sum of P(grade >= k) over k. Features are
log(1 + rate) of hashed words (runs of letters and digits, A-Z in lower case) and of their first ``PREFIXES`` bytes, which
stand for stems, kept sparse. A feature enters the model if at least ``LEAST`` sampled documents have it and its smoothed
log-odds between grade 0 and the rest are at least ``LEAST_ODDS``, a rule that asks the same of small and large samples; the L2
penalty bounds the weights of rare ones. Of more than ``WORDS`` such words, or prefixes of one length, those that differ most
by a two-proportion z value count.

Fitting uses at most ``most_labels`` labelled rows (those with the smallest hashes of doc_id), without copies; everything else covers all rows.
Where labels only say toxic or not, ``grades`` makes grades of them: toxic rows are graded 1, 2 or 3 by the share of their
words that are typical of toxic rows, cut at its terciles.

Scale: the sample's sparse rows are written once; its document frequencies are summed with partial aggregation and the best
``WORDS`` of each kind reach the driver; the fit sees a sparse sample of bounded size; scoring is one pass over all texts.

Defined cases: null and empty texts have no features, so their severity is the model's at zero; each row of repeated doc_ids
is scored; null doc_ids are scored and never in the sample; equal features all count; without labels of both kinds every
severity is 0; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, Scratch, shingle_sets, slices, words

#: Most words in the model, and as many prefixes of each length.
WORDS = 2048
#: Least documents and least log-odds of a feature; SMOOTH is added to each count.
LEAST, LEAST_ODDS, SMOOTH = 3, 1.5, 0.5
GRADES = 3
PREFIXES = (4, 5, 6, 7, 8)
#: Features count per so many words.
RATE = 200.0


def _tagged(hashed: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Features, a row for whole words and one for each length of prefix, with the row's number in the low three bits; 0 for none."""
    every = np.concatenate([hashed[None, :], heads])
    kind = np.arange(len(every), dtype=np.uint64)[:, None]
    return np.where(every > 0, every & ~np.uint64(7) | kind, 0).view(np.int64)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, n, feature[], count[], sign) of (doc_id, toxic, text); sign: the least hash of a 5-word shingle, which
    copies and most near copies share."""
    for whole in batches:
        for batch in slices(whole):
            hashed, at, heads = words(batch.column(2), PUNCTUATION, PREFIXES)
            tagged = _tagged(hashed, heads)
            feature, count = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                every = tagged[:, a:b].ravel()
                f, c = np.unique(every[every != 0], return_counts=True)
                feature.append(f)
                count.append(c.astype(np.int32))
            sign = [int(x[0].astype(np.int64)) if len(x) else 0 for x in shingle_sets(batch.column(2), 5)]
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(np.diff(at)), pa.array(feature, pa.list_(pa.int64())), pa.array(count, pa.list_(pa.int32())), pa.array(sign, pa.int64())],
                names=["doc_id", "toxic", "n", "feature", "count", "sign"],
            )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sparse:
    """A matrix of the given cells, which can be multiplied by a vector from the right."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * v[self.column], self.shape[0])

    @property
    def T(self) -> Sparse:
        return Sparse(self.column, self.row, self.value, self.shape[::-1])


class CumulativeLink:
    """P(grade >= k | x) = sigmoid(w x - theta_k), fitted by maximum likelihood with an L2 penalty on w."""

    def __init__(self, weights: np.ndarray, thetas: np.ndarray):
        self.weights, self.thetas = weights, thetas

    @classmethod
    def fit(cls, x: np.ndarray | Sparse, grade: np.ndarray, k: int, penalty: float = 0.1, steps: int = 1500) -> CumulativeLink:
        n, m = x.shape
        rate = np.array([np.clip((grade >= j).mean(), 1e-4, 1 - 1e-4) for j in range(1, k + 1)])
        theta0 = -np.log(rate / (1 - rate))
        # thresholds as a first one and the logarithms of gaps, so that they stay in order
        p = np.r_[np.zeros(m), theta0[0], np.log(np.maximum(np.diff(theta0), 0.05))]
        first, second = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, steps + 1):
            w, gap = p[:m], np.exp(p[m + 1 :])
            theta = p[m] + np.r_[0.0, np.cumsum(gap)]
            z = x @ w
            up = np.c_[np.ones(n), sigmoid(z[:, None] - theta), np.zeros(n)]  # P(>= j), j = 0 .. k + 1
            hi, lo = up[np.arange(n), grade], up[np.arange(n), grade + 1]
            mass = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
            gz = -(dhi - dlo)
            gtheta = np.array([(dhi * (grade == j)).sum() - (dlo * (grade == j - 1)).sum() for j in range(1, k + 1)])
            grad = np.r_[(x.T @ gz + penalty * w) / n, gtheta.sum() / n, np.cumsum(gtheta[:0:-1])[::-1] * gap / n]
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad**2
            p -= 0.1 / (1 + step / 200) * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        return cls(p[:m], p[m] + np.r_[0.0, np.cumsum(np.exp(p[m + 1 :]))])

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k), k = 1 .. K, for values z = w x."""
        return sigmoid(z[:, None] - self.thetas)


def level(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The value of a feature that occurs count times among n words."""
    return np.log1p(RATE * count / (n + RATE / 10))


def _picked(chosen: np.ndarray):
    """Of sparse rows only the chosen features: (toxic, n, feature[] as positions in chosen, count[])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, count = [], []
            for f, c in zip(batch.column(2), batch.column(3), strict=True):
                f, c = f.values.to_numpy(), c.values.to_numpy()
                at = np.searchsorted(chosen, f).clip(max=max(0, len(chosen) - 1))
                hit = chosen[at] == f if len(chosen) else np.zeros(len(f), bool)
                place.append(at[hit].astype(np.int32))
                count.append(c[hit])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(place, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))], names=["toxic", "n", "place", "count"])

    return run


def grades(toxic: np.ndarray, rate: np.ndarray, k: int = GRADES) -> np.ndarray:
    """0 for rows that aren't toxic, else 1 .. k by the quantiles of rate among toxic rows."""
    edges = np.quantile(rate[toxic == 1], np.arange(1, k) / k) if (toxic == 1).any() else np.zeros(k - 1)
    return np.where(toxic == 1, 1 + np.searchsorted(edges, rate, "left"), 0)


def _score(chosen: np.ndarray, model: CumulativeLink | None, cut: float):
    low = np.zeros(1 << 18, bool)  # the low bits of features
    low[chosen & 0x3FFFF] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                n = batch.num_rows
                z = np.zeros(n)
                if model is not None and len(chosen):
                    hashed, at, heads = words(batch.column(1), PUNCTUATION, PREFIXES)
                    cells = []
                    for row in _tagged(hashed, heads):
                        likely = np.flatnonzero(low[row & 0x3FFFF])
                        place = np.searchsorted(chosen, row[likely]).clip(max=len(chosen) - 1)
                        same = chosen[place] == row[likely]
                        doc = np.searchsorted(at, likely[same], "right") - 1
                        cells.append(doc * len(chosen) + place[same])
                    cell, count = np.unique(np.concatenate(cells), return_counts=True)
                    np.add.at(z, cell // len(chosen), level(count, np.diff(at)[cell // len(chosen)]) * model.weights[cell % len(chosen)])
                up = model.probabilities(z) if model is not None else np.zeros((n, GRADES))
                expected = up.sum(1)
                yield pa.record_batch(
                    [batch.column(0).cast(pa.int64()), pa.array(expected), pa.array((up >= 0.5).sum(1).astype(np.int32)), pa.array(expected >= cut)],
                    names=["doc_id", "expected_severity", "grade", "toxic"],
                )

    return run


def severity(docs: DataFrame, labels: DataFrame, most_labels: int = 12_000, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) per row; grade is the median one, toxic whether the expected severity
    exceeds the value that agrees best with the sample's labels. labels: (doc_id, toxic)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = scratch.cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels), "sample")
    rows = docs.join(known, "doc_id").select("doc_id", "toxic", "text")
    sample = rows.mapInArrow(_sparse, "doc_id long, toxic int, n long, feature array<long>, count array<int>, sign long")
    one = F.min_by(F.struct("doc_id", "toxic", "n", "feature", "count"), "doc_id").alias("x")
    sample = scratch.cut(sample.groupBy("sign").agg(one).select("x.*"), "sparse")
    kinds = {t: n for t, n in sample.groupBy("toxic").count().collect()}
    model, chosen, cut = None, np.zeros(0, np.int64), np.inf
    if kinds.get(0) and kinds.get(1):
        n0, n1 = kinds[0], kinds[1]
        df = sample.select("toxic", F.explode("feature").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        share = (F.col("a") + F.col("b")) / (n0 + n1)
        z = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
        odds = F.log((F.col("a") + SMOOTH) / (n1 - F.col("a") + SMOOTH)) - F.log((F.col("b") + SMOOTH) / (n0 - F.col("b") + SMOOTH))
        able = df.where(F.col("a") + F.col("b") >= LEAST).select("feature", odds.alias("odds"), z.alias("z")).where(F.abs("odds") >= LEAST_ODDS)
        able = scratch.cut(able, "able")
        odds_of = {f: v for kind in range(1 + len(PREFIXES)) for f, v in able.where(F.col("feature").bitwiseAND(7) == kind).orderBy(F.desc("z"), "feature").limit(WORDS).select("feature", "odds").collect()}
        chosen = np.array(sorted(odds_of), np.int64)
        few = sample.select("toxic", "n", "feature", "count").mapInArrow(_picked(chosen), "toxic int, n long, place array<int>, count array<int>").toArrow()
        toxic, size = few["toxic"].to_numpy(), few["n"].to_numpy()
        row = np.repeat(np.arange(len(toxic)), pc.list_value_length(few["place"]).to_numpy())
        column = pc.list_flatten(few["place"]).to_numpy().astype(np.int64)
        count = pc.list_flatten(few["count"]).to_numpy()
        x = Sparse(row, column, level(count, size[row]), (len(toxic), len(chosen)))
        typical = np.array([odds_of[f] > 0 and f & 7 == 0 for f in chosen.tolist()], bool)[column]
        rate = np.bincount(row[typical], np.expm1(x.value[typical]), len(toxic))
        model = CumulativeLink.fit(x, grades(toxic, rate), GRADES)
        expected = model.probabilities(x @ model.weights).sum(1)
        order = np.argsort(-expected, kind="stable")
        last = np.r_[expected[order][1:] != expected[order][:-1], True]
        agree = np.where(last, np.cumsum(np.where(toxic[order] == 1, 1, -1)), -1 << 40)
        i = int(agree.argmax())
        low = expected[order][i + 1] if i + 1 < len(order) else expected[order][i]
        cut = float((expected[order][i] + low) / 2) if agree[i] > 0 else np.inf
    return docs.mapInArrow(_score(chosen, model, cut), "doc_id long, expected_severity double, grade int, toxic boolean")
