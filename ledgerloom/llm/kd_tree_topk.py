"""Exact top-k search by inner product with KD-trees per shard (operator 9).

A tree over a bounded sample of the vectors, split at the median of the widest dimension, has the cells that vectors are dealt to;
a cell of more than ``SHARD`` vectors is split further by a hash of vec_id, so a vector that very many rows have is no hot shard.
Each shard has a KD-tree of its own, split likewise, whose nodes have tight bounding boxes: q+ . high + q- . low bounds a query's
product with anything in a box (q+ and q- the positive and negative components). A block of queries goes through a tree best node
first, with its k-th results so far; a query leaves a node whose bound can't beat its own k-th. Equal scores go to the smaller
vec_id, so a box that only ties is left out if its ids are all larger.

Each query first searches its home shard, the one that it is in. Its k-th score and id go with it: the boxes of all cells, of
bounded number, are tested before the query is copied to the shards of those that can hold a better result. So all queries meet
all rows, in blocks, but for what the bounds rule out.

Components are floor(scale * x) with x as double. Products are exact: in double arithmetic where magnitudes allow, else in
integers of any size; scores are clamped to 64 bits.

Defined cases: vectors that are null or hold null or non-finite components, or such that aren't finite times scale, take no part, neither as queries nor as
candidates, nor do rows without vec_id; of vectors of different lengths missing components count as 0; vec_id is a key: of rows that
repeat one, that with the smallest embedding (by its components in order) counts, and asks if it does; fewer than k candidates
give as many rows; other columns, whatever their names, are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, parallelism

SHARD = 8192
LEAF = 128
#: Queries that go through a tree together.
BLOCK = 64
#: Sampled vectors, and the most numbers in the boxes of all cells.
SAMPLE, BOXES = 1 << 13, 1 << 18
EXACT = float(1 << 53)
_OUT = "query_id long, vec_id long, score long"


def halves(part: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows below and above the median of a dimension."""
    order = np.argsort(part[:, wide], kind="stable")
    return order[: len(order) // 2], order[len(order) // 2 :]


class Cells:
    """Nested median splits of a sample into at most ``most`` cells."""

    def __init__(self, x: np.ndarray, most: int):
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, and what is below it and not: a split or ~cell
        self.n = 0
        self.top = self._split(x, most)

    def _split(self, x: np.ndarray, most: int) -> int:
        if most > 1 and len(x) > 1 and x.shape[1]:
            wide = int((x.max(0) - x.min(0)).argmax())
            at = float(np.median(x[:, wide]))
            below = x[:, wide] < at
            if below.any():
                here = len(self.splits)
                self.splits.append((0, 0.0, 0, 0))
                self.splits[here] = wide, at, self._split(x[below], most // 2), self._split(x[~below], most - most // 2)
                return here
        self.n += 1
        return ~(self.n - 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(self.top, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            wide, at, low, high = self.splits[node]
            below = x[rows, wide] < at if wide < x.shape[1] else np.full(len(rows), 0 < at)
            todo += [(low, rows[below]), (high, rows[~below])]
        return out


class KDTree:
    """A tree over the rows of x; nodes have a box, the smallest rank of an id in it, and two nodes or at most LEAF rows below."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        order = np.lexsort((*x.T[::-1].astype(float), ids)) if x.shape[1] else np.argsort(ids, kind="stable")
        order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(ids) else order  # an id counts once
        self.ids, self.x = ids[order], x[order]  # from here, row number = rank of the id
        self.low, self.high, self.first, self.below, self.rows = [], [], [], [], []
        self._node(np.arange(len(self.ids)))
        self.low, self.high, self.first = np.array(self.low), np.array(self.high), np.array(self.first)

    def _node(self, rows: np.ndarray) -> int:
        here, part = len(self.first), self.x[rows]
        low, high = part.min(0), part.max(0)
        for x, v in ((self.low, low), (self.high, high), (self.first, int(rows.min())), (self.below, None), (self.rows, None)):
            x.append(v)
        wide = int((high - low).argmax()) if part.shape[1] else 0
        if len(rows) <= LEAF or not part.shape[1]:
            self.rows[here] = np.sort(rows)
        else:
            self.below[here] = tuple(self._node(rows[half]) for half in halves(part, wide))
        return here

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: list, floor_id: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (ranks, scores) of its k best rows that beat (floor, floor_id), unsorted; own: its own id."""
        n = len(self.x)
        kind = object if self.x.dtype == object or q.dtype == object else np.float64
        x, q, low, high = (v.astype(kind) for v in (self.x, q, self.low, self.high))
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        # one number orders (score, -rank): score * n - rank
        rank_floor = np.searchsorted(self.ids, floor_id)
        has = np.array([f is not None for f in floor])
        least = np.where(has, np.array([f if f is not None else 0 for f in floor], kind) * n - rank_floor, -np.inf if kind is np.float64 else -(1 << 200))
        best = np.empty((len(q), k), kind)
        best[:] = least[:, None]
        own_rank = np.searchsorted(self.ids, own)
        own_rank = np.where(self.ids[own_rank.clip(max=n - 1)] == own, own_rank, -1)

        def visit(rows: np.ndarray, who: np.ndarray) -> None:
            key = q[who] @ x[rows].T * n - rows
            mine = own_rank[who][:, None] == rows
            key[mine] = least[who][np.nonzero(mine)[0]]
            better = (key > best[who, :1]).any(1)
            if better.any():
                who = who[better]
                both = np.concatenate([best[who], key[better]], 1)
                both.partition(both.shape[1] - k, 1)
                best[who] = both[:, -k:]  # the k-th comes first

        heap: list = []

        def meet(node: int, who: np.ndarray) -> None:
            bound = (up[who] @ high[node] + down[who] @ low[node]) * n - self.first[node]
            open_ = bound > best[who, 0]
            if open_.any():
                heappush(heap, (-bound[open_].max(), node, who[open_], bound[open_]))

        meet(0, np.arange(len(q)))
        while heap:
            _, node, who, bound = heappop(heap)
            who = who[bound > best[who, 0]]  # k-th results have come closer since
            if not len(who):
                continue
            if self.below[node] is None:
                visit(self.rows[node], who)
            else:
                for child in self.below[node]:
                    meet(child, who)
        out = []
        for row, none in zip(best, least, strict=True):
            keys = row[row > none]
            score = np.array([-((-int(v)) // n) for v in keys], object)
            rank = np.array([int(s) * n - int(v) for s, v in zip(score, keys, strict=True)], np.int64)
            out.append((rank, score))
        return out


def _matrix(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows' components as integers (in doubles), padded with 0, and which rows are usable."""
    column = column.cast(pa.large_list(pa.float64()))
    ends, flat = column.offsets.to_numpy(), column.values
    known = np.asarray(column.is_valid()) if len(column) else np.zeros(0, bool)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = known & (bad[ends[1:]] == bad[ends[:-1]])
    long = np.diff(ends)
    wide = int(long[good].max()) if good.any() else 0
    out = np.zeros((int(good.sum()), wide))
    for row, i in zip(out, np.flatnonzero(good), strict=True):
        row[: long[i]] = values[ends[i] : ends[i + 1]]
    with np.errstate(over="ignore"):
        return np.floor(scale * out), good


def _widen(parts: list[np.ndarray]) -> np.ndarray:
    wide = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts])


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _lists(x: np.ndarray) -> pa.Array:
    ends = np.arange(0, x.size + 1, x.shape[1]) if x.shape[1] else np.zeros(len(x) + 1, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(x.ravel(), pa.float64())).cast(pa.list_(pa.float64()))


def _deal(cells: Cells, scale: float):
    """(vec_id, asks, cell, embedding) with integer components of usable rows (vec_id, asks, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _matrix(batch.column(2), scale)
            ids, asks = batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))
            yield pa.record_batch([ids, asks, pa.array(cells.of(x)), _lists(x)], names=["vec_id", "asks", "cell", "embedding"])

    return run


def _tree(vectors: list[tuple[np.ndarray, np.ndarray]]) -> KDTree:
    return KDTree(_widen([v for _, v in vectors]), np.concatenate([i for i, _ in vectors]))


def _results(tree: KDTree, ids: np.ndarray, q: np.ndarray, k: int, floor: list, floor_id: np.ndarray) -> list[list[int]]:
    wide = max(q.shape[1], tree.x.shape[1])
    most = float(np.abs(q).max(initial=1)) * float(np.abs(tree.x.astype(float)).max(initial=1)) * max(1, wide)
    x, q = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (tree.x, q))
    exact = most * (len(x) + 1) < EXACT
    if wide != tree.x.shape[1] or not exact:
        tree = KDTree(x if exact else _integers(x), tree.ids)
    q = q if exact else _integers(q)
    out: list[list[int]] = [[], [], []]
    for a in range(0, len(ids), BLOCK):
        b = slice(a, a + BLOCK)
        for one, (rank, s) in zip(ids[b].tolist(), tree.search(q[b], ids[b], k, floor[b], floor_id[b]), strict=True):
            out[0] += [one] * len(rank)
            out[1] += tree.ids[rank].tolist()
            out[2] += [max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in s]
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(shard, is it the shard's first, rows) of batches sorted by shard."""
    at = None
    for batch in batches:
        shard = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a < b:
                yield int(shard[a]), int(shard[a]) != at, batch.slice(a, b - a)
                at = int(shard[a])


def _home(k: int):
    """Rows (shard, cell, vec_id, asks, embedding) sorted by shard: results of the shard's own queries, and its box as rows
    (query_id null, vec_id: dimension, cell, low, high)."""

    def close(vectors: list, asking: list, cell: int) -> pa.RecordBatch:
        tree = _tree(vectors)
        asks = np.isin(tree.ids, np.concatenate(asking))
        out = _results(tree, tree.ids[asks], tree.x[asks], k, [None] * int(asks.sum()), np.zeros(int(asks.sum()), np.int64))
        n, wide = len(out[0]), tree.x.shape[1]
        gap = lambda kind, m: pa.nulls(m, kind)
        low, high = tree.low[0].astype(float), tree.high[0].astype(float)
        columns = (
            (pa.array(out[0], pa.int64()), gap(pa.int64(), wide)), (pa.array(out[1], pa.int64()), pa.array(np.arange(wide), pa.int64())), (pa.array(out[2], pa.int64()), gap(pa.int64(), wide)),
            (gap(pa.int32(), n), pa.array(np.full(wide, cell), pa.int32())), (gap(pa.float64(), n), pa.array(low)), (gap(pa.float64(), n), pa.array(high)),
        )
        return pa.record_batch([pa.concat_arrays(c) for c in columns], names=["query_id", "vec_id", "score", "cell", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, asking, cell = [], [], 0
        for _, first, batch in _runs(batches):
            if first and vectors:
                yield close(vectors, asking, cell)
                vectors, asking = [], []
            ids, cell = batch.column(2).to_numpy(), batch.column(1)[0].as_py()
            vectors.append((ids, _matrix(batch.column(4), 1.0)[0]))
            asking.append(ids[batch.column(3).to_numpy(zero_copy_only=False).astype(bool)])
        if vectors:
            yield close(vectors, asking, cell)

    return run


def _route(low: np.ndarray, high: np.ndarray, cells: np.ndarray):
    """(vec_id, embedding, floor, floor_id, cell) for each of the cells whose box can hold a better result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _matrix(batch.column(1), 1.0)
            wide = low.shape[1]
            x = np.pad(x, ((0, 0), (0, max(0, wide - x.shape[1]))))[:, :wide]
            floor = np.array([-np.inf if f is None else float(f) for f in batch.column(2).to_pylist()])
            # rounding can't hide a better result: bounds count a little more than they are
            bound = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T
            size = np.abs(x) @ np.maximum(np.abs(low), np.abs(high)).T
            row, cell = np.nonzero(bound + 1e-9 * size + 1 >= floor[:, None])
            yield pa.record_batch([*(batch.column(i).take(pa.array(row)) for i in range(4)), pa.array(cells[cell], pa.int32())], names=["vec_id", "embedding", "floor", "floor_id", "cell"])

    return run


def _away(k: int):
    """Rows (shard, q, vec_id, embedding, floor, floor_id), sorted by shard, vectors before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, tree = [], None
        for _, first, batch in _runs(batches):
            if first:
                vectors, tree = [], None
            asks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            ids, x = batch.column(2).to_numpy(), _matrix(batch.column(3), 1.0)[0]
            if not asks.all():
                vectors.append((ids[~asks], x[~asks]))
            if asks.any() and vectors:
                tree = tree or _tree(vectors)
                floors = [batch.column(i).filter(pa.array(asks)).to_pylist() for i in (4, 5)]
                out = _results(tree, ids[asks], x[asks], k, floors[0], np.array([f or 0 for f in floors[1]], np.int64))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return run


def _unique(scratch: Scratch, vectors: DataFrame) -> DataFrame:
    """One row per vec_id. Only ids are shuffled to find those that repeat, and vectors only if some do."""
    repeated = scratch.cut(vectors.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if repeated.isEmpty():
        return vectors
    one = vectors.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("embedding", "asks")).alias("x")).select("vec_id", "x.asks", "x.embedding")
    return vectors.join(repeated, "vec_id", "left_anti").unionAll(one)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, embedding): the k best other rows of each query row."""
    spark = vectors.sparkSession
    scratch, width = scratch or Scratch(spark), parallelism(spark)
    finite = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    vectors = vectors.select(F.col("vec_id").cast("long"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = vectors.count()
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE).select("embedding")
    x, _ = _matrix(pa.array([r[0] for r in sample.collect()], pa.list_(pa.float64())), scale)
    cells = Cells(x, min(max(1, -(-n // SHARD), min(width, n // 512)), max(1, BOXES // max(1, x.shape[1])), SAMPLE // 16))
    dealt = _unique(scratch, vectors).mapInArrow(_deal(cells, scale), "vec_id long, asks boolean, cell int, embedding array<double>")
    dealt = scratch.cut(dealt, "dealt")
    parts, total = [], 0
    for cell, m in sorted(dealt.groupBy("cell").count().collect()):  # of bounded number
        parts.append((cell, total, -(-m // SHARD)))
        total += parts[-1][2]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = F.broadcast(spark.createDataFrame(parts, "cell int, base int, parts int"))
    groups = min(total, 4 * width)
    shard = (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
    rows = dealt.join(parts, "cell").select(shard.alias("shard"), "cell", "vec_id", "asks", "embedding")
    by_shard = lambda df, *order: df.repartitionById(groups, F.col("shard") % groups).sortWithinPartitions("shard", *order)
    home = by_shard(rows).mapInArrow(_home(k), _OUT + ", cell int, low double, high double")
    home = scratch.cut(home, "home")
    found = home.where("query_id is not null").select("query_id", "vec_id", "score")

    def best(found: DataFrame) -> DataFrame:
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if total == 1:
        return best(found)
    boxes = home.where("query_id is null").groupBy("cell", "vec_id").agg(F.min("low"), F.max("high")).collect()  # BOXES numbers at most
    if not boxes:
        return best(found)
    seen = {c: i for i, c in enumerate(sorted({b[0] for b in boxes}))}
    low, high = (np.zeros((len(seen), 1 + max(b[1] for b in boxes))) for _ in range(2))
    for cell, at, a, b in boxes:
        low[seen[cell], at], high[seen[cell], at] = a, b
    kth = best(found).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))
    asked = dealt.where("asks").join(kth, "vec_id", "left").select("vec_id", "embedding", "floor", "floor_id")
    away = asked.mapInArrow(_route(low, high, np.array(list(seen), np.int32)), "vec_id long, embedding array<double>, floor long, floor_id long, cell int")
    away = away.join(parts, "cell").withColumn("shard", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("parts") - 1)))
    homes = rows.where("asks").select("vec_id", "shard")  # done already
    away = away.join(homes, ["vec_id", "shard"], "left_anti").select("shard", F.lit(True).alias("q"), "vec_id", "embedding", "floor", "floor_id")
    none = F.lit(None).cast("long")
    both = rows.select("shard", F.lit(False).alias("q"), "vec_id", "embedding", none.alias("floor"), none.alias("floor_id")).unionAll(away)
    others = scratch.cut(by_shard(both, "q").mapInArrow(_away(k), _OUT), "others")
    return best(found.unionAll(others))
