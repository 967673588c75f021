"""Filter interaction audit (operator 12): what each order of five filters removes at each step.

A document fails A with under 100 words, B with under 80 % distinct words, C with over 10 % capital letters A-Z, D with any of the
characters #$%&*| and E if its text is that of a document with a smaller doc_id.

E goes by an RDD that is routed by fingerprint, the text's xxHash. A table of bits of fixed size (``BITS``) has the fingerprints that
occur twice or more; texts without their bit differ from all others. Of the rest, each task keeps chains of the texts with an equal fingerprint, with the full text, so that
a collision joins no two texts, and the smallest doc_id; a doc_id that isn't the smallest is emitted as soon as that is known. What is
left is partitioned by the hash and chained again, sorted by it, outside memory where need be, so that a task holds one chain at a
time. Texts with copies in their own task first meet by (hash, part of the tasks), so that of a text with copies
everywhere no task gets more than about the square root of the number of tasks.

A document's failures are five bits; vectors of counts by the 32 masks (all, quality = 1, toxic = 1) are merged for each part with
combineByKey, and all 120 orders follow from a part's vector.

Scale: fingerprints are counted without texts; a text that may have copies is shuffled once from each task, or twice if it has copies
there. To that end tasks read their rows twice, once for the texts with copies there and once for the others, which is cheaper than
two shuffles. Chains of a map task are given on when they
hold over ``HELD`` bytes; labels are joined to narrow rows.

Defined cases: a null text is the empty text, and empty texts are copies of each other; a null lang is part ''; a null doc_id is
smaller or larger than none, so it neither fails E nor makes others fail; rows with equal doc_id and text don't make each other
fail; of several labels of a doc_id one with 1 counts; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import count, permutations

import numpy as np
from pyspark.rdd import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_held, bit_table, parallelism

FILTERS = "ABCDE"
#: Bits of the table of fingerprints that occur again.
BITS = 24
#: Bytes of text in a map task's chains.
HELD = 32 << 20
_NOT_CAPITAL = bytes(i for i in range(256) if not 65 <= i <= 90)
_NOT_SPECIAL = bytes(i for i in range(256) if i not in b"#$%&*|")
E = 16
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

#: Documents on their way: (doc_id, part, number of rows).
Doc = tuple[int | None, str, int]


def own_failures(data: bytes) -> int:
    """The bits of A to D for a text in UTF-8. bytes.split goes by ASCII white space."""
    words = data.split()
    few = len(words) < 100
    repeated = 100 * len(set(words)) < 80 * len(words)
    capitals = 100 * len(data.translate(None, _NOT_CAPITAL)) > 10 * len(data.decode("utf-8", "surrogatepass"))
    return few | repeated << 1 | capitals << 2 | bool(data.translate(None, _NOT_SPECIAL)) << 3


class Chain:
    """Texts with one fingerprint: each once, with its smallest doc_id, that one's rows, and how many rows came in."""

    def __init__(self) -> None:
        self.links: dict[bytes, list] = {}

    def put(self, data: bytes, docs: Iterable[Doc]) -> Iterator[Doc]:
        """Take documents with this text; those for which there now is a smaller one are given back."""
        link = self.links.setdefault(data, [None, {}, 0])
        for doc_id, part, n in docs:
            link[2] += n
            if not link[1] or doc_id < link[0]:
                yield from ((link[0], p, k) for p, k in link[1].items())
                link[0], link[1] = doc_id, {part: n}
            elif doc_id == link[0]:
                link[1][part] = link[1].get(part, 0) + n
            else:
                yield doc_id, part, n

    def rest(self) -> Iterator[tuple[bytes, list[Doc], bool]]:
        """(text, the rows of its smallest doc_id, whether several rows came in)."""
        for data, (least, docs, came) in self.links.items():
            yield data, [(least, p, n) for p, n in docs.items()], came > 1


def _read(rows: Iterable, at: int, spread: int, again: np.ndarray, several: bool) -> Iterator[tuple]:
    """((fingerprint, salt), (text, mask, documents)) of one task's rows (doc_id, text, part, fingerprint). several: of texts with copies
    in this task, salted, and nothing else; otherwise of the others, and the decided documents, without text, at keys of their own."""
    chains: dict[int, Chain] = {}
    held = 0
    own = count(at << 24)

    def give() -> Iterator[tuple]:
        for fp, chain in chains.items():
            for data, docs, copies in chain.rest():
                if copies == several:
                    yield (fp, at % spread if several else -1), (data, own_failures(data), docs)
        chains.clear()

    for doc_id, text, part, fp in rows:
        alone = doc_id is None or not bit_held(again, np.array([fp]).view(np.uint64), BITS)[0]
        if alone and several:
            continue
        data = text.encode("utf-8", "surrogatepass")
        if alone:
            yield (next(own), -1), (None, own_failures(data), [(doc_id, part, 1)])
            continue
        chain = chains.setdefault(fp, Chain())
        held += 0 if data in chain.links else len(data)
        lost = list(chain.put(data, [(doc_id, part, 1)]))
        if lost and not several:
            yield (next(own), -1), (None, own_failures(data) | E, lost)
        if held > HELD:
            yield from give()
            held = 0
    yield from give()


def _chained(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows in the order of their keys: the texts of a key are chained; what is left has the fingerprint alone as its key."""
    key, chain, masks = None, Chain(), {}

    def give() -> Iterator[tuple]:
        for data, docs, _ in chain.rest():
            yield (key[0], -1), (data, masks[data], docs)

    for k, (data, mask, docs) in rows:
        if data is None:
            yield k, (None, mask, docs)
            continue
        if k != key:
            yield from give()
            key, chain, masks = k, Chain(), {}
        masks[data] = mask
        if lost := list(chain.put(data, docs)):
            yield k, (None, mask | E, lost)
    yield from give()


def _routed(rows: RDD, n: int) -> RDD:
    return rows.repartitionAndSortWithinPartitions(n, lambda k: (k[0] + 7919 * (k[1] + 1)) % n).mapPartitions(_chained)


def failures(docs: DataFrame) -> RDD:
    """(doc_id, part, mask, rows) of all documents; rows: how many have that doc_id, part and text."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("fp"))
    repeated = scratch.cut(rows.groupBy("fp").count().where("count > 1").select("fp"), "repeated")
    again = spark.sparkContext.broadcast(bit_table(repeated.rdd.map(lambda r: np.array([r["fp"]]).view(np.uint64)), BITS))
    rows = rows.rdd
    tasks = rows.getNumPartitions()
    n, spread = max(parallelism(spark), tasks), max(1, math.isqrt(tasks))
    met = _routed(rows.mapPartitionsWithIndex(lambda i, it: _read(it, i, spread, again.value, True)), n)
    others = rows.mapPartitionsWithIndex(lambda i, it: _read(it, i, spread, again.value, False))
    return _routed(others.union(met), n).flatMap(lambda r: [(doc_id, part, r[1][1], k) for doc_id, part, k in r[1][2]])


def count_vectors(docs: DataFrame, labels: DataFrame) -> RDD:
    """(part, int64 array of 3 x 32): documents by mask, of them those of quality 1, and the toxic ones."""
    spark = docs.sparkSession
    masks = spark.createDataFrame(failures(docs), "doc_id long, part string, mask int, n long", verifySchema=False)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    rows = masks.join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0))).rdd

    def add(v: np.ndarray, x: tuple) -> np.ndarray:
        mask, n, good, toxic = x
        v[:, mask] += (n, n * good, n * toxic)
        return v

    pairs = rows.map(lambda r: (r[0], tuple(r[1:])))
    return pairs.combineByKey(lambda x: add(np.zeros((3, 32), np.int64), x), add, lambda a, b: a + b, parallelism(spark))


def orders(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of AUDIT for a part."""
    masks = np.arange(32)
    removed, rows = {}, []
    for order in permutations(range(5)):
        left = np.ones(32, bool)
        for step, f in enumerate(order, 1):
            fails = masks >> f & 1 == 1
            here, before = left & fails, ~left & fails
            left = left & ~fails
            total, good, toxic = (int(x) for x in counts[:, here].sum(1))
            removed[f] = removed.get(f, 0) + total
            rows.append((f, "".join(FILTERS[i] for i in order), step, int(counts[0, left].sum()), total, int(counts[0, before].sum()), int(counts[0, 1 << f]), good, toxic))
    for f, *row in rows:
        yield part, *row, removed[f]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """AUDIT rows of docs (doc_id, text, lang) and labels (doc_id, quality, toxic): 600 for each part."""
    return docs.sparkSession.createDataFrame(count_vectors(docs, labels).flatMap(lambda x: orders(*x)), AUDIT, verifySchema=False)
