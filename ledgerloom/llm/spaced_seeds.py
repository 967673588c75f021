"""Benchmark decontamination with spaced-seed hashing (operator 2).

Fixed masks choose 6 of up to 12 neighbouring words and ignore the others, so that a hash of the chosen words survives
substitutions at ignored places. Hashes of all benchmark items are joined with those of all documents, and around each hit
the item is laid over the document at the hit's offset and compared word by word.

A document holds an item if, at one offset, the item's words agree in at least ``identity`` of its length, or a stretch with
that identity has at least ``stretch`` agreeing words. Words are runs of letters and digits with A-Z in lower case; ASCII
punctuation and white space part them.

The documents are read once. Each task tests its hashes against a bit table of the benchmark's hashes, of at most 2**27
bits however large the benchmark is; what passes (contaminated documents and few others) is joined with the benchmark's
hashes exactly. A fuller table only lets more candidates through.

Defined cases: null and empty texts hold nothing and null or empty items are never held; items of under ``least`` words
can't be told from chance and aren't searched (with a lower ``least`` those of under 5 words are, by exact match at an identity
of 0.8); items of up to ``SURE`` words are searched by further masks, so that none is missed at that length; equal items are all reported; each row of repeated doc_ids is searched, and its findings are reported once per (doc_id, item_id);
rows without doc_id are searched and reported with a null doc_id; other columns are ignored by ``contamination`` and kept by
``clean``; empty tables give no findings.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, Scratch, fresh, mix, parallelism, slices, words

#: The masks: 1 marks a word that is hashed, 0 one that is ignored.
MASKS = ("11101011", "1101100101", "1100101011", "101100010011")
#: Items of up to so many words are found whichever words are substituted, as far as identity allows; MASKS suffice above.
SURE = 16
#: Bits that a hash sets, and that all must be set for it to pass.
PROBES = 4
_ODD = np.cumprod(np.full(64, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)
_HITS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("words", pa.binary()), ("hash", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32()))]
)
_SEEDS = pa.schema([("hash", pa.int64()), ("item_id", pa.int64()), ("at", pa.int32())])


def seeds(hashed: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of len(mask) words."""
    n = len(hashed) - len(mask) + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in (j for j, x in enumerate(mask) if x == "1" and n > 0):
        out += hashed[j : j + n] * _ODD[j]
    return mix(out ^ np.uint64(int("1" + mask, 2) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


@cache
def masks_for(n: int, identity: float = 0.8) -> tuple[str, ...]:
    """Those that an item of n words is searched by: all MASKS that fit, and up to SURE words as many lighter ones as it takes
    that no choice of the substituted words that identity allows hits every place of every mask."""
    masks = [m for m in MASKS if len(m) <= n]
    if n > SURE:
        return tuple(masks)
    share = Fraction(identity).limit_denominator(10_000)
    wrong = n - -(-share.numerator * n // share.denominator)
    if not wrong:
        return ("1" * n,)
    at = lambda m: [sum(1 << k + i for i, x in enumerate(m) if x == "1") for k in range(n - len(m) + 1)]
    left = [sum(1 << i for i in x) for x in combinations(range(n), wrong)]
    left = [x for x in left if all(x & p for m in masks for p in at(m))]
    for weight in range(min(n - wrong, 4 if n < 8 else 5), 0, -1):
        able = ["".join("01"[i in {0, span - 1, *x}] for i in range(span)) for span in range(weight, n + 1) for x in combinations(range(1, span - 1), max(0, weight - 2))]
        while left:
            kept = {m: [x for x in left if all(x & p for p in at(m))] for m in able}
            best = min(able, key=lambda m: (len(kept[m]), len(m), m))
            if len(kept[best]) == len(left):
                break
            masks.append(best)
            left = kept[best]
    return tuple(masks)


def _seed_rows(least: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, at = words(batch.column(1), PUNCTUATION)
            out: list[list] = [[], [], []]
            for item, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for mask in masks_for(b - a, identity) if b - a >= least else ():
                    found = seeds(hashed[a:b], mask)
                    out[0].append(found.astype(np.int64))
                    out[1].append(np.full(len(found), item if item is not None else -(1 << 63), np.int64))
                    out[2].append(np.arange(len(found), dtype=np.int32))
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], schema=_SEEDS)

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashed, at = words(batch.column(1), PUNCTUATION)
        blobs = [hashed[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(blobs, pa.binary())], names=["item_id", "item"])


def places(found: np.ndarray, probe: int, size: int) -> np.ndarray:
    """The bit of each hash for one of PROBES probes, in a table of 2**size bits."""
    return ((found * _ODD[probe]) >> np.uint64(64 - size)).astype(np.int64)


def _bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.record_batch([pa.array(np.unique(np.concatenate([places(found, p, size) for p in range(PROBES)])))], names=["bit"])

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, bits): 2**16 bits of the table each."""
    chunks: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.column(0).to_numpy(zero_copy_only=False)
        for chunk in np.unique(at >> 16).tolist():
            bits = chunks.setdefault(chunk, np.zeros(1 << 16, bool))
            bits[at[at >> 16 == chunk] & 0xFFFF] = True
    for chunk, bits in chunks.items():
        yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])


def _search(table, size: int, masks: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, n = table.value, 0
        first = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in slices(whole):
                hashed, at = words(batch.column(1), PUNCTUATION)
                where, what = [], []
                for mask in masks:
                    found = seeds(hashed, mask)
                    hit = np.arange(len(found))
                    for probe in range(PROBES):
                        place = places(found[hit], probe, size)
                        hit = hit[(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
                    doc = np.searchsorted(at, hit, "right") - 1
                    inside = hit + len(mask) <= at[doc + 1]
                    where.append(hit[inside])
                    what.append(found[hit[inside]])
                pos, seed = np.concatenate(where), np.concatenate(what).astype(np.int64)
                if not len(pos):
                    continue
                order = np.argsort(pos, kind="stable")
                pos, seed = pos[order], seed[order]
                doc = np.searchsorted(at, pos, "right") - 1
                own, start = np.unique(doc, return_index=True)
                ids = batch.column(0).to_pylist()
                rows = []
                for d, a, b in zip(own.tolist(), start.tolist(), [*start[1:].tolist(), len(pos)], strict=True):
                    rows.append((first + n, ids[d], hashed[at[d] : at[d + 1]].tobytes(), seed[a:b], (pos[a:b] - at[d]).astype(np.int32)))
                    n += 1
                yield pa.record_batch([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _HITS, strict=True)], schema=_HITS)

    return run


def overlap(doc: np.ndarray, item: np.ndarray, off: int, identity: float, stretch: int) -> tuple[int, int] | None:
    """(agreeing words, first of them in the document) of the item laid over the document at off, if that is an overlap."""
    a, b = max(0, -off), min(len(item), len(doc) - off)
    if a >= b:
        return None
    same = doc[a + off : b + off] == item[a:b]
    part = Fraction(identity).limit_denominator(10_000)
    num, den = part.numerator, part.denominator
    every = int(same.sum())
    if den * every >= num * len(item):
        return every, off + a + int(same.argmax())
    # of all stretches whose score isn't negative that with the most agreeing words: for each end the first begin of no higher score
    score = np.r_[0, np.cumsum(np.where(same, den - num, -num))]
    agree = np.r_[0, np.cumsum(same)]
    begin = np.searchsorted(-np.minimum.accumulate(score), -score)
    end = int((agree - agree[begin]).argmax())
    begin = int(begin[end])
    count = int(agree[end] - agree[begin])
    return (count, off + a + begin + int(same[begin:end].argmax())) if count >= stretch else None


def _verify(identity: float, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            out = []
            for doc_id, item_id, doc, item, off in zip(d["doc_id"], d["item_id"], d["words"], d["item"], d["off"], strict=True):
                item = np.frombuffer(item, np.uint64)
                if got := overlap(np.frombuffer(doc, np.uint64), item, off, identity, stretch):
                    out.append((doc_id, item_id, got[0], len(item), got[1]))
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "item_id", "matched", "item_words", "doc_word"])

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, identity: float = 0.8, stretch: int = 13, least: int = 5, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, item_id, matched, item_words, doc_word): each document's best overlap with each item that it holds."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    bench = benchmark.select(F.col("item_id").cast("long"), "text")
    seed = scratch.cut(bench.mapInArrow(_seed_rows(least, identity), "hash long, item_id long, at int"), "seeds")
    items = bench.where("item_id is not null").mapInArrow(_item_words, "item_id long, item binary")
    size = min(27, max(16, (128 * seed.count()).bit_length()))
    table = np.zeros(1 << size >> 3, np.uint8)
    bits = seed.select("hash").mapInArrow(_bits(size), "bit long")
    chunks = bits.repartitionById(parallelism(spark), F.shiftright("bit", 16).cast("int")).mapInArrow(_tables, "chunk int, bits binary")
    for at, part in chunks.collect():  # of fixed total size
        table[at << 13 : (at + 1) << 13] |= np.frombuffer(part, np.uint8)
    short = [r[0] for r in bench.mapInArrow(_item_words, "item_id long, item binary").select((F.octet_length("item") / 8).cast("int").alias("n")).where(f"n >= {max(1, least)} and n <= {SURE}").distinct().collect()]
    masks = list(dict.fromkeys([*MASKS, *(m for n in sorted(short) for m in masks_for(n, identity))]))
    shared = spark.sparkContext.broadcast(table)
    hits = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _search(shared, size, masks), "row long, doc_id long, words binary, hash array<long>, pos array<int>"
    )
    hits = scratch.cut(hits, "hits")
    each = hits.select("row", F.explode(F.arrays_zip("hash", "pos")).alias("x")).select("row", "x.hash", "x.pos")
    pairs = each.join(seed, "hash").select("row", "item_id", (F.col("pos") - F.col("at")).alias("off")).distinct()
    laid = pairs.join(hits.select("row", "doc_id", "words"), "row").join(items, "item_id").select("doc_id", "item_id", "words", "item", "off")
    found = laid.mapInArrow(_verify(identity, stretch), "doc_id long, item_id long, matched long, item_words long, doc_word long")
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("matched", "item_words", "doc_word"), F.struct("matched", -F.col("doc_word"))).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all columns, whatever their names; rows with one doc_id, or without, are one document."""
    scratch, out = Scratch(docs.sparkSession), fresh("bad", docs)
    bad = scratch.cut(contamination(docs, benchmark, scratch=scratch, **how).select(F.col("doc_id").alias(out)).distinct(), "contaminated")
    return docs.join(bad.hint("merge"), docs["doc_id"].eqNullSafe(F.col(out)), "left_anti")
