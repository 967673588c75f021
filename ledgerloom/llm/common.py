"""Shared pieces of the training-data operators: scratch tables, word hashing over Arrow buffers, distributed components.

Word hashing works on the bytes of an Arrow string column, without a Python object per word or per document. It goes
through a column in slices of about ``SLICE`` bytes, cut at document ends or white space, so memory is bounded by the
slice (or by the longest word) however long a document is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.rdd import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 20
ARROW = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
#: Words of up to so many bytes are hashed by table, longer ones by a cryptographic hash.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    return x ^ (x >> _S33)


#: A pseudo-random number for each byte at each of the first LONG places of a word.
_PLACED = mix(mix(np.arange(1, (LONG << 8) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def placed(data: np.ndarray, start: np.ndarray, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, places) of the bytes from the first word's on, A-Z as lower case: the sum of a word's numbers stands for it.

    start: where words begin; a word ends before the next one, and bytes in gaps count nothing. Bytes beyond LONG places say
    nothing about the word: ``digests`` has its hash.
    """
    part = LOWER[data[start[0] :]]
    within = np.arange(start[0], len(data), dtype=np.int32) - np.repeat(start.astype(np.int32), np.diff(start, append=len(data)))
    value = _PLACED[(np.minimum(within, LONG - 1) << 8) | part]
    if gap is not None:
        value[gap[start[0] :]] = 0
    return value, within


def digests(data: np.ndarray, start: np.ndarray, hashes: np.ndarray, end: np.ndarray) -> None:
    """Replace the hashes of words (from start to end) that have over LONG bytes."""
    for i in np.flatnonzero(end - start > LONG).tolist():
        word = data[start[i] : end[i]].tobytes().lower()
        hashes[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def large(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null counts as the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8) if ends is not None else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def _cuts(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of about SLICE bytes that end where a document ends or at white space."""
    at, last = int(ends[0]), int(ends[-1])
    while at < last:
        to = min(at + SLICE, last)
        if to < last:
            k = int(np.searchsorted(ends, to, "right")) - 1
            if ends[k] > at:
                to = int(ends[k])
            else:  # inside one long document
                while to < last and not SPACE[data[to]] and to < ends[k + 1]:
                    found = np.flatnonzero(SPACE[data[to : to + 4096]])
                    to = min(int(ends[k + 1]), to + (int(found[0]) if found.size else 4096))
        yield at, to
        at = to


def words(column: pa.Array, gaps: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """The 64-bit hash of each word of each text, A-Z in lower case, and n + 1 offsets of the documents' words.

    With prefixes, also a row of hashes for each of these numbers of bytes: of the words' first bytes, 0 for words that
    aren't longer.

    A word is a longest run without bytes of ``gaps``, by default ASCII white space, which gaps must include. Nulls and
    texts without words have no words.
    """
    data, ends = large(column)
    hashes, begins, heads = [], [], []
    for a, b in _cuts(data, ends):
        part = data[a:b]
        gap = gaps[part]
        first = ~gap
        first[1:] &= gap[:-1]
        inner = ends[np.searchsorted(ends, a, "left") : np.searchsorted(ends, b, "left")] - a
        first[inner] = ~gap[inner]
        start = np.flatnonzero(first)
        if not start.size:
            continue
        value, within = placed(part, start, gap)
        hashes.append(mix(np.add.reduceat(value, start - start[0])))
        if (np.diff(start, append=b - a) > LONG).any():
            digests(part, start, hashes[-1], start + np.add.reduceat((~gap[start[0] :]).astype(np.int64), start - start[0]))
        begins.append(start + a)
        if prefixes:
            size = np.add.reduceat((value != 0).astype(np.int64), start - start[0])
            heads.append(np.zeros((len(prefixes), len(start)), np.uint64))
            for row, most in zip(heads[-1], sorted(prefixes, reverse=True), strict=True):
                value[within >= most] = 0
                row[:] = np.where(size > most, mix(np.add.reduceat(value, start - start[0]) + np.uint64(most)), 0)
    if not hashes:
        none = np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
        return (*none, np.zeros((len(prefixes), 0), np.uint64)) if prefixes else none
    out = np.concatenate(hashes), np.searchsorted(np.concatenate(begins), ends, "left")
    return (*out, np.concatenate(heads, 1)) if prefixes else out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted hashes of its distinct k-word shingles; the whole sequence as one if it has fewer words."""
    hashed, at = words(column)
    total = len(hashed) - k + 1
    every = np.zeros(max(0, total), np.uint64)
    for j in range(k if total > 0 else 0):
        every += hashed[j : j + total] * _POWERS[j + 1]
    every = mix(every)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield distinct(every[a : b - k + 1])
        elif b > a:
            short = (hashed[a:b] * _POWERS[1 : 1 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text; a longer text is alone."""
    _, ends = large(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Scratch:
    """Tables written to the folder that all executors share, so that a lost executor costs no recomputation.

    The folder is spark.checkpoint.dir; where that is unset (as in tests), a folder in the warehouse directory.

    Where the session sets no limit on the bytes of an Arrow batch, it gets that of ``ARROW``: by default a batch may have 64 MB
    of texts, which the executor and its Python worker both hold.
    """

    def __init__(self, spark: SparkSession):
        if _LIMIT not in spark.conf.getAll:
            spark.conf.set(_LIMIT, ARROW)
        top = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        self.spark, self.path, self.n = spark, f"{top.rstrip('/')}/{uuid.uuid4().hex}", 0

    def place(self, name: str) -> str:
        self.n += 1
        return f"{self.path}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write the rows and read them back: lineage ends here."""
        df.write.parquet(path := self.place(name))
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for x in tables:
            path = jvm.org.apache.hadoop.fs.Path(x.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *tables: DataFrame) -> str:
    """name, or what it takes after it to differ from all columns of tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Slices of a bit table, which are combined apart.
SLICES = 64


def bit_table(keys: RDD, bits: int) -> np.ndarray:
    """A table of 2 ** bits bits with those of arrays of 64-bit keys set; SLICES rows of fixed size go to the driver."""
    size = (1 << bits) // SLICES

    def run(rows: Iterable[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        out = np.zeros(1 << bits, bool)
        for h in rows:
            out[bit_place(h, bits)] = True
        for i, part in enumerate(np.split(out, SLICES)):
            if part.any():
                yield i, np.packbits(part, bitorder="little")

    out = np.zeros(1 << bits - 3, np.uint8)
    for i, part in keys.coalesce(16).mapPartitions(run).reduceByKey(np.bitwise_or, SLICES).collect():
        out[i * size // 8 : (i + 1) * size // 8] = part
    return out


def bit_place(h: np.ndarray, bits: int) -> np.ndarray:
    return mix(h) >> np.uint64(64 - bits)


def bit_held(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bits of keys are set."""
    at = bit_place(h, bits)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def components(scratch: Scratch, edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for every node of edges (src, dst), label the smallest node that it reaches.

    Alternating large-star and small-star rounds: every round keeps one edge per node at most, all steps are grouped
    minima with partial aggregation and joins that adaptive execution can split, and nothing is gathered. Self loops and
    repeated edges are allowed; no edges give no rows.
    """
    spark = scratch.spark
    now = scratch.cut(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges"
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = state(now)
    for _ in range(most):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        wide = both.join(least, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        lows = low.select(F.col("u").alias("x"), "m")
        close = wide.join(lows, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = scratch.cut(close.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        sign = state(then)
        scratch.drop(now)
        now = then
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
