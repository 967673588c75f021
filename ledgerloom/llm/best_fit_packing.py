"""Best-fit packing by minimum bin slack (operator 3).

Documents are tokenized and cut into pieces of at most ``room`` tokens; pieces are packed into as few sequences of ``room``
tokens as the heuristic finds. Only lengths matter to packing, so it works on the counts of the ``room`` possible lengths, of
fixed size however many pieces there are: per bin the longest length left is taken, and a bitset dynamic programme over the
lengths left finds the fullest feasible combination with it. The combination is then removed as often as the counts allow,
which is what removing it bin by bin would do.

Pieces are then matched with the combinations by their rank among pieces of their length. Ranks come from counts per
(bucket, length) and positions inside these groups, with buckets a hash of doc_id, so that a length that a third of all pieces
have is ranked in as many tasks as any.

Tokenizing goes through a bounded cache of units, words or parts of words between which the tokenizer never joins: a text's ids
are its units' ids, which are looked up by hash in arrays. Texts with special tokens are tokenized whole.

Defined cases: a null or empty text is the end token alone; pieces of equal length are ranked by (bucket, doc_id, piece, start,
crc), so repeated rows of a doc_id are packed separately and interchangeably; a null doc_id is packed as any other; other
columns, whatever their names, are ignored by ``pieces`` and kept by ``pack``; no rows give no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import PUNCTUATION, SPACE, Scratch, digests, fresh, large, mix, parallelism, placed, slices

ROOM = 2048
END = np.zeros(1, "<u4").tobytes()
#: Units that a worker keeps; a fuller cache is emptied.
CACHE = 600_000
#: Texts given to the tokenizer at once, and bytes of text that go through the cache at once.
BATCH, SLICE = 256, 1 << 19
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_WITH_IDS = _PIECES.append(pa.field("ids", pa.binary()))


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: ASCII marks that part units; apostrophes don't, as they begin endings such as 's.
_MARK = PUNCTUATION & ~SPACE & ~_set(b"'")
#: First bytes of Latin letters beyond ASCII, and the bytes that go on.
_LATIN = _set(bytes(range(0xC3, 0xCA))) | _set(bytes(range(0x80, 0xC0)))
_OTHER = (np.arange(256) >= 128) & ~_LATIN


def units(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of the units of data, which documents part at edges.

    A unit is a word or, where its characters are ASCII or Latin letters, a run of marks or of others in it. The tokenizer
    never joins over such a border, nor over white space, so a unit's ids don't depend on what stands around it. The hash takes
    A-Z as lower case, as the tokenizer does.
    """
    space = SPACE[data]
    n = len(data)
    begin = ~space
    begin[1:] &= space[:-1]
    inner = edges[(edges > 0) & (edges < n)]
    begin[inner] = ~space[inner]
    begin[:1] = ~space[:1]
    odd = _OTHER[data] | (data == 39)
    odd[1:] |= ((data[1:] == 0x97) | (data[1:] == 0xB7)) & (data[:-1] == 0xC3)  # multiplication and division signs
    odd[1:] |= (data[1:] == 0xB0) & (data[:-1] == 0xC4)  # I with a dot, which gets two characters in lower case
    word = np.flatnonzero(begin)
    if not len(word):
        return word, word, np.zeros(0, np.uint64)
    whole = np.repeat(np.add.reduceat(odd[word[0] :].astype(np.int32), word - word[0]) > 0, np.diff(word, append=n))
    mark = _MARK[data]
    turn = np.zeros(n, bool)
    turn[1:] = (mark[1:] != mark[:-1]) & ~space[1:] & ~space[:-1]
    turn[word[0] :] &= ~whole
    begin |= turn
    start = np.flatnonzero(begin)
    end = start + np.add.reduceat((~space[start[0] :]).astype(np.int64), start - start[0])
    hashes = mix(np.add.reduceat(placed(data, start, space)[0], start - start[0]))
    digests(data, start, hashes, end)
    return start, end, hashes


class UnitCache:
    """Ids of units by their 64-bit hash, in a few arrays: sorted hashes, and where their ids are in one pool."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; a thread's memory stays with it
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.encode() for x in (t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        """In small batches, as the tokenizer's results are many times larger than the ids."""
        for a in range(0, len(texts), BATCH):
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + BATCH], add_special_tokens=False))

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        """keys: in order, none known yet."""
        ids, size = array("I"), array("i")
        for x in self._encode([t.decode("utf-8", "replace") for t in texts]):
            ids.extend(x)
            size.append(len(x))
        size = np.array(size)
        at = (len(self.pool) + np.cumsum(size) - size).astype(np.int32)
        self.pool = np.concatenate([self.pool, np.array(ids, "<u4")])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.keys, keys)
        return np.where(self.keys[place.clip(max=len(self.keys) - 1)] == keys, place, -1) if len(self.keys) else np.full(len(keys), -1)

    def ids(self, column: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, a null being empty."""
        data, ends = large(column)
        data, edges = data[ends[0] : ends[-1]], ends - ends[0]
        start, end, keys = units(data, edges)
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.clear()
        place = self._find(unique)
        if (new := np.flatnonzero(place < 0)).size:
            text = data.tobytes()
            self._learn(unique[new], [text[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            place = self._find(unique)
        at, size = self.at[place][back], self.size[place][back]
        stop = np.cumsum(size)
        whole = self.pool[np.repeat(at - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)].tobytes()
        bound = np.concatenate([[0], stop])[np.searchsorted(start, edges, "left")] * 4
        raw = data.tobytes() if self.special else b""
        marked = any(x in raw for x in self.special)
        for a, b, i, j in zip(bound[:-1].tolist(), bound[1:].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if marked and any(x in raw[i:j] for x in self.special):
                yield np.array(next(self._encode([raw[i:j].decode("utf-8", "replace")])), "<u4").tobytes()
            else:
                yield whole[a:b]


_CACHES: dict[str, UnitCache] = {}


def _tokenize(path: str, room: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _CACHES.get(path) or _CACHES.setdefault(path, UnitCache(path))  # kept while the worker lives
        for whole in batches:
            for batch in slices(whole, size=SLICE):
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), cache.ids(batch.column(1)), strict=True):
                    ids += END
                    for piece, a in enumerate(range(0, len(ids), 4 * room)):
                        part = ids[a : a + 4 * room]
                        rows.append((doc, piece, a // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else ())))
                schema = _WITH_IDS if keep_ids else _PIECES
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs (doc_id, text); tokenizer: the path of its file."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.mapInArrow(_tokenize(tokenizer, room, keep_ids), out)


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """Lengths (with how many of each) of the fullest bin that has the longest length left."""
    longest = int(np.flatnonzero(counts)[-1])
    free = room - longest
    limit = (1 << free + 1) - 1
    reach, steps = 1, []
    if free:
        for length in np.flatnonzero(counts[: free + 1])[::-1].tolist():
            left, times = min(int(counts[length]) - (length == longest), free // length), 1
            while left > 0:
                take = min(times, left)
                more = (reach | reach << take * length) & limit
                if more != reach:
                    steps.append((length, take, reach))
                    reach = more
                left -= take
                times *= 2
            if reach >> free & 1:
                break
    out, at = {longest: 1}, reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= take * length
    return out


def combinations(counts: np.ndarray, room: int = ROOM) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths with the number of bins that each fills; counts: pieces by length."""
    counts, out = counts.copy(), []
    while counts.any():
        one = fullest(counts, room)
        times = min(int(counts[length]) // n for length, n in one.items())
        for length, n in one.items():
            counts[length] -= n * times
        out.append((one, times))
    return out


def _places(counts: np.ndarray, room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank, in a bin, first sequence, first offset)."""
    used, out, sequence = np.zeros(room + 1, np.int64), [], 0
    for one, times in combinations(counts, room):
        offset = 0
        for length, n in sorted(one.items(), reverse=True):
            out.append((length, int(used[length]), int(used[length] + n * times - 1), n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return out


def pack(pieces: DataFrame, room: int = ROOM, scratch: Scratch | None = None) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset."""
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark)
    buckets = 8 * parallelism(spark)
    bucket, first, place, rank = (fresh(x, pieces) for x in ("bucket", "first", "place", "rank"))
    of = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    made = scratch.cut(pieces.withColumn(bucket, of), "pieces")
    counted = scratch.cut(made.groupBy("length", bucket).agg(F.count("*").alias(first)), "counts")
    counts = np.zeros(room + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum(first)).collect():  # at most room rows
        counts[length] = n
    before = F.sum(first).over(W.partitionBy("length").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    firsts = counted.select("length", bucket, F.coalesce(before, F.lit(0)).alias(first))
    places = spark.createDataFrame(_places(counts, room), "length long, low long, high long, many long, seq long, off long")
    within = W.partitionBy(bucket, "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = made.withColumn(place, F.row_number().over(within)).join(firsts, [bucket, "length"])
    ranked = ranked.withColumn(rank, F.col(first) + F.col(place) - 1).drop(bucket, first, place)
    # combinations are of bounded number: each uses up some length's count below its number in the bin
    out = ranked.join(F.broadcast(places).alias("p"), (F.col("p.length") == ranked["length"]) & ranked[rank].between(F.col("p.low"), F.col("p.high")))
    at = ranked[rank] - F.col("p.low")
    return out.select(
        *[ranked[c] for c in pieces.columns],
        (F.col("p.seq") + F.floor(at / F.col("p.many"))).cast("long").alias("sequence_id"),
        (F.col("p.off") + at % F.col("p.many") * ranked["length"]).cast("long").alias("offset"),
    )
