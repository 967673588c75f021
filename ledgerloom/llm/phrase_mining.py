"""Phrase collocation mining (operator 13).

Texts are split at .,;:!? and line ends into pieces, those at spaces and tabs into words, A-Z in lower case; all counts are per lang.
Candidates are phrases of 2 or 3 words that occur ``least`` times or more. They are found level by level: a phrase can only be
frequent if all phrases inside it are, so that only such occurrences go on.

A level is counted in shards by the phrase's hash. Each task over texts adds equal phrases up first and sends a shard one block of
them. The distinct candidates of a shard get a minimal perfect hash (bit tables of falling size: keys alone at their place stay,
others go to the next table), with the key stored at each slot; an entry counts only where the stored key is its own. Each block is
counted with numpy.bincount by slot, and these arrays are summed as a tree. Frequent keys with their counts get a minimal perfect
hash again; the counts of a candidate's two parts at each cut are read from it by slot: a shard asks each other shard once for the
distinct keys it needs.

A word is known by 64 bits of a hash of its bytes, a phrase by a linear combination of its words' hashes, so that a part follows from
the whole and the other part; equal hashes are taken for equal phrases. Only phrases in the result, and those that tie with the last
of them, are written out, by a last pass over the texts.

Scale: nothing that grows with the corpus is broadcast or gathered: broadcast are bit tables of fixed size (``BITS``; where a corpus
fills them, they rule out less and the results stay the same). A phrase is shuffled once from each task, with 9 bytes as a rule. The
number of shards grows with the corpus (``shard_bytes`` of text each), so a task's keys are bounded; a word or phrase of however many
occurrences is one entry for each task that read it.

Defined cases: a null text is the empty text; a null lang is ``und``, together with the lang of that name; repeated rows count again;
doc_id and other columns are ignored; no rows, or no candidates, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.rdd import RDD
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Scratch, _cuts, bit_held, bit_table, digests, distinct, large, mix, placed

#: Bytes between words, and those of them between pieces.
GAPS = SPACE.copy()
GAPS[list(b".,;:!?")] = True
BREAKS = GAPS.copy()
BREAKS[list(b" \t")] = False
#: Bits of a table of frequent keys.
BITS = 26
#: Entries that a task holds before it gives them on.
HELD = 3 << 19
_PAIR = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_TRIPLE = tuple(np.uint64(x) for x in (0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))
_INVERSE = {int(x): np.uint64(pow(int(x), -1, 1 << 64)) for x in (_PAIR[1], _TRIPLE[2])}
BLOCKS = "kind string, level int, lang string, shard int, h binary, c binary, a binary, b binary"
TABLE = "level int, lang string, shard int, mph binary, h binary, c binary, a binary, b binary, total long"
MESSAGES = "level int, lang string, shard int, kind string, from_level int, from_shard int, h binary, c binary"
FOUND = "level int, lang string, h long, a long, l long, r long, score long"


# --- hashes and words


def tokens(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(hash, start, end, piece) of each word of a column: its bytes in the column's buffer, and a number that two words share if
    nothing but spaces and tabs is between the words from one to the other."""
    data, ends = large(column)
    out: list[tuple[np.ndarray, ...]] = []
    broken = 0
    for a, b in _cuts(data, ends):
        part = data[a:b]
        gap = GAPS[part]
        first, last = ~gap, ~gap
        first[1:] &= gap[:-1]
        last[:-1] &= gap[1:]
        inner = ends[np.searchsorted(ends, a, "left") : np.searchsorted(ends, b, "left")] - a
        first[inner] = ~gap[inner]
        inner = inner[inner > 0]
        last[inner - 1] = ~gap[inner - 1]
        cuts = np.cumsum(BREAKS[part], dtype=np.int64) + broken
        broken = int(cuts[-1])
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if start.size:
            value, _ = placed(part, start, gap)
            hashes = mix(np.add.reduceat(value, start - start[0]))
            digests(part, start, hashes, end)
            out.append((hashes, start + a, end + a, cuts[start] + np.searchsorted(ends, start + a, "right")))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def of_lang(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * _PAIR[0] + b * _PAIR[1]


def second(whole: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The second word's hash of a pair whose first one is a."""
    return (whole - a * _PAIR[0]) * _INVERSE[int(_PAIR[1])]


def triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return a * _TRIPLE[0] + b * _TRIPLE[1] + c * _TRIPLE[2]


def third(whole: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (whole - a * _TRIPLE[0] - b * _TRIPLE[1]) * _INVERSE[int(_TRIPLE[2])]


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Of keys in rising order the numbers rise; shards: a power of two."""
    return (h >> np.uint64(33)).astype(np.int64) * shards >> 31


# --- minimal perfect hash


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n - 1. Each bit table has three bits for two keys left; a key that is alone at its place stays, its
    slot is the number of set bits before. Other keys than those it was made for get any slot or -1: compare the stored key."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables, self.ranks, n = tables, [], 0
        for bits in tables:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + n)
            n += int(bits.sum())

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * int(_PAIR[0]) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        tables = []
        while keys.size:
            if len(tables) == 256:
                raise ValueError("keys aren't distinct")
            at = cls._at(keys, len(tables), size := keys.size * 3 // 2 + 8)
            number = np.bincount(at, minlength=size)
            tables.append(number == 1)
            keys = keys[number[at] > 1]
        return cls(tables)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.tables, self.ranks, strict=True)):
            at = self._at(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + np.packbits(t).tobytes() for t in self.tables)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        tables, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            to = at + 8 + (n + 7) // 8
            tables.append(np.unpackbits(np.frombuffer(data, np.uint8, to - at - 8, at + 8), count=n).astype(bool))
            at = to
        return cls(tables)


def _u(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", np.uint64)


def _i(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", np.int64)


def _short(c: np.ndarray) -> bytes:
    """Counts with a byte each if that is enough for all, else with 8."""
    return (c.astype(np.uint8) if c.max(initial=0) < 256 else c.astype(np.int64)).tobytes()


def _counts(block: dict) -> np.ndarray:
    return np.frombuffer(block["c"], np.int64 if len(block["c"]) == len(block["h"]) else np.uint8)


def read_slots(row: dict, keys: np.ndarray) -> np.ndarray:
    """The slots of keys in a table's row, -1 where the stored key is another one."""
    slots, stored = PerfectHash.load(row["mph"]).slots(keys), _u(row["h"])
    if not stored.size:
        return np.full(len(keys), -1, np.int64)
    return np.where(stored[slots] == keys, slots, -1)


def _batch(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table({n: pa.array(list(c), kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def _batches(rows: Iterable[tuple], schema: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held_back, size = [], 0
    for row in rows:
        held_back.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > most:
            yield from _batch(held_back, schema).to_batches()
            held_back, size = [], 0
    if held_back:
        yield from _batch(held_back, schema).to_batches()


# --- passes over the texts


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, tuple[np.ndarray, ...]]]:
    """(lang, texts, tokens) with the words' hashes by lang."""
    for batch in batches:
        text, lang = batch.column(0), batch.column(1)
        for name in pc.unique(lang).to_pylist():
            own = text.filter(pc.equal(lang, name)).cast(pa.large_string())
            h, *rest = tokens(own)
            yield name, own, (h + of_lang(name), *rest)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Entries (h, c, more...) by h, counts summed."""
    h, c, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return keys, np.bincount(inverse, c, len(keys)).astype(np.int64), *(m[first] for m in more)


def _blocks(level: int, shards: int, entries: Iterable[tuple[str, str, tuple[np.ndarray, ...]]]) -> Iterator[tuple]:
    """Entries (kind, lang, (h, c, more...)), gathered, summed and given on in blocks by shard."""
    kept: dict[tuple[str, str], list] = {}
    n = 0

    def give() -> Iterator[tuple]:
        for (kind, lang), parts in kept.items():
            h, c, *more = _merged(parts)
            shard = _shard(h, shards)
            for a, b in pairwise([*np.flatnonzero(np.diff(shard, prepend=-1)), len(h)]):
                columns = [x[a:b].tobytes() for x in more]
                yield kind, level, lang, int(shard[a]), h[a:b].tobytes(), _short(c[a:b]), *columns, *[None] * (2 - len(columns))

    for kind, lang, entry in entries:
        kept.setdefault((kind, lang), []).append(entry)
        n += len(entry[0])
        if n > HELD:
            kept = {k: [_merged(v)] for k, v in kept.items()}
            n = sum(len(v[0][0]) for v in kept.values())
            if n > HELD // 2:
                yield from give()
                kept, n = {}, 0
    yield from give()


def _pairs(h: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word with the next one, and whether they are one phrase."""
    return pair(h[:-1], h[1:]), piece[:-1] == piece[1:]


def _first(shards: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (("words", lang, np.unique(h, return_counts=True)) for lang, _, (h, *_) in _each(batches))
        yield from _batches(_blocks(1, shards, entries), BLOCKS)

    return run


def _second(shards: int, words) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple]:
            for lang, _, (h, _, _, piece) in _each(batches):
                known = bit_held(words.value, h, BITS)
                both, one = _pairs(h, piece)
                yield "pairs", lang, np.unique(both[one & known[:-1] & known[1:]], return_counts=True)

        yield from _batches(_blocks(2, shards, entries()), BLOCKS)

    return run


def _third(shards: int, pairs) -> Callable:
    """Phrases of three words with the hashes of their first word and pair, and the first words of frequent pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple]:
            for lang, _, (h, _, _, piece) in _each(batches):
                both, one = _pairs(h, piece)
                one &= bit_held(pairs.value, both, BITS)
                keys, first = np.unique(both[one], return_index=True)
                yield "parts", lang, (keys, np.zeros(len(keys), np.int64), h[:-1][one][first])
                at = np.flatnonzero(one[:-1] & one[1:])
                keys, first, c = np.unique(triple(h[at], h[at + 1], h[at + 2]), return_index=True, return_counts=True)
                at = at[first]
                yield "triples", lang, (keys, c, h[at], both[at])

        yield from _batches(_blocks(3, shards, entries()), BLOCKS)

    return run


def _spelt(wanted) -> Callable:
    """(level, lang, h, phrase) of phrases whose hash is wanted, each once a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for lang, texts, (h, start, end, piece) in _each(batches):
            data, _ = large(texts)
            rows = []
            for n in (2, 3):
                if len(h) < n:
                    continue
                keys = pair(h[:-1], h[1:]) if n == 2 else triple(h[:-2], h[1:-1], h[2:])
                at = np.flatnonzero(piece[: len(keys)] == piece[n - 1 :])
                at = at[bit_held(wanted.value[n], keys[at], BITS)]
                keys, first = np.unique(keys[at], return_index=True)
                for key, i in zip(keys.tolist(), at[first].tolist(), strict=True):
                    if (lang, key) not in seen:
                        seen.add((lang, key))
                        words = [data[start[j] : end[j]].tobytes().lower() for j in range(i, i + n)]
                        rows.append((n, lang, key - (key >> 63 << 64), b" ".join(words).decode("utf-8", "replace")))
            yield from _batch(rows, SPELT).to_batches()

    return run


SPELT = "level int, lang string, h long, phrase string"


# --- levels


def _tree_sum(arrays: Iterable[np.ndarray], size: int) -> np.ndarray:
    """The sum of arrays, neighbours first: as many are held at once as the tree is high."""
    held: list[tuple[int, np.ndarray]] = []
    for x in arrays:
        held.append((0, x))
        while len(held) > 1 and held[-1][0] == held[-2][0]:
            (n, b), (_, a) = held.pop(), held.pop()
            held.append((n + 1, a + b))
    return np.sum([x for _, x in held], 0) if held else np.zeros(size, np.int64)


def _count(least: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        """A shard's blocks, counted by slot; its frequent keys, in a perfect hash of their own, and the sum of all counts."""
        rows = table.to_pylist()
        keys = distinct(np.concatenate([_u(r["h"]) for r in rows]))
        mph = PerfectHash.build(keys)
        stored = np.empty(len(keys), np.uint64)
        stored[mph.slots(keys)] = keys

        def by_slot(row: dict) -> np.ndarray:
            h = _u(row["h"])
            slots = mph.slots(h)
            own = stored[slots] == h
            return np.bincount(slots[own], _counts(row)[own], len(keys)).astype(np.int64)

        c = _tree_sum(map(by_slot, rows), len(keys))
        keep = np.flatnonzero(c >= least)
        frequent = PerfectHash.build(stored[keep])
        order = keep[np.argsort(frequent.slots(stored[keep]))]
        more = {x: None for x in "ab"}
        for x in more:
            if rows[0][x] is not None:
                out = np.empty(len(keys), np.uint64)
                for r in rows:
                    out[mph.slots(_u(r["h"]))] = _u(r[x])
                more[x] = out[order].tobytes()
        return _batch([(rows[0]["level"], rows[0]["lang"], rows[0]["shard"], frequent.dump(), stored[order].tobytes(), c[order].tobytes(), more["a"], more["b"], int(c.sum()))], TABLE)

    return run


def level(blocks: DataFrame, least: int) -> DataFrame:
    """The frequent keys of a level by shard (TABLE), from its blocks."""
    return blocks.groupBy("lang", "shard").applyInArrow(_count(least), TABLE)


def _third_level(least: int) -> Callable:
    count = _count(least)

    def run(blocks: pa.Table, tables: pa.Table) -> pa.Table:
        """A shard's phrases of three words, counted, and its row of frequent pairs with the hashes of their first words."""
        out = []
        own = blocks.filter(pc.equal(blocks["kind"], "triples"))
        if own.num_rows:
            out.append(count(own))
        for row in tables.to_pylist():
            first = np.zeros(len(row["h"]) // 8, np.uint64)
            for block in blocks.filter(pc.equal(blocks["kind"], "parts")).to_pylist():
                slots = read_slots(row, _u(block["h"]))
                first[slots[slots >= 0]] = _u(block["a"])[slots >= 0]
            out.append(_batch([tuple(row[x] for x in ("level", "lang", "shard", "mph", "h", "c")) + (first.tobytes(), None, row["total"])], TABLE))
        return pa.concat_tables(out) if out else _batch([], TABLE)

    return run


def keys_of(table: DataFrame) -> RDD:
    return table.select("h").rdd.map(lambda r: _u(r["h"]))


# --- cuts


def _parts(row: dict) -> list[tuple[int, np.ndarray]]:
    """(level, keys) of the parts of a row's phrases: the first and the rest of each cut."""
    h, a = _u(row["h"]), _u(row["a"])
    if row["level"] == 2:
        return [(1, a), (1, second(h, a))]
    both = _u(row["b"])
    b = second(both, a)
    c = third(h, a, b)
    return [(1, a), (2, pair(b, c)), (2, both), (1, c)]


def _ask(shards: int) -> Callable:
    """A row's messages to the shards of its phrases' parts: the distinct keys whose counts it needs, and of phrases of three words
    also their counts, for the pairs inside."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for row in (r for x in batches for r in x.to_pylist()):
                parts = _parts(row)
                for to in {n for n, _ in parts}:
                    asked = np.concatenate([x for n, x in parts if n == to])
                    keys = np.unique(asked)
                    most = np.zeros(len(keys), np.int64)
                    np.maximum.at(most, np.searchsorted(keys, asked), np.tile(_i(row["c"]), sum(n == to for n, _ in parts)))
                    shard = _shard(keys, shards)
                    for i, j in pairwise([*np.flatnonzero(np.diff(shard, prepend=-1)), len(keys)]):
                        yield to, row["lang"], int(shard[i]), "ask", row["level"], row["shard"], keys[i:j].tobytes(), None
                        if to == 2:
                            yield to, row["lang"], int(shard[i]), "inside", row["level"], row["shard"], keys[i:j].tobytes(), most[i:j].tobytes()

        yield from _batches(rows(), MESSAGES)

    return run


def _answer(asked: pa.Table, tables: pa.Table) -> pa.Table:
    """What a shard is asked, read by slot."""
    if not asked.num_rows:
        return _batch([], MESSAGES)
    [row] = tables.to_pylist()  # parts of frequent phrases are frequent, so their shard has a table
    counts, out = _i(row["c"]), []
    for q in asked.to_pylist():
        slots = read_slots(row, _u(q["h"]))
        if (slots < 0).any():
            raise ValueError("part of a phrase without a count")
        out.append((q["from_level"], row["lang"], q["from_shard"], "answer", row["level"], row["shard"], q["h"], counts[slots].tobytes()))
    return _batch(out, MESSAGES)


def _score(messages: pa.Table, tables: pa.Table) -> pa.Table:
    """A row's phrases with their lowest cut, in whole numbers of any size; pairs inside a frequent enough longer one go."""
    if not tables.num_rows:
        return _batch([], FOUND)
    [row] = tables.to_pylist()
    if not row["h"]:
        return _batch([], FOUND)
    messages = messages.to_pylist()
    known = {}
    for n in (1, 2):
        got = [(_u(m["h"]), _i(m["c"])) for m in messages if m["kind"] == "answer" and m["from_level"] == n]
        if got:
            h, c = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(h)
            known[n] = h[order], c[order]
    read = [known[n][1][np.searchsorted(known[n][0], keys)].tolist() for n, keys in _parts(row)]
    a, h = _i(row["c"]), _u(row["h"])
    inside = np.zeros(len(a), np.int64)
    for m in (m for m in messages if m["kind"] == "inside"):
        slots = read_slots(row, _u(m["h"]))
        np.maximum.at(inside, slots[slots >= 0], _i(m["c"])[slots >= 0])
    keep = [100 * x < 50 * y for x, y in zip(inside.tolist(), a.tolist(), strict=True)]
    out = []
    for key, n, good, *lr in zip(h.view(np.int64).tolist(), a.tolist(), keep, *read, strict=True):
        if good:
            score, k = min((1_000_000 * n * n // (lr[k] * lr[k + 1]), k) for k in range(0, len(lr), 2))
            out.append((row["level"], row["lang"], key, n, lr[k], lr[k + 1], score))
    return _batch(out, FOUND)


def candidates(docs: DataFrame, least: int = 10, shard_bytes: int = 16 << 20, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """FOUND rows of all candidates of docs (text, lang) that no longer one takes in, (lang, n) with the number of words, and the texts
    as they were read."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(0, int(size / shard_bytes - 1e-9)).bit_length()
    send = spark.sparkContext.broadcast

    words = scratch.cut(level(texts.mapInArrow(_first(shards), BLOCKS), least), "words")
    pairs = scratch.cut(level(texts.mapInArrow(_second(shards, send(bit_table(keys_of(words), BITS))), BLOCKS), least), "pairs")
    blocks, shard = texts.mapInArrow(_third(shards, send(bit_table(keys_of(pairs), BITS))), BLOCKS), ["lang", "shard"]
    longer = blocks.groupBy(*shard).cogroup(pairs.groupBy(*shard)).applyInArrow(_third_level(least), TABLE)
    longer = scratch.cut(longer, "pairs_and_triples")

    of = ["level", "lang", "shard"]
    asked = scratch.cut(longer.mapInArrow(_ask(shards), MESSAGES), "asked")
    every = words.unionByName(longer.where("level = 2"))
    answers = asked.where("kind = 'ask'").groupBy(*of).cogroup(every.groupBy(*of)).applyInArrow(_answer, MESSAGES)
    found = answers.unionByName(asked.where("kind = 'inside'")).groupBy(*of).cogroup(longer.groupBy(*of)).applyInArrow(_score, FOUND)
    sizes = words.groupBy("lang").agg(F.sum("total").alias("n"))
    return scratch.cut(found, "found"), sizes, texts


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, shard_bytes: int = 16 << 20, scratch: Scratch | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``most`` phrases of docs (text, lang) by score, a, phrase."""
    scratch = scratch or Scratch(docs.sparkSession)
    found, sizes, texts = candidates(docs, least, shard_bytes, scratch)
    best = [F.col("score").desc(), F.col("a").desc()]
    found = found.withColumn("rank", F.rank().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= most).drop("rank")
    found = scratch.cut(found, "best")  # with all that tie with the last
    keys = {n: found.where(F.col("level") == n).select("h").rdd.map(lambda r: np.array([r["h"]]).view(np.uint64)) for n in (2, 3)}
    wanted = docs.sparkSession.sparkContext.broadcast({n: bit_table(x, BITS) for n, x in keys.items()})
    spelt = texts.mapInArrow(_spelt(wanted), SPELT).dropDuplicates(["level", "lang", "h"])
    rows = found.join(spelt, ["level", "lang", "h"]).join(sizes, "lang")
    order = W.partitionBy("lang").orderBy(*best, "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
