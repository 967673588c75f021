"""N-gram Jaccard join with signature trees (operator 6).

Two documents link when the Jaccard similarity of their sets of distinct k-word shingles reaches a rational threshold.
The result is exact over all documents (up to collisions of 64-bit shingle hashes): no cap on candidates or partners.

1. One pass over the texts makes each document's shingle set, its size and a 128-bit fingerprint. Documents with equal
   fingerprints form a class; its smallest doc_id stands for it, so copies are never compared or expanded into pairs.
2. Routing. Sets of sizes in one band are split by hash into m segments. Linked sets differ in at most
   H = a (1 - t) / t shingles, a the smaller size, so with m = H + 1 + S segments at least S + 1 are equal. Each set sends a
   hash per segment, without those of under ``LEAST`` shingles unless it has more than S such; then all. So linked sets
   always share a hash. The hashes travel packed, a few bytes each, and come together per bucket. Sets with an equal hash are
   tested by size and token bitmap: a few in pairs, many through a signature tree. What the bitmaps don't rule out is an edge;
   components of these edges are the shards of the join.
3. Signature trees. In a shard, split into blocks of bounded size, sets are leaves' entries; a node holds the OR of the
   token bitmaps below it and their range of sizes. A dual traversal of two trees (or of one with itself) leaves out a pair
   of nodes if the sizes can't fit or if the bitmaps' overlap, the most that two sets can have in common, is too small.
   Pairs of sets that pass are counted exactly; every set's links are counted, and links that connect sets are kept.
4. Components of these links give the documents' groups.

Skew: copies of a text are one set. A hash that very many sets of a task send leaves it as rows besides the packed hashes, so no
bucket holds a hot hash whole; its sets are tested in blocks of ``GROUP``, as a shard's are joined in blocks of ``BLOCK``.

Defined cases: null, empty and white-space texts have the empty set and link with nothing, not even each other; texts with
fewer than k words have one shingle, the whole sequence; rows are expected once per doc_id, of repeated doc_ids each row
comes back and counts as a copy, and ``representatives`` keeps all rows of a doc_id or none; null doc_ids count as documents
that link with nothing; other columns of the input, whatever their names, are ignored (``annotate``) or kept
(``representatives``); no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, distinct, fresh, mix, parallelism, shingle_sets, slices

#: Segments with fewer shingles are sent only by sets with many of them.
LEAST = 2
#: Ratio of the sizes that a band spans.
BAND = 1.5
#: Sets of a shard in one block, and sets with one hash in one block.
BLOCK, GROUP = 512, 2048
LEAF, FAN = 16, 8
#: A hash's sets are taken in all pairs up to this number, beyond it through a signature tree.
FEW = 6
#: A hash that more sets of a task send at once leaves it as rows.
HOT = 64
FLUSH = 1 << 20
#: Documents whose hashes make a bucket, about; rounds of splitting a set whose segments are mostly empty; bytes of exact bitmaps.
BUCKET, ROUNDS, EXACT = 1 << 14, 16, 1 << 25
MASK = (1 << 64) - 1
_PROFILE = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bucket", pa.int32()), ("packed", pa.binary())]  # packed: of a set its bitmap, of a bucket its hashes
)
_LINKS = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
_COUNTED = _LINKS.append(pa.field("n", pa.int64()))  # n: 0 for a link, or links of src
_SALT = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


class Bands:
    """Bands of set sizes and the segments of each; num / den is the threshold."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.first = -(-num // (den - num)) if den > num else 1 << 62  # below it only equal sets link
        self.ends: list[int] = []

    def of(self, n: int) -> int:
        while not self.ends or self.ends[-1] <= n:
            self.ends.append(max(self.first + 1, int((self.ends or [self.first])[-1] * BAND) + 1))
        return int(np.searchsorted(self.ends, n, "right"))

    def segments(self, band: int) -> tuple[int, int]:
        """m and S of a band."""
        apart = (self.ends[band] - 1) * (self.den - self.num) // self.num
        return apart + 2 + apart // 8, 1 + apart // 8

    def keys(self, found: np.ndarray) -> np.ndarray:
        """What a sorted set sends: also to the band below if a set there can be its smaller partner."""
        n = len(found)
        if n < self.first:
            return found[:0]
        own, out = self.of(n), []
        for band in (own, own - 1):
            if band < 0 or band < own and -(-self.num * n // self.den) >= self.ends[band]:
                continue
            m, slack = self.segments(band)
            for turn in range(ROUNDS):
                split = found if not turn else np.sort(mix(found + np.uint64(turn)))
                at = ((split >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                count = np.diff(start, append=n)
                few = count < LEAST
                empty = m - len(start)
                salt = np.uint64((band * ROUNDS + turn) * int(_SALT[2]) & MASK)
                key = mix(np.add.reduceat(mix(split ^ _SALT[0]), start) + at[start] * _SALT[1] + salt + count.astype(np.uint64) * _SALT[3])
                out.append(key[~few] if int(few.sum()) + empty <= slack else key)
                if empty <= slack:
                    break
                # else equal empty segments may be all that two such sets share: both are split once more, by other hashes
            else:
                out.append(mix(np.array([salt ^ _SALT[3]], np.uint64)))
        return np.concatenate(out)


def _profile(k: int, num: int, den: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        ids: list[int] = []
        parts: list[np.ndarray] = []
        sent: set[tuple[int, int]] = set()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            keys = np.concatenate(parts)
            whose = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(x) for x in parts])
            own = np.array(ids, np.int64)
            order = np.argsort(keys, kind="stable")
            keys, whose = keys[order], whose[order]
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            count = np.diff(start, append=len(keys))
            place = np.arange(len(keys)) - np.repeat(start, count)
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            keys = keys.astype(np.uint32)
            hot = (np.repeat(count, count) > HOT) & (place > FEW + 1)  # the bucket still sees that there are many
            lone = (keys[hot] | bucket[hot] << np.uint64(32)).view(np.int64), own[whose[hot]]
            keys, whose, bucket = keys[~hot], whose[~hot], bucket[~hot]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blobs, small = [], np.uint16 if len(ids) < 1 << 16 else np.uint32
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(keys)], strict=True):
                used, back = np.unique(whose[a:b], return_inverse=True)
                head = np.array([b - a, len(used), small().itemsize], np.int64)
                blobs.append(head.tobytes() + own[used].tobytes() + keys[a:b].tobytes() + back.astype(small).tobytes())
            ids.clear()
            parts.clear()
            held = 0
            none, n = pa.nulls(len(blobs), pa.int64()), len(lone[0])
            yield pa.record_batch([none, none, none, none, pa.array(bucket[start].astype(np.int32)), pa.array(blobs, pa.binary())], schema=_PROFILE)
            if n:
                yield pa.record_batch(
                    [pa.array(lone[1]), pa.array(np.full(n, -1)), pa.array(lone[0]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_PROFILE
                )

        for whole in batches:
            for batch in slices(whole):
                doc, rows = batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), []
                for one, found in zip(doc, shingle_sets(batch.column(batch.schema.get_field_index("text")), k), strict=True):
                    n = len(found)
                    k1 = int(mix(found ^ _SALT[1]).sum(dtype=np.uint64).astype(np.int64))
                    k2 = int(mix(found ^ _SALT[2]).sum(dtype=np.uint64).astype(np.int64))
                    rows.append((one, n, k1, k2, bitmap(found, own_bits(n)) if n >= bands.first else None))
                    if n < bands.first or one is None or (k1, k2) in sent:
                        continue
                    if len(sent) < 1 << 17:
                        sent.add((k1, k2))
                    if len(keys := bands.keys(found)):
                        ids.append(one)
                        parts.append(keys)
                        held += len(keys)
                *columns, maps = zip(*rows, strict=True)
                columns = [pa.array(x, pa.int64()) for x in columns]
                yield pa.record_batch([*columns, pa.nulls(len(rows), pa.int32()), pa.array(maps, pa.binary())], schema=_PROFILE)
                if held >= FLUSH:
                    yield from flush()
        if parts:
            yield from flush()

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each hash with two sets or more: all pairs (src, dst) of up to FEW sets, else rows (hash, doc_id) with many = true.
    Rows (bucket, packed) come in order of buckets."""

    def one(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        for blob in blobs:
            n, docs, width = np.frombuffer(blob, np.int64, 3).tolist()
            keys.append(np.frombuffer(blob, np.uint32, n, 24 + 8 * docs))
            ids.append(np.frombuffer(blob, np.int64, docs, 24)[np.frombuffer(blob, f"u{width}", n, 24 + 8 * docs + 4 * n)])
        key, doc = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(start, append=len(key))
        place = np.arange(len(key)) - np.repeat(start, count)
        group = np.repeat(count, count)
        pairs = []
        for apart in range(1, FEW):  # set i of a group with set i + apart
            i = np.flatnonzero((group <= FEW) & (place + apart < group))
            a, b = doc[i], doc[i + apart]
            pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b])
        pair = np.unique(np.concatenate(pairs), axis=0)
        large = group > FEW
        many = np.unique(np.stack([(key[large] | np.uint64(bucket) << np.uint64(32)).view(np.int64), doc[large]], 1), axis=0)
        for rows, flag in ((pair, False), (many, True)):
            for a in range(0, len(rows), 1 << 16):
                part = rows[a : a + (1 << 16)]
                yield pa.record_batch([pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(np.full(len(part), flag))], names=["src", "dst", "many"])

    at, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != at and held:
                yield from one(at, held)
                held = []
            at = bucket
            held.append(blob)
    if held:
        yield from one(at, held)


def _bounded_pairs(num: int, den: int):
    """Pairs (src, dst, n1, map1, n2, map2) that sizes and bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            keep = []
            for n1, x, n2, y in zip(d["n1"], d["map1"], d["n2"], d["map2"], strict=True):
                if den * min(n1, n2) < num * max(n1, n2):
                    keep.append(False)
                    continue
                p, q = folded([x, y]) if len(x) != len(y) else (np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                most = int(np.bitwise_count(p & q).sum(dtype=np.int64)) + min(n1 - int(np.bitwise_count(p).sum(dtype=np.int64)), n2 - int(np.bitwise_count(q).sum(dtype=np.int64)))
                keep.append(min(most, n1, n2) * (num + den) >= num * (n1 + n2))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=_LINKS)

    return run


def _bounded_groups(num: int, den: int):
    """Of rows (hash, lo, hi, doc_id, n, map), those of a hash's two blocks together: pairs that connect what bitmaps don't rule out."""

    def one(ids: list[int], sizes: list[int], maps: list[bytes]) -> list[tuple[int, int]]:
        bits, size = folded(maps), np.array(sizes, np.int64)
        order = np.lexsort((size, bits[:, 0]))
        tree = SignatureTree(bits[order], size[order])
        doc = np.array(ids, np.int64)[order]
        out, root = [], np.arange(len(doc))
        # those that may link with the first set are one shard already
        most = np.minimum(np.bitwise_count(tree.maps & tree.maps[0]).sum(1, dtype=np.int64) + np.minimum(tree.extra, tree.extra[0]), np.minimum(tree.size, tree.size[0]))
        with_first = most * (num + den) >= num * (tree.size + tree.size[0])
        with_first[0] = True
        root[with_first] = 0
        out += [(int(doc[0]), int(x)) for x in doc[with_first][1:]]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if not with_first.all():
            for p, q in dual(tree, tree, num, den, with_first):
                for i, j in zip(p.tolist(), q.tolist(), strict=True):
                    if (r := find(i)) != (t := find(j)):
                        root[max(r, t)] = min(r, t)
                        out.append((int(doc[i]), int(doc[j])))
        return [(min(x), max(x)) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [])
        for batch in batches:
            out = []
            for *key, doc, n, bits in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if key != at:
                    out += one(*held) if held[0] else []
                    at, held = key, ([], [], [])
                for x, v in zip(held, (doc, n, bits), strict=True):
                    x.append(v)
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=_LINKS)
        if held[0] and (out := one(*held)):
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=_LINKS)

    return run


def bitmap(found: np.ndarray, bits: int) -> bytes:
    """The set's token bitmap of a power of two of bits; half as many bits are the OR of neighbours."""
    at = np.zeros(bits, bool)
    at[(mix(found ^ _SALT[3]) >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = True
    return np.packbits(at).tobytes()


def own_bits(n: int) -> int:
    """Bits of a set's own bitmap: at least two for each shingle."""
    return 1 << max(6, (2 * n - 1).bit_length())


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of different lengths at the length of the shortest."""
    least = min(map(len, maps)) * 8
    out = []
    for x in maps:
        at = np.unpackbits(np.frombuffer(x, np.uint8))
        out.append(np.packbits(at.reshape(least, -1).any(1)) if len(at) > least else np.frombuffer(x, np.uint8))
    return np.stack(out).view(np.uint64)


class SignatureTree:
    """Sets in leaves of LEAF entries; each node has the OR of the bitmaps below it, the range of sizes and the most
    shingles of a set that share a bit with another (``extra``): two sets have at most
    |bits in common| + min(extra) shingles in common."""

    def __init__(self, maps: np.ndarray, size: np.ndarray):
        self.maps, self.size = maps, size
        self.extra = self.size - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        self.levels = [(self.maps, self.size, self.size, self.extra)]
        for width in [LEAF] + [FAN] * 64:
            maps, low, high, extra = self.levels[-1]
            if len(maps) == 1 and len(self.levels) > 1:
                break
            at = np.arange(0, len(maps), width)
            self.levels.append((np.bitwise_or.reduceat(maps, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))

    @classmethod
    def of(cls, sets: list[np.ndarray], bits: int) -> SignatureTree:
        maps = np.stack([np.frombuffer(bitmap(x, bits), np.uint64) for x in sets])
        return cls(maps, np.array([len(x) for x in sets], np.int64))

    @property
    def top(self) -> int:
        return len(self.levels) - 1

    def below(self, level: int, node: int) -> np.ndarray:
        width = LEAF if level == 1 else FAN
        return np.arange(node * width, min((node + 1) * width, len(self.levels[level - 1][0])))


def dual(a: SignatureTree, b: SignatureTree, num: int, den: int, joined: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (positions in a and b) that no pair of nodes above them rules out; no pairs among joined sets of a tree
    with itself."""
    stack = [(a.top, 0, b.top, 0)]
    whole = [joined] if joined is not None else []
    for level in range(1, a.top + 1 if whole else 0):
        whole.append(np.logical_and.reduceat(whole[-1], np.arange(0, len(whole[-1]), LEAF if level == 1 else FAN)))
    while stack:
        i, x, j, y = stack.pop()
        if a is b and i == j and x > y:
            continue
        # the higher node opens, of equal levels both
        xs, i2 = (a.below(i, x), i - 1) if i >= j else (np.array([x]), i)
        ys, j2 = (b.below(j, y), j - 1) if j >= i else (np.array([y]), j)
        (ma, la, ha, ea), (mb, lb, hb, eb) = a.levels[i2], b.levels[j2]
        most = np.bitwise_count(ma[xs][:, None, :] & mb[ys][None, :, :]).sum(2, dtype=np.int64) + np.minimum(ea[xs][:, None], eb[ys][None, :])
        most = np.minimum(most, np.minimum(ha[xs][:, None], hb[ys][None, :]))
        low = la[xs][:, None] + lb[ys][None, :]
        # overlap o and sizes p, q link if den o >= num (p + q - o)
        good = (most * (num + den) >= num * low) & (den * ha[xs][:, None] >= num * lb[ys][None, :]) & (den * hb[ys][None, :] >= num * la[xs][:, None])
        if whole:
            good &= ~(whole[i2][xs][:, None] & whole[j2][ys][None, :])
        p, q = np.nonzero(good)
        p, q = xs[p], ys[q]
        if i2 == 0 and j2 == 0:
            if a is b:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield p, q
        else:
            stack += [(i2, s, j2, t) for s, t in zip(p.tolist(), q.tolist(), strict=True)]


class Exact:
    """Numbers of shingles that sets have in common."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.maps = sets, None
        if len(sets) <= 3:
            return
        every = np.concatenate(sets)
        every.sort()
        shared = every[1:][every[1:] == every[:-1]]  # what is in one set only is in no intersection
        shared = shared[np.r_[True, shared[1:] != shared[:-1]]] if len(shared) else shared
        wide = -(-len(shared) // 64) * 64
        if not wide or wide // 8 * len(sets) > EXACT:
            return
        self.maps = np.zeros((len(sets), wide // 64), np.uint64)
        for row, one in zip(self.maps, sets, strict=True):
            bits = np.zeros(wide, bool)
            place = np.searchsorted(shared, one).clip(max=len(shared) - 1)
            bits[place[shared[place] == one]] = True
            row[:] = np.packbits(bits).view(np.uint64)

    def overlap(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.maps is not None:
            return np.bitwise_count(self.maps[p] & self.maps[q]).sum(1, dtype=np.int64)
        out = np.zeros(len(p), np.int64)
        for at, (i, j) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
            both = np.concatenate([self.sets[i], self.sets[j]])
            both.sort()
            out[at] = np.count_nonzero(both[1:] == both[:-1])
        return out


def links(
    a: list[np.ndarray], b: list[np.ndarray] | None, num: int, den: int, copies: list[int] | None = None, count: np.ndarray | None = None
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect the sets of a, or those of a with those of b (positions, b's after a's), and each one's root; to count
    is added, for each set, the copies of all sets that it links with."""
    every = a + (b or [])
    size, weight = np.array([len(x) for x in every], np.int64), np.array(copies or [1] * len(every), np.int64)
    root, out, exact = np.arange(len(every)), [], Exact(every)
    count = np.zeros(len(every), np.int64) if count is None else count

    def verify(p: np.ndarray, q: np.ndarray) -> None:
        o = exact.overlap(p, q)
        link = den * o >= num * (size[p] + size[q] - o)
        p, q = p[link], q[link]
        np.add.at(count, p, weight[q])
        np.add.at(count, q, weight[p])
        new = root[p] != root[q]
        for i, j in zip(p[new].tolist(), q[new].tolist(), strict=True):
            if (r := root[i]) != (s := root[j]):
                root[root == max(r, s)] = min(r, s)
                out.append((i, j))

    if len(every) <= 3:
        p, q = np.triu_indices(len(every), 1)
        apart = (p < len(a)) & (q >= len(a)) if b else np.ones(len(p), bool)
        verify(p[apart], q[apart])
        return out, root
    bits = 1 << max(9, min(15, (8 * int(size.max())).bit_length()))
    tree = SignatureTree.of(a, bits)
    other = SignatureTree.of(b, bits) if b else tree
    for p, q in dual(tree, other, num, den):
        verify(p, q + (len(a) if b else 0))
    return out, root


def _join(k: int, num: int, den: int):
    """Rows (cluster, lo, hi, block, doc_id, copies, text), those of a pair of blocks together."""

    def one(rows: dict[int, tuple[int, int, int, np.ndarray]], lo: int, hi: int) -> list[tuple[int, int, int]]:
        rows = sorted(rows.values(), key=lambda r: (r[3][:1].tolist(), len(r[3]), r[1]))  # alike sets next to each other: tight nodes
        a, b = [r for r in rows if r[0] == lo], [r for r in rows if r[0] == hi and lo != hi]
        if lo != hi and not (a and b):
            return []
        count = np.zeros(len(a) + len(b), np.int64)
        got, _ = links([r[3] for r in a], [r[3] for r in b] or None, num, den, [r[2] for r in a + b], count)
        ids = [r[1] for r in a + b]
        return [(min(ids[i], ids[j]), max(ids[i], ids[j]), 0) for i, j in got] + [(x, x, n) for x, n in zip(ids, count.tolist(), strict=True) if n]

    def made(out: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, {}
        for whole in batches:
            for batch in slices(whole):
                d = {c: batch.column(batch.schema.get_field_index(c)) for c in ("cluster", "lo", "hi", "block", "doc_id", "copies", "text")}
                keys = zip(*(d[c].to_pylist() for c in ("cluster", "lo", "hi", "block", "doc_id", "copies")), strict=True)
                out = []
                for (cluster, lo, hi, block, doc, copies), found in zip(keys, shingle_sets(d["text"], k), strict=True):
                    if at != (cluster, lo, hi):
                        out += one(rows, at[1], at[2]) if at else []
                        at, rows = (cluster, lo, hi), {}
                    rows[doc] = block, doc, copies, found
                if out:
                    yield made(out)
        if at and (out := one(rows, at[1], at[2])):
            yield made(out)

    return run


def _blocks(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows (doc_id, ...) with block and blocks, so many that ``key`` has about ``most`` rows in each."""
    blocks = rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    return rows.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))


def annotate(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row of docs (doc_id, text); n_links: other documents that it links with."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    width = parallelism(spark)
    docs = docs.select("doc_id", "text")
    buckets = max(width, docs.count() // BUCKET)
    profile = scratch.cut(
        docs.mapInArrow(_profile(k, num, den, buckets), "doc_id long, n long, k1 long, k2 long, bucket int, packed binary"), "profile"
    )
    sizes = profile.where("bucket is null and n >= 0")
    classes = scratch.cut(
        sizes.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    own = scratch.cut(_with_class(sizes.select("doc_id", "n", "k1", "k2"), classes), "own")
    packed = profile.where("bucket is not null").select("bucket", "packed")
    near = packed.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_neighbours, "src long, dst long, many boolean")
    near = near.unionAll(profile.where("n = -1").select("k1", "doc_id", F.lit(True)))
    near = scratch.cut(near.distinct(), "near")
    maps = sizes.where("packed is not null and doc_id is not null").groupBy("doc_id", "n").agg(F.min("packed").alias("map"))
    maps = scratch.cut(maps, "maps")
    side = lambda i, c: maps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{i}"), F.col("map").alias(f"map{i}"))
    pairs = near.where("not many").join(side(1, "src").hint("merge"), "src").join(side(2, "dst").hint("merge"), "dst")
    pairs = pairs.select("src", "dst", "n1", "map1", "n2", "map2").mapInArrow(_bounded_pairs(num, den), "src long, dst long")
    groups = _blocks(near.where("many").select(F.col("src").alias("hash"), F.col("dst").alias("doc_id")), "hash", GROUP)
    groups = scratch.cut(groups.join(maps.hint("merge"), "doc_id"), "groups").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = groups.where("blocks = 1 or other <> block").select("hash", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "n", "map")
    groups = groups.repartition(width, "hash", "lo", "hi").sortWithinPartitions("hash", "lo", "hi", "doc_id")
    near = scratch.cut(pairs.unionAll(groups.mapInArrow(_bounded_groups(num, den), "src long, dst long")).distinct(), "near")
    shards = components(scratch, near)
    # the sets that were tested are any of a class's copies; its smallest doc_id stands for them in the join
    members = shards.join(own.select(F.col("doc_id").alias("node"), "rep", "copies"), "node").groupBy("rep").agg(F.min("label").alias("cluster"), F.max("copies").alias("copies"))
    members = scratch.cut(members.withColumnRenamed("rep", "doc_id"), "members")
    dealt = scratch.cut(_blocks(members, "cluster", BLOCK), "dealt")
    # texts are always shuffled to the shards' rows: a plan that is alike at every size
    rows = docs.join(dealt.hint("merge"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc_id", "copies", "text")
    rows = rows.repartition(width, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    found = scratch.cut(rows.mapInArrow(_join(k, num, den), "src long, dst long, n long"), "links")
    scratch.drop(profile, near, dealt)
    labels = components(scratch, found.where("n = 0").select("src", "dst"))
    counts = found.where("n > 0").groupBy("src").agg(F.sum("n").alias("others"))
    labels = scratch.cut(labels.join(counts, F.col("node") == F.col("src")).select(F.col("node").alias("rep"), "label", "others"), "labels")
    out = own.join(labels, "rep", "left")
    linked = F.coalesce("others", F.lit(0)) + F.col("copies") - 1
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"), linked.alias("n_links"))


def _with_class(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, n, rep, copies); an empty set stands for itself. Only classes of several documents are joined."""
    several = classes.where("copies > 1").select("k1", "k2", "rep", "copies")
    known = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    rep, copies = F.when(known, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")), F.when(known, F.coalesce("copies", F.lit(1))).otherwise(F.lit(1))
    return sizes.join(several, ["k1", "k2"], "left").select("doc_id", "n", rep.alias("rep"), copies.alias("copies"))


def representatives(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component (or null), with all columns."""
    scratch, out = Scratch(docs.sparkSession), fresh("copy", docs)
    copies = annotate(docs, k, num, den, scratch).where("doc_id <> component_id").select(F.col("doc_id").alias(out)).distinct()
    return docs.join(scratch.cut(copies, "copies").hint("merge"), docs["doc_id"] == F.col(out), "left_anti")
