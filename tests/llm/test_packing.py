"""Best-fit packing: exact tokens, gapless sequences, combinations at least as good as brute force on small bins."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import best_fit_packing as B
from ledgerloom.llm.queries import tokenizer_path

ALPHABET = list("abcXYZ 0139'’“”.,!?;:-_()[]{}<>|&%$#@*+=/\\\"\n\t\r\x0b\x1c\x85\xa0 éÉßÀ×÷İıſΣςσ…–漢字½²①̀ŉ😀")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_unit_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(2)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["it's we're I'LL 's''s", "<|endoftext|> a<|startoftext|>b", "", None, "word " * 3000]
    cache = B.UnitCache(tokenizer_path())
    for text, got in zip(texts, cache.ids(pa.array(texts, pa.string())), strict=True):
        assert got == np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_packing_is_whole_and_gapless(spark, tokenizer):
    rng = random.Random(4)
    docs = [(1, None), (2, ""), (3, "x"), (None, "null id"), (5, "same"), (5, "same"), (6, "long text " * 1500)]
    docs += [(100 + i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 1500)))) for i in range(150)]
    df = spark.createDataFrame([(i, t, 7, "q") for i, t in docs], "doc_id long, text string, offset int, piece string")
    rows = B.pack(B.pieces(df, tokenizer_path())).collect()
    want = []
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, a // 2048, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)]
    key = lambda x: [(v is None, v or 0) for v in x]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
    assert len(at) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_no_rows(spark):
    assert B.pack(B.pieces(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path())).count() == 0


def test_fullest_bin_equals_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        room = rng.randint(5, 30)
        counts = np.zeros(room + 1, np.int64)
        for _ in range(rng.randint(1, 8)):
            counts[rng.randint(1, room)] += rng.randint(1, 3)
        longest = int(np.flatnonzero(counts)[-1])
        reach = {longest}
        left = counts.copy()
        left[longest] -= 1
        for length in np.flatnonzero(left):
            for _ in range(left[length]):
                reach |= {x + int(length) for x in reach if x + length <= room}
        got = B.fullest(counts, room)
        assert sum(k * n for k, n in got.items()) == max(reach)
        assert all(n <= counts[k] for k, n in got.items())


def test_combinations_use_every_piece():
    counts = np.random.default_rng(1).integers(0, 5, 2049)
    counts[0] = 0
    used = np.zeros_like(counts)
    bins = 0
    for one, times in B.combinations(counts):
        assert sum(k * n for k, n in one.items()) <= 2048
        for k, n in one.items():
            used[k] += n * times
        bins += times
    assert (used == counts).all()
    # as many lengths above half a bin as below: within a few hundredths of the bound
    assert bins <= 1.03 * -(-int((counts * np.arange(2049)).sum()) // 2048)


def test_long_words_have_their_own_ids(tokenizer):
    """Words that differ by bytes 4,096 apart, and ones that meet in linear hashes modulo a power of two."""
    morse = "".join("b" if bin(i).count("1") % 2 else "a" for i in range(1024))
    texts = ["a" + "x" * 4095 + "b", "b" + "x" * 4095 + "a", morse, morse.translate({97: "b", 98: "a"}), "x" * 5000 + "'s", "é" * 300, "<|endoftext|> " + "y" * 300]
    got = list(B.UnitCache(tokenizer_path()).ids(pa.array(texts)))
    assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_clashing_names(spark):
    made = spark.createDataFrame([(1, 0, 0, 5, 7, "a", "b", "c", "d")], "doc_id long, piece int, start long, length long, ids_crc32 long, bucket string, First string, place string, rank string")
    got = B.pack(made).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 5, 7, "a", "b", "c", "d", 0, 0)]
