"""N-gram Jaccard join and decontamination against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ngram_jaccard_join as J
from ledgerloom.llm import spaced_seeds as S
from ledgerloom.llm.common import PUNCTUATION, Scratch, components, shingle_sets, words

SCHEMA = "doc_id long, text string, k1 string, n long, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "x " * 3000)]
    for base in range(12):
        n = rng.choice([5, 9, 12, 20, 40, 80, 200])
        text = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(rng.randint(1, 30)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, n // 15))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy += [rng.choice(vocabulary)]
            rows.append((100 + len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
def test_components_equal_brute_force(spark, k, num, den):
    rows = corpus(k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.annotate(frame(spark, rows), k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(1300):
        copy = list(base)
        copy[rng.randrange(60)] = f"z{i}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in J.annotate(frame(spark, rows), 3, 90, 100).collect()}
    want = brute(rows[:200], 3, 90, 100)
    assert {i: got[i] for i in range(200)} == {i: want[i][1] for i in range(200)} or set(got.values()) == {0}


def test_empty_table_and_null_ids(spark):
    assert J.annotate(frame(spark, []).limit(0), 3, 90, 100).count() == 0
    rows = [(None, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l")]
    got = sorted(J.annotate(frame(spark, rows), 3, 90, 100).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.component_id) for r in got] == [(None, None), (2, 2), (3, 2)]
    kept = J.representatives(frame(spark, rows), 3, 90, 100)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2]


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (50, 50, 80)]
    sets = []
    for i in range(150):
        x = base[i % 3].copy()
        x[rng.integers(0, len(x), rng.integers(0, 5))] = rng.integers(0, 1 << 62)
        sets.append(np.unique(x))
    _, root = J.links(sets, None, 9, 10)

    def top(r, i):
        while r[i] != i:
            i = r[i]
        return i

    plain = list(range(150))
    for i in range(150):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 10 * o >= 9 * (len(sets[i]) + len(sets[j]) - o):
                a, b = top(plain, i), top(plain, j)
                plain[max(a, b)] = min(a, b)
    assert [top(root, i) for i in range(150)] == [top(plain, i) for i in range(150)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.label for r in components(Scratch(spark), spark.createDataFrame(edges, "src long, dst long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[start] == min(seen)
    assert set(got) == set(near)


def test_words_at_slice_borders(monkeypatch):
    import ledgerloom.llm.common as common

    texts = ["Ab cd  é x", None, "", " lead", "trail ", "word" * 5000, "a b " * 4000, "x"]
    whole = words(pa.array(texts))
    monkeypatch.setattr(common, "SLICE", 7)
    parts = words(pa.array(texts))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert np.diff(whole[1]).tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(next(shingle_sets(pa.array(["a b a b a b"]), 2))) == 2


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"q{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 9, 15, 30, 60])))) for i in range(30)]
    items += [(90, None), (91, ""), (92, items[0][1])]
    docs = [(1, None), (2, ""), (3, "clean text only")]
    planted = {}
    for i, (item, text) in enumerate(items[:30]):
        w = text.split()
        for j in range(0, len(w), 12):
            if len(w) >= 15:
                w[j] = "other"
        lead = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2000))]
        docs.append((10 + i, " ".join(lead) + ", " + " ".join(w).upper() + ". tail"))
        if len(w) >= 5:
            planted[10 + i] = item
    found = S.contamination(frame(spark, docs), spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    want = set()
    for d, t in docs:
        w = words(pa.array([t]), PUNCTUATION)[0]
        for item, text in items:
            q = words(pa.array([text]), PUNCTUATION)[0]
            if len(q) >= 5 and any(S.overlap(w, q, off, 0.8, 13) for off in range(-len(q), len(w) + 1)):
                want.add((d, item))
    assert got <= want and {(d, i) for d, i in planted.items()} <= got
    assert len(got) >= 0.95 * len(want)


def test_clean_keeps_columns_and_rows(spark):
    text = "the quick brown fox jumps over the lazy dog near the old river bank today"
    docs = frame(spark, [(1, "before " + text), (2, "nothing here"), (2, "nothing here"), (None, "free"), (4, None)])
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    kept = S.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 2, 4]
    assert S.clean(docs, bench.limit(0)).count() == 5
    assert S.contamination(docs.limit(0), bench).count() == 0


def test_masks_tolerate_substitutions():
    a = np.arange(1, 13, dtype=np.uint64)
    for mask in S.MASKS:
        b = a.copy()
        b[[j for j, x in enumerate(mask) if x == "0"]] += np.uint64(99)
        assert S.seeds(a, mask)[0] == S.seeds(b, mask)[0]
        assert mask.count("1") == 6


def most_agreeing(same, num, den, least):
    """Plain rule: the most agreeing words of any stretch with that identity, if they are enough."""
    n = len(same)
    best = max((sum(same[i:j]) for i in range(n) for j in range(i + 1, n + 1) if den * sum(same[i:j]) >= num * (j - i)), default=0)
    return best if best >= least else None


def test_longest_stretch_of_the_identity():
    cases = [[1] * 12 + [0] * 4 + [1] * 12 + [0] * 30, ([1] * 4 + [0]) * 8 + [0] * 40]
    rng = random.Random(9)
    cases += [[0] * rng.randrange(30) + [int(rng.random() > rng.choice([0.1, 0.2, 0.3])) for _ in range(rng.randrange(5, 45))] + [0] * 30 for _ in range(300)]
    for same in cases:
        item = np.arange(1, len(same) + 1, dtype=np.uint64)
        doc = np.where(np.array(same, bool), item, item + np.uint64(1000))
        want = sum(same) if 5 * sum(same) >= 4 * len(same) else most_agreeing(same, 4, 5, 13)
        got = S.overlap(doc, item, 0, 0.8, 13)
        assert (got and got[0]) == want, same
        assert got is None or same[got[1]]


def test_partly_copied_and_edited_passage_is_found(spark):
    item = [f"i{j}" for j in range(60)]
    copy = item[:28]
    copy[12:16] = ["x1", "x2", "x3", "x4"]
    docs = frame(spark, [(1, "lead " + " ".join(copy) + " tail")])
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in S.contamination(docs, bench).collect()] == [(1, 7, 24, 60, 1)]


def test_short_items_with_substituted_words(spark):
    items, docs, want = [], [], set()
    for n in range(2, 17):
        item = [f"n{n}w{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        wrong = n - -(-4 * n // 5)
        for at in [[], *([j] for j in range(n if wrong else 0)), *([j, j + 1] for j in range(n - 1 if wrong > 1 else 0)), *([j, n - 1 - j] for j in range(n // 2 if wrong > 1 else 0))]:
            words_ = ["other" if j in at else x for j, x in enumerate(item)]
            docs.append((len(docs), "some lead " + " ".join(words_) + " and tail"))
            want.add((len(docs) - 1, n))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in S.contamination(frame(spark, docs), bench).collect()}
    assert got == {x for x in want if x[1] >= 5}
    assert {(r.doc_id, r.item_id) for r in S.contamination(frame(spark, docs), bench, least=1).collect()} == want


def counted(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    out = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                out[a] += den * o >= num * (len(sets[a]) + len(sets[b]) - o)
    return out


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
def test_number_of_links_equals_brute_force(spark, monkeypatch, k, num, den):
    """Every link counts, in groups that blocks split too."""
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "GROUP", 8)
    rows = corpus(10 + k)
    got = J.annotate(frame(spark, rows), k, num, den).collect()
    assert {r.doc_id: r.n_links for r in got} == counted(rows, k, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, num, den)


def test_a_hot_hash_leaves_its_bucket(monkeypatch):
    """Of a hash that many sets of a task send, the packed part and the rows together have all sets."""
    monkeypatch.setattr(J, "HOT", 8)
    base = [f"v{i}" for i in range(60)]
    texts = [" ".join([*base, f"z{i}", f"y{i}"]) for i in range(40)]
    batch = pa.record_batch([pa.array(range(40), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    made = pa.Table.from_batches(list(J._profile(3, 90, 100, 1)(iter([batch])))).to_pylist()
    rows = defaultdict(set)
    for r in made:
        if r["n"] == -1:
            rows[r["k1"]].add(r["doc_id"])
    packed = pa.record_batch([pa.array([0], pa.int32()), pa.array([r["packed"] for r in made if r["bucket"] is not None], pa.binary())], names=["bucket", "packed"])
    for r in pa.Table.from_batches(list(J._neighbours(iter([packed])))).to_pylist():
        if r["many"]:
            rows[r["src"]].add(r["dst"])
    want = defaultdict(set)
    for i, found in enumerate(shingle_sets(pa.array(texts), 3)):
        for key in J.Bands(90, 100).keys(found).tolist():
            want[key & 0xFFFFFFFF].add(i)
    assert rows == {key: x for key, x in want.items() if len(x) > J.FEW}
    assert any(r["n"] == -1 for r in made)


def test_mostly_empty_segments_share_a_key():
    """Linked sets share a key also where most of their segments are empty."""
    rng = np.random.default_rng(5)
    bands = J.Bands(8, 10)
    for _ in range(3000):
        n = int(rng.integers(4, 60))
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        other = np.unique(np.r_[one[int(len(one) * 0.2) :], rng.integers(0, 1 << 63, 1).astype(np.uint64)]) if rng.random() < 0.5 else one[int(len(one) * 0.2) :]
        o = len(np.intersect1d(one, other))
        if 10 * o >= 8 * (len(one) + len(other) - o):
            assert len(np.intersect1d(bands.keys(one), bands.keys(other)))


def morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


LONG_WORDS = ["a" + "x" * 4095 + "b", "b" + "x" * 4095 + "a", morse(1024), morse(1024, "b", "a"), morse(8192), morse(8192, "b", "a"), "x" * 5000, "x" * 5001, "x" * 256, "x" * 257]


def test_long_words_differ(spark):
    hashed, _ = words(pa.array(LONG_WORDS))
    assert len(set(hashed.tolist())) == len(LONG_WORDS)
    assert words(pa.array([LONG_WORDS[0].upper()]))[0][0] == hashed[0]
    rows = list(enumerate(LONG_WORDS)) + [(90, LONG_WORDS[3].upper())]
    got = J.annotate(frame(spark, rows), 3, 90, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 90, 100)
    assert {r.doc_id: r.n_links for r in got} == counted(rows, 3, 90, 100)


def test_clashing_names(spark):
    rows = [(1, "a b c d e f g h i j k l", 7, 8), (2, "a b c d e f g h i j k l", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Copy long, copy_ long")
    docs = docs.select("*", F.col("Copy").alias("_out"), F.col("Copy").alias("block"), F.col("Copy").alias("n"))
    assert [tuple(r) for r in J.representatives(docs).collect()] == [(1, rows[0][1], 7, 8, 7, 7, 7)]
