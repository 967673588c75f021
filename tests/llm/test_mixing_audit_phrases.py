"""Source mixing, filter audit, phrase mining against plain versions and on odd inputs."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from ledgerloom.llm import filter_audit as A
from ledgerloom.llm import phrase_mining as P
from ledgerloom.llm import source_mixing as X

SPACE = r"[^\x20\x09-\x0D]+"


def size(text):
    return len(re.findall(SPACE, text or ""))


# --- mixing


def water_filling(sizes, weights, share, epochs):
    """Rounds of sharing out what is left by weight, clamping those above their cap."""
    budget, target, left = share * sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while left:
        level = (budget - sum(target[i] for i in range(len(sizes)) if i not in left)) / sum(weights[i] for i in left)
        over = {i for i in left if level * weights[i] >= epochs * sizes[i]}
        for i in over or left:
            target[i] = Fraction(epochs * sizes[i]) if over else level * weights[i]
        left -= over or left
    return target


def mixed(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, size int, key string")
    return X.mix(df, **settings).collect()


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", None, "ä", "", "z", "A"]
    rows = [(i, rng.choice(names[: 3 + 2 * seed]), " ".join("w" * rng.randint(0, 9))) for i in range(200)]
    rows += [(7, "a", "x\ty\x0bz q")] * 30 + [(None, "b", None), (None, "b", "p q r")]
    got = mixed(spark, rows)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, s, t in rows)
    own = defaultdict(int)
    for _, s, t in rows:
        own[s] += size(t)
    sources = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(sources, water_filling([own[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))], Fraction(3, 2), 2), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == own[r.source] and abs(r.target - float(want[r.source])) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.whole * r.size + r.part and r.part <= r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + Fraction(1, 2)) for s in sources)
    cut = [r for r in got if 0 < r.part < r.size]
    assert len(cut) <= len(sources)
    again = mixed(spark, random.Random(1).sample(rows, len(rows)))
    key = lambda r: tuple(r)[:1] + (r.source or "", r.taken, r.size)
    assert sorted(map(key, got), key=repr) == sorted(map(key, again), key=repr)
    assert sorted(map(key, got), key=repr) != sorted(map(key, mixed(spark, rows, seed=1)), key=repr)


def test_mix_of_one_document_over_and_over(spark):
    rows = [(1, "s", "a b c d")] * 500 + [(2, "t", "a")]
    got = mixed(spark, rows)
    assert sum(r.taken for r in got) == 3002  # s: 3000 at most 4000, t: 2 at most
    assert {r.target for r in got if r.source == "t"} == {2.0}


def test_mixture_texts(spark):
    df = spark.createDataFrame([(i, "s", f" a{i}  b{i}\tc{i} ", "r") for i in range(5)] + [(9, "t", "", "r"), (10, "t", None, "r")], "doc_id long, source string, text string, repetition string")
    got = X.mixture(df, share=Fraction(5, 4)).collect()
    assert sum(size(r.text) for r in got) == 19 and got[0].__fields__ == [*df.columns, "repetition_"]
    assert all(r.text in (f" a{r.doc_id}  b{r.doc_id}\tc{r.doc_id} ", f" a{r.doc_id}") for r in got)
    assert X.mix(df.limit(0)).count() == 0 and X.mixture(df.where("doc_id > 8")).count() == 0
    assert {(r.target, r.taken) for r in X.mix(df.where("doc_id > 8")).collect()} == {(0.0, 0)}


# --- audit


def fails(doc, smallest):
    doc_id, text, _ = doc
    text = text or ""
    words = re.findall(SPACE, text)
    e = doc_id is not None and smallest.get(text) is not None and smallest[text] < doc_id
    return (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), e)


def audited(docs, labels):
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    rows = {}
    for part in {p or "" for _, _, p in docs}:
        own = [(d, fails(d, smallest)) for d in docs if (d[2] or "") == part]
        total = Counter()
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                total[f] += len(gone)
                rows[part, "".join("ABCDE"[i] for i in order), step] = [
                    f, len(left), len(gone), sum(m[f] for _, m in own) - len(gone), sum(m[f] and sum(m) == 1 for _, m in own), sum(d[0] in good for d, _ in gone), sum(d[0] in toxic for d, _ in gone)
                ]
        for k, v in rows.items():
            if k[0] == part:
                v.append(total[v[0]])
    return {k: tuple(v[1:]) for k, v in rows.items()}


def run_audit(spark, docs, labels):
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, mask int").repartition(5)
    rows = A.audit(df, spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, n int")).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}, len(rows)


@pytest.mark.parametrize("held", [A.HELD, 200])
def test_audit_equals_plain_version(spark, monkeypatch, held):
    monkeypatch.setattr(A, "HELD", held)
    rng = random.Random(2)
    texts = [None, "", "a " * 120, " ".join(map(str, range(100))), "A" * 10 + "b" * 90, "A" * 11 + "b" * 89, "é#", "x y \x1f z", "w" * 5000] + [" ".join(rng.choice("ab c# D E fgh".split()) for _ in range(rng.randint(1, 150))) for _ in range(30)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)] + [(None, texts[2], "en"), (None, None, "de"), (5, texts[2], "en"), (5, texts[2], "fr"), (5, texts[2], "en")]
    docs += [(1000 + i, "same text of many", "en") for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 1200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    got, n = run_audit(spark, docs, labels)
    assert n == len(got) == 600 * 4 and got == audited(docs, labels)


def test_audit_of_collisions_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(A.F, "xxhash64", lambda c: A.F.length(c) % 2)  # nearly all texts collide
    docs = [(i, "ab" * (i % 7), "en") for i in range(60)]
    got, _ = run_audit(spark, docs, [])
    assert got == audited(docs, [])
    assert run_audit(spark, [], [])[1] == 0


def test_chain_holds_the_smallest():
    chain, lost = A.Chain(), []
    for data, doc in [(b"x", 5), (b"y", 1), (b"x", 3), (b"x", 9), (b"x", 3)]:
        lost += chain.put(data, [(doc, "p", 1)])
    assert lost == [(5, "p", 1), (9, "p", 1)]
    assert list(chain.rest()) == [(b"x", [(3, "p", 2)], True), (b"y", [(1, "p", 1)], False)]


# --- phrases


def phrases(docs, least, most):
    out = []
    for lang in {v or "und" for v, _ in docs}:
        f, n = Counter(), 0
        for v, text in docs:
            if (v or "und") != lang:
                continue
            text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                for k in (1, 2, 3):
                    f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items() if len(p) == 2):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes,held,most", [(1 << 24, P.HELD, 2000), (600, 300, 7)])
def test_phrases_equal_plain_version(spark, monkeypatch, shard_bytes, held, most):
    monkeypatch.setattr(P, "HELD", held)
    rng = random.Random(4)
    vocabulary = ["the", "The", "a", "rare" * 80, "RARE" * 80, "déjà", "vu", "x#y", "o'k", "of", "in", "go"]
    docs = []
    for _ in range(120):
        words = [rng.choice(vocabulary[: rng.choice([4, 12])]) + rng.choice(["", "", "", ",", ".", "!?", "\n", " "]) for _ in range(rng.randint(0, 60))]
        docs.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([" ", "  ", "\t", " \r\n"]).join(words)))
    docs += [("en", None), ("en", ""), ("fr", "  .. \t"), ("en", "New York City is in New York. " * 12), ("es", "uno dos " * 9)]
    df = spark.createDataFrame([(*d, 1, b"") for d in docs], "lang string, text string, level int, h binary").repartition(4)
    got = sorted(tuple(r) for r in P.collocations(df, least=6, most=most, shard_bytes=shard_bytes).collect())
    assert got == phrases(docs, 6, most) and len(got) > 15


def test_no_phrases(spark):
    df = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert P.collocations(df).count() == 0 and P.collocations(df.limit(0)).count() == 0


def test_long_texts_are_one_piece(spark):
    """A text of several slices counts the phrases across them."""
    text = "aa bb " * 400_000
    got = {r.phrase: (r.a, r.l, r.r, r.n) for r in P.collocations(spark.createDataFrame([("en", text)], "lang string, text string")).collect()}
    assert got["aa bb aa"][0] == 399_999 and got["bb aa bb"][0] == 399_999 and all(v[3] == 800_000 for v in got.values())


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        made = P.PerfectHash.load(P.PerfectHash.build(keys).dump())
        assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
        row = {"mph": made.dump(), "h": keys[np.argsort(made.slots(keys))].tobytes()}
        strange = rng.integers(0, 1 << 63, 500).astype(np.uint64) | np.uint64(1 << 63)
        assert (P.read_slots(row, strange) == -1).all() and (P.read_slots(row, keys) >= 0).all()
    assert P._tree_sum((np.full(3, i) for i in range(7)), 3).tolist() == [21] * 3
    a, b, c = (rng.integers(0, 1 << 63, 9).astype(np.uint64) for _ in range(3))
    assert (P.second(P.pair(a, b), a) == b).all() and (P.third(P.triple(a, b, c), a, b) == c).all()
