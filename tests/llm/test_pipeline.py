"""Each stage of the pipeline on its own input against a plain version of it."""

import re

import pyarrow as pa

import corpus_pipeline as P
from ledgerloom.llm import spaced_seeds as S
from ledgerloom.llm.common import PUNCTUATION, Scratch, words

SF = "/root/testdata/sf0.001"


def plain_duplicates(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 10 * o >= 8 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def plain_clean(rows, items):
    queries = [words(pa.array([t]), PUNCTUATION)[0] for t in items]
    out = set()
    for i, t in rows:
        w = words(pa.array([t]), PUNCTUATION)[0]
        known = set(w.tolist())
        near = [q for q in queries if len(known & set(q.tolist())) >= 5]
        if not any(S.overlap(w, q, off, 0.8, 13) for q in near for off in range(-len(q), len(w) + 1)):
            out.add(i)
    return out


def plain_redacted(text):
    text = re.sub(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]{6,}""", r"\1*REDACTED*", text, flags=re.I | re.A)
    return re.sub("[0-9a-f]{24,}", "*REDACTED*", re.sub("AKIA[A-Z0-9]{16,}", "*REDACTED*", text))


def test_stages(spark):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in P.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = scratch.cut(stage(spark, docs, SF), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "near_duplicates":
            assert set(after) == plain_duplicates(before)
        elif name == "decontamination":
            assert set(after) == plain_clean(before, items)
        elif name == "secrets":
            assert after == {i: plain_redacted(t) for i, t in before}
        else:
            assert set(after) <= {i for i, _ in before}
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(after)
    whole = P.run(spark, SF).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(whole) == key(packed)


def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, names that operators use inside."""
    good = "the committee considered several proposals before it settled on a plan that members could support in the coming year"
    rows = [(1, good, "en", "a", 9, 1, "k"), (1, good, "en", "a", 9, 1, "k"), (2, good, None, None, None, None, None), (3, None, "en", "a", 0, 1, "k"), (4, "", "de", "b", 0, 1, "k"), (None, None, None, None, None, None, None),
            (5, " \t\n", "en", "a", 3, 1, "k"), (6, "word " * 60_000, "en", "a", 1, 1, "k"), (7, "w" * 300_000, "en", "a", 1, 1, "k"), (8, f"{good} password: hunter2hunter2 end", "fr", "c", 1, 1, "k"), (9, "few words", "en", "a", 1, 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, blob int, hash string")


def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    scratch = Scratch(spark)
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    stages = dict(P.STAGES)
    kept = {name: scratch.cut(stages[name](spark, docs, SF), name) for name, _ in P.STAGES[:-1]}
    for name, df in kept.items():
        assert df.dtypes == docs.dtypes, name
        assert stages[name](spark, docs.limit(0), SF).count() == 0, name
    near = [i for null, i in ids(kept["near_duplicates"]) if not null]
    assert 2 not in near and near.count(1) in (1, 2) and {3, 4, 5, 6, 7, 9} <= set(near)
    assert set(ids(kept["decontamination"])) == set(ids(docs))
    assert ids(kept["secrets"]) == ids(docs)
    secret = {r.doc_id: r for r in kept["secrets"].collect()}
    assert "hunter2" not in secret[8].text and secret[8].n_chars == len(secret[8].text) and secret[3].text is None and secret[2].n_chars is None
    for name in ("quality", "near_duplicates", "decontamination"):  # rows of one doc_id stay or go together
        assert ids(kept[name]).count((False, 1)) in (0, 1, 2)
    assert ids(kept["quality"]).count((False, 1)) in (0, 2) and ids(kept["decontamination"]).count((False, 1)) == 2
    packed = stages["packing"](spark, docs, SF).collect()
    by = {}
    for r in packed:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {r.doc_id for r in docs.collect()} and len(by[1]) == 2 and [r.length for r in by[3]] == [1] and [r.length for r in by[4]] == [1]
    spans = {}
    for r in packed:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at in spans.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 2048
    assert stages["packing"](spark, docs.limit(0), SF).count() == 0
