"""Operators on small tables: guardrails, drift, merges, versions, sources, sinks and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cleaning as C
from ledgerloom.functions import pricing as P
from ledgerloom.functions.grouping import group_values, rules
from ledgerloom.operators import guardrails as G
from ledgerloom.operators import incremental as I
from ledgerloom.operators import matching as M
from ledgerloom.operators import profile as R
from ledgerloom.operators import windows as W
from ledgerloom.operators.joins import anti_null_safe, snapshot_diff
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import feeds


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("unit,factor,label", [("BX/10", 10.0, "BX/10"), ("CASE/50", 50.0, "CA/50"), ("DZ", 12.0, "DZ"), ("EA", 1.0, "EA"), ("BOX OF 100", 1.0, "BOX OF 100")])
def test_pack(spark, unit, factor, label):
    assert one(spark, P.pack_factor(F.col("u")), u=unit) == factor
    assert one(spark, P.pack_label(F.col("u")), u=unit) == label


def test_prices(spark):
    paid, contract = F.col("p"), F.col("c")
    assert one(spark, P.pack_mismatch(paid, contract), p=150.0, c=15.0) == 10.0
    assert one(spark, P.pack_mismatch(paid, contract), p=16.5, c=15.0) is None
    assert one(spark, P.spike(paid, contract), p=450000.0, c=45000.0) == "10X_TYPO"
    assert one(spark, P.spike(paid, contract), p=46000.0, c=45000.0) == "NORMAL"
    assert one(spark, P.comparison_flag(paid, contract, 10.0), p=11.0, c=10.0) == "WITHIN"
    assert one(spark, P.comparison_flag(paid, contract, 10.0), p=11.5, c=10.0) == "ABOVE_10_PERCENT"
    assert one(spark, P.comparison_flag(paid, contract, 10.0), p=1.0, c=0.0) == "NOT_COMPARABLE"


def test_cleaning(spark):
    x = F.col("x")
    assert one(spark, C.clean_string(x), x="  a \t b ") == "a b"
    assert one(spark, C.clean_string(x), x=" N/A ") is None
    assert one(spark, C.safe_int(x), x="12.7") == 13
    assert one(spark, C.parse_number(x), x="1,234.5") == 1234.5
    assert one(spark, C.parse_date(x), x="2024-03-01T10:00") == datetime.date(2024, 3, 1)
    assert one(spark, C.parse_date(x), x="03/01/2024") == datetime.date(2024, 3, 1)
    assert one(spark, C.date_status(x), x="x") == "INVALID"
    assert one(spark, C.pad_code(x, 5), x="142") == "00142"
    assert one(spark, C.pad_code(x, 5), x="99213") == "99213"
    assert one(spark, C.strip_suffix(x), x="ST JUDE MEDICAL SC INC") == "ST JUDE MEDICAL SC" or one(spark, C.strip_suffix(x), x="ST JUDE MEDICAL SC INC") == "ST JUDE MEDICAL"
    assert one(spark, C.strip_suffix(x), x="MEDTRONIC, LLC") == "MEDTRONIC"
    assert one(spark, C.primary_drg(x), x="APR1 | MS2, MS3") == "MS2"
    assert one(spark, C.procedure_name(x), x="colectomy, laparoscopic") == "LAPAROSCOPIC COLECTOMY"


def test_returns_cancel_one_for_one(spark):
    rows = spark.createDataFrame([(1, "1001", "A", 5.0), (2, "1001", "A", -5.0), (3, "1002", "B", 2.0), (4, "1001", "A", -5.0)], "id int, c string, i string, q double")
    assert {r.id: r.state for r in G.net_returns(rows, "c", "i", "q", "id").collect()} == {1: "NETTED", 2: "NETTED", 3: "ACTIVE", 4: "ACTIVE"}


def test_merges(spark):
    a = spark.createDataFrame([("1", "A", 1.0), ("2", "B", 2.0)], "item_id string, d string, p double")
    b = spark.createDataFrame([("1", "A2", 1.5), ("3", "C", 3.0)], "item_id string, d string, p double")
    got = lambda s: sorted(tuple(r) for r in I.merge([a, b], ["item_id"], s).collect())
    assert got("latest_wins") == [("1", "A2", 1.5), ("2", "B", 2.0), ("3", "C", 3.0)]
    assert len(got("additive_append")) == 4 and len(got("union_distinct")) == 4
    assert got("new_keys") == [("1", "A", 1.0), ("2", "B", 2.0), ("3", "C", 3.0)]


def test_record_drift(spark):
    f = "item_id int, d string, p double"
    b = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None)], f)
    a = spark.createDataFrame([(1, "a2", 1.0), (2, "b", 2.0), (4, "d", None)], f)
    assert {r.item_id: r.change for r in snapshot_diff(b, a, "item_id", ["d", "p"]).collect()} == {1: "CHANGED", 2: "SAME", 3: "REMOVED", 4: "ADDED"}
    assert {r.item_id for r in anti_null_safe(b, a, ["p"]).collect()} == set()


def test_null_and_number_drift(spark):
    b = spark.createDataFrame([(100.0, "x"), (110.0, "x"), (90.0, "x"), (100.0, "x")], "cost double, category string")
    a = spark.createDataFrame([(300.0, None), (320.0, None), (290.0, None), (310.0, "x")], "cost double, category string")
    assert R.null_drift(b, a, ["category"]).first()["after_null"] == 75.0
    got = R.number_drift(b, a, "cost", 15.0).first()
    assert got.before_mean == 100.0 and got.alert


def test_versions(spark):
    day = lambda x: F.lit(x).cast("date")
    first = spark.createDataFrame([("k1", 1.0), ("k2", 2.0)], "k string, p double")
    history = first.withColumns({"valid_from": day("2024-01-01"), "valid_to": F.lit(None).cast("date")})
    then = spark.createDataFrame([("k1", 1.5), ("k3", 3.0)], "k string, p double")
    after = I.scd2(history, then, ["k"], ["p"], day("2024-02-01"))
    rows = {(r.k, r.p, r.valid_to is None) for r in after.collect()}
    assert rows == {("k1", 1.0, False), ("k2", 2.0, False), ("k1", 1.5, True), ("k3", 3.0, True)}
    assert {tuple(r) for r in I.scd2(after, then, ["k"], ["p"], day("2024-03-01")).collect()} == {tuple(r) for r in after.collect()}


def test_mutation_modes(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    late = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    got = lambda m: sorted(tuple(r) for r in I.mutate(now, late, ["k"], m).collect())
    assert got("UPSERT_OVERWRITE") == [("a", 1, "ACTIVE"), ("b", 3, "ACTIVE"), ("c", 4, "ACTIVE")]
    assert got("SPLIT_AUDIT_TRAIL") == [("a", 1, "ACTIVE"), ("b", 2, "SUPERSEDED"), ("b", 3, "ACTIVE"), ("c", 4, "ACTIVE")]
    assert got("PRESERVE_HISTORIC_RECORD") == [("a", 1, "ACTIVE"), ("b", 2, "ACTIVE"), ("b", 3, "LEDGERED"), ("c", 4, "ACTIVE")]
    assert ("b", 2, "REVIEW_REQUIRED") in got(None)


def test_fuzzy_vendors(spark):
    names = spark.createDataFrame([("ACME MEDICL SUPPLY",), ("UNRELATED",)], "name string")
    standards = spark.createDataFrame([("ACME MEDICAL SUPPLY",), ("OTHER MEDICAL",)], "standard string")
    assert [(r.name, r.standard) for r in M.fuzzy_vendors(names, standards).collect()] == [("ACME MEDICL SUPPLY", "ACME MEDICAL SUPPLY")]


def test_row_ids_are_gapless(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = W.row_ids(df, ["k"]).collect()
    assert all(r.row_number == r.k + 1 for r in got) and len(got) == 5000


def test_labels_once_per_value(spark):
    seen = group_values(spark.createDataFrame([("plate a",), ("x",), ("plate a",)], "value string"), rules).collect()
    assert sorted((r.value, r.label) for r in seen) == [("plate a", "ORTHO"), ("x", "GENERAL")]


def test_readers(spark, tmp_path):
    (tmp_path / "f.txt").write_text('a|b|c\n1|x|\n2|y\n3|"q\nr"|z\n')
    rows = readers.delimited(spark, str(tmp_path / "f.txt"), ["a", "b", "c"], relaxed=True).collect()
    assert [tuple(r) for r in rows] == [("1", "x", None), ("2", "y", None), ("3", "q\nr", "z")]
    assert readers.sniff(spark, str(tmp_path / "f.txt")) == "|"
    assert readers.or_empty(spark, str(tmp_path / "none"), ["a"]).count() == 0
    assert readers.kind(["PO_NUMBER", "x"]) == "purchase_orders"
    assert "_source_file" in readers.with_audit(readers.delimited(spark, str(tmp_path / "f.txt"))).columns


def test_versions_swap_only_after_checks(spark, tmp_path):
    store = sinks.Versions(spark, f"file://{tmp_path}/store")
    store.commit({"t": spark.range(3)})
    with pytest.raises(ValueError):
        store.commit({"t": spark.range(9)}, check=lambda n, df: df.count() < 5)
    assert store.read("t").count() == 3
    store.commit({"t": spark.range(4)})
    assert store.read("t").count() == 4
    assert sinks.published(spark.range(1)).columns == ["ID"]
    assert sinks.page(spark.range(10), ["id"], 5, 2) == {"total": 10, "rows": [{"id": 5}, {"id": 6}]}
    sinks.csv_parts(spark.range(10).coalesce(1), f"{tmp_path}/csv", rows_per_file=4)
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 3


def test_streams(spark, tmp_path):
    spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int").write.parquet(f"{tmp_path}/in")
    store = sinks.Versions(spark, f"file://{tmp_path}/store")
    store.commit({"t": spark.createDataFrame([("a", 1, "ACTIVE"), ("b", 2, "ACTIVE")], "k string, v int, record_status string")})
    feeds.deliver(spark, f"{tmp_path}/in", "k string, v int", store, "t", ["k"], "UPSERT_OVERWRITE", f"{tmp_path}/check").awaitTermination()
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    q = feeds.ingest_logs(spark, f"{tmp_path}/in", "k string, v int", f"{tmp_path}/out", f"{tmp_path}/check2")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    now = F.lit("2024-06-01").cast("timestamp")
    logs = spark.createDataFrame([(datetime.datetime(2024, 2, 1), "x", 1.0), (datetime.datetime(2024, 5, 25), "x", 2.0)], "ts timestamp, action string, value double")
    assert feeds.retained(logs, now).count() == 1
    assert feeds.windowed(logs).count() == 2


def test_schema_drift(spark):
    assert I.schema_drift({"id": "bigint", "x": "int"}, spark.range(1).withColumn("y", F.lit(1))) == [("x", "MISSING", "HIGH"), ("y", "NEW", "LOW")]


def test_catalog_splits_a_hot_entity(spark):
    from ledgerloom.operators import manifest

    rows = [("hot", f"{i:05d}", i // 3) for i in range(4000)] + [("cold", "a", 1), (None, "b", 2), (None, "c", 1)]
    df = manifest.catalog(spark.createDataFrame(rows, "entity string, name string, arrived int").repartition(5))
    got = {(r.entity, r.name): (r.version, r.status) for r in df.collect()}
    want = {("hot", f"{i:05d}"): (i + 1, "ACTIVE" if i == 3999 else "SUPERSEDED") for i in range(4000)}
    assert got == want | {("cold", "a"): (1, "ACTIVE"), (None, "b"): (2, "ACTIVE"), (None, "c"): (1, "SUPERSEDED")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(entity" in plan and "row_number() windowspecdefinition(entity" not in plan


def test_row_ids_of_wide_rows_in_many_partitions(spark):
    rows = spark.range(0, 40_000, 1, 20).select((F.col("id") * 7919 % 40_000).alias("k"), F.col("id").alias("place"), F.repeat(F.lit("x"), 50).alias("part"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        got = W.row_ids(rows, ["k"]).select("k", "row_number", "part", "n").collect()
        nulls = W.row_ids(rows, ["n", "k"], "at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 40_000 and all(r.row_number == r.k + 1 for r in got)
    want = sorted((r.n is None, r.n or 0, r.k) for r in nulls)
    assert sorted((r.at, (r.n is None, r.n or 0, r.k)) for r in nulls) == list(enumerate(want, 1))


def test_versions_are_numbered_and_discarded(spark, tmp_path):
    store = sinks.Versions(spark, f"file://{tmp_path}/store")
    made = [store.commit({"t": spark.range(n)}, notes={"n": n}) for n in (1, 2, 3)]
    assert store.versions() == made and store.notes() == {"n": 3}
    store.discard(keep=1)
    assert store.versions() == made[-1:] and store.read("t").count() == 3
    store._numbers = lambda: []  # another commit has come in between
    with pytest.raises(RuntimeError):
        store.commit({"t": spark.range(9)})
        store.commit({"t": spark.range(9)})


@pytest.mark.parametrize("mode,trail", [("UPSERT_OVERWRITE", []), ("SPLIT_AUDIT_TRAIL", [("b", 2, "SUPERSEDED"), ("c", 3, "SUPERSEDED")]), ("PRESERVE_HISTORIC_RECORD", [("b", 5, "LEDGERED"), ("c", 6, "LEDGERED")])])
def test_deliveries_keep_the_trail(spark, tmp_path, mode, trail):
    store = sinks.Versions(spark, f"file://{tmp_path}/store")
    store.commit({"t": spark.createDataFrame([("a", 1, "ACTIVE"), ("b", 2, "ACTIVE"), ("c", 3, "ACTIVE")], "k string, v int, record_status string")})
    for row in (("b", 5), ("c", 6)):
        spark.createDataFrame([row], "k string, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feeds.deliver(spark, f"{tmp_path}/in", "k string, v int", store, "t", ["k"], mode, f"{tmp_path}/check").awaitTermination()
    active = [("a", 1, "ACTIVE"), *([("b", 2, "ACTIVE"), ("c", 3, "ACTIVE")] if mode.startswith("PRESERVE") else [("b", 5, "ACTIVE"), ("c", 6, "ACTIVE")])]
    got = sorted(tuple(r) for r in store.read("t").select("k", "v", "record_status").collect())
    assert got == sorted(active + trail)
    versions = store.versions()
    import shutil

    shutil.rmtree(tmp_path / "check" / "commits")  # as after a failure between the commit of the version and of the batch
    feeds.deliver(spark, f"{tmp_path}/in", "k string, v int", store, "t", ["k"], mode, f"{tmp_path}/check").awaitTermination()
    assert store.versions() == versions and got == sorted(tuple(r) for r in store.read("t").select("k", "v", "record_status").collect())


def test_fuzzy_vendors_equal_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(6)
    standards = sorted({"".join(rng.choices("ABCDE ", k=rng.randint(1, 14))).strip() or "A" for _ in range(120)} | {"MEDTRONIC", "AB", "AXB", "ACME INC", "ACNE INC"})
    names = {"MDETRONIC", "Xedtronic", "AB", "aXB", "ABX", "", *(rng.choice(standards) for _ in range(20))}
    for s in standards:
        x = list(s)
        for _ in range(rng.randint(0, 3)):
            x.insert(rng.randrange(len(x) + 1), rng.choice("ABCDE "))
            x.pop(rng.randrange(len(x)))
        names.add("".join(x))
    got = {r.name: (r.standard, r.ratio) for r in M.fuzzy_vendors(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(s,) for s in standards], "standard string")).collect()}
    want = {}
    for n in names:
        best = min(((-SequenceMatcher(None, n.upper(), s, autojunk=False).ratio(), s) for s in standards))
        if -best[0] >= 0.8:
            want[n] = (best[1], -best[0])
    assert got == want and "MDETRONIC" in got and "Xedtronic" in got


def test_nearest_signature_misses_none(spark):
    from ledgerloom.operators import manifest

    columns = spark.createDataFrame([("a", [1.0, 0.9]), ("b", [-1.0, 0.0])], "name string, vector array<double>")
    known = spark.createDataFrame([("x", [0.9, 1.0]), ("y", [0.0, 1.0])], "name string, vector array<double>")
    assert [(r.name, r.nearest) for r in manifest.nearest_signature(columns, known).collect()] == [("a", "x")]
    assert manifest.nearest_signature(columns, known.limit(0)).count() == 0


@pytest.mark.parametrize("unit,factor,label", [("PK 20", 20.0, "PK/20"), ("box-12", 12.0, "BO/12"), ("BX 5", 5.0, "BX/5"), ("CS/0", 1.0, "CS/0"), ("BOX", 10.0, "BOX"), (" dozen ", 12.0, "DOZEN"), ("EA/7", 1.0, "EA/7"), ("carton_144", 144.0, "CA/144")])
def test_pack_units_without_slash(spark, unit, factor, label):
    assert one(spark, P.pack_factor(F.col("u")), u=unit) == factor
    assert one(spark, P.pack_label(F.col("u")), u=unit) == label


def test_legal_forms_and_classes(spark):
    x = F.col("x")
    for name, bare in [("ST JUDE MEDICAL SC INC", "ST JUDE MEDICAL"), ("Acme  Incorporated", "ACME"), ("ACME, L.L.C.", "ACME"), ("ACME LIMITED", "ACME"), ("ACME LP", "ACME LP"), ("INC", "INC")]:
        assert one(spark, C.strip_suffix(x), x=name) == bare
    for text, kind in [("bone screw", "Orthopedic / Implants"), ("Catheter", "Cardiology"), ("surgical gown", "PPE / Apparel"), ("skin stapler", "Surgical Supplies"), ("gauze", "Wound Care"), ("iv set", "IV & Injection"), ("other", "Food"), ("mask for bone", "Orthopedic / Implants")]:
        assert one(spark, C.keyword_class(x, F.lit(" Food ")), x=text) == kind
    assert one(spark, C.keyword_class(x, F.lit(" ")), x="other") == C.UNCLASSIFIED and one(spark, C.keyword_class(x, x, F.lit("Seed")), x="bone") == "Seed"


def test_feeds_in_parts(spark, tmp_path):
    for name, text in (("c10.csv", "a,b\n5,z\n"), ("c2.csv", "b,a\ny,3\n"), ("c1.csv", "a,b\n1,x\n2,\n"), ("c3.csv", "")):
        (tmp_path / name).write_text(text)
    found = readers.discover(spark, "nostore://x/*", f"file://{tmp_path}/none*", f"file://{tmp_path}/c*.csv")
    assert [p.rsplit("/", 1)[1] for p in found] == ["c1.csv", "c2.csv", "c10.csv"]
    rows = readers.parts(spark, f"file://{tmp_path}/c*.csv").select("a", "b", "_source_index").collect()
    assert sorted(map(tuple, rows)) == [("1", "x", 0), ("2", None, 0), ("3", "y", 1), ("5", "z", 2)]
    (tmp_path / "c11.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="c11"):
        readers.parts(spark, f"file://{tmp_path}/c*.csv")
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, f"file://{tmp_path}/none*")
