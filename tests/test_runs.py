"""Publication, resumed stages, catalog, labels, bad rows, parity, similar sets."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import grouping as L
from ledgerloom.operators.catalog import Catalog
from ledgerloom.operators.matching import similar_sets
from ledgerloom.operators.profile import parity
from ledgerloom.operators.stages import Run, Stage
from ledgerloom.sources import publish, readers
from ledgerloom.sources.sinks import Versions


def test_publication_is_all_or_none(spark, tmp_path):
    uri = f"file://{tmp_path}/t"
    rows = spark.range(1000).select("id", F.to_timestamp(F.lit("2024-01-02 03:04:05")).alias("at")).repartition(3)
    done = publish.publish(rows, uri, chunk=100)
    assert done["rows"] == 1000 and len(done["files"]) >= 10
    back = publish.read_published(spark, uri)
    assert back.dtypes == [("ID", "bigint"), ("AT", "timestamp_ntz")] and back.count() == 1000 and back.first().AT == dt.datetime(2024, 1, 2, 3, 4, 5)
    broken = rows.withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        publish.publish(broken, uri)
    assert publish.current(uri) == done and publish.read_published(spark, uri).count() == 1000
    assert sorted(os.listdir(tmp_path / "t")) == sorted(["pointer", done["run"]])  # the failed run's chunks are gone
    publish.publish(rows.where("id < 5"), uri, mode="append")
    assert publish.read_published(spark, uri).count() == 1005
    publish.publish(rows.where("id < 5"), uri)
    assert publish.read_published(spark, uri).count() == 5


def test_run_resumes_after_the_last_finished_stage(spark, tmp_path):
    calls = []

    def step(name, fails=()):
        def work(*inputs):
            calls.append(name)
            if name in fails:
                raise RuntimeError(name)
            return inputs[0].withColumn("id", F.col("id") + 1) if inputs else spark.range(3)

        return work

    def run(fails=(), **settings):
        return Run(spark, f"file://{tmp_path}/run", [Stage("c", step("c", fails), ("b",)), Stage("a", step("a", fails)), Stage("b", step("b", fails), ("a",), settings)])

    with pytest.raises(RuntimeError, match="c"):
        run(fails=("c",)).resume()
    assert run().states() == {"a": "FINISHED", "b": "FINISHED", "c": "PENDING"} and calls == ["a", "b", "c"]
    again = run()
    assert again.resume() == ["c"] and sorted(r.id for r in again.read("c").collect()) == [2, 3, 4] and again.resume() == []
    assert run(x=1).resume() == ["b", "c"]  # other settings, and what follows
    again = run(x=1)
    again.forget("a")
    assert again.states()["c"] == "PENDING" and again.resume() == ["a", "b", "c"]
    with pytest.raises(ValueError, match="circle"):
        Run(spark, f"file://{tmp_path}/x", [Stage("a", step("a"), ("b",)), Stage("b", step("b"), ("a",))])


def test_catalog_of_two_writers(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(n)
    frame = lambda *rows: spark.createDataFrame(rows, "entity string, name string, arrived timestamp, rows long")
    path = f"file://{tmp_path}/catalog"
    one, two = Catalog(Versions(spark, path)), Catalog(Versions(spark, path))
    one.register(frame(("items", "a", at(1), 4), ("orders", "o", at(1), 1)))
    commit, raced = one.store.commit, []

    def late(tables, **more):  # between the first writer's reading and its commit the second one commits
        if not raced:
            raced.append(1)
            two.register(frame(("items", "c", at(3), 6)))
            raise RuntimeError("another version was committed meanwhile")
        return commit(tables, **more)

    one.store.commit = late
    one.register(frame(("items", "b", at(2), 5)))
    versions = {r.name: r.version for r in one.files("items").collect()}
    assert versions == {"a": 1, "c": 2, "b": 3}
    assert [tuple(r) for r in one.candidates().collect()] == [("items", 3)]
    one.merged("items", "all", at(9), 15)
    got = {r.name: (r.version, r.status, r.canonical, r.merged_into) for r in two.files("items").collect()}
    assert got == {**{n: (v, "SUPERSEDED", False, "all") for n, v in versions.items()}, "all": (4, "MERGED_CONSOLIDATED", True, None)}
    assert {r.status for r in two.files("orders").collect()} == {"ACTIVE"} and two.candidates().count() == 0


@pytest.mark.parametrize("reply,found", [
    ('[{"a": 1}]', [{"a": 1}]), ('```json\n[{"a": 1}]\n```', [{"a": 1}]), ('So:\n```\n{"n": 2, "rows": [{"a": 1}, 3]}\n``` done', [{"a": 1}]), ('{"n": 2}', []), ("sorry", []), ("", []), ('"x"', []),
])
def test_replies(reply, found):
    assert L.unwrap(reply) == found


def test_labels_are_asked_once(spark, tmp_path):
    log = tmp_path / "asked"

    def client(values):
        with log.open("a") as out:
            out.write("".join(v + "\n" for v in values))
        if "bad" in values:
            raise OSError("service is down")
        return L.json.dumps([{"value": v, "label": v.upper()} for v in values if v != "unknown"])

    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "value string").coalesce(1)
    cache = L.LabelCache(Versions(spark, f"file://{tmp_path}/labels"), client)
    assert cache.run(frame("x", "x", "unknown", None)) == {"asked": 2, "by_rule": 1}
    assert cache.run(frame("x", "bolt")) == {"asked": 1, "by_rule": 0}
    assert sorted(log.read_text().split()) == ["bolt", "unknown", "x"]
    assert cache.run(frame("bad")) == {"asked": 1, "by_rule": 1} and cache.run(frame("x", "unknown")) == {"asked": 1, "by_rule": 1}
    assert sorted(map(tuple, cache.known().collect())) == [("bad", "GENERAL", "RULE"), ("bolt", "BOLT", "CLIENT"), ("unknown", "GENERAL", "RULE"), ("x", "X", "CLIENT")]


def test_bad_rows_are_set_aside(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a|b|c\n1|2|3\n4|5\n6\n7|8|9|10\n11|"12|13\n"x|y"|14|\n')
    rows, bad = readers.quarantined(spark, f"file://{tmp_path}/f.csv", ["a", "b", "c"])
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("1", "2", "3"), ("4", "5", None), ("6", None, None), ("x|y", "14", None)], key=str)
    assert sorted(r["_bad"] for r in bad.collect()) == ['11|"12|13', "7|8|9|10"]


def test_parity_finds_a_planted_difference(spark):
    left = spark.range(100).select(F.col("id").cast("double").alias("v"))
    metrics = {"rows": (F.count("*"), 0.0), "sum": (F.sum("v"), 0.01)}
    equal = lambda right: {r.metric: r.equal for r in parity(left, right, metrics).collect()}
    assert equal(left) == {"rows": True, "sum": True} and equal(left.where("v > 0")) == {"rows": False, "sum": True} and equal(left.where("v < 90")) == {"rows": False, "sum": False}
    assert equal(left.limit(0)) == {"rows": False, "sum": False}


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_similar_sets_equal_all_pairs(spark, least):
    rng = random.Random(1)
    rows = [(i, rng.choice(["g", "h", None]), rng.sample("abcdefghij", rng.randint(0, 6)) * rng.choice([1, 2])) for i in range(150)]
    found, candidates = similar_sets(spark.createDataFrame(rows, "id long, g string, t array<string>"), "id", "g", "t", least)
    want = {(a, b) for a, g, s in rows for b, h, t in rows if a < b and g and g == h and s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= least - 1e-12}
    assert {tuple(r) for r in found.collect()} == want and want
    pairs = sum(bool(a < b and g and g == h) for a, g, _ in rows for b, h, _ in rows)
    assert len(want) <= candidates.count() < pairs / (2 if least >= 0.8 else 1)
