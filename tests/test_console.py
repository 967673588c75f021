"""Pages, drill-downs and assertions behind a console."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import console as O


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f"name {i % 7}", None if i % 5 == 0 else "50%_x", float(i)) for i in range(100)], "id long, name string, note string, v double").cache()


def test_pages_have_counts_and_do_not_overlap(rows):
    got = O.table_page(rows, search="NAME 3", sort="v", descending=True, start=2, length=3)
    assert (got.total, got.filtered) == (100, 14) and [r.id for r in got.rows.collect()] == [80, 73, 66]
    seen = [r.id for n in range(0, 100, 10) for r in O.table_page(rows, sort="name", start=n).rows.collect()]
    assert sorted(seen) == list(range(100))
    assert O.table_page(rows, equal={"name": "name 1", "gone": "x"}).filtered == 15
    assert O.table_page(rows, search="%_").filtered == 80 and O.table_page(rows, search="\\").filtered == 0
    assert O.table_page(rows, sort="id; drop table x", start=-5, length=-1).rows.count() == 0
    assert O.table_page(rows, length=10**9, most=20).rows.count() == 20 and O.table_page(rows.limit(0), search="x").total == 0


def test_drill_and_stats(spark, rows, tmp_path):
    fact = rows.select("id", F.col("v").alias("line_spend"), (F.col("id") % 2 == 0).alias("is_contract_matched"), (F.col("v") - 90).alias("savings_opportunity"), F.lit(0.0).alias("overpayment_amount"))
    totals, top = O.drill(fact, "id", limit=2)
    assert {r.figure: (r.rows, r.total) for r in totals.collect()} == {"spend": (99, 4950.0), "match_rate": (50, 2450.0), "savings": (9, 45.0), "overpayment": (0, 0.0)}
    assert [(r.figure, r.key) for r in top.collect()] == [("spend", 99), ("spend", 98), ("match_rate", 98), ("match_rate", 96), ("savings", 99), ("savings", 98)]
    assert {r.column_name: (r.rows, r.nulls) for r in O.column_stats(rows).collect()}["note"] == (100, 20)
    O.download(rows.where("id < 3"), f"file://{tmp_path}/d")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/d").count() == 3


def test_assertions_fail_where_they_should(spark):
    usage = spark.createDataFrame([(2.0, 3.0), (1.0, 1.0), (None, 1.0)], "unit_price double, quantity double")
    orders = spark.createDataFrame([(5.0,)], "total_value double")
    fact = spark.createDataFrame([(6.0, True, True, 1), (1.0, True, False, 99), (None, False, False, 99)], "line_spend double, is_item_master_matched boolean, is_contract_matched boolean, contract_match_tier int")
    tenants = spark.createDataFrame([("a", "b", "c")], "client_id string, client_name string, client_type string")
    state = lambda *x, **more: {r.id[-3:]: r.status for r in O.assertions(*x, **more).collect()}
    assert state(usage, orders, fact, orders, orders, tenants, coverage=60) == dict.fromkeys("001 002 003 004 005 006 007 008".split(), "PASS")
    bad = tenants.unionAll(spark.createDataFrame([(None, "b", " ")], tenants.schema))
    worse = usage.unionAll(spark.createDataFrame([(1.0, -1.0)], usage.schema))
    assert set(state(worse, orders, fact.withColumn("contract_match_tier", F.lit(7)), orders.unionAll(orders), orders.limit(0), bad).values()) == {"FAIL"}


def test_figures_count_every_row_of_the_fact(spark):
    """API-06 leaves no row and no figure out: its counts and sums are those of all that FCT-CONSUMPTION gives."""
    from ledgerloom.plans import registry

    fact = registry.QUERIES["FCT-CONSUMPTION"](spark, "/root/testdata/sf0.001").collect()
    got = {r.figure: (r.rows, r.total) for r in registry.QUERIES["API-06"](spark, "/root/testdata/sf0.001").collect()}
    hit = {
        "spend": [r.line_spend for r in fact if r.line_spend > 0], "match_rate": [r.line_spend for r in fact if r.is_contract_matched],
        "savings": [r.savings_opportunity for r in fact if r.savings_opportunity > 0], "overpayment": [r.overpayment_amount for r in fact if r.overpayment_amount > 0],
    }
    assert len(fact) > 5000 and {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in hit.items()}
    assert all(v[1] == pytest.approx(sum(hit[k]), abs=0.01) for k, v in got.items())
