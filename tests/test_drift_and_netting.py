"""Drift report and netting of returns against plain versions."""

import random
import statistics

import pytest

from ledgerloom.operators import drift as R
from ledgerloom.operators import guardrails as G


def netted(rows):
    buys, back = [r for r in rows if not (r[3] or 0) < 0], [r for r in rows if (r[3] or 0) < 0]
    gone, pairs = set(), []
    for row, case, item, quantity in buys:
        for i, (other, its_case, its_item, returned) in enumerate(back):
            if i not in gone and (not case or case == (its_case or "")) and (item or "") == (its_item or "") and abs((quantity or 0) + returned) < 0.001:
                gone.add(i)
                pairs.append((row, other))
                break
    return pairs


@pytest.mark.parametrize("seed", range(4))
def test_netting_equals_plain_version(spark, seed):
    rng = random.Random(seed)
    amounts = [1.0, 2.0] if seed == 0 else [1.0, 1.0004, 1.0008, 1.0013, 2.0, 0.0, None]
    cases = ["a", "b", "c"] if seed == 1 else ["a", "b", "", None]
    rows = []
    for i in range(400):
        amount = rng.choice(amounts)
        rows.append((i, rng.choice(cases), rng.choice(["x", "y", None]), None if amount is None else amount * rng.choice([1, 1, -1])))
    df = spark.createDataFrame(rows, "id long, case_id string, item string, quantity double")
    got = G.net_returns(df, "case_id", "item", "quantity", "id").collect()
    pairs = netted(rows)
    want = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    assert {r.id: r.partner for r in got if r.state == "NETTED"} == want and len(got) == 400 and want
    assert all(r.partner is None for r in got if r.state == "ACTIVE")


def test_one_pair_and_none(spark):
    df = spark.createDataFrame([(1, "1001", "A", 5.0), (2, "1001", "A", -5.0), (3, "1002", "B", 2.0)], "id long, case_id string, item string, quantity double")
    assert sorted(tuple(r) for r in G.net_returns(df, "case_id", "item", "quantity", "id").collect()) == [(1, "NETTED", 2), (2, "NETTED", 1), (3, "ACTIVE", None)]
    assert G.net_returns(df.limit(0), "case_id", "item", "quantity", "id").count() == 0


def sections(report):
    out = {}
    for r in report.collect():
        out.setdefault(r.section, {})[r.name] = (r.before, r.after, r.change, r.severity)
    return out


def test_drift_of_records(spark):
    columns = "item_id string, item_description string, unit_price double, vendor string"
    before = spark.createDataFrame([("1", "Gauze 4x4", 5.0, "Medline"), ("2", "Scalpel #10", 15.0, "Becton"), ("3", "Saline 500ml", 8.0, "Baxter")], columns)
    after = spark.createDataFrame([("1", "Gauze 4x4 Sterile", 5.5, "Medline"), ("2", "Scalpel #10", 15.0, "Becton"), ("4", "Suture 3-0", 25.0, "Ethicon")], columns)
    report, samples = R.report(before, after, ["item_id"])
    got = sections(report)
    assert got["volume"]["rows"] == (3, 3, 0, "LOW")
    assert {k: v[1] for k, v in got["churn"].items()} == {"added": 1, "dropped": 1, "modified": 1, "unchanged": 1}
    assert got["field"] == {"item_description": (None, 1, 50.0, "HIGH"), "unit_price": (None, 1, 50.0, "HIGH")}
    assert got["median"]["unit_price"][:2] == (8.0, 15.0)
    assert sorted(map(tuple, samples.collect())) == [("1", "item_description", "Gauze 4x4", "Gauze 4x4 Sterile"), ("1", "unit_price", "5.0", "5.5")]


def test_drift_of_nulls_and_numbers(spark):
    columns = "id string, cost double, category string"
    before = spark.createDataFrame([("1", 100.0, "OR"), ("2", 110.0, "ER"), ("3", 90.0, "ICU"), ("4", 100.0, "OR")], columns)
    after = spark.createDataFrame([("1", 300.0, None), ("2", 320.0, None), ("3", 290.0, "ICU"), ("4", 310.0, None)], columns)
    got = sections(R.report(before, after, ["id"])[0])
    assert got["null_rate"]["category"] == (0, 75, 75, "SEVERE")
    assert got["mean"]["cost"][0] == 100 and got["mean"]["cost"][2] > 100 and got["mean"]["cost"][3] == "ALERT"
    assert got["volume"]["rows"][3] == "LOW"
    empty = sections(R.report(before.limit(0), after, ["id"])[0])
    assert empty["volume"]["rows"] == (0, 4, 400, "HIGH") and empty["churn"]["added"][1] == 4


def test_median(spark):
    rng = random.Random(5)
    for n in (0, 1, 2, 101, 500):
        values = [rng.choice([1.0, 2.0, 2.5, rng.random()]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert R.median(df, "v") == (statistics.median(values) if values else None)


@pytest.mark.parametrize("wild", [False, True])
def test_netting_shuffles_rows_once(spark, wild):
    """Rows get their state where they are matched: no join brings it back to them by row_id."""
    df = spark.range(300).selectExpr("id", f"if({str(wild).lower()} and id % 7 = 0, '', string(id % 5)) as case_id", "'x' as item", "if(id % 4 = 0, -1.0, 1.0) * (id % 3) as quantity")
    out = G.net_returns(df, "case_id", "item", "quantity", "id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "row_id" in line]
    assert {r.id for r in out.collect()} == set(range(300)) and out.count() == 300
