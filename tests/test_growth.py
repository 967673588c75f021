"""What must hold at larger sizes: work in proportion to the input, and results that don't depend on the size."""

import datetime
import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ledgerloom.operators import joins as J
from ledgerloom.operators import mapper
from ledgerloom.operators import matching as M
from ledgerloom.operators import quality as Q
from ledgerloom.operators import vendors
from ledgerloom.plans import changes, domain, marts
from ledgerloom.plans.registry import aggregates, projections
from ledgerloom.sources import shared, sinks


def day(n):
    return datetime.date(1995, 1, 1) + datetime.timedelta(days=n)


CONTRACT = "contract_number string, item_id string, vendor string, manufacturer_part string, uom string, price double, each_price double, category string, starts date, ends date"


def test_part_lookup_equals_all_pairs(spark):
    """One vendor and part with many contracts and rows, closed, open and overlapping ones."""
    rng = random.Random(3)
    ks = []
    for i in range(300):
        a = rng.randrange(900)
        ks.append((f"C{rng.randrange(200)}", f"i{i % 40}", rng.choice("VW"), rng.choice("PQ"), rng.choice(["EA", "BX"]), float(rng.randrange(9)), 1.0, "c", day(a), None if rng.random() < 0.1 else day(a + rng.randrange(90))))
    rows = [(i, rng.choice(["", "none", "i1", "i2"]), rng.choice("VW"), rng.choice(["P", "Q", ""]), "EA", day(rng.randrange(1000))) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, item_id string, vendor string, catalog_number string, unit string, day date")
    items = spark.createDataFrame([("i1", "P"), ("i3", "Q")], "item_id string, manufacturer_part string")
    got = M.contract_in_force(df, spark.createDataFrame(ks, CONTRACT), items, spark.createDataFrame([], "alias_name string, standard_vendor string")).collect()
    assert len(got) == len(rows)
    far = datetime.date(2099, 12, 31)
    for r in got:
        item = r.item_id if r.item_id in ("i1", "i3") else {"P": "i1", "Q": "i3"}.get(r.catalog_number, r.item_id)
        best = []
        for n, i, v, part, uom, price, _, _, a, b in ks:
            by_item, by_part = i == item and item != "", part == r.catalog_number
            if v == r.vendor and a <= r.day <= (b or far) and (by_item or by_part):
                tier = 4 if not by_item else 1 if by_part and r.unit == uom else 2 if r.unit == uom else 3
                best.append((tier, b is None, -(b or far).toordinal(), n, a, price, uom))
        want = min(best, default=(None,) * 7)
        assert (r.effective_item, r.tier, r.contract_number, r.starts, r.price, r.contract_uom) == (item, want[0], want[3], want[4], want[5], want[6])


def test_a_row_meets_its_items_contracts_by_one_join(spark):
    rows = spark.createDataFrame([(1, "i", "V", "EA", day(5))], "row_id long, item_id string, vendor string, unit string, day date")
    out = M.contract_cascade(rows, spark.createDataFrame([("C", "i", "V", "p", "EA", 1.0, 1.0, "c", day(0), day(9))], CONTRACT), "row_id", date_in_join=False)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 and out.first().contract_number == "C"


def test_numbered_names_are_matched_soon(spark):
    names, standards = [f"Supplier#O{n:08d}" for n in range(0, 3000, 3)], [f"SUPPLIER#{n:09d}" for n in range(3000)]
    began = time.time()
    got = {r.name: r for r in M.fuzzy_vendors(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(s,) for s in standards], "standard string"), block=700).collect()}
    assert time.time() - began < 60 and set(got) == set(names)
    for name in names[::97]:
        best = min((-SequenceMatcher(None, name.upper(), s, autojunk=False).ratio(), s) for s in standards)
        assert (-got[name].ratio, got[name].standard) == best


def test_long_and_short_names(spark):
    rng = random.Random(5)
    standards = ["".join(rng.choice("AB C\u00c9\U0001f600") for _ in range(n)).strip() or "X" for n in (1, 2, 3, 5, 9, 63, 64, 65, 129, 200)]
    names = [s[: len(s) // 2] + "Z" + s[len(s) // 2 :] for s in standards]
    got = {r.name: (r.standard, r.ratio) for r in M.fuzzy_vendors(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(s,) for s in standards], "standard string")).collect()}
    for name in set(names):
        ratio, best = min((-SequenceMatcher(None, name, s, autojunk=False).ratio(), s) for s in set(standards))
        assert got.get(name) == ((best, -ratio) if -ratio >= 0.8 else None)


def test_copies_of_an_item_are_no_pairs(spark):
    class D:
        item_master = spark.createDataFrame([(f"{i:04d}", "a  b" if i % 2 else "b  a", "m") for i in range(400)] + [("x", "a b c d e", "m"), ("y", "a b c d", "m")], "item_id string, description string, manufacturer string")

    got = sorted(map(tuple, changes.alike(D).collect()))
    assert got == sorted([(f"{i:04d}", "0000", "COPY") for i in range(1, 400)] + [("x", "y", "ALIKE")])


def test_reconciled_sums_are_exact(spark):
    class D:
        lineitem = spark.createDataFrame([(1e15,), (0.3,), (-1e15,)] , "l_extendedprice double").coalesce(1)
        purchase_orders = spark.createDataFrame([(1e15,), (-1e15,), (0.3,)], "total_value double").coalesce(1)

    assert tuple(changes.reconciled(D).first()) == (0.0, False)


def test_windows_reach_days_that_months_clip(spark):
    """31 August less six months is 28 February, so a contract that ends then is near on that day."""
    schema = "contract_number string, vendor string, item_id string, uom string, price double, each_price double, starts date, ends date"
    end = datetime.date(1997, 2, 28)
    before, after = (spark.createDataFrame([("C", "V", "i", "EA", p, p, day(0), end), ("D", "V", "i", "EA", 1.0, 1.0, day(900), None)], schema) for p in (1.0, 2.0))
    (w,) = mapper.contract_windows(before, after, 6).collect()
    assert w.since <= datetime.date(1997, 8, 31) <= w.until


def test_lines_meet_orders_with_their_customers(spark):
    """Lines are shuffled for orders and parts, not once more for customers."""
    d = domain.Domain(spark, "/root/testdata/sf0.001")
    plan = d.consumption._jdf.queryExecution().optimizedPlan().toString()
    depth = {x: next(len(line) - len(line.lstrip(" :+-")) for line in plan.splitlines() if x in line and "Relation" in line) for x in ("c_custkey", "l_orderkey")}
    assert depth["c_custkey"] > depth["l_orderkey"]


def test_blank_keys_are_dealt_out(spark):
    left = spark.createDataFrame([(i, "" if i % 2 else "a") for i in range(400)] + [(400, None)], "id long, k string")
    right = spark.createDataFrame([("", "x"), ("", "y"), ("a", "z"), ("b", "w")], "k string, v string")
    for how in ("inner", "left"):
        spread, plain = J.join_spread(left, right, "k", how, "id", 8), left.join(right, "k", how)
        assert sorted(map(str, spread.select("id", "k", "v").collect())) == sorted(map(str, plain.select("id", "k", "v").collect()))
    tasks = left.where("k = ''").withColumn("p", F.pmod(F.xxhash64("id"), F.lit(8))).select("p").distinct().count()
    assert tasks == 8


def test_shapes_of_ambiguity_copy_no_rows(spark):
    class D:
        contracts = spark.createDataFrame(
            [("V", "a", "C", 1.0, day(0)), ("V", "b", "C", 1.0, day(0)), ("V", "b", "D", 2.0, day(0)), ("V", "c", "C", None, day(0)), ("V", "c", "D", 2.0, day(1)), ("V", "d", "C", 1.0, None), ("V", "d", "C", 2.0, day(0)), ("V", "e", "C", None, day(0)), ("V", "e", "C", None, day(1)), ("V", "f", "C", 0.0, None), ("V", "f", "C", -0.0, None)],
            "vendor string, item_id string, contract_number string, price double, starts date",
        )

    out = aggregates.scenarios(D)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("A_SINGLE", 1), ("B_CONTRACTS_AND_PRICES", 1), ("C_CONTRACTS", 1), ("D_PRICES", 1), ("E_STARTS", 1), ("F_COPIES", 1)]


def test_orders_meet_their_invoices_by_one_join(spark):
    """Also where a line has two orders, which then share their invoices, each at its own factor."""
    po = [("P", "1", "i", "V", "BX", 10.0, 4.0, 30.0), ("P", "1", "i", "V", "EA", 2.0, 3.0, 8.0), ("P", "2", "", "V", "", 1.0, 5.0, 6.0)]

    class D:
        purchase_orders = spark.createDataFrame(po, "po_number string, po_line string, item_id string, vendor string, uom string, factor double, quantity double, unit_price double")
        invoices = spark.createDataFrame([("P", "1", "BX", 2.0, 10.5, None), ("P", "1", "EA", 1.0, 4.0, 2.0), ("Q", "1", "EA", 1.0, 1.0, 1.0)], "po_number string, po_line string, uom string, quantity double, unit_price double, factor double")
        contracts = spark.createDataFrame([("i", "V", 7.0), ("i", "V", 9.0)], "item_id string, vendor string, price double")

    out = projections.each_level_orders(D)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    got = {(r.po_line, r.po_ea_factor): (r.invoice_uom, r.invoice_ea_factor, r.invoice_ea_factor_rule, r.invoice_qty_total_ea, r.invoice_avg_unit_price_ea, r.invoice_last_unit_price_ea, r.contract_price_ea) for r in out.collect()}
    # pairs: (BX, 10) at 10, (BX, 2) at 1, (EA) at 2 twice
    assert got == {("1", 10.0): ("EA", 10.0, "invoice_factor", 26.0, 3.89, 10.5, 0.7), ("1", 2.0): ("EA", 10.0, "invoice_factor", 26.0, 3.89, 10.5, 3.5), ("2", 1.0): ("EA", 1.0, "ea_factor_1", 5.0, 6.0, 6.0, None)}


def test_contracts_of_a_line_are_met_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "written", lambda df, name: seen.append(df) or df)
    usage = spark.createDataFrame([("V", "i", day(5), "EACH"), ("V", "i", day(5), "BOX"), ("V", "i", day(-1), "EA"), ("V", "j", day(5), "EA"), ("W", "i", day(5), "EA")], "vendor string, item_id string, day date, unit string")
    k = [("V", "i", "C", day(0), None, "EA", 1.0, 1.0, ""), ("V", "i", "C", day(0), None, "EA", 1.0, 1.0, ""), ("V", "i", "D", day(0), day(5), "BX", 10.0, 1.0, "T"), ("V", "i", "E", day(0), day(4), "BX", 3.0, 3.0, "T"), ("V", "j", "C", day(0), None, "EA", 1.0, 1.0, ""), ("V", "j", "D", day(0), None, "EA", None, 1.0, "")]
    scenarios, drivers = Q.ambiguity(usage, spark.createDataFrame(k, "vendor string, item_id string, contract_number string, starts date, ends date, uom string, price double, each_price double, tier string"))
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {r.scenario: (r.lines, r.combos) for r in scenarios.collect()} == {"A": (2, 1), "B": (2, 1), "C": (0, 0), "D": (0, 0), "E": (0, 0), "F": (0, 0)} and drivers.count() == 0


def test_nearest_day_shuffles_each_side_once(spark):
    rng = random.Random(8)
    left = [(i, rng.choice(["a", "b", None]), day(rng.randrange(60)) if rng.random() < 0.9 else None) for i in range(200)]
    left += [(0, left[0][1], day(70)), (0, left[0][1], day(3))]
    right = [(rng.choice(["a", "b", "c", None]), day(rng.randrange(0, 60, 3)) if rng.random() < 0.9 else None, rng.choice("xyz"), i) for i in range(30)]
    off = "-1"
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for c in before:
            spark.conf.set(c, off)
        out = J.nearest(spark.createDataFrame(left, "id long, k string, d date"), spark.createDataFrame(right, "k string, other date, t string, u long"), ["k"], "d", "other", 4, ["id"], ["t", "u"])
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
        got = {r.id: (r.k, r.day_gap, r.other, r.t, r.u) for r in out.collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
    want = {}
    for i, k, d in left:
        for rk, o, t, u in right:
            if k is not None and k == rk and d and o and abs((o - d).days) <= 4:
                one = (abs((o - d).days), -o.toordinal(), t, u)
                want[i] = min(want.get(i, one), one)
    assert {i: (g, -o.toordinal(), t, u) for i, (_, g, o, t, u) in got.items()} == want and out.columns == ["id", "k", "d", "other", "t", "u", "day_gap"]


def test_a_row_meets_alike_ids_by_one_join(spark):
    items = spark.createDataFrame([("1", "a"), ("1", "a"), ("01", "b"), ("2", "a"), ("2", "b"), ("003", "c"), ("4", None), ("0", "z"), (None, "n")], "item_id string, unspsc string")
    rows = spark.createDataFrame(list(enumerate(["1", "01", "001", "2", "3", "003", "4", "04", "", "00", "0", "9", None])), "row_id long, item_id string")
    out = M.unspsc(rows, items, "row_id")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    found = {"1": ("FOUND", "a"), "01": ("FOUND", "b"), "001": ("LEADING_ZERO", None), "2": ("AMBIGUOUS", None), "3": ("LEADING_ZERO", None), "003": ("FOUND", "c"), "4": ("MISSING", None), "04": ("LEADING_ZERO", None)}
    found |= {"": ("LEADING_ZERO", None), "00": ("LEADING_ZERO", None), "0": ("FOUND", "z"), "9": ("MISSING", None), None: ("MISSING", None)}
    ids = {r.row_id: r.item_id for r in rows.collect()}
    assert {ids[r.row_id]: (r.state, r.unspsc) for r in out.collect()} == found


def test_names_of_vendors_are_compiled(spark):
    """The JVM compiles no method of over 8000 bytes."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else there is no code before the run
    try:
        pairs = domain.Domain(spark, "/root/testdata/sf0.001").vendor_usage.groupBy("vendor", "item_id").count()
        parts = pairs._jdf.queryExecution().debug().codegenToSeq()
        assert 0 < max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_vendors_read_each_feed_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(vendors, "written", lambda df, name: seen.append((name, df)) or shared.written(df, name))
    d = domain.Domain(spark, "/root/testdata/sf0.001")
    vendors.resolve(d.vendor_usage, d.vendor_contracts, d.vendor_items)
    reading = [name for name, df in seen if any("lineitem.parquet" in f for f in df.inputFiles())]
    assert reading == ["vendor_items", "contract_vendors"]


def test_a_delivery_shuffles_rows_once(spark, tmp_path, monkeypatch):
    """Usage and what was mapped before meet, and meet all they need of their items, by one shuffle, and no copy of them is written."""
    usage = "row_id string, item_id string, vendor string, day date, supply_price double, client_price double"
    contract = "contract_number string, vendor string, item_id string, uom string, price double, each_price double, starts date, ends date"
    before = [("a", "1", "V", day(5), 1.0, 1.0), ("b", "2", "V", day(5), 1.0, 1.0), ("c", "", "V", day(5), 1.0, 1.0), ("d", "01", "V", day(5), 1.0, 1.0)]
    after = [before[0], ("b", "1", "V", day(5), 1.0, 1.0), before[2], ("e", "01", "V", day(5), 1.0, 1.0)]
    feeds = (spark.createDataFrame([("C", "V", "1", "EA", 1.0, 1.0, day(0), None)], contract), spark.createDataFrame([("1", "x")], "item_id string, unspsc string"), spark.createDataFrame([("W", "V")], "name string, standard string"))
    names, plans = [], []
    monkeypatch.setattr(mapper, "written", lambda df, name: names.append(name) or shared.written(df, name))
    assembled = mapper._assembled
    monkeypatch.setattr(mapper, "_assembled", lambda rows, *x, **more: plans.append(rows) or assembled(rows, *x, **more))
    m = mapper.Mapper(sinks.Versions(spark, f"file://{tmp_path}/m"))
    assert m.run(spark.createDataFrame(before, usage), *feeds) == {"new": 4, "changed": 0, "deleted": 0, "remapped_contract": 0, "remapped_item": 0, "reused": 0, "same": 0}
    assert m.run(spark.createDataFrame(after, usage), *feeds) == {"new": 1, "changed": 1, "deleted": 1, "remapped_contract": 0, "remapped_item": 0, "reused": 2, "same": 2}
    assert not {"usage", "affected"} & set(names)
    joined = plans[1]._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("RepartitionByExpression") == 1 and joined.count("Join") == 3  # aliases, vendors, facts of items
    got = {r.row_id: (r.status, r.item_gap_code) for r in m.store.read("mapped").collect()}
    assert got == {"a": ("MATCHED", None), "b": ("MATCHED", None), "c": ("MISSING_MAPPING_KEY", "MISSING_ITEM_ID"), "e": ("NOT_FOUND", "ITEM_NOT_IN_ITEM_MASTER_LEADING_ZEROS")}


def test_columns_of_a_feed_are_derived_where_needed(spark):
    d = domain.Domain(spark, "/root/testdata/sf0.001")
    lines = d.raw_lines.join(d.part, F.col("l_partkey") == F.col("p_partkey"))
    late = lines.select(*(F.expr(sql).alias(name) for name, sql in domain.fields("consumption").items()))
    assert late.columns == d.consumption.columns and late.exceptAll(d.consumption).isEmpty() and d.consumption.exceptAll(late).isEmpty()


def test_lines_of_the_marts_are_read_once_and_travel_bare(spark, monkeypatch):
    """No copy of the lines is written, and texts are made of them behind the joins."""
    names = []
    monkeypatch.setattr(M, "written", lambda df, name: names.append(name) or shared.written(df, name))
    plan = marts.consumption_fact(domain.Domain(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert names == ["steps"] and sum("Relation" in line and "l_extendedprice" in line for line in plan) == 2  # lines, and the keys of contracts
    first = next(i for i, line in enumerate(plan) if "Join" in line)
    assert any("row_id" in line for line in plan[:first]) and not any("row_id" in line for line in plan[first:])


def test_order_lines_meet_invoices_where_they_met_their_order(spark):
    """No shuffle by texts: the numbers of orders and lines are made behind the joins, and lines are shuffled for orders and for items."""
    d = domain.Domain(spark, "/root/testdata/sf0.001")
    off = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for c in off:
            spark.conf.set(c, "-1")
        plan = marts.purchase_fact(d)._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in off.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not any("po_number" in line or "po_line" in line for line in shuffles)
    assert sum("l_orderkey" in line for line in shuffles) == 3  # lines, orders, invoices


def test_all_pairs_of_alike_items(spark):
    """Within classes and between alike ones, and an item that is there twice counts twice."""
    rng = random.Random(5)
    words = [("a", "b", "c", "d", "e"), ("a", "b", "c", "d"), ("b", "c", "d", "a", "a"), ("f",), ("a", "b", "c", "d", "f")]
    rows = [(f"{rng.randrange(60)}", None if i % 20 == 7 else " ".join(rng.choice(words)), rng.choice(["m", "n", None])) for i in range(90)]

    class D:
        item_master = spark.createDataFrame(rows, "item_id string, description string, manufacturer string")

    alike = lambda x, y: len(x & y) / len(x | y) >= 0.8
    want = [(a[0], b[0]) for a in rows for b in rows if a[2] and a[2] == b[2] and a[1] and b[1] and a[0] < b[0] and alike(set(a[1].upper().split(" ")), set(b[1].upper().split(" ")))]
    assert len(want) > 200 and sorted(map(tuple, changes.alike_pairs(D).collect())) == sorted(want)
