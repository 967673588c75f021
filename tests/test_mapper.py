"""The mapper: a second run after deliveries equals a full one, and maps only what they touch."""

import datetime as dt
import random

import pytest

from ledgerloom.operators import mapper as M
from ledgerloom.sources.sinks import Versions

USAGE = "row_id string, item_id string, vendor string, day date, supply_price double, client_price double"
CONTRACTS = "contract_number string, vendor string, item_id string, uom string, price double, each_price double, starts date, ends date"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


class Feeds:
    def __init__(self, seed):
        r = self.r = random.Random(seed)
        self.usage = {f"r{i}": (r.choice(["1", "2", "3", "007", "8", "x9", "", " 5 "]), r.choice(["a", "B", "b inc", "c", " "]), r.choice([None, *map(day, range(0, 900, 40))]), r.choice([None, 1.0, 2.0, 2.5]), 2.0) for i in range(300)}
        self.contracts = [self.contract(n) for n in range(40)]
        self.items = [(i, c) for i in "1 2 3 7 8 5".split() for c in r.sample(["11", "12", None], r.choice([1, 1, 2]))]
        self.aliases = [("B INC", "B")]

    def contract(self, n):
        r, s = self.r, self.r.randrange(0, 600, 30)
        return f"C{n}", r.choice(["a", "B", "b  inc", ""]), r.choice(["1", "2", "3", "8", "5"]), r.choice(["EA", "bx", None]), r.choice([None, 2.0, 20.0, 3.0]), r.choice([None, 2.0, 2.0, 3.0]), r.choice([day(s)] * 9 + [None]), r.choice([None, day(s + 90), day(s + 300)])

    def frames(self, spark):
        return (
            spark.createDataFrame([(k, *v) for k, v in self.usage.items()], USAGE), spark.createDataFrame(self.contracts, CONTRACTS),
            spark.createDataFrame(self.items, "item_id string, unspsc string"), spark.createDataFrame(self.aliases, "name string, standard string"),
        )


def rows(store):
    return sorted((tuple(r) for r in store.read("mapped").drop("row_hash").collect()), key=repr)


@pytest.mark.parametrize("change", ["nothing", "usage", "contract", "item", "alias", "all", "settings"])
def test_second_run_equals_a_full_one(spark, tmp_path, change):
    f = Feeds(3)
    mapper = M.Mapper(Versions(spark, f"file://{tmp_path}/a"))
    first = mapper.run(*f.frames(spark))
    assert first["new"] == 300 and first["reused"] == 0
    if change in ("usage", "all"):
        del f.usage["r7"]
        f.usage["r8"] = ("1", "a", day(100), 9.0, 9.0)
        f.usage["new"] = ("1", "a", day(100), 9.0, 9.0)
    if change in ("contract", "all"):
        f.contracts[3] = (*f.contracts[3][:4], 77.0, 77.0, *f.contracts[3][6:])
        del f.contracts[5]
        f.contracts.append(("N", "c", "7", "EA", 1.0, 1.0, day(0), None))
    if change in ("item", "all"):
        f.items = [x for x in f.items if x[0] != "2"] + [("3", "99")]
    if change in ("alias", "all"):
        f.aliases.append(("C", "A"))
    if change == "settings":
        mapper = M.Mapper(mapper.store, M.Settings(lookback_months=2))
    counts = mapper.run(*f.frames(spark))
    whole = M.Mapper(Versions(spark, f"file://{tmp_path}/b"), mapper.settings)
    whole.run(*f.frames(spark))
    assert rows(mapper.store) == rows(whole.store)
    assert mapper.store.notes()["counts"] == counts
    if change == "nothing":
        assert counts["reused"] == 300 and not counts["remapped_contract"]
    elif change == "usage":
        assert (counts["new"], counts["changed"], counts["deleted"], counts["reused"]) == (1, 1, 1, 298)
    elif change == "settings":
        assert counts["new"] == 300
    else:
        assert 0 < counts["reused"] < 300
    third = mapper.run(*f.frames(spark))  # its own state is what it was
    assert third["reused"] == len(f.usage) and third["deleted"] == 0


def test_why_not(spark):
    c = spark.createDataFrame([("C1", "A", "1", "EA", 2.0, 2.0, day(0), day(10)), ("C2", "A", "1", "EA", 3.0, 3.0, day(50), day(60)), ("C3", "A", "1", "BX", 20.0, 3.0, day(50), day(60)),
                               ("C4", "A", "2", "EA", None, 1.0, day(0), None), ("C5", "B", "3", "EA", 1.0, 1.0, day(0), None), ("C6", "B", "3", "EA", 2.0, 2.0, day(0), None)], CONTRACTS)
    asked = [("A", "1", 5), ("A", "1", 20), ("A", "1", 55), ("A", "1", 300), ("A", "2", 5), ("B", "3", 5), ("B", "1", 5), ("Q", "9", 5), ("Q", "1", 5), ("A", "9", 5)]
    wanted = spark.createDataFrame([(v, i, day(n)) for v, i, n in asked], "vendor string, item_id string, day date")
    got = {(r.vendor, r.item_id, (r.day - day(0)).days): r for r in M.decide_contracts(wanted, c, M.Settings()).collect()}
    assert len(got) == len(asked)
    assert (got["A", "1", 5].contract_number, got["A", "1", 5].reason) == ("C1", "SINGLE_ACTIVE_CONTRACT")
    x = got["A", "1", 20]
    assert (x.status, x.gap_code, x.closest_number, x.candidates) == ("NOT_ACTIVE", "NOT_ACTIVE_EXPIRED_WITHIN_LOOKBACK", "C1", 1) and "nearest is C1" in x.gap_detail and "10 days away" in x.gap_detail
    assert (got["A", "1", 55].contract_number, got["A", "1", 55].reason) == ("C2", "SAME_EACH_PRICE_ACROSS_TIED_RECORDS_PACK_UOM_DIFFERS")
    assert got["A", "1", 300].gap_code == "NOT_ACTIVE_EXPIRED_BEFORE_LOOKBACK" and got["A", "2", 5].gap_code == "CONTRACT_PRICE_MISSING"
    assert got["B", "3", 5].status == "AMBIGUOUS_MULTIPLE_CONTRACTS" and "C5|price=1.0" in got["B", "3", 5].gap_detail
    codes = [got[v, i, 5].gap_code for v, i in (("B", "1"), ("Q", "9"), ("Q", "1"), ("A", "9"))]
    assert codes == ["VENDOR_ITEM_PAIR_NOT_IN_CONTRACTS", "VENDOR_AND_ITEM_NOT_IN_CONTRACTS", "VENDOR_NOT_IN_CONTRACTS", "ITEM_NOT_IN_CONTRACTS"]
    assert "contracted under: A" in got["Q", "1", 5].gap_detail
