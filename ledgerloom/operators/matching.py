"""Matching cascades: items, contracts, vendors. All tiers are one pass of equi-joins; the least tier wins by a window."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import strip_suffix
from ..sources.shared import written
from .joins import join_spread, valid_on

BLANK = ("", "N/A", "NA", "NULL", "NONE")


def item_cascade(rows: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, matched_item, tier, confidence): by item id (1.0), maker's part (0.90) or vendor's part (0.80); tier 99 without match.

    rows: key, item_id, catalog_number, vendor_part; items: item_id, manufacturer_part, vendor_part.
    """
    up = lambda c: F.upper(F.trim(c))
    tiers = [("item_id", "item_id", 1, 1.0), ("catalog_number", "manufacturer_part", 2, 0.90), ("vendor_part", "vendor_part", 3, 0.80)]
    rows = rows.select(key, *(up(left).alias(f"k{t}") for left, _, t, _ in tiers))
    for _, right, t, _ in tiers:  # a left join on one key each, as many rows as before
        k = F.col(f"k{t}")
        known = items.groupBy(up(right).alias(f"k{t}")).agg(F.min("item_id").alias(f"item{t}")).where(~k.isin(*BLANK))
        rows = rows.join(known, f"k{t}", "left").drop(f"k{t}")
    return rows.select(
        key, F.coalesce(*(F.col(f"item{t}") for *_, t, _ in tiers)).alias("matched_item"),
        F.coalesce(*(F.when(F.col(f"item{t}").isNotNull(), t) for *_, t, _ in tiers), F.lit(99)).alias("tier"),
        F.coalesce(*(F.when(F.col(f"item{t}").isNotNull(), c) for *_, t, c in tiers), F.lit(0.0)).alias("confidence"),
    )


def contract_cascade(rows: DataFrame, contracts: DataFrame, key: str, date_in_join: bool) -> DataFrame:
    """(key, contract_number, tier, status): by item, vendor and unit (1), item and vendor (2), or item (3).

    With date_in_join, only contracts valid on the day compete, so that an expired one never hides a valid one of a later tier.
    Without it the tier is chosen first and a contract out of its time makes the row LAPSED_CONTRACT.
    rows: key, item_id, vendor, unit, day; contracts: contract_number, item_id, vendor, uom, starts, ends, price.
    """
    c = contracts.where(~F.upper(F.trim("item_id")).isin(*BLANK))  # rows without item find none
    c = c.groupBy("item_id").agg(F.collect_set(F.struct("contract_number", F.col("vendor").alias("c_vendor"), F.col("uom").alias("c_unit"), "starts", "ends")).alias("all"))

    def ranked(x: Column) -> Column:
        same = F.col("vendor") == x["c_vendor"]
        tier = F.when(same & (F.col("unit") == x["c_unit"]), 1).when(same, 2).otherwise(3)
        last = F.coalesce(x["ends"], F.lit("2099-12-31").cast("date"))
        return F.struct(tier.alias("tier"), (~valid(x)).alias("invalid"), (-F.unix_date(last)).alias("last"), x["contract_number"].alias("contract_number"))

    valid = lambda x: F.coalesce(valid_on(F.col("day"), x["starts"], x["ends"]), F.lit(False))
    of_row = F.filter("all", valid) if date_in_join else F.col("all")
    best = join_spread(rows, c, "item_id", "left", key).select(key, F.array_min(F.transform(of_row, ranked)).alias("best"))  # a row meets its item's contracts as one array
    status = F.when(F.col("best.contract_number").isNull(), "NO_CONTRACT").when(F.col("best.invalid"), "LAPSED_CONTRACT").otherwise("ON_CONTRACT")
    return best.select(key, "best.contract_number", F.coalesce("best.tier", F.lit(99)).alias("tier"), status.alias("status"))


def first_by_end(rows: DataFrame, keys: list[str], before: list[str]) -> DataFrame:
    """Of each key the row that is least in the columns of before, then has the latest end, an open one last."""
    others = [c for c in rows.columns if c not in keys]
    order = [*before, F.col("ends").isNull(), -F.unix_date("ends"), "contract_number", "starts", F.col("price").isNull(), "price", "contract_uom"]
    least = F.min(F.struct(F.struct(*order).alias("order"), F.struct(*others).alias("row"))).alias("best")
    return rows.groupBy(*keys).agg(least).select(*keys, "best.row.*")


def _plain(column: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(column), F.lit(""))))


def effective_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows (item_id, catalog_number and more) with part, effective_item and item_known: the row's item if the item master has it, else the
    least one with its maker's part, else the row's."""
    by_part = items.groupBy(_plain("manufacturer_part").alias("part")).agg(F.min("item_id").alias("item_of_part")).where(~F.col("part").isin(*BLANK))
    asked = rows.withColumn("part", _plain("catalog_number")).join(items.select("item_id", F.lit(True).alias("in_master")), "item_id", "left").join(by_part, "part", "left")
    effective = F.when(F.col("in_master").isNull() & F.col("item_of_part").isNotNull(), F.col("item_of_part")).otherwise(F.col("item_id"))
    return asked.select(*rows.columns, "part", effective.alias("effective_item"), (F.col("in_master").isNotNull() | F.col("item_of_part").isNotNull()).alias("item_known"))


_FOUND = ["contract_number", "starts", "ends", "price", "each_price", "contract_uom"]


def by_end(x) -> list[Column]:
    """A contract by the latest end, an open one last."""
    return [x["ends"].isNull().alias("open"), (-F.unix_date(x["ends"])).alias("last"), x["contract_number"].alias("contract_number"), x["starts"].alias("starts"), x["price"].isNull().alias("no_price"), *(x[c].alias(c) for c in ("price", "contract_uom", "ends", "each_price"))]


def contract_in_force(rows: DataFrame, contracts: DataFrame, items: DataFrame, aliases: DataFrame, products: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """rows with part, effective_item, item_known, standard_vendor, and tier, contract_number, starts, ends, price, each_price and
    contract_uom of the contract in force on day.

    The effective item is as ``effective_items`` says; the standard vendor is its alias'. Tiers: item, vendor, maker's part and unit (1);
    item, vendor and unit (2); item and vendor (3); vendor and maker's part (4). rows: item_id, vendor, catalog_number, unit, day and more;
    aliases: alias_name, standard_vendor. Where a column ``by`` decides item and part, products (by, item_id, catalog_number and more) has
    these instead of rows, so that rows are shuffled once for all of it.

    A row meets its item's contracts as one array. What items don't decide is looked up by vendor, part and day: of all contracts of a
    vendor and part that have started by a day the one with the latest end is in force, if any is that has an end. So the steps of a
    running minimum over days decide, and no row meets all contracts of its part.
    """
    known = aliases.select(_plain("alias_name").alias("k"), _plain("standard_vendor").alias("by_alias"))
    c = contracts.select("item_id", _plain("vendor").alias("standard_vendor"), _plain("manufacturer_part").alias("part"), "contract_number", "starts", "ends", "price", "each_price", F.col("uom").alias("contract_uom"))
    of_item = c.where("item_id <> ''").groupBy(F.col("item_id").alias("effective_item")).agg(F.collect_set(F.struct("standard_vendor", "part", *_FOUND)).alias("all"))
    asked = effective_items(rows if products is None else products, items).join(of_item, "effective_item", "left")
    asked = asked if products is None else rows.join(asked, by)
    kept = [x for x in asked.columns if x != "all"]
    asked = asked.withColumn("k", _plain("vendor")).join(known, "k", "left").withColumn("standard_vendor", F.coalesce("by_alias", "k"))
    fits = lambda x: (x["standard_vendor"] == F.col("standard_vendor")) & (F.col("standard_vendor") != "") & valid_on(F.col("day"), x["starts"], x["ends"])

    def ranked(x: Column) -> Column:
        same = F.col("unit") == x["contract_uom"]
        return F.struct(F.when(same & (F.col("part") == x["part"]), 1).when(same, 2).otherwise(3).alias("tier"), *by_end(x))

    asked = asked.withColumn("best", F.array_min(F.transform(F.filter("all", fits), ranked)))
    live = F.col("best").isNull() & F.col("day").isNotNull() & (F.col("standard_vendor") != "") & ~F.col("part").isin(*BLANK)
    dealt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("day", "unit", "part"), F.lit(4096)).cast("string"))  # rows that ask for nothing go anywhere
    asked = asked.select(*kept, "standard_vendor", F.when(F.coalesce(live, F.lit(False)), F.col("part")).otherwise(dealt).alias("_part"), "best.tier", *(F.col(f"best.{x}").alias(f"_{x}") for x in _FOUND))
    step = F.get(F.filter("steps", lambda x: x["day"] <= F.col("day")), F.size(F.filter("steps", lambda x: x["day"] <= F.col("day"))) - 1)
    out = asked.join(_steps(c), ["standard_vendor", "_part"], "left").withColumn("step", step)
    closed, opened = F.col("step.closed"), F.col("step.opened")
    out = out.withColumn("by_part", F.when(closed["ends"] >= F.col("day"), closed).when(valid_on(F.col("day"), opened["starts"], opened["ends"]), opened))
    tier = F.when(F.col("by_part").isNotNull(), 4).otherwise(F.col("tier"))
    return out.select(*kept, "standard_vendor", tier.alias("tier"), *(F.when(F.col("by_part").isNotNull(), F.col(f"by_part.{x}")).otherwise(F.col(f"_{x}")).alias(x) for x in _FOUND))


def _steps(contracts: DataFrame) -> DataFrame:
    """(standard_vendor, _part, steps): by vendor and maker's part the days, in order, from which another contract is the one with the latest
    end of those that have started, among those with an end (closed) and without (opened). Written, as few rows remain of many."""
    key = ["standard_vendor", "part"]
    best = lambda open_: F.min(F.when(F.col("ends").isNull() == open_, F.struct(*by_end({x: F.col(x) for x in _FOUND}))))
    days = contracts.where("starts is not null and standard_vendor <> ''").where(~F.col("part").isin(*BLANK)).repartition(*key)
    days = days.groupBy(*key, F.col("starts").alias("day")).agg(best(False).alias("closed"), best(True).alias("opened"))
    order = W.partitionBy(*key).orderBy("day")  # with all of the day
    days = days.withColumns({x: F.min(x).over(order) for x in ("closed", "opened")})
    same = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.lag(x).over(order)) for x in ("closed", "opened")))
    days = days.withColumn("same", same).where("not same")
    return written(days.groupBy("standard_vendor", F.col("part").alias("_part")).agg(F.array_sort(F.collect_list(F.struct("day", "closed", "opened"))).alias("steps")), "steps")


def historical(rows: DataFrame, contracts: DataFrame, key: str, lookback_months: int = 6) -> DataFrame:
    """(key, status, contract_number, price): the contract in force on each row's day.

    Each distinct (vendor, item, day) is decided once. Status: NOT_FOUND, NOT_ACTIVE_IN_LOOKBACK or NOT_ACTIVE, PRICE_MISSING,
    AMBIGUOUS_MULTIPLE_CONTRACTS, AMBIGUOUS_MULTIPLE_PRICES or MATCHED; among active contracts those with the latest start count.
    """
    k = contracts.select("item_id", F.struct("vendor", "contract_number", "uom", "price", "each_price", "starts", "ends").alias("x")).groupBy("item_id").agg(F.collect_set("x").alias("all"))
    day, none = F.col("day"), F.lit(False)
    rows = rows.select(key, "vendor", "item_id", "day").where("vendor is not null and item_id is not null and day is not null")
    rows = join_spread(rows, k, "item_id", "left", key)
    open_or = lambda x, d: x["ends"].isNull() | (x["ends"] >= d)
    live = lambda x: F.coalesce((x["starts"] <= day) & open_or(x, day), none)
    near = lambda x: F.coalesce((x["starts"] <= day) & open_or(x, F.add_months("day", -lookback_months)), none)
    rows = rows.withColumn("own", F.filter("all", lambda x: x["vendor"] == F.col("vendor")))  # null without contracts of the item
    rows = rows.withColumn("live", F.filter("own", live))
    rows = rows.withColumn("tie", F.filter("live", lambda x: (x["starts"] == F.array_max(F.col("live.starts"))) & x["price"].isNotNull()))
    # whether there are several is seen by the least and the greatest
    differ = lambda f: F.array_min(F.transform("tie", f)) != F.array_max(F.transform("tie", f))
    prices, numbers = differ(lambda x: F.coalesce(F.round(x["each_price"], 6), -F.round(x["price"], 6))), differ(lambda x: x["contract_number"])
    empty = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    status = (
        F.when(empty(F.filter("own", lambda x: x["contract_number"].isNotNull())), "NOT_FOUND").when(empty("live") & F.exists("own", near), "NOT_ACTIVE_IN_LOOKBACK").when(empty("live"), "NOT_ACTIVE")
        .when(empty("tie"), "PRICE_MISSING").when(prices & numbers, "AMBIGUOUS_MULTIPLE_CONTRACTS").when(prices, "AMBIGUOUS_MULTIPLE_PRICES").otherwise("MATCHED")
    )
    best = F.array_min(F.transform("tie", lambda x: F.struct((x["uom"] != "EA").alias("x"), x["contract_number"].alias("contract_number"), x["uom"].alias("uom"), x["price"].alias("price"))))
    rows = rows.select(key, status.alias("status"), best.alias("best"))
    hit = F.col("status") == "MATCHED"
    return rows.select(key, "status", F.when(hit, F.col("best.contract_number")).alias("contract_number"), F.when(hit, F.col("best.price")).alias("price"))


def current(keys: DataFrame, contracts: DataFrame, day: str) -> DataFrame:
    """(vendor, item_id, scope, current_contract): valid on day, of the own vendor first, else of any."""
    live = contracts.where(valid_on(F.lit(day).cast("date"), F.col("starts"), F.col("ends")))
    choice = F.max_by("contract_number", F.struct("starts", "contract_number")).alias
    own = live.groupBy("vendor", "item_id").agg(choice("own"))
    anyone = live.groupBy("item_id").agg(choice("anyone"))
    scope = F.when(F.col("own").isNotNull(), "OWN_VENDOR").when(F.col("anyone").isNotNull(), "OTHER_VENDOR").otherwise("NONE")
    return keys.join(own, ["vendor", "item_id"], "left").join(anyone, "item_id", "left").select("vendor", "item_id", scope.alias("scope"), F.coalesce("own", "anyone").alias("current_contract"))


def unspsc(rows: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, state, unspsc): FOUND, AMBIGUOUS, MISSING, or LEADING_ZERO where only the id without leading zeros is known."""
    known = items.groupBy("item_id").agg(F.min("unspsc").alias("unspsc"), F.max("unspsc").alias("most"))
    n = F.when(F.col("unspsc").isNull(), 0).when(F.col("unspsc") == F.col("most"), 1).otherwise(2)
    alike = known.groupBy(F.ltrim("item_id", F.lit("0")).alias("bare")).agg(F.collect_list(F.struct("item_id", n.alias("n"), "unspsc")).alias("alike"))
    # a row meets all ids that differ from its own by leading zeros at once
    out = join_spread(rows.withColumn("bare", F.ltrim("item_id", F.lit("0"))), alike, "bare", "left", key)
    own = F.get(F.filter("alike", lambda x: x["item_id"] == F.col("item_id")), F.lit(0))
    out = out.select(key, own["n"].alias("n"), own["unspsc"].alias("unspsc"), F.col("alike").isNotNull().alias("bare_known"))
    state = F.when(F.col("n") == 1, "FOUND").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("n").isNull() & F.col("bare_known"), "LEADING_ZERO").otherwise("MISSING")
    return out.select(key, state.alias("state"), F.when(F.col("n") == 1, F.col("unspsc")).alias("unspsc"))


def vendor_names(aliases: DataFrame, standards: DataFrame) -> DataFrame:
    """(alias, standard, method): equal, then equal without legal form, else none; fuzzy_vendors handles the rest."""
    a = aliases.select("alias", F.regexp_replace(F.upper(F.trim("alias")), r"\s+", " ").alias("k"))
    s = standards.select(F.col("standard").alias("exact"), F.upper("standard").alias("k"))
    core = standards.groupBy(strip_suffix(F.col("standard")).alias("core")).agg(F.min("standard").alias("by_core"))
    out = a.join(s, "k", "left").withColumn("core", strip_suffix(F.col("k"))).join(core, "core", "left")
    method = F.when(F.col("exact").isNotNull(), "EXACT").when(F.col("by_core").isNotNull(), "CORE").otherwise("NONE")
    return out.select("alias", F.coalesce("exact", "by_core").alias("standard"), method.alias("method"))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def _grams(name: str) -> F.Column:
    """Distinct pairs of neighbouring letters; of names of up to 3 letters, which can be alike without a pair, the letters as well."""
    c = F.col(name)
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, i, F.lit(n)))
    pairs = F.filter(cut(2), lambda x: F.length(x) == 2)
    return F.array_distinct(F.when(F.length(c) <= 3, F.concat(pairs, cut(1))).otherwise(pairs))


def fuzzy_pairs(names: DataFrame, standards: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, ratio) of all distinct upper-case names (in the only column) and standards whose ratio by difflib is at least ``least``
    (0.8 or more).

    Candidates lose no match: with a ratio of 0.8 or more of T letters at least 0.4 T are matched on either side, in at most
    0.2 T + 1 runs, so for T over 5 some run has two letters, and the shorter name has two thirds of the longer one's. So they share a
    pair of letters; of a name's pairs, as many as may all be missing and one more must be looked up, and the rarest among the
    standards are. A candidate must have the letters in common that the ratio needs.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("least must be 0.8 or more")
    n = names.select(F.upper(names.columns[0]).alias("a")).where("a <> ''").distinct()
    s = standards.select(F.upper(standards.columns[0]).alias("b")).where("b <> ''").distinct()
    by_gram = s.select("b", F.explode(_grams("b")).alias("gram"))
    often = by_gram.groupBy("gram").agg(F.count("*").alias("often"))
    looked = n.select("a", F.explode(_grams("a")).alias("gram")).join(often, "gram")
    # at least M - runs = 0.2 T - 1 of the name's pairs are shared, T being at least 5 / 3 of its length
    rank = F.row_number().over(W.partitionBy("a").orderBy("often", "gram"))
    missing = F.when(F.length("a") <= 3, F.lit(9)).otherwise(F.floor(F.length("a") * 2 / 3) + 1)
    looked = looked.withColumn("rank", rank).where(F.col("rank") <= missing)
    pairs = looked.join(by_gram, "gram").select("a", "b").distinct()
    la, lb = F.length("a"), F.length("b")
    pairs = pairs.where(2 * F.least(la, lb) >= least * (la + lb) - 1e-9)
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    common = la - F.length(F.array_join(F.array_except(letters("a"), letters("b")), ""))  # at most: repeated letters count as common
    pairs = pairs.where(2 * common >= least * (la + lb) - 1e-9)
    return pairs.withColumn("ratio", _ratio("a", "b")).where(F.col("ratio") >= least)


def fuzzy_vendors(names: DataFrame, standards: DataFrame, least: float = 0.8, block: int = 4096) -> DataFrame:
    """(name, standard, ratio): the most alike standard name by difflib's ratio, of at least ``least`` (0.8 or more).

    Where nearly all names are alike, as numbered ones, no index leaves few candidates. So blocks of names meet blocks of standards, and
    the longest common subsequence, found for all standards of a block at once, bounds the ratio from above; difflib takes standards in
    the order of that bound and stops where it is below the best ratio. A task holds ``block`` names and as many standards.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("least must be 0.8 or more")
    n = names.select(F.upper("name").alias("a")).where("a <> ''").distinct()
    s = standards.groupBy(F.upper("standard").alias("b")).agg(F.min("standard").alias("standard")).where("b <> ''")
    parts = lambda df: -(-df.count() // block) or 1
    of_n, of_s = parts(n), parts(s)
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    n = n.select("a", place("a", of_n).alias("x"), every(of_s).alias("y"))
    s = s.select("b", "standard", every(of_n).alias("x"), place("b", of_s).alias("y"))
    near = n.groupBy("x", "y").cogroup(s.groupBy("x", "y")).applyInPandas(_most_alike(least), "a string, standard string, ratio double")
    best = near.groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "standard")).alias("best"))
    return names.select("name").distinct().withColumn("a", F.upper("name")).join(best, "a").select("name", "best.standard", (-F.col("best.less")).alias("ratio"))


def _common(a: str, place: dict[int, int], letters: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of a and each column of letters, by bits (Hyyro); for an a of over 64 letters the
    sum over its pieces, which is at least that."""
    total = np.zeros(letters.shape[1], dtype=np.int64)
    for start in range(0, len(a), 64):
        piece = a[start : start + 64]
        table = np.zeros(len(place) + 1, dtype=np.uint64)  # place 0 is the filling behind short texts
        for i, c in enumerate(piece):
            table[place.get(ord(c), 0)] |= np.uint64(1 << i)
        table[0] = 0
        v = np.full(letters.shape[1], 2**64 - 1, dtype=np.uint64)
        for row in letters:
            m = table[row]
            v = (v + (v & m)) | (v & ~m)
        total += np.bitwise_count(~v & np.uint64((1 << len(piece)) - 1))
    return total


def _most_alike(least: float):
    def run(names: pd.DataFrame, standards: pd.DataFrame) -> pd.DataFrame:
        """(a, standard, ratio) of the names of a block that have a standard in the other block."""
        standards = standards.sort_values("standard")
        texts, out = list(standards["b"]), []
        place = {c: i for i, c in enumerate(sorted({ord(c) for b in texts for c in b}), 1)}
        sizes = np.array([len(b) for b in texts], dtype=np.int64)
        letters = np.zeros((int(sizes.max(initial=0)), len(texts)), dtype=np.int32)
        for i, b in enumerate(texts):
            letters[: len(b), i] = [place[ord(c)] for c in b]
        for a in names["a"] if texts else ():
            most = 2.0 * _common(a, place, letters) / (len(a) + sizes)
            able = np.flatnonzero(most >= least)
            best, at = 0.0, -1
            for i in able[np.argsort(-most[able], kind="stable")]:
                if most[i] < best:
                    break
                if most[i] == best and i > at:
                    continue
                ratio = SequenceMatcher(None, a, texts[i], autojunk=False).ratio()
                if ratio >= least and (ratio > best or (ratio == best and i < at)):
                    best, at = ratio, i
            if at >= 0:
                out.append((a, standards["standard"].iloc[at], best))
        return pd.DataFrame(out, columns=["a", "standard", "ratio"])

    return run


def similar_sets(sets: DataFrame, key: str, group: str, tokens: str, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """((key, other), candidates) of rows of one group whose sets of tokens have a Jaccard similarity of at least ``least``, key < other.

    By prefixes: sets that are so alike share one of their rarest tokens, of n tokens the first n - ceil(least * n) + 1. Only rows with
    such a token in common, and sizes that allow it, are compared; candidates are those pairs.
    """
    rows = sets.select(F.col(key).alias("key"), F.col(group).alias("grp"), F.array_distinct(tokens).alias("set")).where("grp is not null and size(set) > 0")
    each = rows.select("key", "grp", F.size("set").alias("n"), F.explode("set").alias("token"))
    often = each.groupBy("grp", "token").agg(F.count("*").alias("often"))
    ranked = each.join(often, ["grp", "token"]).withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("often", "token")))
    heads = written(ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("key", "grp", "n", "token"), "heads")
    other = heads.select(F.col("key").alias("other"), "grp", F.col("n").alias("m"), "token")
    fits = (F.col("key") < F.col("other")) & (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9)
    candidates = heads.join(other, ["grp", "token"]).where(fits).select("key", "other").distinct()
    found = candidates.join(rows.select("key", F.col("set").alias("a")), "key").join(rows.select(F.col("key").alias("other"), F.col("set").alias("b")), "other")
    both = F.size(F.array_intersect("a", "b"))
    return found.where(both / (F.size("a") + F.size("b") - both) >= least).select("key", "other"), candidates
