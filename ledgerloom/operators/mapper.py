"""The contract mapper end to end: keys, item master, historical contract, price comparison and reasons for every usage row, and its
maintenance over deliveries.

A run commits the mapped rows together with the contracts, items and aliases they were mapped with. The next run compares these with
the new ones: which rows are new or changed (by a hash of their fields), which have another standard vendor now, which days of which
(vendor, item) a changed contract can reach, which items changed. Only those rows are mapped anew, each where it meets its item.
Where settings changed, or there is no earlier run, all rows are mapped.

Rows are shuffled once, as fed, to the items that differ from theirs by leading zeros, and what was mapped before goes the same way; what
can be derived is derived there. So a changed row whose item is another one doesn't meet its old self, which only matters for counting.

Feeds: usage (row_id, item_id, vendor, day, supply_price, client_price), contracts (contract_number, vendor, item_id, uom, price,
each_price, starts, ends), items (item_id, unspsc), aliases (name, standard). row_id is unique.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import item_key, vendor_key
from ..sources.shared import written
from ..sources.sinks import Versions
from .manifest import fingerprint

FAR_PAST, FAR_FUTURE = "1900-01-01", "2999-12-31"
CONTRACT = "status reason candidates active tied prices contract_number starts ends price each_price uom closest_number closest_ends gap_code gap_detail".split()
ITEM = "unspsc item_status item_gap_code item_gap_detail".split()
RECORD = "vendor ends starts contract_number price each_price uom".split()
#: Rows with a blank item are dealt out over so many keys.
DEAL = 64


@dataclass(frozen=True)
class Settings:
    lookback_months: int = 6
    threshold: float = 0.2
    by_each_price: bool = True
    logic: int = 1


def _date(text: str) -> Column:
    return F.lit(text).cast("date")


def _standard(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """df with vendor normalized (as ``spelling``) and replaced by its alias' standard name."""
    known = aliases.select(F.col("name").alias("spelling"), "standard")
    return df.withColumn("spelling", vendor_key(F.col("vendor"))).join(known, "spelling", "left").withColumn("vendor", F.coalesce("standard", "spelling")).drop("standard")


def base_rows(usage: DataFrame, aliases: DataFrame) -> DataFrame:
    """(row_id, fed_item, fed_vendor, day, supply_price, client_price, vendor): the feed and the standard name of the vendor."""
    rows = usage.select("row_id", F.col("item_id").alias("fed_item"), "vendor", F.col("vendor").alias("fed_vendor"), "day", "supply_price", "client_price")
    return _standard(rows, aliases).drop("spelling")


def derived(rows: DataFrame) -> DataFrame:
    """base_rows with row_hash (of all fields as fed), spelling, item_id and eligibility."""
    fields = ["fed_item", "fed_vendor", "day", "supply_price", "client_price"]
    digest = F.unhex(F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in fields))))
    rows = rows.withColumns({"row_hash": digest, "spelling": vendor_key(F.col("fed_vendor")), "item_id": item_key(F.col("fed_item"))})
    missing = (F.col("item_id") == "") | (F.col("vendor") == "")
    return rows.withColumn("eligibility", F.when(missing, "MISSING_MAPPING_KEY").when(F.col("day").isNull(), "INVALID_CONSUMPTION_DATE").otherwise("ELIGIBLE"))


def dealt(item_id: Column) -> list[Column]:
    """(bare, deal): what a row is shuffled by, the item without leading zeros; a blank one is dealt out by the row."""
    bare = F.ltrim(item_id, F.lit("0"))
    return [bare.alias("bare"), F.when(bare == "", F.pmod(F.xxhash64("row_id"), F.lit(DEAL)).cast("int")).otherwise(0).alias("deal")]


def usable_contracts(contracts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct contract records with vendor and item, the vendor by its standard name."""
    rows = _standard(contracts.withColumn("item_id", item_key(F.col("item_id"))).withColumn("uom", F.upper(F.trim(F.coalesce("uom", F.lit(""))))), aliases)
    return rows.where("vendor <> '' and item_id <> ''").select("contract_number", "vendor", "item_id", "uom", "price", "each_price", "starts", "ends").distinct()


def item_classes(items: DataFrame) -> DataFrame:
    """(item_id, codes): the distinct classes of each item, in order."""
    code = F.nullif(F.trim("unspsc"), F.lit(""))
    return items.select(item_key(F.col("item_id")).alias("item_id"), code.alias("code")).where("item_id <> ''").groupBy("item_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def item_facts(contracts: DataFrame, classes: DataFrame, windows: DataFrame | None = None, classes_before: DataFrame | None = None) -> DataFrame:
    """(bare, deal, contracts, classes and, if given, windows, classes_before): what rows need of their item, as arrays of the records of all
    items that differ by leading zeros, by one shuffle; those of blank items for each key that blank rows are dealt to."""
    feeds = {"contracts": contracts.select("item_id", F.struct("item_id", *RECORD).alias("contracts")), "classes": classes.select("item_id", F.struct("item_id", "codes").alias("classes"))}
    if windows is not None:
        feeds["windows"] = windows.select("item_id", F.struct("item_id", "vendor", "since", "until").alias("windows"))
        feeds["classes_before"] = classes_before.select("item_id", F.struct("item_id", "codes").alias("classes_before"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds.values()).withColumn("bare", F.ltrim("item_id", F.lit("0")))
    every = F.explode(F.when(F.col("bare") == "", F.sequence(F.lit(0), F.lit(DEAL - 1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("deal", every).groupBy("bare", "deal").agg(*(F.collect_list(n).alias(n) for n in feeds))


def with_item(rows: DataFrame) -> DataFrame:
    """rows with what concerns their own item: of_item as ``contracts_by_item`` has it, the ITEM columns as ``classed``."""
    own = lambda c: F.filter(c, lambda x: x["item_id"] == F.col("item_id"))
    rows = rows.withColumns({"of_item": own("contracts"), "codes": F.get(own("classes"), F.lit(0))["codes"]})
    bare_known = F.coalesce(F.exists("classes", lambda x: x["item_id"] == F.col("bare")), F.lit(False))
    n, absent = F.size("codes"), F.col("codes").isNull()
    status = F.when(F.col("item_id") == "", "MISSING_ITEM_ID").when(absent, "NOT_FOUND").when(n == 0, "UNSPSC_MISSING").when(n > 1, "AMBIGUOUS_UNSPSC").otherwise("MATCHED")
    gap = (
        F.when(F.col("item_id") == "", "MISSING_ITEM_ID").when(absent & bare_known & (F.col("bare") != F.col("item_id")), "ITEM_NOT_IN_ITEM_MASTER_LEADING_ZEROS")
        .when(absent & ~F.col("item_id").rlike(r"^\d+$"), "ITEM_NOT_IN_ITEM_MASTER_NONNUMERIC_ID").when(absent, "ITEM_NOT_IN_ITEM_MASTER")
        .when(n == 0, "UNSPSC_MISSING_IN_ITEM_MASTER").when(n > 1, "AMBIGUOUS_UNSPSC")
    )
    q = F.concat(F.lit("Item ID '"), F.col("item_id"), F.lit("'"))
    text = {
        "MISSING_ITEM_ID": F.lit("Consumption Item ID is blank"), "ITEM_NOT_IN_ITEM_MASTER_LEADING_ZEROS": F.concat(q, F.lit(" is only known without leading zeros")),
        "ITEM_NOT_IN_ITEM_MASTER_NONNUMERIC_ID": F.concat(q, F.lit(" is no number and unknown")), "ITEM_NOT_IN_ITEM_MASTER": F.concat(q, F.lit(" is unknown")),
        "UNSPSC_MISSING_IN_ITEM_MASTER": F.concat(q, F.lit(" has no UNSPSC")), "AMBIGUOUS_UNSPSC": F.concat(q, F.lit(" has several UNSPSC: "), F.array_join("codes", "|")),
    }
    rows = rows.withColumn("item_gap_code", gap)
    detail = F.coalesce(*(F.when(F.col("item_gap_code") == k, v) for k, v in text.items()))
    return rows.withColumn("classed", F.struct(F.when(n == 1, F.col("codes")[0]).alias("unspsc"), status.alias("item_status"), F.col("item_gap_code"), detail.alias("item_gap_detail"))).drop("codes", "item_gap_code")


def contracts_by_item(contracts: DataFrame) -> DataFrame:
    """(item_id, of_item): an item's distinct contract records as one array."""
    return contracts.groupBy("item_id").agg(F.collect_set(F.struct(*RECORD)).alias("of_item"))


def decide_contracts(wanted: DataFrame, contracts: DataFrame, settings: Settings) -> DataFrame:
    """(vendor, item_id, day, CONTRACT columns) of distinct (vendor, item_id, day), none of them null or blank."""
    rows = wanted.select("vendor", "item_id", "day").join(contracts_by_item(contracts), "item_id", "left")
    rows = rows.join(contracts.select("vendor").distinct().withColumn("v_known", F.lit(True)), "vendor", "left")
    return with_decisions(rows, settings).select("vendor", "item_id", "day", "decided.*")


def with_decisions(wanted: DataFrame, settings: Settings) -> DataFrame:
    """wanted with the CONTRACT columns as ``decided``; it has vendor, item_id, day, of_item (the contract records of its item as an
    array, null or empty if there are none), and v_known where contracts know the vendor. Each row decides by itself, so rows aren't joined
    with single contracts.

    Of the contracts active on the day those with the latest start count; they match if they agree on one price. Otherwise a code and
    a text say why not: which key contracts lack, or how far the nearest contract is.
    """
    day, since = F.col("day"), F.add_months("day", -settings.lookback_months)
    until = lambda x, d: x["ends"].isNull() | (x["ends"] >= d)

    def seen(x: Column) -> Column:
        started = F.coalesce(x["starts"] <= day, F.lit(False))
        return F.struct(*(x[c].alias(c) for c in ("ends", "starts", "contract_number", "price", "each_price", "uom")), (started & until(x, since)).alias("near"), (started & until(x, day)).alias("live"))

    mine = F.transform(F.filter(F.coalesce("of_item", F.array().cast(wanted.schema["of_item"].dataType)), lambda x: x["vendor"] == F.col("vendor")), seen)
    grouped = wanted.withColumn("all", mine)  # the contracts of one vendor and item
    held = lambda flag: F.size(F.filter("all", lambda x: x[flag]))
    grouped = grouped.withColumns({"n": F.size("all"), "candidates": held("near"), "active": held("live"), "latest": F.array_max(F.transform(F.filter("all", lambda x: x["live"]), lambda x: x["starts"]))})
    tie = F.filter("all", lambda x: x["live"] & (x["starts"] == F.col("latest")))
    grouped = grouped.withColumn("tie", tie).withColumn("priced", F.filter("tie", lambda x: x["price"].isNotNull()))
    by = (lambda x: F.coalesce(F.round(x["each_price"], 6), -F.round(x["price"], 6)).cast("string")) if settings.by_each_price else (lambda x: F.concat_ws("|", F.round(x["price"], 6).cast("string"), x["uom"]))
    distinct = lambda f: F.size(F.array_distinct(F.transform("priced", f)))
    prices, numbers = distinct(by), distinct(lambda x: x["contract_number"])
    packs = distinct(lambda x: F.struct(F.round(x["price"], 6), F.coalesce(F.round(x["each_price"], 6), F.lit(-1.0)), x["uom"]))
    grouped = grouped.withColumns({"tied": F.size("tie"), "prices": prices, "numbers": numbers, "packs": packs})
    status = (
        F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("active") == 0, "NOT_ACTIVE").when(F.col("prices") == 0, "PRICE_MISSING").when((F.col("prices") > 1) & (F.col("numbers") > 1), "AMBIGUOUS_MULTIPLE_CONTRACTS")
        .when(F.col("prices") > 1, "AMBIGUOUS_MULTIPLE_PRICES").otherwise("MATCHED")
    )
    first = F.array_min(F.transform("priced", lambda x: F.struct((x["uom"] != "EA").alias("a"), x["contract_number"].alias("b"), x["uom"].alias("c"), x["price"].alias("d"), x.alias("x"))))["x"]
    far = _date(FAR_FUTURE)
    before = lambda x: (F.datediff(_date(FAR_PAST), F.coalesce(x["ends"], far)), F.datediff(_date(FAR_PAST), x["starts"]))  # noqa: E731  later ends and starts come first
    closest = F.array_min(F.transform(F.filter("all", lambda x: x["near"]), lambda x: F.struct(x["ends"].isNull().alias("o"), before(x)[0].alias("a"), before(x)[1].alias("b"), x["contract_number"].alias("c"), x.alias("x"))))["x"]

    def gap(x: Column) -> Column:
        """Days from a contract that has ended, or to one that hasn't started."""
        return F.when(x["starts"] > day, F.datediff(x["starts"], day)).when((x["starts"] <= day) & (x["ends"] < day), F.datediff(day, x["ends"]))

    nearest = F.array_min(F.transform("all", lambda x: F.struct(gap(x).isNull().alias("o"), gap(x).alias("days"), x["contract_number"].alias("c"), x["starts"].alias("s"), x["ends"].alias("e"))))
    found = grouped.withColumns({"status": status, "first": first, "closest": closest, "nearest": nearest})
    is_ = lambda s: F.col("status") == s
    late = F.col("nearest.e") < day
    v, i = F.col("v_known").isNotNull(), F.coalesce(F.size("of_item") > 0, F.lit(False))
    code = (
        F.when(is_("NOT_FOUND"), F.when(~v & ~i, "VENDOR_AND_ITEM_NOT_IN_CONTRACTS").when(~v, "VENDOR_NOT_IN_CONTRACTS").when(~i, "ITEM_NOT_IN_CONTRACTS").otherwise("VENDOR_ITEM_PAIR_NOT_IN_CONTRACTS"))
        .when(is_("NOT_ACTIVE"), F.when(F.col("nearest.s").isNull(), "NOT_ACTIVE_INVALID_START_DATE").when(F.col("nearest.s") > day, "NOT_ACTIVE_NOT_YET_STARTED")
              .when(late & (F.col("nearest.e") < since), "NOT_ACTIVE_EXPIRED_BEFORE_LOOKBACK").when(late, "NOT_ACTIVE_EXPIRED_WITHIN_LOOKBACK").otherwise("NOT_ACTIVE_NO_END_DATE"))
        .when(is_("PRICE_MISSING"), "CONTRACT_PRICE_MISSING").when(~is_("MATCHED"), F.col("status"))
    )
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    under = F.array_sort(F.array_distinct(F.col("of_item.vendor")))
    vendors = text(F.array_join(F.slice(under, 1, 3), "; "), F.when(F.size(under) > 3, " ...").otherwise(""))
    near = text("none active on ", day, ": nearest is ", F.col("nearest.c"), " (", F.coalesce(F.col("nearest.s").cast("string"), F.lit("invalid")), " to ", F.coalesce(F.col("nearest.e").cast("string"), F.lit("OPEN")), ")")
    listed = F.array_join(F.array_sort(F.transform("priced", lambda x: text(x["contract_number"], "|price=", x["price"], "|each=", F.coalesce(x["each_price"].cast("string"), F.lit("")), "|uom=", x["uom"]))), "; ")
    detail = (
        F.when(is_("NOT_FOUND"), F.when(i, text("Item ID '", F.col("item_id"), "' is contracted under: ", vendors)).otherwise(text("Item ID '", F.col("item_id"), "' has no contract")))
        .when(is_("NOT_ACTIVE"), text(near, F.coalesce(text(", ", F.col("nearest.days"), " days away"), F.lit("")), " [", F.col("n"), " on file]"))
        .when(is_("PRICE_MISSING"), "Active contract found but it has no price").when(~is_("MATCHED"), text(F.col("tied"), " contracts share the latest start ", F.col("latest"), ": ", listed))
    )
    hit = is_("MATCHED")
    reason = (
        F.when(is_("NOT_FOUND"), "NO_CONTRACT_FOR_VENDOR_AND_ITEM").when(is_("NOT_ACTIVE") & (F.col("candidates") > 0), "CONTRACT_IN_LOOKBACK_BUT_NOT_ACTIVE_ON_CONSUMPTION_DATE")
        .when(is_("NOT_ACTIVE"), "VENDOR_ITEM_IN_CONTRACTS_BUT_NONE_IN_LOOKBACK_WINDOW_OR_START_DATE_INVALID").when(is_("PRICE_MISSING"), "ACTIVE_CONTRACT_HAS_NO_PRICE")
        .when(is_("AMBIGUOUS_MULTIPLE_CONTRACTS"), "TIE_ON_LATEST_START_DATE_ACROSS_MULTIPLE_CONTRACTS_WITH_DIFFERENT_PRICES")
        .when(is_("AMBIGUOUS_MULTIPLE_PRICES"), "MULTIPLE_DIFFERENT_PRICES_ON_LATEST_ACTIVE_CONTRACT").when(F.col("packs") > 1, "SAME_EACH_PRICE_ACROSS_TIED_RECORDS_PACK_UOM_DIFFERS")
        .when(F.col("active") == 1, "SINGLE_ACTIVE_CONTRACT").when(F.col("tied") == 1, "LATEST_START_DATE_AMONG_ACTIVE_CONTRACTS")
        .otherwise("TIE_ON_LATEST_START_DATE_SAME_PRICE_LOWEST_CONTRACT_NUMBER_REPORTED")
    )
    of_first = [F.when(hit, F.col(f"first.{c}")).alias(c) for c in ("contract_number", "starts", "ends", "price", "each_price", "uom")]
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in ("candidates", "active", "tied", "prices")]
    near_ones = [F.when(is_("NOT_ACTIVE"), F.col(f"closest.{c}")).alias(f"closest_{a}") for c, a in (("contract_number", "number"), ("ends", "ends"))]
    return found.select(*(c for c in wanted.columns if c not in ("of_item", "v_known")), F.struct("status", reason.alias("reason"), *counts, *of_first, *near_ones, code.alias("gap_code"), detail.alias("gap_detail")).alias("decided"))


def ineligible(column: str) -> Column:
    """The contract columns of rows without key or day."""
    no_item, no_vendor = F.col("item_id") == "", F.col("vendor") == ""
    code = F.when(no_item & no_vendor, "MISSING_ITEM_AND_VENDOR").when(no_item, "MISSING_ITEM_ID").when(no_vendor, "MISSING_VENDOR").otherwise("INVALID_CONSUMPTION_DATE")
    known = {"status": F.col("eligibility"), "reason": F.lit("ROW_NOT_ELIGIBLE_FOR_CONTRACT_MAPPING"), "gap_code": code, "gap_detail": F.lit("key or day is blank")}
    return known.get(column, F.lit(None))


def with_prices(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows with the mapped price, both comparisons with it, and the reasons why they aren't fully mapped."""
    mapped = F.when(F.col("status") == "MATCHED", F.col("each_price" if settings.by_each_price else "price"))
    out = rows.withColumn("mapped_price", mapped)
    for label in ("client", "supply"):
        usable = F.coalesce(F.col("mapped_price").isNotNull() & (F.col("mapped_price") != 0) & F.col(f"{label}_price").isNotNull(), F.lit(False))
        diff = F.when(usable, F.col(f"{label}_price") - F.col("mapped_price"))
        share = diff / F.abs("mapped_price")
        flag = F.when(~usable, "NOT_COMPARABLE").when(F.abs(share) > settings.threshold, f"ABOVE_{round(settings.threshold * 100)}_PERCENT").otherwise("WITHIN_THRESHOLD")
        out = out.withColumns({f"{label}_diff": diff, f"{label}_share": share, f"{label}_flag": flag})
    join = lambda sep, a, b: F.nullif(F.concat_ws(sep, a, b), F.lit(""))
    codes = join("; ", F.concat(F.lit("CONTRACT:"), F.col("gap_code")), F.concat(F.lit("ITEM_MASTER:"), F.col("item_gap_code")))
    texts = join(" || ", F.concat(F.lit("CONTRACT: "), F.col("gap_detail")), F.concat(F.lit("ITEM MASTER: "), F.col("item_gap_detail")))
    return out.withColumns({"unmapped_code": codes, "unmapped_reason": texts})


def contract_windows(before: DataFrame, after: DataFrame, lookback_months: int) -> DataFrame:
    """(vendor, item_id, since, until) of changed contracts; a key that comes or goes has all days. One shuffle, by item."""
    there = lambda df, b, a: df.select(*after.columns, F.lit(b).alias("b"), F.lit(a).alias("a"))
    both = there(before, 1, 0).unionByName(there(after, 0, 1)).repartition("item_id")
    records = both.groupBy(*after.columns).agg(F.max("b").alias("b"), F.max("a").alias("a"))  # null equals null
    end = F.coalesce(F.date_add(F.add_months("ends", lookback_months), 3), _date(FAR_FUTURE))  # months differ by up to 3 days: 31 August less 6 months is 28 February
    differ = F.col("b") != F.col("a")  # of a record, then of a key
    w = records.groupBy("vendor", "item_id").agg(
        F.max("b").alias("b"), F.max("a").alias("a"), F.min(F.when(differ, F.coalesce("starts", _date(FAR_PAST)))).alias("since"), F.max(F.when(differ, end)).alias("until")
    ).where("since is not null")
    return w.select("vendor", "item_id", F.when(differ, _date(FAR_PAST)).otherwise(F.col("since")).alias("since"), F.when(differ, _date(FAR_FUTURE)).otherwise(F.col("until")).alias("until"))


_OWN = ["row_id", "row_hash", "spelling", "vendor", "item_id", "day", "supply_price", "client_price", "eligibility"]


def _assembled(rows: DataFrame, s: Settings, full: bool) -> DataFrame:
    """rows mapped: those with by_contract or by_item anew, of the others what they had (old)."""
    out = with_decisions(rows, s)
    kept = lambda c: F.lit(None) if full else F.col(f"old.{c}")
    contract = {c: F.when(~F.col("by_contract"), kept(c)).when(F.col("eligibility") != "ELIGIBLE", ineligible(c)).otherwise(F.col(f"decided.{c}")) for c in CONTRACT}
    item = {c: F.when(F.col("by_item"), F.col(f"classed.{c}")).otherwise(kept(c)) for c in ITEM}
    return with_prices(out.select(*_OWN, *_FLAGS, *(v.alias(k) for k, v in {**contract, **item}.items())), s)


_FLAGS = ["fresh", "by_contract", "by_item", "state"]


def _all_fresh(usage: DataFrame, contracts: DataFrame, classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """All rows with what they need to be mapped anew."""
    known = contracts.select("vendor").distinct().withColumn("v_known", F.lit(True))
    base = base_rows(usage, aliases).join(written(known, "vendors"), "vendor", "left")
    rows = base.select("*", *dealt(item_key(F.col("fed_item")))).join(item_facts(contracts, classes), ["bare", "deal"], "left")
    return with_item(derived(rows)).withColumns({x: F.lit(True) for x in ("fresh", "by_contract", "by_item")}).withColumn("state", F.lit("NEW"))


def map_all(usage: DataFrame, contracts: DataFrame, items: DataFrame, aliases: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All rows mapped at once, without a state."""
    contracts = written(usable_contracts(contracts, aliases), "contracts")
    return _assembled(_all_fresh(usage, contracts, item_classes(items), aliases), settings, full=True).drop(*_FLAGS)


def summary(mapped: DataFrame, key: Column) -> DataFrame:
    """The 16 measures of mapped rows by a key: rows by state, match rate of eligible rows, prices above the threshold."""
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    states = {"contract_not_found": "NOT_FOUND", "contract_not_active": "NOT_ACTIVE", "ambiguous_contracts": "AMBIGUOUS_MULTIPLE_CONTRACTS", "ambiguous_prices": "AMBIGUOUS_MULTIPLE_PRICES",
              "active_contract_without_price": "PRICE_MISSING", "missing_mapping_key": "MISSING_MAPPING_KEY", "invalid_consumption_date": "INVALID_CONSUMPTION_DATE"}
    g = mapped.groupBy(key.alias("key")).agg(
        F.count("*").alias("consumption_rows"), n("eligibility = 'ELIGIBLE'", "eligible_rows"), n("status = 'MATCHED'", "matched_rows"), *(n(f"status = '{v}'", k) for k, v in states.items()),
        n("client_flag like 'ABOVE%'", "client_price_above_threshold_rows"), n("supply_flag like 'ABOVE%'", "supply_price_above_threshold_rows"), n("item_status <> 'MATCHED'", "item_master_unmatched"),
    )
    rate = F.when(F.col("eligible_rows") > 0, F.floor(F.col("matched_rows") * 1000000 / F.col("eligible_rows") + 0.501) / 10000.0)
    return g.withColumns({"match_rate_pct": rate, "unmatched_eligible": F.col("eligible_rows") - F.col("matched_rows"), "ambiguous_total": F.col("ambiguous_contracts") + F.col("ambiguous_prices")})


def kpis(mapped: DataFrame, usage: DataFrame) -> DataFrame:
    """(metric, value) of mapped rows. What must agree is summed apart: states against the rows of the feed itself, unmatched rows against
    the states that leave an eligible row without contract; a difference is an error."""
    s = summary(mapped, F.lit(1)).drop("key", "match_rate_pct").first()
    s = s.asDict() if s else {}
    if s.get("consumption_rows", 0) != usage.count():
        raise AssertionError("mapped rows differ from the feed's")
    why = [s.get(k, 0) for k in ("contract_not_found", "contract_not_active", "ambiguous_total", "active_contract_without_price")]
    if s.get("unmatched_eligible", 0) != sum(why):
        raise AssertionError("unmatched rows differ from the sum of their states")
    return mapped.sparkSession.createDataFrame(sorted(s.items()), "metric string, value long")


class Mapper:
    """A mapped table that is maintained over deliveries, with its state, as versions under a path."""

    def __init__(self, store: Versions, settings: Settings = Settings()):
        self.store, self.settings = store, settings

    def run(self, usage: DataFrame, contracts: DataFrame, items: DataFrame, aliases: DataFrame) -> dict[str, int]:
        """Map a delivery of all feeds and commit the result. Returns how many rows were new, changed, deleted, mapped anew or reused."""
        s = self.settings
        contracts, classes = written(usable_contracts(contracts, aliases), "contracts"), written(item_classes(items), "classes")
        full = self.store.notes().get("fingerprint") != fingerprint(asdict(s))
        rows = _all_fresh(usage, contracts, classes, aliases) if full else self._affected(base_rows(usage, aliases), contracts, classes)
        n = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
        seen, before = Observation(), None if full else self.store.read("mapped")
        out = _assembled(rows, s, full).observe(
            seen, F.count("*").alias("rows"), n("state = 'NEW'", "new"), n("state = 'CHANGED'", "changed"), n("by_contract and not fresh", "remapped_contract"),
            n("by_item and not fresh", "remapped_item"), n("not by_contract and not by_item", "reused"), n("state = 'SAME'", "same"),
        ).drop(*_FLAGS)

        def notes(read) -> dict:
            """As counted while the rows were written."""
            counts = {k: int(seen.get.get(k, 0)) for k in ("rows", "new", "changed", "remapped_contract", "remapped_item", "reused", "same")}
            total, there = counts.pop("rows"), 0 if full else before.count()
            both = counts["changed"] + counts["same"]
            if both < min(total, there):  # changed rows with another item haven't met
                both = read("mapped").select("row_id").join(before.select("row_id"), "row_id", "left_semi").count()
            return {"fingerprint": fingerprint(asdict(s)), "counts": counts | {"new": total - both, "changed": both - counts["same"], "deleted": there - both}}

        self.store.commit({"mapped": out, "contracts": contracts, "classes": classes}, notes=notes)
        return self.store.notes()["counts"]

    def _affected(self, base: DataFrame, contracts: DataFrame, classes: DataFrame) -> DataFrame:
        """base with state, what was mapped before (old), whether its contract and its item must be mapped anew, and what that needs."""
        yes = F.lit(True)
        windows = written(contract_windows(self.store.read("contracts"), contracts, self.settings.lookback_months), "windows")
        vendors = contracts.select("vendor", yes.alias("v_known")).unionByName(windows.select("vendor", yes.alias("v")), allowMissingColumns=True).groupBy("vendor").agg(F.max("v_known").alias("v_known"), F.max("v").alias("v"))
        base = base.join(written(vendors, "vendors"), "vendor", "left")
        fed = [c for c in base.columns if c != "row_id"]
        base = base.select("row_id", *dealt(item_key(F.col("fed_item"))), F.struct(*fed).alias("now"))
        old = self.store.read("mapped").select("row_id", *dealt(F.col("item_id")), F.struct("row_hash", "vendor", *CONTRACT, *ITEM).alias("old"))
        both = base.unionByName(old, allowMissingColumns=True).repartition("bare", "deal")
        both = both.withColumn("old", F.first("old", ignorenulls=True).over(W.partitionBy("bare", "deal", "row_id"))).where("now is not null")
        facts = item_facts(contracts, classes, windows, self.store.read("classes"))
        rows = derived(both.select("row_id", "bare", "deal", "now.*", "old").join(facts, ["bare", "deal"], "left"))
        window = F.get(F.filter("windows", lambda x: (x["item_id"] == F.col("item_id")) & (x["vendor"] == F.col("vendor"))), F.lit(0))
        i = F.coalesce(F.exists("windows", lambda x: x["item_id"] == F.col("item_id")), F.lit(False))
        codes = lambda c, item: F.get(F.filter(c, lambda x: x["item_id"] == F.col(item)), F.lit(0))["codes"]
        moved = lambda item: ~codes("classes", item).eqNullSafe(codes("classes_before", item))
        state = F.when(F.col("old").isNull(), "NEW").when(F.col("old.row_hash") != F.col("row_hash"), "CHANGED").otherwise("SAME")
        rows = rows.withColumns({"state": state, "window": window, "i": i}).withColumn("fresh", F.col("state") != "SAME")
        inside = F.coalesce(F.col("day").between(F.col("window.since"), F.col("window.until")), F.lit(False))
        explained = (F.col("window").isNotNull() & (F.col("old.status") == "NOT_ACTIVE")) | ((F.col("old.status") == "NOT_FOUND") & (F.col("v").isNotNull() | F.col("i")))
        by_contract = F.col("fresh") | inside | F.coalesce(explained, F.lit(False)) | (F.col("old.vendor") != F.col("vendor"))
        return with_item(rows.withColumns({"by_contract": by_contract, "by_item": F.col("fresh") | moved("item_id") | moved("bare")}))


def current_contracts(keys: DataFrame, contracts: DataFrame, day: str, settings: Settings = Settings()) -> DataFrame:
    """(vendor, item_id, current_status, scope, current_number, current_price, current_each_price, price_count, no_contract_code) of distinct
    (vendor, item_id): an active contract of the own vendor first, else of any; a price only if the latest ones agree on it.

    contracts: rows of ``usable_contracts``.
    """
    at = _date(day)
    live = contracts.where((F.col("starts") <= at) & (F.col("ends").isNull() | (F.col("ends") >= at)))

    def of(by: list[str], name: str) -> DataFrame:
        latest = live.groupBy(*by).agg(F.max("starts").alias("latest"))
        tie = live.join(latest, by).where((F.col("starts") == F.col("latest")) & F.col("price").isNotNull())
        price = F.coalesce(F.round("each_price", 6), -F.round("price", 6)) if settings.by_each_price else F.round("price", 6)
        pick = F.min(F.struct((F.col("uom") != "EA").alias("a"), "vendor", "contract_number", "uom", "price", "each_price")).alias("pick")
        priced = tie.groupBy(*by).agg(F.count_distinct(price).alias("n"), pick)
        return latest.join(priced, by, "left").select(*by, F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pick").alias(name))

    facts = contracts.groupBy("item_id").agg(F.max(F.when((F.col("starts") <= at) & (F.col("ends") < at), True)).alias("past"), F.max(F.when(F.col("starts") > at, True)).alias("later"))
    out = keys.join(of(["vendor", "item_id"], "own"), ["vendor", "item_id"], "left").join(of(["item_id"], "anyone"), "item_id", "left").join(facts.withColumn("there", F.lit(True)), "item_id", "left")
    best = F.coalesce("own", "anyone")
    blank, n = F.col("item_id") == "", best["n"]
    status = F.when(blank, "NOT_ASSESSED").when(n == 1, "CONTRACTED").when(n > 1, "CONTRACTED_PRICE_AMBIGUOUS").when(best.isNotNull(), "CONTRACTED_NO_PRICE").otherwise("NON-CONTRACTED")
    none = ~blank & best.isNull()
    why = F.when(blank, "MISSING_ITEM_ID").when(none & F.col("there").isNull(), "NO_CONTRACT_RECORD_FOR_ITEM").when(none & F.col("past"), "ALL_CONTRACTS_EXPIRED").when(none & F.col("later"), "ONLY_FUTURE_CONTRACTS").when(none, "NO_VALID_CONTRACT_DATES")
    scope = F.when(F.col("own").isNotNull(), "SAME_VENDOR").when(F.col("anyone").isNotNull(), "OTHER_VENDOR")
    picked = [F.when(n == 1, best["pick"][a]).alias(b) for a, b in (("contract_number", "current_number"), ("price", "current_price"), ("each_price", "current_each_price"))]
    return out.select("vendor", "item_id", status.alias("current_status"), scope.alias("scope"), *picked, n.cast("int").alias("price_count"), why.alias("no_contract_code"))
