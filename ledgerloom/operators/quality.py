"""Data-quality profiles of contracts and usage as (metric, value) rows, and what makes contracts ambiguous.

Measures of single rows come from one aggregate; measures of keys from groupings of the usable distinct records, which are written
once, whether a key has several values by its least and greatest one; overlaps by a sweep over a key's records in the order of start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import date_status, item_key, parse_date, vendor_key
from ..sources.shared import written

METRICS = "metric string, value long"


def _metrics(spark, values: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(k, int(v or 0)) for k, v in values.items()], METRICS)


def several(name: str) -> list[Column]:
    """Aggregates whose results ``differs`` compares: whether a group has different values (nulls don't count)."""
    return [F.min(name).alias(f"{name}_least"), F.max(name).alias(f"{name}_most")]


def differs(name: str) -> Column:
    return F.col(f"{name}_least") != F.col(f"{name}_most")


def _of(df: DataFrame, by: list[str], name: str) -> tuple[int, int]:
    """(groups, groups with several values of name)."""
    row = df.groupBy(*by).agg(*several(name)).agg(F.count("*"), F.count_if(differs(name))).first()
    return row[0], row[1]


def clean_contracts(raw: DataFrame, standard: Column) -> DataFrame:
    """Raw contract records with keys, dates with their status, and standard (of the column spelling) as vendor."""
    text = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    out = raw.select(
        vendor_key(F.col("vendor")).alias("spelling"), item_key(F.col("item_id")).alias("item_id"), "contract_number", text("uom").alias("uom"), "price", "each_price",
        parse_date(F.col("start_text")).alias("starts"), date_status(F.col("start_text")).alias("start_status"), parse_date(F.col("end_text")).alias("ends"), date_status(F.col("end_text")).alias("end_status"),
        text("tier").alias("tier"), F.trim(F.coalesce("category", F.lit(""))).alias("category"), F.trim(F.coalesce("vendor_code", F.lit(""))).alias("vendor_code"),
    )
    return out.withColumn("vendor", standard)


RECORD = ["vendor", "item_id", "contract_number", "starts", "ends", "uom", "price", "each_price", "tier"]


def contract_profile(rows: DataFrame) -> DataFrame:
    """(metric, value): 31 measures of rows of ``clean_contracts``."""
    rows = written(rows, "raw_contracts")
    n = lambda c: F.count_if(F.expr(c))
    one = rows.agg(
        F.count("*").alias("raw_records"), n("vendor = '' or item_id = ''").alias("missing_vendor_or_item"), n("start_status = 'MISSING'").alias("missing_start"), n("start_status = 'INVALID'").alias("invalid_start"),
        n("end_status = 'MISSING'").alias("missing_end"), n("end_status = 'INVALID'").alias("invalid_end"), n("year(starts) < 2000").alias("start_before_2000"), n("price is null").alias("missing_price"),
        n("each_price is null").alias("missing_each_price"), n("category = ''").alias("missing_category"), n("tier = ''").alias("missing_tier"), n("vendor_code = ''").alias("missing_vendor_code"),
    ).first().asDict()
    others = [F.min("category").alias("category"), F.max("category").alias("category_most")]
    records = written(rows.groupBy(*RECORD).agg(F.count("*").alias("copies"), *others), "records")
    one["exact_duplicates"] = one["raw_records"] - records.count()
    one["distinct_tiers"] = rows.select("tier").distinct().count()
    one["distinct_spellings"] = rows.select("spelling").distinct().count()
    coded = rows.where("vendor_code <> ''")
    one["spellings_with_several_codes"], one["codes_with_several_spellings"] = _of(coded, ["spelling"], "vendor_code")[1], _of(coded, ["vendor_code"], "spelling")[1]
    usable = records.where("vendor <> '' and item_id <> ''")
    one["end_before_start"] = usable.where("ends < starts").count()
    one["standard_vendors"] = usable.select("vendor").distinct().count()
    keys = usable.groupBy("vendor", "item_id").agg(*(x for c in ("contract_number", "price", "each_price", "uom") for x in several(c)))
    row = keys.agg(F.count("*"), *(F.count_if(differs(c)) for c in ("contract_number", "price", "each_price", "uom"))).first()
    one |= dict(zip(("vendor_item_keys", "keys_with_several_contracts", "keys_with_several_prices", "keys_with_several_each_prices", "keys_with_several_units"), row, strict=True))
    one["items"], one["items_with_several_contracts"] = _of(usable, ["item_id"], "contract_number")
    category = rows.where("vendor <> '' and item_id <> '' and category <> ''")
    one["items_with_several_categories"] = _of(category, ["item_id"], "category")[1]
    one["key_units_with_several_prices"] = _of(usable, ["vendor", "item_id", "uom"], "price")[1]
    before = W.partitionBy("vendor", "item_id").orderBy("starts", F.col("ends").asc_nulls_last(), "contract_number", "uom", "price", "each_price", "tier").rowsBetween(W.unboundedPreceding, -1)
    far = F.lit("2999-12-31").cast("date")
    swept = usable.where("starts is not null").withColumn("over", F.col("starts") <= F.max(F.coalesce("ends", far)).over(before)).where("over")
    row = swept.groupBy("vendor", "item_id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    one["overlapping_records"], one["keys_with_overlaps"] = row[0], row[1]
    one["usable_records"] = usable.count()
    return _metrics(rows.sparkSession, one)


def usage_profile(usage: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(dataset, metric, value) of usage (vendor, item_id, day text, price), items (item_id, unspsc) and aliases (name, standard, method,
    needs_review)."""
    rows = usage.select(vendor_key(F.col("vendor")).alias("spelling"), item_key(F.col("item_id")).alias("item_id"), F.col("day"), "price").join(aliases.select(F.col("name").alias("spelling"), "standard"), "spelling", "left")
    rows = written(rows.withColumn("vendor", F.coalesce("standard", "spelling")), "usage")
    n = lambda c: F.count_if(F.expr(c))
    one = rows.agg(
        F.count("*").alias("rows"), n("item_id = ''").alias("blank_item"), n("spelling = ''").alias("blank_vendor"), F.count_if(date_status(F.col("day")) == "MISSING").alias("blank_day"),
        F.count_if(date_status(F.col("day")) == "INVALID").alias("invalid_day"), n("price is null").alias("blank_price"), n("price <= 0").alias("price_not_positive"),
        F.count_if((F.col("item_id") != "") & ~F.col("item_id").rlike(r"^\d+$")).alias("item_not_numeric"), n("item_id like '0_%'").alias("item_with_leading_zero"),
    ).first().asDict()
    count = lambda df, *by: df.select(*by).distinct().count()
    one |= {"items": count(rows.where("item_id <> ''"), "item_id"), "vendor_item_keys": count(rows.where("item_id <> '' and vendor <> ''"), "vendor", "item_id"), "spellings": count(rows.where("spelling <> ''"), "spelling"), "standard_vendors": count(rows.where("vendor <> ''"), "vendor")}
    per = items.groupBy(item_key(F.col("item_id")).alias("item_id")).agg(F.count("*").alias("n"), F.min(F.nullif(F.trim("unspsc"), F.lit(""))).alias("a"), F.max(F.nullif(F.trim("unspsc"), F.lit(""))).alias("b")).where("item_id <> ''")
    of_item = per.agg(F.sum("n").alias("rows"), F.count("*").alias("items"), n("a <> b").alias("several_classes"), n("a is null").alias("without_class"), F.sum(F.col("n") - 1).alias("duplicate_rows")).first().asDict()
    of_alias = aliases.agg(F.count("*").alias("spellings"), n("name <> standard").alias("renamed"), n("needs_review = 'Y'").alias("needs_review"), n("method = 'NO_MATCH'").alias("no_match")).first().asDict()
    out = [(k, m, int(v or 0)) for k, x in (("usage", one), ("items", of_item), ("aliases", of_alias)) for m, v in x.items()]
    return usage.sparkSession.createDataFrame(out, "dataset string, metric string, value long")


#: Units of usage rows and of contracts that are the same.
UNIT_NAMES = {"EACH": "EA", "CASE": "CA", "ROLL": "RL", "PACKAGE": "PK", "BOX": "BX", "BAG": "BG", "PAIR": "PR", "BOTTLE": "BO", "TRAY": "TY"}


def ambiguity(usage: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenario, lines, combos, share) and (driver, lines, combos, share) of usage (vendor, item_id, day, unit) whose active contracts with
    the latest start don't agree on price, each price and unit.

    A: all of them. B: one each price, they differ by pack only. C: not B, and the usage's unit is that of one price alone. D: not B,
    several tiers of one each price each. E: not B, one tier has several each prices. F: all but B; these by driver.
    contracts: vendor, item_id, contract_number, starts, ends, uom, price, each_price, tier.
    """
    own, key = ["vendor", "item_id"], ["vendor", "item_id", "day"]
    day = F.col("day")
    each = F.round("each_price", 6)
    pack = F.concat_ws("|", F.round("price", 6).cast("string"), F.coalesce(each.cast("string"), F.lit("")), "uom")
    last = F.coalesce("ends", F.lit("2999-12-31").cast("date"))
    record = F.struct("starts", "ends", "tier", "contract_number", "uom", F.col("price").isNotNull().alias("priced"), each.alias("each"), pack.alias("pack"), last.alias("last"))
    records = contracts.groupBy(*own).agg(F.collect_set(record).alias("records"))
    live = F.filter("records", lambda c: (c["starts"] <= day) & (c["ends"].isNull() | (c["ends"] >= day)))
    latest = F.array_max(F.transform("live", lambda c: c["starts"]))
    priced = F.filter("live", lambda c: (c["starts"] == F.col("latest")) & c["priced"])
    # a line meets its contracts once; only lines whose latest ones have several packs go on, and all lines of a day do or don't
    lines = usage.join(records, own).withColumn("live", live).withColumn("latest", latest).select(*key, "unit", priced.alias("tied"))
    packs = F.transform("tied", lambda c: c["pack"])
    lines = lines.where((F.size("tied") > 1) & (F.array_min(packs) != F.array_max(packs)))
    asked = lines.groupBy(*key).agg(F.count("*").alias("lines"), F.min("unit").alias("unit"), F.first("tied").alias("tied"))
    names = F.create_map(*(F.lit(x) for p in UNIT_NAMES.items() for x in p))
    unit = F.coalesce(F.try_element_at(names, F.upper(F.trim("unit"))), F.lit("?"))
    tied = asked.select(*key, "lines", unit.alias("unit"), F.explode("tied").alias("c")).select(*key, "lines", "unit", "c.*").withColumn("fits", F.col("unit") == F.col("uom"))
    per_tier = tied.groupBy(*key, "tier").agg(
        F.max("lines").alias("lines"), *several("each"), *several("pack"), *several("contract_number"), *several("last"), F.max("fits").alias("fits"),
        F.min(F.when(F.col("fits"), F.col("pack"))).alias("fit_least"), F.max(F.when(F.col("fits"), F.col("pack"))).alias("fit_most"), F.count("each").alias("eaches"),
    )
    up = lambda c: [F.min(f"{c}_least").alias(f"{c}_least"), F.max(f"{c}_most").alias(f"{c}_most")]
    g = per_tier.groupBy(*key).agg(
        F.max("lines").alias("lines"), F.count("*").alias("tiers"), *(x for c in ("each", "pack", "contract_number", "last", "fit") for x in up(c)), F.max(F.coalesce(differs("each"), F.lit(False))).alias("in_tier"),
        F.sum("eaches").alias("eaches"), F.max("fits").alias("fits"),
    ).where(differs("pack"))
    by_each = (F.col("eaches") > 0) & ~differs("each")
    left = ~by_each
    driver = F.when(differs("contract_number"), "DIFFERENT_CONTRACT_NUMBERS").when(F.col("tiers") > 1, "DIFFERENT_PRICING_TIER").when(differs("last"), "SAME_CONTRACT_AND_TIER_DIFFERENT_END_DATE").otherwise("SAME_CONTRACT_TIER_AND_END_DATE")
    cases = {
        "A": F.lit(True), "B": by_each, "C": left & F.col("fits") & ~differs("fit"), "D": left & (F.col("tiers") > 1) & ~F.col("in_tier") & (F.col("eaches") > 0), "E": left & F.col("in_tier"), "F": left,
    }
    g = written(g.select("lines", F.when(left, driver).alias("driver"), *(F.coalesce(c, F.lit(False)).alias(k) for k, c in cases.items())), "ambiguous")
    one = g.agg(*(f.alias(f"{k}{i}") for k in cases for i, f in enumerate((F.sum(F.when(F.col(k), F.col("lines"))), F.count_if(F.col(k))))))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.coalesce(f"{k}0", F.lit(0)).alias("lines"), F.col(f"{k}1").alias("combos"), F.floor(F.coalesce(F.col(f"{k}0") * 10000 / F.col("A0"), F.lit(0.0)) + 0.501).alias("basis_points")) for k in cases)))
    drivers = g.where("F").groupBy("driver").agg(F.sum("lines").alias("lines"), F.count("*").alias("combos"))
    return one.select(rows.alias("x")).select("x.*"), drivers
