"""Vendor resolution: every spelling of a vendor in any feed gets the contract vendor that it stands for, with method, confidence and
evidence.

The evidence is taken in stages, each for the names that the stages before left open: spellings in contracts (EXACT, or for the
most frequent of several CONTRACT_VENDOR_ANCHOR), equal names without punctuation and legal forms (CORE_KEY), vendor codes of the
item master's name or of the items used under the name (VENDOR_CODE), the contracts of those items (ITEM_OVERLAP), alike names
with a margin to the second (FUZZY_NAME); what is left is NO_MATCH and stands for itself.

Rows are counted by (name, item) once; all stages work on those pairs, on distinct names, and, for the overlap, on an inverted index
from items to contract vendors, joined with the open names only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import item_key, vendor_key
from ..sources.shared import written
from .matching import fuzzy_pairs

#: Words that say nothing about which company it is: legal forms, and general words besides.
LEGAL_WORDS = "INC INCORPORATED CORP CORPORATION LLC LP LLP LTD LIMITED CO COMPANY PLC GMBH THE USA US NA OF".split()
GENERAL_WORDS = """MEDICAL SURGICAL HEALTH HEALTHCARE SYSTEMS SYSTEM PRODUCTS LABORATORIES INDUSTRIES TECHNOLOGIES TECHNOLOGY SCIENTIFIC
    SUPPLY INTERNATIONAL GROUP HOLDINGS DEVICES SOLUTIONS AMERICA AND SALES SERVICES DENTAL INSTRUMENTS SPECIALTIES BIOMEDICAL
    LIFESCIENCES WORLD WIDE WORLDWIDE DIVISION CARE PHARMA PHARMACEUTICALS""".split()


@dataclass(frozen=True)
class Limits:
    """What evidence must reach."""

    code_share: float = 0.8
    code_items: int = 3
    item_share: float = 0.6
    strong_share: float = 0.9
    strong_items: int = 10
    broad_share: float = 0.8
    broad_items: int = 50
    lead: float = 1.5
    ratio: float = 0.94
    margin: float = 0.03


def vendor_core(name: Column) -> Column:
    """Upper-case words without punctuation and legal forms; the words as they are if nothing else is there."""
    plain = F.trim(F.regexp_replace(F.replace(F.upper(name), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " "))
    kept = F.filter(F.split(plain, " "), lambda w: ~w.isin(*LEGAL_WORDS, ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(plain)


def telling_words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(vendor_core(name), " "), lambda w: (F.length(w) > 2) & ~w.isin(*LEGAL_WORDS, *GENERAL_WORDS)))


def _share_word(a: str, b: str) -> Column:
    return F.arrays_overlap(telling_words(F.col(a)), telling_words(F.col(b)))


def _most(df: DataFrame, key: str, value: str, weight: Column, alias: str) -> DataFrame:
    """(key, alias): the value with the greatest weight, ties to the least value."""
    counted = df.groupBy(key, value).agg(weight.alias("_w"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_w"), value)).alias(alias))


def contract_vendors(contracts: DataFrame) -> DataFrame:
    """(name, standard, core, method, records) of every spelling in contracts (vendor, rows): those with one core take the most frequent one's."""
    spelt = contracts.groupBy(F.col("vendor").alias("name")).agg(F.sum("rows").alias("records")).withColumn("core", vendor_core(F.col("name")))
    top = spelt.groupBy("core").agg(F.min_by("name", F.struct(-F.col("records"), "name")).alias("standard"), F.count("*").alias("members"))
    method = F.when(F.col("name") != F.col("standard"), "CORE_KEY").when(F.col("members") == 1, "EXACT").otherwise("CONTRACT_VENDOR_ANCHOR")
    return spelt.join(top, "core").select("name", "standard", "core", method.alias("method"), "records")


def code_evidence(pairs: DataFrame, items: DataFrame, contracts: DataFrame, owners: DataFrame) -> DataFrame:
    """(name, code_source, code, code_vendor, code_share, code_items): the code that most rows of a name's items have, by the item
    master (IM), for names without any by contracts (CON), and the contract vendor that owns it.

    pairs (name, item_id, rows); owners (code, code_vendor).
    """

    def of(codes: DataFrame, source: str) -> DataFrame:
        coded = pairs.join(codes.where("item_id <> '' and vendor_code <> ''").select("item_id", F.col("vendor_code").alias("code")).distinct(), "item_id")
        by_code = coded.groupBy("name", "code").agg(F.sum("rows").alias("r"), F.count("*").alias("n"))  # a pair has an item once
        best = F.min(F.struct((-F.col("r")).alias("less"), "code", "n")).alias("x")
        top = by_code.groupBy("name").agg(best, F.sum("r").alias("all"))
        return top.select("name", F.lit(source).alias("code_source"), "x.code", (-F.col("x.less") / F.col("all")).alias("code_share"), F.col("x.n").alias("code_items"))

    by_items = of(items, "IM")
    both = by_items.unionByName(of(contracts, "CON").join(by_items.select("name"), "name", "left_anti"))
    return both.join(owners, "code", "left").select("name", "code_source", "code", "code_vendor", "code_share", "code_items")


def code_accepts(limits: Limits) -> Column:
    """Whether code evidence decides alone: by the item master with its share; by contracts also with several items or a shared word."""
    strong = (F.col("code_source") == "IM") | (F.col("code_items") >= limits.code_items) | _share_word("name", "code_vendor")
    return F.coalesce(F.col("code_vendor").isNotNull() & (F.col("code_share") >= limits.code_share) & strong, F.lit(False))


def overlap(pairs: DataFrame, index: DataFrame, limits: Limits) -> DataFrame:
    """(name, standard, hits, contracted, share, accepted): the contract vendor that has most of a name's contracted items.

    pairs (name, item_id), distinct; index (item_id, standard), distinct: the inverted index of contract vendors' items.
    """
    contracted = pairs.join(index.select("item_id").distinct(), "item_id", "left_semi").groupBy("name").agg(F.count("*").alias("contracted"))
    hits = pairs.join(index, "item_id").groupBy("name", "standard").agg(F.count("*").alias("hits"))
    place = F.row_number().over(W.partitionBy("name").orderBy(F.desc("hits"), "standard"))
    best = hits.withColumn("place", place).where("place <= 2").groupBy("name").agg(
        F.max_by("standard", -F.col("place")).alias("standard"), F.max(F.when(F.col("place") == 1, F.col("hits"))).alias("hits"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("hits"))), F.lit(0)).alias("second"),
    )
    share = F.col("hits") / F.col("contracted")
    strong = ((share >= limits.strong_share) & (F.col("contracted") >= limits.strong_items)) | ((share >= limits.broad_share) & (F.col("contracted") >= limits.broad_items))
    enough = (F.col("contracted") >= 2) & (share >= limits.item_share) & (F.col("hits") >= limits.lead * F.col("second"))
    word = _share_word("name", "standard")
    out = best.join(contracted, "name").withColumn("word", word)
    return out.select("name", "standard", "hits", "contracted", share.alias("share"), "word", (enough & (F.col("word") | strong)).alias("accepted"))


def resolve(usage: DataFrame, contracts: DataFrame, items: DataFrame, limits: Limits = Limits(), fuzzy: bool = True) -> DataFrame:
    """(name, standard, method, confidence, evidence, needs_review, usage_rows, contract_records, item_rows, code_check) of every
    spelling in any feed.

    usage: vendor, item_id; contracts, items: vendor, item_id, vendor_code. Blank vendors and items take no part. code_check says how
    vendor codes agree with a vendor that was found by judgement: CONFIRMED, CONFLICT, INCONCLUSIVE or NO_CODE_DATA.
    """
    keys = [vendor_key(F.col("vendor")).alias("vendor"), item_key(F.col("item_id")).alias("item_id")]
    coded = [*keys, F.trim(F.coalesce("vendor_code", F.lit(""))).alias("vendor_code")]
    # spellings as delivered are counted first, so that cleaning is done once for each and not for each row
    counted = lambda df, by, n=F.count("*"): df.groupBy(*by).agg(n.alias("rows"))
    raw = lambda df, by: counted(df, [x for x in ("vendor", "item_id", "vendor_code") if x in df.columns]).select(*by, "rows")
    pairs = written(counted(raw(usage.select("vendor", "item_id"), keys).where("vendor <> ''").withColumnRenamed("vendor", "name"), ["name", "item_id"], F.sum("rows")), "vendor_items")
    items = written(items.select(*coded), "item_vendors")
    contracts = written(counted(raw(contracts.select("vendor", "item_id", "vendor_code"), coded), ["vendor", "item_id", "vendor_code"], F.sum("rows")), "contract_vendors")
    known = contracts.where("vendor <> ''")
    spelt = contract_vendors(known)
    spelt = written(spelt, "spellings")
    cores = spelt.select("core", "standard").distinct()
    standard_of = spelt.select(F.col("name").alias("vendor"), "standard")

    owners = _most(known.where("vendor_code <> ''").withColumnRenamed("vendor_code", "code"), "code", "vendor", F.sum("rows"), "vendor")
    owners = owners.join(standard_of, "vendor").select("code", F.col("standard").alias("code_vendor"))
    named = _most(items.where("vendor <> '' and vendor_code <> ''").withColumnRenamed("vendor", "name"), "name", "vendor_code", F.count("*"), "code")
    named = named.join(owners, "code").select("name", F.col("code_vendor").alias("named_vendor"))
    evidence = written(code_evidence(pairs.where("item_id <> ''"), items, contracts, owners), "codes")

    counts = pairs.groupBy("name").agg(F.sum("rows").alias("usage_rows"))
    counts = counts.join(spelt.select("name", F.col("records").alias("contract_records")), "name", "full_outer")
    counts = counts.join(items.where("vendor <> ''").groupBy(F.col("vendor").alias("name")).agg(F.count("*").alias("item_rows")), "name", "full_outer")
    names = counts.na.fill(0, ["usage_rows", "contract_records", "item_rows"]).withColumn("core", vendor_core(F.col("name")))

    own = spelt.select("name", F.col("standard").alias("own_standard"), F.col("method").alias("own_method"))
    first = names.join(own, "name", "left").join(cores.withColumnRenamed("standard", "core_standard"), "core", "left").join(named, "name", "left").join(evidence, "name", "left")
    accepts = code_accepts(limits)
    same_name = F.concat(F.lit("same name as '"), F.coalesce("own_standard", "core_standard"), F.lit("' without punctuation and legal forms"))
    percent = lambda c: F.concat(F.round(c * 100).cast("int").cast("string"), F.lit(" %"))
    by_code = F.concat(F.lit("code "), F.col("code"), F.lit(" ("), F.col("code_source"), F.lit(") has "), percent(F.col("code_share")), F.lit(" of rows, "), F.col("code_items").cast("string"), F.lit(" items"))
    stage = lambda standard, method, confidence, why: F.struct(standard.alias("standard"), method.alias("method"), confidence.alias("confidence"), why.alias("evidence"))
    one = F.lit(1.0)
    found = (
        F.when(F.col("own_standard").isNotNull(), stage(F.col("own_standard"), F.col("own_method"), one, F.when(F.col("own_method") == "CORE_KEY", same_name).otherwise("")))
        .when(F.col("core_standard").isNotNull(), stage(F.col("core_standard"), F.lit("CORE_KEY"), one, same_name))
        .when(F.col("named_vendor").isNotNull(), stage(F.col("named_vendor"), F.lit("VENDOR_CODE"), one, F.lit("the item master's code of this name")))
        .when(accepts, stage(F.col("code_vendor"), F.lit("VENDOR_CODE"), F.round("code_share", 3), by_code))
    )
    first = written(first.withColumn("found", found), "by_name_and_code")

    open_names = first.where("found is null").select("name", "core")
    used = pairs.select("name", "item_id").unionAll(items.select(F.col("vendor").alias("name"), "item_id")).where("item_id <> ''").join(open_names.select("name"), "name", "left_semi").distinct()
    index = known.where("item_id <> ''").join(standard_of, "vendor").select("item_id", "standard").distinct()
    shared = written(overlap(used, index, limits), "overlap")
    why = F.concat(F.col("hits").cast("string"), F.lit(" of "), F.col("contracted").cast("string"), F.lit(" contracted items are of '"), F.col("standard"), F.lit("'"), F.when(F.col("word"), "").otherwise(" (names share no word)"))
    by_items = shared.where("accepted").select("name", stage(F.col("standard"), F.lit("ITEM_OVERLAP"), F.round("share", 3), why).alias("by_items"))
    out = first.join(by_items, "name", "left")
    if fuzzy:
        rest = open_names.join(by_items, "name", "left_anti")
        near = fuzzy_pairs(rest.select("core").distinct(), cores.select(F.col("core").alias("standard")), limits.ratio - limits.margin).join(cores.select(F.col("core").alias("b"), "standard"), "b")
        place = F.row_number().over(W.partitionBy("a").orderBy(F.desc("ratio"), F.desc("standard")))
        near = near.withColumn("place", place).withColumn("next", F.coalesce(F.lead("ratio").over(W.partitionBy("a").orderBy(F.desc("ratio"), F.desc("standard"))), F.lit(0.0)))
        near = near.where((F.col("place") == 1) & (F.col("ratio") >= limits.ratio) & (F.col("ratio") - F.col("next") >= limits.margin))
        alike = F.concat(F.lit("names alike by "), F.round("ratio", 2).cast("string"))
        near = near.select(F.col("a").alias("core"), stage(F.col("standard"), F.lit("FUZZY_NAME"), F.round("ratio", 3), alike).alias("by_ratio"))
        out = out.join(near, "core", "left")
    else:
        out = out.withColumn("by_ratio", F.lit(None).cast(out.schema["found"].dataType))
    best = shared.select("name", F.concat(F.lit("; "), why, F.lit(", too few")).alias("less"))
    none = stage(F.col("name"), F.lit("NO_MATCH"), F.lit(0.0), F.concat(F.lit("no contract vendor with this name"), F.coalesce("less", F.lit(""))))
    out = out.join(best, "name", "left").withColumn("x", F.coalesce("found", "by_items", "by_ratio", none))
    judged = F.col("x.method").isin("ITEM_OVERLAP", "FUZZY_NAME", "NO_MATCH", "VENDOR_CODE")
    check = F.when(F.col("code_vendor").isNull(), "NO_CODE_DATA").when(F.col("code_share") < 0.5, "INCONCLUSIVE").when(F.col("code_vendor") == F.col("x.standard"), "CONFIRMED").otherwise("CONFLICT")
    return out.select(
        "name", "x.standard", "x.method", "x.confidence", "x.evidence", F.when(judged, "Y").otherwise("N").alias("needs_review"),
        "usage_rows", "contract_records", "item_rows", F.when(judged, check).otherwise("").alias("code_check"), "code_vendor", accepts.alias("code_accepted"), "code_share",
    )


#: What a reviewer's remark must hold to approve, and to ask for the vendor code.
APPROVES = r"(?i)\b(ok|okay|approved?|accept(ed)?|agree[ds]?|confirmed?)\b"
ASKS_CODE = r"(?i)vendor\s*(code|id)"


def reviewed(resolved: DataFrame, remarks: DataFrame) -> DataFrame:
    """(name, standard, method, review_status) after a reviewer's remarks (name, remark): a vendor's name overrides, an approval keeps what
    was found, a request for the code takes the code's vendor if its evidence is accepted, other text only stays a comment.

    resolved: rows of ``resolve``. Names of contracts' vendors and standards are valid as overrides.
    """
    valid = resolved.select(F.col("standard").alias("key")).unionAll(resolved.where("contract_records > 0").select("name")).distinct().withColumn("valid", F.lit(True))
    said = resolved.join(remarks.select("name", F.trim(F.coalesce("remark", F.lit(""))).alias("remark")), "name", "left").withColumn("key", vendor_key(F.col("remark")))
    said = said.join(valid, "key", "left")
    remark = F.coalesce("remark", F.lit(""))
    kind = F.when(remark == "", "").when(F.col("valid"), "OVERRIDE").when(remark.rlike(APPROVES), "APPROVED").when(remark.rlike(ASKS_CODE), "CHECK_CODE").otherwise("COMMENT_ONLY")
    said = said.withColumn("kind", kind)
    by_code = (F.col("kind") == "CHECK_CODE") & F.col("code_accepted")
    standard = F.when(F.col("kind") == "OVERRIDE", F.col("key")).when(by_code, F.col("code_vendor")).otherwise(F.col("standard"))
    weak = F.when(F.col("code_vendor").isNull(), "NO_VENDOR_CODE_EVIDENCE").otherwise("VENDOR_CODE_EVIDENCE_TOO_WEAK")
    status = (
        F.when(by_code, "DECIDED_BY_VENDOR_CODE").when(F.col("kind") == "CHECK_CODE", weak)
        .when((F.col("kind") == "APPROVED") & (F.col("code_check") == "CONFLICT"), "APPROVED_BUT_CODE_CONFLICT").otherwise(F.col("kind"))
    )
    return said.select("name", standard.alias("standard"), F.when(by_code, "VENDOR_CODE").otherwise(F.col("method")).alias("method"), status.alias("review_status"))
