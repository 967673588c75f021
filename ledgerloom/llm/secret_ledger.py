"""Secret scans with an incremental blob ledger (operator 7), in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds which (blob, rule, rule version) has been
scanned and the findings; a run scans only pairs that it lacks, each blob once however many paths and versions have it, and
joins the findings back to all of them.

A rule's matches are found leftmost and non-overlapping with Java's regular expressions, in which (?i) concerns ASCII letters
only; a match counts if its tested group has the least number of characters. Every rule's time is in proportion to the text's length. Offsets are of code points, the end exclusive.
They are sums of the lengths of the pieces between matches and of the matches.

Scale: a scan shuffles texts once, by blob, and copies fall together before the shuffle; a blob's findings are rows of the
ledger. Only its result row has all spans of a text in one value, as the report's format asks.

Defined cases: a null text is the empty text; equal texts share a blob; each row of repeated doc_ids gets its result; a null
doc_id is kept; other columns, whatever their names, are ignored by ``report`` and kept by ``redact``; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, fresh


@dataclass(frozen=True)
class Rule:
    """A match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order that ranks spans with equal starts.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 64, base=False),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, base=False),
    # begins where a run of its characters does, and each run is gone over once: else long runs of eyJ took the square of their length
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 30, version=2, base=False),
)
LEDGER = "blob string, rule string, found boolean, start int, end int"


def _matches(text: Column, rule: Rule, rank: int, todo: Column) -> Column:
    """An array of structs (rank, place, gap, long, good) of a rule's matches, in order."""
    none = F.array().cast("array<struct<rank:int,place:int,gap:int,long:int,good:boolean>>")
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("tested"),
    )
    each = F.transform(
        F.filter(parts, lambda x: x["all"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(rank).alias("rank"), i.cast("int").alias("place"), F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("long"),
            (F.length(x["tested"]) >= rule.least).alias("good"),
        ),
    )
    return F.when(todo & text.rlike(rule.pattern), each).otherwise(none)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, found, start, end) for versions (text, ...): a row per finding, and per pair without
    findings one with found = false. ledger: rows of earlier runs."""
    blobs = versions.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        blobs = blobs.join(done, "blob", "left")
        todo = [~F.coalesce(F.array_contains("done", r.key), F.lit(False)) for r in rules]
    else:
        todo = [F.lit(True)] * len(rules)
    found = F.concat(*(_matches(F.col("text"), r, i, t) for i, (r, t) in enumerate(zip(rules, todo, strict=True))))
    new = F.filter(F.array(*(F.when(t, F.lit(i)) for i, t in enumerate(todo))), lambda x: x.isNotNull())
    scanned = blobs.select("blob", new.alias("new"), found.alias("found"))
    marks = F.transform("new", lambda i: F.struct(i.alias("rank"), F.lit(-1).alias("place"), F.lit(0).alias("gap"), F.lit(0).alias("long"), F.lit(False).alias("good")))
    rows = scanned.select("blob", F.explode(F.concat(marks, "found")).alias("x")).select("blob", "x.*")
    w = W.partitionBy("blob", "rank").orderBy("place")
    start = F.sum("gap").over(w) + F.coalesce(F.sum("long").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", start.cast("int")).where("good or place = -1")
    names = F.array(*(F.lit(r.key) for r in rules))
    return rows.select("blob", F.element_at(names, F.col("rank") + 1).alias("rule"), F.col("good").alias("found"), F.when(F.col("good"), F.col("start")).alias("start"), F.when(F.col("good"), F.col("start") + F.col("long")).alias("end"))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): per blob with findings by these rules an array of (start, rank, end), in order."""
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))))
    rows = ledger.where(F.col("found") & F.col("rule").isin([r.key for r in rules]))
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", rank[F.col("rule")].alias("rank"), "end"))).alias("spans"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def report(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_<kind> of base rules, base_sha256, spans) per row of docs (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession)
    new = scratch.cut(scan(docs, ledger, rules).where("found" if ledger is None else "true"), "ledger")
    per_blob = scratch.cut(findings(new if ledger is None else new.unionByName(ledger), rules), "findings")
    paths = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    out = paths.join(per_blob, "blob", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int>>"))
    base = [i for i, r in enumerate(rules) if r.base]
    of_base = F.filter(spans, lambda s: s["rank"].isin(base))
    return out.select(
        "doc_id",
        *(_count(spans, i).alias(f"n_{rules[i].kind}") for i in base),
        F.sha2(_joined(of_base, rules), 256).alias("base_sha256"),
        _joined(spans, rules).alias("spans"),
    )


#: What a redaction replaces besides the findings, one after the other: of an assignment its value, of other kinds the match. An
#: assignment whose value is too short can hide a longer one inside it from the scan, but not from these.
REDACTIONS = (
    (r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]{6,}""", "$1"),
    ("AKIA[A-Z0-9]{16,}", ""),
    *((r.pattern, "") for r in RULES[2:]),
)


def _ranges(text: Column, spans: Column, rules: tuple[Rule, ...]) -> Column:
    """What to redact of spans, as an array of structs (start, end) in order: of an assignment its value."""

    def one(s: Column) -> Column:
        start = s["start"]
        for i, r in enumerate(rules):
            if r.group:
                value = F.regexp_extract(text.substr(s["start"] + 1, s["end"] - s["start"]), r.pattern, r.group)
                start = F.when(s["rank"] == i, s["end"] - F.length(value)).otherwise(start)
        return F.struct(start.cast("int").alias("start"), s["end"].alias("end"))

    return F.array_sort(F.transform(spans, one))


def _without(text: Column, ranges: Column, mark: str) -> Column:
    """text with mark for each range; overlapping ones are one."""
    none = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, r: Column) -> Column:
        apart = F.when((r["start"] >= s["at"]), F.concat(s["out"], text.substr(s["at"] + 1, r["start"] - s["at"]), F.lit(mark))).otherwise(s["out"])
        return F.struct(apart.alias("out"), F.greatest(s["at"], r["end"]).alias("at"))

    return F.aggregate(ranges, none, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))


def redact(docs: DataFrame, mark: str = "*REDACTED*", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, scratch: Scratch | None = None) -> DataFrame:
    """docs with every secret in text replaced by mark, and n_chars, where it is there, counted anew for changed texts.

    What goes are the findings of the blobs, of a ledger of earlier runs and of a scan of what it lacks, joined back to all
    rows of a blob, and then what REDACTIONS still match. A null text stays null.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    new = scratch.cut(scan(docs, ledger, rules).where("found" if ledger is None else "true"), "ledger")
    blob, spans, made = fresh("blob", docs), fresh("spans", docs), fresh("redacted", docs)
    per_blob = scratch.cut(findings(new if ledger is None else new.unionByName(ledger), rules), "findings").withColumnsRenamed({"blob": blob, "spans": spans})
    # a row's text is null or has its blob's spans
    rows = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)).join(per_blob, blob, "left")
    text = F.col("text")
    rows = rows.withColumn(made, F.when(F.col(spans).isNotNull(), _without(text, _ranges(text, F.col(spans), rules), mark)).otherwise(text))
    text = F.col(made)
    for pattern, keep in REDACTIONS:
        text = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, keep + mark)).otherwise(text)
    out = rows.withColumn(made, text)
    if "n_chars" in docs.columns:
        long = F.length(made).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(made) != F.col("text"), long).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(made)).select(docs.columns)
