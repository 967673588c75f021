"""What a console asks of tables: pages with counts, drill-downs behind a figure, exports, and the suite of assertions on the marts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    """Counts of all rows and of those that the filters leave, and the page's rows."""

    total: int
    filtered: int
    rows: DataFrame


def table_page(df: DataFrame, search: str = "", equal: dict[str, str] | None = None, sort: str | None = None, descending: bool = False, start: int = 0, length: int = 10, most: int = 10_000) -> Page:
    """A page of rows in which some column, as text, holds ``search`` in any case, and that meet the equalities. Columns to filter or sort
    by must be the table's own; other names are ignored. All columns break ties, so pages don't overlap. length is at most ``most``."""
    conditions = [F.col(c) == v for c, v in (equal or {}).items() if c in df.columns]
    if search:
        text = search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        conditions.append(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).cast("string").ilike(f"%{text}%"), F.lit(False)) for c in df.columns)))
    hit = reduce(lambda a, b: a & b, conditions, F.lit(True))
    total, filtered = df.agg(F.count("*"), F.count_if(hit)).first()
    first = [F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()] if sort in df.columns else []
    return Page(total, filtered, df.where(hit).orderBy(*first, *df.columns).offset(max(0, start)).limit(min(most, max(0, length))))


def download(df: DataFrame, path: str) -> None:
    """The whole table as CSV with a header, in as many parts as Spark writes."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


#: What is behind a figure: the rows that count, and the measure that they are ordered by.
FIGURES: dict[str, tuple[Column | str, str]] = {
    "spend": ("line_spend > 0", "line_spend"), "match_rate": ("is_contract_matched", "line_spend"), "savings": ("savings_opportunity > 0", "savings_opportunity"), "overpayment": ("overpayment_amount > 0", "overpayment_amount"),
}


def drill(fact: DataFrame, key: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """((figure, rows, total), (figure, place, key, measure)): of each figure how many rows are behind it and their sum, by one pass, and
    its ``limit`` greatest rows, ties by key."""
    one = fact.agg(*(x for n, (c, m) in FIGURES.items() for x in (F.count_if(F.expr(c)).alias(f"{n} n"), F.sum(F.when(F.expr(c), F.col(m))).alias(f"{n} s"))))
    totals = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("figure"), F.col(f"{n} n").alias("rows"), F.coalesce(f"{n} s", F.lit(0.0)).alias("total")) for n in FIGURES))).alias("x")).select("x.*")
    tops = []
    for n, (c, m) in FIGURES.items():
        top = fact.where(c).orderBy(F.desc(m), key).limit(limit).select(F.lit(n).alias("figure"), F.col(key).alias("key"), F.col(m).alias("measure"))
        tops.append(top)
    return totals, reduce(DataFrame.unionAll, tops)


def assertions(usage: DataFrame, orders: DataFrame, fact: DataFrame, order_fact: DataFrame, gaps: DataFrame, tenants: DataFrame, coverage: float = 85.0, gap_rows: tuple[int, int] = (1, 1_000_000)) -> DataFrame:
    """(id, value, status): the eight assertions on the marts, against their feeds: spend and rows of usage, item coverage, negative prices
    and quantities, spend of orders, tiers, tenants, rows of the gap mart. Each table is read once.

    usage: unit_price, quantity; orders: total_value; fact: line_spend, is_item_master_matched, is_contract_matched, contract_match_tier;
    order_fact: total_value; tenants: client_id, client_name, client_type.
    """
    spend = F.sum(F.coalesce(F.col("unit_price") * F.col("quantity"), F.lit(0.0)))
    raw = usage.agg(spend.alias("spend"), F.count("*").alias("rows"), F.count_if((F.col("unit_price") < 0) | (F.col("quantity") < 0)).alias("negative")).first()
    own = fact.agg(
        F.sum(F.coalesce("line_spend", F.lit(0.0))).alias("spend"), F.count("*").alias("rows"), F.count_if("is_item_master_matched").alias("known"),
        F.count_if(F.col("is_contract_matched") & ~F.col("contract_match_tier").isin(1, 2, 3, 4)).alias("tiers"),
    ).first()
    total = F.sum(F.coalesce("total_value", F.lit(0.0)))
    po, po_own = orders.agg(total).first()[0] or 0.0, order_fact.agg(total).first()[0] or 0.0
    missing = tenants.where(reduce(lambda a, b: a | b, (F.coalesce(F.trim(c), F.lit("")) == "" for c in ("client_id", "client_name", "client_type")))).count()
    n_gaps = gaps.count()
    near = lambda a, b: abs((a or 0.0) - (b or 0.0)) <= max(0.01, 1e-9 * abs(b or 0.0))
    share = 100.0 * own["known"] / own["rows"] if own["rows"] else 0.0
    rows = [
        ("TEST_FIN_001", own["spend"] or 0.0, near(own["spend"], raw["spend"])), ("TEST_CARD_002", own["rows"], own["rows"] == raw["rows"]), ("TEST_FK_003", share, share >= coverage),
        ("TEST_VAL_004", raw["negative"], raw["negative"] == 0), ("TEST_PO_005", po_own, near(po_own, po)), ("TEST_MATCH_006", own["tiers"], own["tiers"] == 0), ("TEST_TENANT_007", missing, missing == 0),
        ("TEST_GAP_008", n_gaps, gap_rows[0] <= n_gaps <= gap_rows[1]),
    ]
    return usage.sparkSession.createDataFrame([(i, float(v), "PASS" if ok else "FAIL") for i, v, ok in rows], "id string, value double, status string")


def column_stats(df: DataFrame) -> DataFrame:
    """(column_name, rows, nulls, least, most) of every column, as text, in one pass."""
    df = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)) if df.columns else df
    one = df.agg(F.count("*").alias("rows"), *(x for c in df.columns for x in (F.count(c).alias(f"{c} n"), F.min(c).alias(f"{c} a"), F.max(c).alias(f"{c} b"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("rows"), (F.col("rows") - F.col(f"{c} n")).alias("nulls"), F.col(f"{c} a").alias("least"), F.col(f"{c} b").alias("most")) for c in df.columns))).alias("x")).select("x.*")

