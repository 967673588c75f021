"""Guardrail operators over whole tables."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..sources.shared import written


def price_bounds(df: DataFrame, keys: list[str], price: str) -> DataFrame:
    """(keys, low, middle, high): Tukey's fences of positive prices; with under four prices 0, the least and ten times it."""
    q = df.where(F.col(price) > 0).groupBy(*keys).agg(F.percentile(price, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"), F.min(price).alias("one"))
    iqr = F.col("q")[2] - F.col("q")[0]
    few = F.col("n") < 4
    return q.select(
        *keys, F.when(few, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("q")[0] - 1.5 * iqr)).alias("low"),
        F.when(few, F.col("one")).otherwise(F.col("q")[1]).alias("middle"), F.when(few, F.col("one") * 10).otherwise(F.col("q")[2] + 1.5 * iqr).alias("high"),
    )


def net_returns(rows: DataFrame, case: str, item: str, quantity: str, row_id: str, tolerance: float = 0.001) -> DataFrame:
    """(row_id, state, partner): in order of row_id, each purchase takes the first return of its case, item and amount that is left; one
    without case takes the first of any case. Amounts are equal within the tolerance.

    Where no purchase without case and no two different amounts meet, the n-th purchase of a case goes with its n-th return, by row
    numbers of (case, item, amount), so a popular item is split by case. Only items and amounts where they do meet are gone
    through in order, by rows that can find a partner: of each case and amount, purchases up to the number of the case's returns.

    The rows are written once; each is shuffled once to its case and gets its state there, those without returns not at all.
    """
    amount = F.abs(F.coalesce(F.col(quantity).cast("double"), F.lit(0.0)))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sign = F.when(F.col(quantity) < 0, -1).otherwise(1)
    x = written(rows.select(F.col(row_id).alias("row_id"), blank(case).alias("case"), blank(item).alias("item"), amount.alias("amount"), sign.alias("sign")), "netting")
    near = x.groupBy("item", "amount").agg(F.count_if(F.col("sign") < 0).alias("back"), F.count_if((F.col("sign") > 0) & (F.col("case") == "")).alias("wild"))
    by_amount = W.partitionBy("item").orderBy("amount")
    start = F.when(F.col("amount") - F.lag("amount").over(by_amount) < tolerance, 0).otherwise(1)
    near = near.withColumn("start", start).withColumn("cluster", F.sum("start").over(by_amount))
    facts = near.groupBy("item", "cluster").agg(F.sum("back").alias("back"), F.sum("wild").alias("wild"), F.count("*").alias("amounts"))
    facts = near.select(F.col("item").alias("i"), F.col("amount").alias("a"), F.col("cluster").alias("c")).join(facts.where("back > 0"), (F.col("i") == F.col("item")) & (F.col("c") == F.col("cluster")))
    facts = facts.select("i", "a", "cluster", ((F.col("wild") > 0) | (F.col("amounts") > 1)).alias("meet"))
    facts = written(facts, "amounts")
    at = (F.col("item") == F.col("i")) & (F.col("amount") == F.col("a"))
    key = ["item", "cluster", "case"]
    none = F.lit(None).cast(dict(x.dtypes)["row_id"])
    alone = x.join(facts, at, "left_anti").select("row_id", none.alias("partner"))
    x = x.join(facts, at).drop("i", "a")
    plain = x.where("not meet").repartition(*key)  # one amount in a cluster
    plain = plain.withColumn("n", F.row_number().over(W.partitionBy(*key, "sign").orderBy("row_id")))
    of_sign = lambda s: F.max(F.when(F.col("sign") == s, F.col("row_id"))).over(W.partitionBy(*key, "n"))
    plain = plain.select("row_id", F.when(F.col("sign") > 0, of_sign(-1)).otherwise(of_sign(1)).alias("partner"))
    met = x.where("meet").repartition(*key).withColumn("n", F.row_number().over(W.partitionBy(*key, "amount", "sign").orderBy("row_id")))
    # of a case with k returns the first k purchases of an amount can find one; of those without case, as many as there are returns
    returns = x.where("meet and sign < 0")
    most = returns.groupBy(*key).agg(F.count("*").alias("k")).unionByName(returns.groupBy("item", "cluster").agg(F.count("*").alias("k")).withColumn("case", F.lit("")))
    met = met.join(most.groupBy(*key).agg(F.max("k").alias("k")), key, "left")
    able = (F.col("sign") < 0) | F.coalesce(F.col("n") <= F.col("k"), F.lit(False))
    idle = met.where(~able).select("row_id", none.alias("partner"))
    found = met.where(able).drop("n", "k").groupBy("item", "cluster").applyInPandas(_in_order(tolerance), f"row_id {dict(x.dtypes)['row_id']}, partner {dict(x.dtypes)['row_id']}")
    out = alone.unionByName(plain).unionByName(idle).unionByName(found)
    return out.select(F.col("row_id").alias(row_id), F.when(F.col("partner").isNotNull(), "NETTED").otherwise("ACTIVE").alias("state"), "partner")


def _in_order(tolerance: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """(row_id, partner) of the rows of one item and cluster of amounts, both ways; partner is null where none is left."""
        group = group.sort_values("row_id")
        queues: dict[tuple, deque] = {}  # of returns by case and amount, and by amount alone
        back = group[group["sign"] < 0]
        for place, (row, case, amount) in enumerate(zip(back["row_id"], back["case"], back["amount"], strict=True)):
            queues.setdefault((case, amount), deque()).append((place, row))
            queues.setdefault((None, amount), deque()).append((place, row))
        amounts, gone, out = sorted(set(back["amount"])), set(), []
        taken = [None] * len(back)
        buys = group[group["sign"] > 0]
        for row, case, amount in zip(buys["row_id"], buys["case"], buys["amount"], strict=True):
            first = None
            for i in range(bisect_left(amounts, amount - tolerance), len(amounts)):
                if amounts[i] - amount >= tolerance:
                    break
                queue = queues.get((case or None, amounts[i]), ())
                while queue and queue[0][0] in gone:
                    queue.popleft()
                if queue and abs(amounts[i] - amount) < tolerance and (first is None or queue[0] < first[0]):
                    first = queue[0], queue
            if first:
                gone.add(first[0][0])
                taken[first[0][0]] = row
            out.append((row, first[0][1] if first else None))
        out.extend(zip(back["row_id"], taken, strict=True))
        return pd.DataFrame(out, columns=["row_id", "partner"], dtype=object)

    return run


def assess(df: DataFrame, paid: str, contract: str, unit: str) -> DataFrame:
    """All guardrails of a line as columns, in one pass."""
    p, c = F.col(paid), F.col(contract)
    return df.withColumns({"pack": P.pack_factor(F.col(unit)), "multiple": P.pack_mismatch(p, c), "spike": P.spike(p, c), "sanity": P.sanity(p, c)})


def column_tests(df: DataFrame, not_null: list[str], unique: list[str], accepted: dict[str, list[str]]) -> DataFrame:
    """(test, failures)."""
    simple = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"not_null_{c}") for c in not_null), *(F.count_if(~F.col(c).isin(v)).alias(f"accepted_{c}") for c, v in accepted.items()))
    names = simple.columns
    out = [simple.select(F.explode(F.array(*(F.struct(F.lit(n).alias("test"), F.col(n).alias("failures")) for n in names))).alias("x")).select("x.*")] if names else []
    for c in unique:
        twice = df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1")
        out.append(twice.agg(F.lit(f"unique_{c}").alias("test"), F.count("*").alias("failures")))
    return reduce(DataFrame.unionAll, out)
