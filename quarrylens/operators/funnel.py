"""Narrowing candidates: caps, latest verdicts, running budgets, gates, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens import dims
from quarrylens.operators import running


def cap_per(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group; the limit is pushed below the exchange by the planner."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key as one aggregate (no sort): the largest struct of the order columns."""
    rest = [c for c in df.columns if c not in (key, *order)]
    best = F.max(F.struct(*order, *rest)).alias("best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *(F.col(f"best.{c}") for c in (*order, *rest)))


def running_budget(df: DataFrame, group: str, order: list[str], cost: str, limit: int, piece: Column, warn: float = 0.8) -> DataFrame:
    """What was spent before each row, whether it still runs (the row that crosses the limit does) and whether it warns. ``piece`` rises with the order."""
    return running.sum_before(df, [group], order, piece, F.col(cost), "spent_before").withColumn("runs", F.col("spent_before") < limit).withColumn(
        "warns", F.col("spent_before") >= limit * warn
    )


def severity(score: str) -> Column:
    c = F.col(score)
    return F.when(c.isNull(), "unknown").when(c >= 9, "critical").when(c >= 7, "high").when(c >= 4, "medium").otherwise("low")


def severity_rank(name: str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in dims.SEVERITY_RANK.items() for x in kv))
    return F.coalesce(table[F.lower(name)], F.lit(1))


def first_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in order of priority; of rows with one key the earliest part's smallest wins."""
    tagged = None
    for i, p in enumerate(parts):
        p = p.withColumn("priority", F.lit(i))
        tagged = p if tagged is None else tagged.unionByName(p, allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in (*key, "priority")]
    return tagged.groupBy(*key).agg(F.min(F.struct("priority", *rest)).alias("b")).select(*key, "b.priority", *(F.col(f"b.{c}") for c in rest))
