"""Taggers and scores over code rows: patterns, sinks, guards, proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens import dims
from quarrylens.functions import text as T


def annotate(df: DataFrame, code: str) -> DataFrame:
    return df.withColumn("sources", T.matched_kinds(code, dims.SOURCE_PATTERNS)).withColumn("dangers", T.matched_kinds(code, dims.DANGER_PATTERNS))


def score(name: str, code: str) -> Column:
    """Additive score: a telling name 2, input 1.5, a decision 2, parsing by hand 1.5, public 0.5."""
    one = lambda cond, w: F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    return (
        one(F.lower(name).rlike(dims.INTENT_NAME), 2.0)
        + one(F.col(code).rlike("req\\.body|request|payload|os\\.environ|process\\.env"), 1.5)
        + one(F.col(code).rlike("return (true|false|True|False|None|null|nil)"), 2.0)
        + one(F.size(F.regexp_extract_all(code, F.lit("\\.(split|strip|trim|replace|startswith|decode|match)\\("), F.lit(1))) >= 2, 1.5)
        + one(~F.col(name).startswith("_"), 0.5)
    )


def tier(score_col: str) -> Column:
    return F.when(F.col(score_col) >= 6, "high").when(F.col(score_col) >= 4, "medium").when(F.col(score_col) >= 2, "low").otherwise("none")


def sink_kind(code: str) -> Column:
    """Kind of the first call that is a sink; a call of several kinds has the first in the table."""
    calls = T.called_names(code)
    mapping = {n: k for k, names in reversed(dims.SINK_CALLS) for n in names}
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.get(F.filter(F.transform(calls, lambda n: table[n]), lambda k: k.isNotNull()), 0)


def near(df: DataFrame, id_col: str, code: str, sink: str, source: str, distance: int = 5) -> DataFrame:
    """Lines with a sink and the distance to the nearest line with a source, where that is at most ``distance``.

    Both are found on the row's own array of lines, so no line leaves its row unless it is a hit.
    """
    marked = df.where(F.col(code).rlike(sink) & F.col(code).rlike(source)).select(id_col, T.lines(code).alias("ls"))
    hits = lambda p: F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(p), i + 1)), lambda v: v.isNotNull())
    pairs = marked.select(id_col, F.explode(hits(sink)).alias("line"), hits(source).alias("at"))
    gap = F.array_min(F.transform("at", lambda a: F.abs(a - F.col("line"))))
    return pairs.select(id_col, F.col("line").cast("int").alias("line"), gap.cast("int").alias("gap")).where(F.col("gap") <= distance)
