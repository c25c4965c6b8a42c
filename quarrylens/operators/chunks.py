"""Cutting code into rows: line windows, numbered snippets, brace blocks, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens import dims
from quarrylens.functions import text as T
from quarrylens.operators import running


def line_windows(df: DataFrame, id_col: str, code: str, size: int = dims.CHUNK_WINDOW, overlap: int = dims.CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` lines that overlap; blank ones are dropped, the number counts the others. Narrow: no shuffle.

    The windows of a value are built as an array, so their numbers need no window function.
    """
    step = size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("ls") - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + overlap < F.size("ls")))
    piece = F.transform(starts, lambda s: F.struct(
        (s + 1).alias("start_line"), F.least(s + size, F.size("ls")).alias("end_line"), F.array_join(F.slice("ls", s + 1, size), "\n").alias("chunk")
    ))
    kept = F.filter(piece, lambda p: F.length(F.trim(F.regexp_replace(p.chunk, "[ \\t\\n]", ""))) > 0)
    cut = df.where(F.col(code).isNotNull()).select(id_col, T.lines(code).alias("ls")).select(id_col, F.posexplode(kept).alias("chunk_no", "p"))
    return cut.select(id_col, "chunk_no", "p.start_line", "p.end_line", "p.chunk")


def snippets(df: DataFrame, id_col: str, code: str, pattern: str, around: int = 2) -> DataFrame:
    """The first line that matches with ``around`` lines on both sides, numbered."""
    numbered = F.transform("ls", lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    hit = F.array_position(F.transform("ls", lambda x: x.rlike(pattern)), True)
    base = df.where(F.col(code).rlike(pattern)).select(id_col, T.lines(code).alias("ls")).withColumn("line", hit.cast("int")).where("line > 0")
    first = F.greatest(F.col("line") - around, F.lit(1))
    return base.select(
        id_col, "line", F.array_join(F.slice(numbered, first, F.col("line") + around - first + 1), "\n").alias("snippet")
    )


def brace_blocks(df: DataFrame, id_col: str, code: str, most: int = 60) -> DataFrame:
    """Lines until the braces opened so far are closed again, at most ``most``."""
    opened = lambda x: F.length(x) - F.length(F.regexp_replace(x, "\\{", ""))
    closed = lambda x: F.length(x) - F.length(F.regexp_replace(x, "\\}", ""))
    state = F.aggregate(
        F.slice("ls", 1, most),
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("begun"), F.lit(0).alias("n"), F.lit(False).alias("done")),
        lambda s, x: F.when(s.done, s).otherwise(F.struct(
            (s.depth + opened(x) - closed(x)).alias("depth"), (s.begun | (opened(x) > 0)).alias("begun"), (s.n + 1).alias("n"),
            ((s.begun | (opened(x) > 0)) & (s.depth + opened(x) - closed(x) <= 0)).alias("done"),
        )),
    )
    return df.where(F.col(code).contains("{")).select(id_col, T.lines(code).alias("ls")).withColumn("s", state).select(
        id_col, F.col("s.n").alias("block_lines"), F.col("s.done").alias("closed")
    )


def within_budget(df: DataFrame, group: str, order: list[str], size: str, budget: int, piece: Column) -> DataFrame:
    """Rows of each group, in order, until the running size exceeds the budget; the row that crosses it still counts. ``piece`` rises with the order."""
    return running.sum_before(df, [group], order, piece, F.col(size), "used_before").where(F.col("used_before") < budget)
