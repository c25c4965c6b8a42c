"""Running sums and previous rows of groups of any size: in slices of the order, with what the slices before add.

A slice is a column that rises with the order (an hour, a thousand ids). Slices are sorted in tasks of their own; only one row a slice
meets in the window that links them, so a group with a third of all rows is never ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _with_slices(df: DataFrame, per_slice: DataFrame, group: list[str]) -> DataFrame:
    """Rows with what their slice knows; groups may be null."""
    right = per_slice.select(*(F.col(c).alias(f"_r_{c}") for c in (*group, "_slice")), *(c for c in per_slice.columns if c not in (*group, "_slice")))
    same = df["_slice"].eqNullSafe(right["_r__slice"])
    for g in group:
        same = same & df[g].eqNullSafe(right[f"_r_{g}"])
    return df.join(right, same).drop(*(f"_r_{c}" for c in (*group, "_slice")))


def sum_before(df: DataFrame, group: list[str], order: list[str], piece: Column, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the earlier rows of the group."""
    rows = df.withColumns({"_slice": piece, "_value": value})
    totals = rows.groupBy(*group, "_slice").agg(F.sum("_value").alias("_total"))
    earlier = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, "_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    linked = _with_slices(rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))), offsets, group)
    return linked.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_slice", "_value", "_offset", "_inside")


def previous(df: DataFrame, group: list[str], order: list[str], piece: Column, columns: list[str], name: str) -> DataFrame:
    """Adds ``name``: a struct of ``columns`` of the row before in the group, null for the first."""
    rows = df.withColumn("_slice", piece)
    last = rows.groupBy(*group, "_slice").agg(F.max(F.struct(*order, F.struct(*columns).alias("kept"))).alias("_last"))
    before = F.lag("_last.kept").over(W.partitionBy(*group).orderBy("_slice"))
    ends = last.select(*group, "_slice", before.alias("_earlier"))
    inside = F.lag(F.struct(*columns)).over(W.partitionBy(*group, "_slice").orderBy(*order))
    linked = _with_slices(rows.withColumn("_inside", inside), ends, group)
    return linked.withColumn(name, F.coalesce("_inside", "_earlier")).drop("_slice", "_inside", "_earlier")
