"""Differences of sets and multisets, counted changes between texts, and overlapping edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def multiset_change(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per key its count before and after, and how many were removed, introduced and kept."""
    both = before.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a")))
    n = both.groupBy(*keys).agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
    return n.withColumns({"removed": F.greatest(F.col("before") - F.col("after"), F.lit(0)), "introduced": F.greatest(F.col("after") - F.col("before"), F.lit(0)), "kept": F.least("before", "after")})


def introduced(old: Column, new: Column) -> Column:
    """Members that are new; none if either side is null."""
    return F.when(old.isNull() | new.isNull(), F.array().cast("array<string>")).otherwise(F.sort_array(F.array_except(new, old)))


def conflicts(edits: DataFrame, key: str) -> DataFrame:
    """Edits (key, start, end) that overlap the one before them; two insertions do at the same offset only.

    Sorted by start, an edit overlaps an earlier one if it starts before the greatest end so far.
    """
    order = Window.partitionBy(key).orderBy("start", "end")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    furthest, same = F.max("end").over(earlier), (F.lag("start").over(order) == F.col("start")) & (F.lag("end").over(order) == F.col("end")) & (F.col("start") == F.col("end"))
    return edits.withColumn("conflict", F.coalesce((F.col("start") < furthest) & (F.col("end") > F.col("start")), F.lit(False)) | F.coalesce(same, F.lit(False)) | F.coalesce((F.col("start") == F.col("end")) & (F.col("start") < furthest), F.lit(False)))


def context(lines: DataFrame, key: str, at: str, changed: str, around: int) -> DataFrame:
    """Lines within so many of a changed one."""
    near = Window.partitionBy(key).orderBy(at).rowsBetween(-around, around)
    return lines.withColumn("shown", F.max(F.col(changed).cast("int")).over(near) == 1).where("shown")
