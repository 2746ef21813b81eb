"""Samples matched to entities, with an explicit outcome for each, and joins of verdict tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("no_file", "syntax_errors", "no_entity", "name_mismatch", "ambiguous", "span_mismatch", "matched")


def match(samples: DataFrame, entities: DataFrame, broken_files: DataFrame) -> DataFrame:
    """Samples (sample_id, file, name, start, end) with an outcome, in this order: the file isn't there; nothing starts at
    the line (in a file with syntax errors, or else); nothing there has the name; several have; the end differs; matched.

    One join by file and line, one semi-join by file: counts decide, so a file with many entities stays spread.
    """
    here = entities.select("file", F.col("start").alias("start"), F.col("name").alias("name_"), F.col("end").alias("end_"))
    at = samples.join(here, ["file", "start"], "left")
    counts = at.groupBy("sample_id", "file", "name", "start", "end").agg(F.count("name_").alias("n_line"), F.count_if(F.col("name_") == F.col("name")).alias("n_named"), F.count_if((F.col("name_") == F.col("name")) & (F.col("end_") == F.col("end"))).alias("n_span"))
    files = entities.select("file").distinct().withColumn("has_file", F.lit(True))
    broken = broken_files.select("file").distinct().withColumn("broken", F.lit(True))
    told = counts.join(files, "file", "left").join(broken, "file", "left")
    outcome = (
        F.when(F.col("has_file").isNull(), "no_file").when((F.col("n_line") == 0) & F.col("broken").isNotNull(), "syntax_errors").when(F.col("n_line") == 0, "no_entity")
        .when(F.col("n_named") == 0, "name_mismatch").when(F.col("n_named") > 1, "ambiguous").when(F.col("n_span") == 0, "span_mismatch").otherwise("matched")
    )
    return told.select("sample_id", "file", outcome.alias("outcome"))


def breakdown(matched: DataFrame, by: str) -> DataFrame:
    """Counts of each outcome, as columns."""
    counted = matched.groupBy(by).pivot("outcome", list(OUTCOMES)).count()
    return counted.select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in OUTCOMES])


def coverage(samples: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Samples and distinct keys, in all and of those that are present, with shares (0 when empty)."""
    marked = samples.join(present.select(key).distinct().withColumn("present", F.lit(True)), key, "left").withColumn("present", F.coalesce("present", F.lit(False)))
    out = marked.agg(F.count("*").alias("samples"), F.count_if("present").alias("reachable"), F.countDistinct(key).alias("repositories"), F.countDistinct(F.when(F.col("present"), F.col(key))).alias("present"))
    return out.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("reachable"), F.col("samples")), F.lit(0.0)), 6))
