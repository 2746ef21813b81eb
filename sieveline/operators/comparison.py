"""Two passes over the same entities, compared: verdicts, measurements and the reasons given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by `order`."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, "row.*")


def aligned(table: DataFrame, verdicts: DataFrame, key: str, predictor: str) -> DataFrame:
    """Verdicts (predictor, key, flagged) for each row of `table`; a predictor without one for some row is dropped whole."""
    wanted = table.select(key).distinct()
    met = verdicts.join(wanted, key).dropDuplicates([predictor, key])
    n = wanted.agg(F.count("*").alias("wanted"))
    whole = met.groupBy(predictor).agg(F.count("*").alias("has")).crossJoin(F.broadcast(n)).where("has = wanted").select(predictor)
    return met.join(F.broadcast(whole), predictor, "left_semi")  # a row per predictor


def metric_shift(rows: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """Medians of a metric before and after, and their difference."""
    a, b = F.percentile(before, 0.5), F.percentile(after, 0.5)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(a, 6).alias("before"), F.round(b, 6).alias("after"), F.round(b - a, 6).alias("shift"))


def context_counters(rows: DataFrame, whole: Column, alone: Column, by: list[str]) -> DataFrame:
    """Entities, how many either pass flags, how many agree, and what is lost or falsely alarmed without the context."""
    n = F.count_if
    return rows.groupBy(*by).agg(F.count("*").alias("entities"), n(whole).alias("flagged_whole"), n(alone).alias("flagged_alone"), n(whole == alone).alias("agree"), n(whole & ~alone).alias("lost"), n(alone & ~whole).alias("false_alarm"))


def moved(rows: DataFrame, features: dict[str, tuple[str, str]]) -> DataFrame:
    """Per feature how many entities both passes measured, and how many they measured differently."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), (F.col(a) != F.col(b)).alias("moved")) for k, (a, b) in features.items()])).alias("x")
    return rows.select(pairs).select("x.*").where("moved is not null").groupBy("feature").agg(F.count("*").alias("compared"), F.count_if("moved").alias("moved"))


def decisive(contributions: DataFrame, entity: list[str]) -> DataFrame:
    """Per feature how often it is the largest decisive contribution of a flagged entity, and the share of entities that have one.

    `contributions` has entity, feature, contribution, decisive: a row for each feature of each flagged entity.
    """
    first = F.max(F.when(F.col("decisive"), F.struct("contribution", "feature")))["feature"]
    per = contributions.groupBy(*entity).agg(first.alias("feature"))
    total = per.agg(F.count("*").alias("flagged"), F.count("feature").alias("explained"))
    counted = per.where("feature is not null").groupBy("feature").agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("feature", "n", "flagged", "explained", F.round(F.col("explained") / F.col("flagged"), 4).alias("share"))


def majority(rows: DataFrame, by: list[str], fold: str, truth: str) -> DataFrame:
    """The baseline that predicts, in each fold, what most of the other folds' rows are (ties: false), as counts of the confusion."""
    per = rows.groupBy(*by, fold).agg(F.count("*").alias("n"), F.count_if(truth).alias("yes"))
    w = Window.partitionBy(*by)  # a row per fold
    said = per.select(*by, fold, "n", "yes", ((F.sum("yes").over(w) - F.col("yes")) * 2 > F.sum("n").over(w) - F.col("n")).alias("said"))
    pick = lambda which, value: F.sum(F.when(F.col("said") == which, value).otherwise(0)).cast("long")
    yes, no = F.col("yes"), F.col("n") - F.col("yes")
    return said.groupBy(*by).agg(pick(True, yes).alias("tp"), pick(True, no).alias("fp"), pick(False, yes).alias("fn"), pick(False, no).alias("tn"))


def differing(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ, or that only one side has."""
    both = a.select(key, F.col(value).alias("trained")).join(b.select(key, F.col(value).alias("running")), key, "full")
    return both.where(~F.col("trained").eqNullSafe(F.col("running")))


def over_budget(files: DataFrame, by: list[str], size: Column, most_files: int, most_bytes: int) -> DataFrame:
    """Files and bytes of each target, and whether it may be scanned: a target fails closed at either bound."""
    out = files.groupBy(*by).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"))
    return out.withColumn("allowed", (F.col("files") <= most_files) & (F.coalesce("bytes", F.lit(0)) <= most_bytes))
