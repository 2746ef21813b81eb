"""Threshold sweeps, calibration over folds, bootstrap intervals and reweighted rates.

Sweeps and bootstraps are one job: every configuration (or draw) is a column of conditional sums, or a row of a short
table that the pre-aggregated cells are joined to. The rows themselves are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import scores


def sweep(rows: DataFrame, by: list[str], fired: dict[str, Column], truth: Column) -> DataFrame:
    """Counts and scores of every named configuration per group, from one pass: by, config, tp .. mcc."""
    cells = [c.alias(f"{name}__{k}") for name, f in fired.items() for k, c in zip(scores.COUNTS, scores.confusion(truth, f), strict=True)]
    wide = rows.groupBy(*by).agg(*cells)
    long = wide.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("config"), *[F.col(f"{n}__{k}").alias(k) for k in scores.COUNTS]) for n in fired])))
    return long.select(*by, "config", *scores.COUNTS, *scores.all_scores())


def folds(groups: DataFrame, key: str, k: int) -> DataFrame:
    """Groups dealt to folds by their place in order. Groups are few beside rows; they are distinct first."""
    return groups.select(key).distinct().withColumn("fold", ((F.dense_rank().over(Window.orderBy(key)) - 1) % k).cast("long"))


def calibrated(rows: DataFrame, group: str, by: list[str], fired: dict[str, Column], truth: Column, k: int) -> DataFrame:
    """Per group and fold, the configuration of greatest MCC on the other folds (the first such), and its counts on this one."""
    dealt = rows.join(folds(rows, group, k), group)
    per = sweep(dealt, [*by, "fold"], fired, truth).select(*by, "fold", "config", *scores.COUNTS)
    total = Window.partitionBy(*by, "config")
    rest = per
    for c in scores.COUNTS:
        rest = rest.withColumn(f"own_{c}", F.col(c)).withColumn(c, F.sum(c).over(total) - F.col(c))
    position = F.array_position(F.array(*map(F.lit, fired)), F.col("config"))
    best = rest.withColumn("mcc", F.round(scores.mcc(), 9)).withColumn("place", F.row_number().over(Window.partitionBy(*by, "fold").orderBy(F.desc_nulls_last("mcc"), position)))
    return best.where("place = 1").select(*by, "fold", "config", *[F.col(f"own_{c}").alias(c) for c in scores.COUNTS])


def resampled(cells: DataFrame, group: str, draws: DataFrame) -> DataFrame:
    """`cells` (group, tp..tn) under `draws` (draw, group, weight): MCC of every draw. Groups without rows weigh nothing."""
    summed = draws.join(cells, group).groupBy("draw").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in scores.COUNTS])
    return summed.select("draw", *scores.COUNTS, scores.mcc().alias("mcc"))


def interval(values: DataFrame, column: str) -> DataFrame:
    """Median, 2.5 and 97.5 percentiles (linear), and the share over 0, of values that are defined."""
    p = F.percentile(column, [0.025, 0.5, 0.975])
    return values.where(F.col(column).isNotNull()).agg(F.count("*").alias("draws"), p.alias("p"), F.avg((F.col(column) > 0).cast("double")).alias("above")).select(
        "draws", F.round(F.get("p", 0), 6).alias("low"), F.round(F.get("p", 1), 6).alias("median"), F.round(F.get("p", 2), 6).alias("high"), F.round("above", 6).alias("above"))


def bootstrap_draws(spark, groups: list, draws: int, seed: int) -> DataFrame:
    """(draw, group, weight) as numpy's generator draws groups with replacement; groups are few (hundreds), draws thousands."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    out = []
    for k in range(draws):
        at, n = np.unique(rng.integers(0, len(groups), len(groups)), return_counts=True)
        out.append(pd.DataFrame({"draw": k, "group": [groups[i] for i in at], "weight": n}))
    return spark.createDataFrame(pd.concat(out))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes * n_class) per class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # a row per class
    return counts.select(label, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def greedy_folds(sizes: list[tuple[str, int]], k: int) -> dict[str, int]:
    """Groups, largest first, each to the fold with the fewest rows so far."""
    load = [0] * min(k, max(1, len(sizes)))
    out = {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        at = load.index(min(load))
        out[name] = at
        load[at] += n
    return out


def paired_differences(cells: DataFrame, group: str, draws: DataFrame, predictor: str, reference: str) -> DataFrame:
    """Intervals of the reference's MCC less each other predictor's, on the same draws.

    `cells` has predictor, group and tp..tn. A draw in which either score isn't defined is dropped for that difference.
    """
    summed = draws.join(cells, group).groupBy(predictor, "draw").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in scores.COUNTS])
    scored = summed.select(predictor, "draw", scores.mcc().alias("mcc")).where("mcc is not null")
    base = scored.where(F.col(predictor) == reference).select("draw", F.col("mcc").alias("base"))
    rows = scored.where(F.col(predictor) != reference).join(base, "draw").withColumn("difference", F.col("base") - F.col("mcc"))
    p = F.percentile("difference", [0.025, 0.5, 0.975])
    out = rows.groupBy(predictor).agg(F.count("*").alias("draws"), p.alias("p"), F.avg((F.col("difference") > 0).cast("double")).alias("above"))
    low, high = F.round(F.get("p", 0), 6), F.round(F.get("p", 2), 6)
    return out.select(predictor, "draws", low.alias("low"), F.round(F.get("p", 1), 6).alias("median"), high.alias("high"), F.round("above", 6).alias("above"), ((low > 0) | (high < 0)).alias("excludes_zero"))
