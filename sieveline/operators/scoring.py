"""Labels from reviews, scores of predictions against them, and agreement between raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import scores


def aggregated(reviews: DataFrame) -> DataFrame:
    """Per (sample, smell) the number of reviews and the severity rank by mean (half up), max, min and unanimity (null if they differ)."""
    rank = F.col("rank")
    return reviews.groupBy("sample_id", "smell").agg(
        F.count(rank).alias("reviews"), F.floor(F.sum(rank) / F.count(rank) + 0.5).alias("mean"), F.max(rank).alias("max"), F.min(rank).alias("min"),
        F.when(F.min(rank) == F.max(rank), F.min(rank)).alias("unanimous"),
    )


def scored(rows: DataFrame, by: list[str], truth: str = "truth", predicted: str = "predicted", digits: int = 6) -> DataFrame:
    """Counts and scores per group."""
    return rows.groupBy(*by).agg(*scores.confusion(F.col(truth), F.col(predicted))).select(*by, *scores.COUNTS, *scores.all_scores(digits))


def paired(reviews: DataFrame) -> DataFrame:
    """Both orders of every two reviews of a sample, as (first, second) verdicts "smelly"; a sample has few reviewers.

    Reviews of a sample are counted by verdict first, so a sample costs four rows whatever the number of its reviews.
    """
    n = reviews.groupBy("sample_id", "smell").agg(F.count_if(F.col("rank") > 0).alias("yes"), F.count_if(F.col("rank") == 0).alias("no"))
    cells = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), c.cast("long").alias("pairs")) for a, b, c in (
        (True, True, F.col("yes") * (F.col("yes") - 1)), (True, False, F.col("yes") * F.col("no")), (False, True, F.col("yes") * F.col("no")), (False, False, F.col("no") * (F.col("no") - 1)))])
    return n.select("smell", F.inline(cells)).where("pairs > 0")


def weighted_kappa(rows: DataFrame, first: str, second: str, levels: int, by: list[str]) -> DataFrame:
    """Quadratic weights; null without rows or without expected disagreement. From margins: sum of w*o over sum of w*r*c."""
    a, b = F.col(first).cast("double"), F.col(second).cast("double")
    n = F.count("*").cast("double")
    seen = F.sum((a - b) * (a - b)) / n
    # E (A-B)^2 for independent A and B of the same margins.
    chance = F.sum(a * a) / n + F.sum(b * b) / n - 2 * (F.sum(a) / n) * (F.sum(b) / n)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(1 - F.try_divide(seen, F.round(chance, 12)), 6).alias("kappa"))


def severity_matrix(rows: DataFrame, first: str, second: str, levels: list[int]) -> DataFrame:
    """Counts for every cell, zeros included."""
    counts = rows.groupBy(F.col(first).cast("long").alias("first"), F.col(second).cast("long").alias("second")).agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    cells = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in levels])).alias("first")).select("first", F.explode(F.array(*[F.lit(x).cast("long") for x in levels])).alias("second"))
    return cells.join(counts, ["first", "second"], "left").select("first", "second", F.coalesce("n", F.lit(0)).alias("n"))


def nearest_rank(values: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """v[min(n-1, int(q*n))] of the sorted values of each group (nulls first).

    Values are counted in part by every task, so only a group's distinct values are ranked within one task.
    """
    w = Window.partitionBy(*by)
    cells = values.groupBy(*by, value).agg(F.count("*").alias("here_"))
    upto = F.sum("here_").over(w.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = cells.withColumn("upto_", upto).withColumn("n_", F.sum("here_").over(w))
    place = lambda q: F.least(F.col("n_") - 1, F.floor(F.lit(q) * F.col("n_")))
    at = lambda q: F.max(F.when((place(q) >= F.col("upto_") - F.col("here_")) & (place(q) < F.col("upto_")), F.col(value)))
    return ranked.groupBy(*by).agg(*[at(q).alias(k) for k, q in shares.items()])


def separation(values: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """Mann-Whitney AUC, ties half: from counts per distinct value and running totals of them."""
    cells = values.groupBy(*by, value).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = cells.withColumn("won", F.col("p") * (below + F.col("q") / 2.0))
    return wins.groupBy(*by).agg(F.round(F.try_divide(F.sum("won").cast("double"), F.sum("p").cast("double") * F.sum("q")), 9).alias("auc"))
