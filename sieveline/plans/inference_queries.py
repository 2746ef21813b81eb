"""Sweeps, calibration, bootstrap, misses and the clauses that block them, and rates over strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import scores
from sieveline.functions.clauses import clause, satisfied
from sieveline.operators import inference
from sieveline.plans.registry import query
from sieveline.plans.scoring_queries import CELLS_SQL, SCORES_SQL
from sieveline.sources import binding
from sieveline.sources.binding import table, with_sql

#: Knob and factor of every configuration of a sweep, in order.
LIMITS = {"value": (50_000, 100_000, 150_000, 200_000, 250_000), "measured": (1, 2, 3)}
CONFIGS = {f"{knob}>={limit}": (knob, limit) for knob, limits in LIMITS.items() for limit in limits}


def fired() -> dict[str, Column]:
    return {name: F.col(knob) >= limit for name, (knob, limit) in CONFIGS.items()}


_GRID = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{k}', {v})" for i, (n, (k, v)) in enumerate(CONFIGS.items())) + ") AS t(pos, config, knob, lim))"
_SWEPT = with_sql("judged") + f", {_GRID}, s AS (SELECT smell, repository, pos, config, knob, lim, truth, CASE knob WHEN 'value' THEN value ELSE measured END >= lim AS predicted FROM judged, grid)"
_MCC = "(tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0)"


@query(f"{_SWEPT}, c AS (SELECT smell, config, {CELLS_SQL} FROM s GROUP BY ALL) SELECT smell, config, {SCORES_SQL} FROM c")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return inference.sweep(binding.judged(spark, d), ["smell"], fired(), F.col("truth"))


@query(f"{_SWEPT}, c AS (SELECT smell, knob, lim, {CELLS_SQL} FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY smell ORDER BY round({_MCC}, 6) DESC NULLS LAST, knob DESC, lim DESC) AS rn FROM c) SELECT smell, knob, lim::DOUBLE AS lim, round({_MCC}, 6) AS mcc FROM r WHERE rn = 1")
def best_swept(spark: SparkSession, d: str) -> DataFrame:
    swept = inference.sweep(binding.judged(spark, d), ["smell"], fired(), F.col("truth")).where("mcc is not null")
    knob, lim = F.split_part("config", F.lit(">="), F.lit(1)), F.split_part("config", F.lit(">="), F.lit(2)).cast("double")
    return swept.groupBy("smell").agg(F.max(F.struct("mcc", knob.alias("knob"), lim.alias("lim"))).alias("b")).select("smell", "b.knob", "b.lim", "b.mcc")


@query(f"{_SWEPT}, c AS (SELECT smell, pos, config, {CELLS_SQL} FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY smell ORDER BY round({_MCC}, 6) DESC NULLS LAST, pos) AS rn FROM c) SELECT smell, config AS model, round({_MCC}, 6) AS mcc FROM r WHERE rn = 1")
def best_model(spark: SparkSession, d: str) -> DataFrame:
    swept = inference.sweep(binding.judged(spark, d), ["smell"], fired(), F.col("truth"))
    place = F.row_number().over(Window.partitionBy("smell").orderBy(F.desc_nulls_last("mcc"), F.array_position(F.array(*map(F.lit, CONFIGS)), F.col("config"))))
    return swept.withColumn("place", place).where("place = 1").select("smell", F.col("config").alias("model"), "mcc")


@query(with_sql("judged") + "SELECT repository, (dense_rank() OVER (ORDER BY repository) - 1) % 5 AS fold FROM (SELECT DISTINCT repository FROM judged)")
def fold_of(spark: SparkSession, d: str) -> DataFrame:
    return inference.folds(binding.judged(spark, d), "repository", 5)


@query(f"""{_SWEPT}, f AS (SELECT repository, (dense_rank() OVER (ORDER BY repository) - 1) % 5 AS fold FROM (SELECT DISTINCT repository FROM judged)), p AS (SELECT smell, fold, pos, config, truth, predicted FROM s JOIN f USING (repository)),
    t AS (SELECT p.smell, o.fold, pos, config, {CELLS_SQL} FROM p JOIN (SELECT DISTINCT smell, fold FROM p) o ON o.smell = p.smell AND o.fold <> p.fold GROUP BY p.smell, o.fold, pos, config),
    b AS (SELECT *, row_number() OVER (PARTITION BY smell, fold ORDER BY round({_MCC}, 9) DESC NULLS LAST, pos) AS rn FROM t),
    own AS (SELECT smell, fold, config, {CELLS_SQL} FROM p GROUP BY ALL) SELECT own.smell, own.fold, own.config, own.tp, own.fp, own.fn, own.tn FROM b JOIN own USING (smell, fold, config) WHERE rn = 1""")
def calibrate(spark: SparkSession, d: str) -> DataFrame:
    return inference.calibrated(binding.judged(spark, d), "repository", ["smell"], fired(), F.col("truth"), 5)


@query("SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 9) AS weight FROM labels GROUP BY quality")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return inference.balanced_weights(table(spark, d, "labels"), "quality").withColumn("weight", F.round("weight", 9))


_WILSON = """round(coalesce(greatest((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 0), 0), 6) AS low,
    round(coalesce(least((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 1), 1), 6) AS high"""


@query(with_sql("judged") + f", c AS (SELECT smell, repository, count(*) FILTER (truth) AS good, count(*)::DOUBLE AS n FROM judged GROUP BY ALL), q AS (SELECT *, good / n AS p FROM c) SELECT smell, repository, good, n::BIGINT AS n, {_WILSON} FROM q")
def wilson(spark: SparkSession, d: str) -> DataFrame:
    rows = binding.judged(spark, d).groupBy("smell", "repository").agg(F.count_if("truth").alias("good"), F.count("*").alias("n"))
    low, high = scores.wilson(F.col("good"), F.col("n"))
    return rows.select("smell", "repository", "good", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(with_sql("judged") + """, s AS (SELECT smell, count(*) AS size FROM judged GROUP BY smell), j AS (SELECT smell, count(*) AS judged, count(*) FILTER (truth) AS ok FROM judged WHERE key % 7 = 0 GROUP BY smell)
    SELECT round(sum(size * ok / judged) / sum(size), 6) AS rate, sum(judged)::BIGINT AS judged FROM s JOIN j USING (smell)""")
def reweighted_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = binding.judged(spark, d)
    strata = rows.groupBy("smell").agg(F.count("*").alias("size"), F.count_if(F.col("key") % 7 == 0).alias("judged"), F.count_if((F.col("key") % 7 == 0) & F.col("truth")).alias("ok")).where("judged > 0")
    return strata.agg(F.round(F.try_divide(F.sum(F.col("size") * F.col("ok") / F.col("judged")), F.sum("size")), 6).alias("rate"), F.sum("judged").alias("judged"))


@query("""WITH v AS (SELECT o_orderpriority AS verdict, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS accepted FROM orders GROUP BY 1)
    SELECT p.verdict, coalesce(v.n, 0) AS n, coalesce(v.accepted, 0) AS accepted FROM (SELECT DISTINCT o_orderpriority AS verdict FROM orders UNION SELECT 'unknown') p LEFT JOIN v ON v.verdict = p.verdict""")
def accept_by_verdict(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    verdicts = orders.select(F.col("o_orderpriority").alias("verdict")).union(spark.range(1).select(F.lit("unknown"))).distinct()
    counted = orders.groupBy(F.col("o_orderpriority").alias("verdict")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("accepted"))
    return verdicts.join(counted, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accepted", F.lit(0)).alias("accepted"))


def blocking(rows: DataFrame) -> DataFrame:
    """Missed positives with the clauses that failed, in order, and how near each came (at most 1)."""
    clauses = F.array(clause("VALUE", ">", 200_000, F.col("value")), clause("MEASURED", ">=", 2, F.col("measured")), clause("REVIEWED", ">", 1, F.col("reviewed")))
    failed = F.filter(clauses, lambda c: ~satisfied(c))
    near = F.transform(failed, lambda c: F.struct(c["metric"].alias("metric"), F.round(c["value"] / c["threshold"], 4).alias("ratio")))
    return rows.where("truth").select("key", "smell", near.alias("failed")).where(F.size("failed") > 0)


_BLOCKED = with_sql("judged") + """, f AS (SELECT key, smell, list_filter([{'metric': 'VALUE', 'ratio': CASE WHEN NOT value > 200000 THEN round(value / 200000, 4) END}, {'metric': 'MEASURED', 'ratio': CASE WHEN NOT measured >= 2 THEN round(measured / 2, 4) END},
    {'metric': 'REVIEWED', 'ratio': CASE WHEN NOT reviewed > 1 THEN round(reviewed / 1.0::DOUBLE, 4) END}], lambda c: c.ratio IS NOT NULL) AS failed FROM judged WHERE truth), b AS (SELECT * FROM f WHERE len(failed) > 0)"""


@query(_BLOCKED + " SELECT key, smell, array_to_string(list_transform(failed, lambda c: c.metric), ',') AS metrics, round(list_sum(list_transform(failed, lambda c: c.ratio)), 4) AS ratios FROM b")
def blocking_misses(spark: SparkSession, d: str) -> DataFrame:
    b = blocking(binding.judged(spark, d))
    return b.select("key", "smell", F.array_join(F.transform("failed", lambda c: c["metric"]), ",").alias("metrics"), F.round(F.aggregate("failed", F.lit(0.0), lambda a, c: a + c["ratio"]), 4).alias("ratios"))


@query(_BLOCKED + """ SELECT smell, count(*) AS missed, count(*) FILTER (len(failed) = 1) AS by_one, count(*) FILTER (len(failed) = 1 AND failed[1].metric = 'VALUE') AS by_value,
    round(quantile_cont(CASE WHEN failed[1].metric = 'VALUE' THEN failed[1].ratio END, 0.5), 6) AS median_value FROM b GROUP BY smell""")
def blocking_summary(spark: SparkSession, d: str) -> DataFrame:
    first, one = F.get("failed", 0), F.size("failed") == 1
    return blocking(binding.judged(spark, d)).groupBy("smell").agg(
        F.count("*").alias("missed"), F.count_if(one).alias("by_one"), F.count_if(one & (first["metric"] == "VALUE")).alias("by_value"),
        F.round(F.percentile(F.when(first["metric"] == "VALUE", first["ratio"]), 0.5), 6).alias("median_value"))


@query(with_sql("judged") + f""", cells AS (SELECT repository, {CELLS_SQL} FROM judged GROUP BY repository), w AS (SELECT d AS draw, repository, (repository * 7 + d * d) % 3 AS weight, tp, fp, fn, tn FROM cells, range(0, 50) AS r(d)),
    c AS (SELECT draw, sum(tp * weight) AS tp, sum(fp * weight) AS fp, sum(fn * weight) AS fn, sum(tn * weight) AS tn FROM w GROUP BY draw)
    SELECT draw, round({_MCC}, 6) AS mcc FROM c""")
def bootstrap_given(spark: SparkSession, d: str) -> DataFrame:
    """Draws with stated weights, so that SQL can make them as well."""
    cells = binding.judged(spark, d).groupBy("repository").agg(*scores.confusion(F.col("truth"), F.col("predicted")))
    draws = cells.select("repository", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("draw")).withColumn("weight", (F.col("repository") * 7 + F.col("draw") * F.col("draw")) % 3)
    return inference.resampled(cells, "repository", draws).select("draw", F.round("mcc", 6).alias("mcc"))


@query()
def bootstrap_mcc(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the MCC per smell over 200 draws of repositories with replacement."""
    cells = binding.judged(spark, d).groupBy("repository").agg(*scores.confusion(F.col("truth"), F.col("predicted")))
    groups = [r["repository"] for r in cells.select("repository").distinct().orderBy("repository").collect()]
    draws = inference.bootstrap_draws(spark, groups, 200, 20260826).withColumnRenamed("group", "repository")
    return inference.interval(inference.resampled(cells, "repository", draws), "mcc")


@query()
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Repositories dealt to five folds of even size, largest first."""
    sizes = [(r["repository"], r["n"]) for r in binding.judged(spark, d).groupBy("repository").agg(F.count("*").alias("n")).collect()]
    return spark.createDataFrame(sorted(inference.greedy_folds(sizes, 5).items()), "repository long, fold int")
