"""Labels from reviews, scores against them, agreement, and what separates misses from hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import scores
from sieveline.functions.clauses import severity_name
from sieveline.operators import scoring
from sieveline.plans.registry import query
from sieveline.sources import binding
from sieveline.sources.binding import with_sql

SCORES_SQL = """tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
    round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy,
    round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc"""
CELLS_SQL = "count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn, count(*) FILTER (NOT truth AND NOT predicted) AS tn"
AGGREGATED_SQL = with_sql("reviews") + """, agg AS (SELECT sample_id, smell, count(rank) AS reviews, floor(sum(rank) / count(rank) + 0.5)::BIGINT AS mean, max(rank) AS max, min(rank) AS min,
    CASE WHEN min(rank) = max(rank) THEN min(rank) END AS unanimous FROM reviews GROUP BY sample_id, smell)"""


@query(AGGREGATED_SQL + " SELECT sample_id, smell, reviews, mean, max, min, unanimous, ['none', 'minor', 'major', 'critical'][mean + 1] AS severity FROM agg")
def severity_aggregation(spark: SparkSession, d: str) -> DataFrame:
    return scoring.aggregated(binding.reviews(spark, d)).withColumn("severity", severity_name(F.col("mean")))


@query(with_sql("judged") + f"SELECT smell, {CELLS_SQL} FROM judged GROUP BY smell")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return binding.judged(spark, d).groupBy("smell").agg(*scores.confusion(F.col("truth"), F.col("predicted")))


@query(with_sql("judged") + f", c AS (SELECT smell, repository, {CELLS_SQL} FROM judged GROUP BY smell, repository) SELECT smell, repository, {SCORES_SQL} FROM c")
def scores_by_group(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scored(binding.judged(spark, d), ["smell", "repository"])


@query(with_sql("judged") + f", c AS (SELECT smell, {CELLS_SQL} FROM judged GROUP BY smell) SELECT smell, {SCORES_SQL} FROM c", name="scores")
def scores_(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scored(binding.judged(spark, d), ["smell"])


@query(AGGREGATED_SQL + f""", u AS (SELECT smell, how, label > 0 AS truth, reviews > 4 AS predicted FROM (UNPIVOT (SELECT smell, reviews, mean, max, min, unanimous FROM agg) ON mean, max, min, unanimous INTO NAME how VALUE label)),
    c AS (SELECT smell, how, {CELLS_SQL} FROM u GROUP BY smell, how) SELECT smell, how, {SCORES_SQL} FROM c""")
def scores_by_aggregation(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("mean", "max", "min", "unanimous")
    long = scoring.aggregated(binding.reviews(spark, d)).select("smell", "reviews", F.inline(F.array(*[F.struct(F.lit(k).alias("how"), F.col(k).cast("long").alias("label")) for k in kinds]))).where("label is not null")
    return scoring.scored(long.select("smell", "how", (F.col("label") > 0).alias("truth"), (F.col("reviews") > 4).alias("predicted")), ["smell", "how"])


@query(with_sql("judged") + "SELECT smell, ['none', 'minor', 'major', 'critical'][reviewed + 1] AS severity, count(*) AS support, count(*) FILTER (predicted) AS caught, round(count(*) FILTER (predicted) / count(*), 6) AS recall FROM judged WHERE reviewed > 0 GROUP BY smell, reviewed")
def recall_by_severity(spark: SparkSession, d: str) -> DataFrame:
    rows = binding.judged(spark, d).where("reviewed > 0").groupBy("smell", "reviewed").agg(F.count("*").alias("support"), F.count_if("predicted").alias("caught"))
    return rows.select("smell", severity_name(F.col("reviewed")).alias("severity"), "support", "caught", F.round(F.col("caught") / F.col("support"), 6).alias("recall"))


_FLAGGED = "reviewed > 0 AND measured > 0"


@query(with_sql("judged") + f"SELECT a.x AS first, b.x AS second, (SELECT count(*) FROM judged WHERE reviewed = a.x AND measured = b.x) AS n FROM range(1, 4) AS a(x), range(1, 4) AS b(x)")
def severity_matrix(spark: SparkSession, d: str) -> DataFrame:
    return scoring.severity_matrix(binding.judged(spark, d).where(_FLAGGED), "reviewed", "measured", [1, 2, 3])


@query(with_sql("judged") + f""", f AS (SELECT * FROM judged WHERE {_FLAGGED}), o AS (SELECT smell, reviewed, measured, count(*) AS n FROM f GROUP BY ALL),
    r AS (SELECT smell, reviewed, count(*) AS n FROM f GROUP BY ALL), c AS (SELECT smell, measured, count(*) AS n FROM f GROUP BY ALL),
    e AS (SELECT r.smell, sum(pow(reviewed - measured, 2) * r.n * c.n) AS expected, any_value((SELECT count(*) FROM f WHERE f.smell = r.smell)) AS n FROM r JOIN c ON r.smell = c.smell GROUP BY r.smell)
    SELECT e.smell, e.n, round(1 - (SELECT sum(pow(reviewed - measured, 2) * n) FROM o WHERE o.smell = e.smell) / (expected / e.n), 6) AS kappa FROM e""")
def weighted_kappa(spark: SparkSession, d: str) -> DataFrame:
    return scoring.weighted_kappa(binding.judged(spark, d).where(_FLAGGED), "reviewed", "measured", 3, ["smell"])


@query(f"""WITH judged AS (SELECT quality = 1 AS truth, toxic = 1 AS predicted FROM labels), c AS (SELECT {CELLS_SQL} FROM judged), k AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM c),
    x AS (SELECT *, ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (n * n) AS e FROM k) SELECT tp, fp, fn, tn, round(((tp + tn) / n - e) / nullif(1 - e, 0), 6) AS kappa FROM x""")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    rows = binding.table(spark, d, "labels").select((F.col("quality") == 1).alias("truth"), (F.col("toxic") == 1).alias("predicted"))
    return rows.agg(*scores.confusion(F.col("truth"), F.col("predicted"))).select(*scores.COUNTS, F.round(scores.cohen_kappa(), 6).alias("kappa"))


@query(with_sql("reviews") + f""", pairs AS (SELECT a.smell, a.rank > 0 AS truth, b.rank > 0 AS predicted FROM reviews a JOIN reviews b ON a.sample_id = b.sample_id AND a.smell = b.smell AND a.reviewer <> b.reviewer),
    c AS (SELECT smell, {CELLS_SQL} FROM pairs GROUP BY smell) SELECT smell, (tp + fp + fn + tn) // 2 AS pairs, {SCORES_SQL} FROM c""")
def reviewer_agreement(spark: SparkSession, d: str) -> DataFrame:
    pairs = scoring.paired(binding.reviews(spark, d))
    counted = pairs.groupBy("smell").agg(*scores.confusion(F.col("first"), F.col("second"), F.col("pairs")))
    return counted.select("smell", F.expr("(tp + fp + fn + tn) div 2").alias("pairs"), *scores.COUNTS, *scores.all_scores())


_SIDES = ", ab AS (SELECT *, value % 2 < 1 AS model FROM judged)"


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """Rules and model verdicts on all orders, joined by key."""
    rules = binding.judged(spark, d).select("key", "smell", "truth", "predicted", "value")
    model = rules.select("key", (F.col("value") % 2 < 1).alias("model"))
    return rules.join(model, "key")


@query(with_sql("judged") + _SIDES + """ SELECT smell, count(*) FILTER (predicted AND model) AS both, count(*) FILTER (predicted AND NOT model) AS rules_only, count(*) FILTER (model AND NOT predicted) AS model_only,
    count(*) FILTER (NOT predicted AND NOT model) AS neither FROM ab GROUP BY smell""")
def ab_agreement(spark: SparkSession, d: str) -> DataFrame:
    p, m = F.col("predicted"), F.col("model")
    return _sides(spark, d).groupBy("smell").agg(F.count_if(p & m).alias("both"), F.count_if(p & ~m).alias("rules_only"), F.count_if(m & ~p).alias("model_only"), F.count_if(~p & ~m).alias("neither"))


@query(with_sql("judged") + _SIDES + f""", u AS (SELECT smell, 'union' AS how, truth, predicted OR model AS predicted FROM ab UNION ALL SELECT smell, 'intersection', truth, predicted AND model FROM ab),
    c AS (SELECT smell, how, {CELLS_SQL} FROM u GROUP BY smell, how) SELECT smell, how, {SCORES_SQL} FROM c""")
def ab_combined(spark: SparkSession, d: str) -> DataFrame:
    either = F.inline(F.array(F.struct(F.lit("union").alias("how"), (F.col("predicted") | F.col("model")).alias("verdict")), F.struct(F.lit("intersection").alias("how"), (F.col("predicted") & F.col("model")).alias("verdict"))))
    return scoring.scored(_sides(spark, d).select("smell", "truth", either), ["smell", "how"], predicted="verdict")


@query(with_sql("judged") + f"SELECT smell, round(count(*) FILTER (measured > reviewed) / count(*), 6) AS over, round(count(*) FILTER (measured < reviewed) / count(*), 6) AS under, round(count(*) FILTER (measured = reviewed) / count(*), 6) AS same FROM judged WHERE {_FLAGGED} GROUP BY smell")
def severity_bias(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    m, r = F.col("measured"), F.col("reviewed")
    return binding.judged(spark, d).where(_FLAGGED).groupBy("smell").agg(share(m > r).alias("over"), share(m < r).alias("under"), share(m == r).alias("same"))


_CELL = "CASE WHEN truth AND predicted THEN 'caught' WHEN truth THEN 'missed' WHEN predicted THEN 'spurious' ELSE 'negative' END"


@query(with_sql("judged") + f"SELECT smell, {_CELL} AS cell, count(*) AS n, round(sum(value), 2) AS total FROM judged GROUP BY ALL")
def partition(spark: SparkSession, d: str) -> DataFrame:
    return binding.judged(spark, d).groupBy("smell", F.expr(_CELL).alias("cell")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(with_sql("judged") + f""", s AS (SELECT smell, {_CELL} AS cell, list(value ORDER BY value) AS v FROM judged GROUP BY ALL)
    SELECT smell, cell, v[least(len(v) - 1, floor(0.25 * len(v)))::INT + 1] AS q1, v[least(len(v) - 1, floor(0.5 * len(v)))::INT + 1] AS q2, v[least(len(v) - 1, floor(0.75 * len(v)))::INT + 1] AS q3 FROM s""")
def quartiles_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = binding.judged(spark, d).withColumn("cell", F.expr(_CELL))
    return scoring.nearest_rank(rows, ["smell", "cell"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


@query(with_sql("judged") + """, r AS (SELECT smell, truth, rank() OVER (PARTITION BY smell ORDER BY measured) + (count(*) OVER (PARTITION BY smell, measured) - 1) / 2 AS rk FROM judged)
    SELECT smell, round((sum(rk) FILTER (truth) - count(*) FILTER (truth) * (count(*) FILTER (truth) + 1) / 2) / (count(*) FILTER (truth)::DOUBLE * count(*) FILTER (NOT truth)), 9) AS auc FROM r GROUP BY smell""")
def separation_auc(spark: SparkSession, d: str) -> DataFrame:
    return scoring.separation(binding.judged(spark, d), ["smell"], "measured", F.col("truth"))


@query(with_sql("judged") + """, neg AS (SELECT smell, list(value ORDER BY value) AS v FROM judged WHERE NOT truth GROUP BY smell)
    SELECT j.smell, count(*) AS misses, count(*) FILTER (value <= v[least(len(v) - 1, len(v) // 2) + 1]) AS below FROM judged j JOIN neg ON neg.smell = j.smell WHERE truth AND NOT predicted GROUP BY j.smell""")
def below_median(spark: SparkSession, d: str) -> DataFrame:
    rows = binding.judged(spark, d)
    middle = scoring.nearest_rank(rows.where("not truth"), ["smell"], "value", {"median": 0.5})
    return rows.where("truth and not predicted").join(middle, "smell").groupBy("smell").agg(F.count("*").alias("misses"), F.count_if(F.col("value") <= F.col("median")).alias("below"))


@query(with_sql("judged") + "SELECT smell, round(quantile_cont(value, 0.5), 6) AS median_value, round(quantile_cont(measured::DOUBLE, 0.5), 6) AS median_measured FROM judged GROUP BY smell")
def medians(spark: SparkSession, d: str) -> DataFrame:
    return binding.judged(spark, d).groupBy("smell").agg(F.round(F.percentile("value", 0.5), 6).alias("median_value"), F.round(F.percentile(F.col("measured").cast("double"), 0.5), 6).alias("median_measured"))
