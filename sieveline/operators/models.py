"""Classifiers of entities under folds of whole groups: out-of-fold predictions, importances and explanations.

Every model is a pyspark.ml pipeline, fitted on the executors. Rows are predicted once, by the model of the folds that
their group isn't in. Scores aren't those of other libraries' models of the same names; the protocol is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import scores
from sieveline.operators.inference import greedy_folds

SEED = 20260826


def zoo(trees: int = 300) -> dict[str, Callable[[], Estimator]]:
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "logistic": lambda: Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(**common | {"featuresCol": "scaled"}, maxIter=200)]),
        "forest": lambda: RandomForestClassifier(**common, numTrees=trees, seed=SEED),
        "boosting": lambda: GBTClassifier(**common, maxIter=20, seed=SEED),
    }


def assembled(rows: DataFrame, features: list[str], label: str, group: str) -> DataFrame:
    """id, group, label, weight (balanced) and features of rows that lack nothing."""
    whole = rows.where(F.col(label).isNotNull()).dropna(subset=features)
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(whole)
    y = F.col(label).cast("double")
    counts = whole.agg(F.count("*").alias("n"), F.sum(y).alias("p")).first()
    n, p = counts["n"], counts["p"] or 0.0
    weight = F.when(y == 1, n / (2 * p) if p else 1.0).otherwise(n / (2 * (n - p)) if n - p else 1.0)
    return vectors.select("id", F.col(group).cast("string").alias("group"), y.alias("label"), weight.alias("weight"), "features")


def folded(rows: DataFrame, k: int = 5) -> DataFrame:
    """`fold` of every row: groups, largest first, go to the fold with the fewest rows."""
    sizes = [(r["group"], r["n"]) for r in rows.groupBy("group").agg(F.count("*").alias("n")).collect()]  # a row per group
    table = rows.sparkSession.createDataFrame(list(greedy_folds(sizes, k).items()), "group string, fold int")
    return rows.join(table, "group")


def cross_validated(rows: DataFrame, make: Callable[[], Estimator]) -> DataFrame:
    """id, group, label, fold, probability: each row by the model that its group had no part in."""
    rows = rows.persist()
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    out = None
    for k in folds:
        model = make().fit(rows.where(F.col("fold") != k))
        part = probabilities(model, rows.where(F.col("fold") == k)).select("id", "group", "label", "fold", "probability")
        out = part if out is None else out.unionByName(part)
    return out


def probabilities(model: Model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("probability", F.get(vector_to_array("probability"), 1))


def scored(predictions: DataFrame, cut: float = 0.5) -> DataFrame:
    counted = predictions.agg(*scores.confusion(F.col("label") == 1, F.col("probability") >= cut))
    return counted.select(*scores.COUNTS, *scores.all_scores())


def permuted(rows: DataFrame, features: list[str], repeats: int) -> DataFrame:
    """Every row once for each feature and repeat, that feature's value taken from another row.

    Within hash buckets, so that no task sorts all rows, each row takes the value of the next in a random order and the
    last that of the first: one window, no join.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("at"), F.lit(r).alias("repeat")) for i, f in enumerate(features) for r in range(repeats)])).alias("e_")
    values = rows.withColumn("x_", vector_to_array("features")).select("id", "label", "x_", each).select("id", "label", "x_", "e_.*")
    bucket = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(64))
    around = Window.partitionBy("feature", "repeat", "b_").orderBy(F.xxhash64("id", "feature", "repeat"), "id")
    own = F.get("x_", F.col("at"))
    taken = values.withColumn("b_", bucket).withColumn("v_", F.coalesce(F.lead(own).over(around), F.first(own).over(around)))
    parts = [F.when(F.col("at") == i, F.col("v_")).otherwise(F.get("x_", i)).alias(f"f_{i}") for i in range(len(features))]
    return VectorAssembler(inputCols=[f"f_{i}" for i in range(len(features))], outputCol="features").transform(taken.select("id", "label", "feature", "repeat", *parts))


def importances(model: Model, rows: DataFrame, features: list[str], repeats: int = 10) -> dict[str, float]:
    """Mean fall of the MCC on held-out rows when a feature is permuted. All changed rows are scored in one transform."""
    whole = scored(probabilities(model, rows)).first()["mcc"] or 0.0
    changed = probabilities(model, permuted(rows, features, repeats)).groupBy("feature", "repeat").agg(*scores.confusion(F.col("label") == 1, F.col("probability") >= 0.5))
    means = changed.select("feature", *scores.all_scores()).groupBy("feature").agg(F.avg(F.coalesce("mcc", F.lit(0.0))).alias("mcc"))
    fallen = {r["feature"]: whole - r["mcc"] for r in means.collect()}  # a row per feature
    return {f: fallen.get(f, 0.0) for f in features}


def importances_over_folds(rows: DataFrame, make: Callable[[], Estimator], features: list[str], repeats: int = 10) -> dict[str, float]:
    """The mean over folds of each feature's importance on the fold held out."""
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    per = [importances(make().fit(rows.where(F.col("fold") != k)), rows.where(F.col("fold") == k), features, repeats) for k in folds]
    return {f: sum(x[f] for x in per) / len(per) for f in features} if per else {}


def ablation(rows: DataFrame, make: Callable[[], Estimator], features: list[str], dropped: list[str]) -> DataFrame:
    """The scores under grouped folds with all features, and without those dropped."""
    kept = [i for i, f in enumerate(features) if f not in dropped]
    fewer = VectorSlicer(inputCol="all_", outputCol="features", indices=kept).transform(rows.withColumnRenamed("features", "all_")).drop("all_")
    tried = [scored(cross_validated(r, make)).withColumn("features", F.lit(k)) for k, r in (("all", rows), ("without", fewer))]
    return tried[0].unionByName(tried[1])


class Unavailable(Exception):
    """A model that can't be served, with the code of the reason."""

    def __init__(self, code: str, said: str) -> None:
        super().__init__(f"{code}: {said}")
        self.code = code


def running_versions() -> dict[str, str]:
    import numpy
    import pyspark

    return {"pyspark": pyspark.__version__, "numpy": numpy.__version__}


def save(spark: SparkSession, model: Model, path: str, features: list[str], trained_on: int) -> None:
    """The model, and beside it a manifest of its features in order, its rows and the libraries it was fitted with."""
    model.write().overwrite().save(f"{path}/model")
    libraries = F.create_map(*[F.lit(x) for kv in running_versions().items() for x in kv])
    manifest = spark.range(1).select(F.array(*map(F.lit, features)).alias("features"), F.lit(trained_on).cast("long").alias("trained_on"), libraries.alias("libraries"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str, columns: list[str]) -> tuple[Model, list[str], int]:
    """The model, its features in order and its number of rows; refused where it is missing, was fitted with other libraries, or names a feature not in `columns`."""
    from pyspark.errors import AnalysisException
    from pyspark.ml.util import DefaultParamsReader

    try:
        row = spark.read.json(f"{path}/manifest", schema="features array<string>, trained_on long, libraries map<string, string>").first()
    except AnalysisException as x:
        raise Unavailable("not_trained", f"no model at {path}") from x
    if row is None or not row["features"]:
        raise Unavailable("not_trained", f"no manifest at {path}")
    running = running_versions()
    differing = sorted(k for k, v in (row["libraries"] or {}).items() if running.get(k) != v)
    if differing:
        raise Unavailable("library_mismatch", f"fitted with a different {', '.join(differing)}")
    missing = [f for f in row["features"] if f not in columns]
    if missing:
        raise Unavailable("feature_missing", f"not in the table: {', '.join(missing)}")
    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark), row["features"], row["trained_on"]


def explained(model: Model, rows: DataFrame, features: list[str]) -> DataFrame:
    """Per flagged row and feature, the fall of its probability when that feature is made typical (its median); decisive if it is then not flagged.

    All changed rows are scored in one transform.
    """
    values = rows.withColumn("x_", vector_to_array("features"))
    typical = values.agg(*[F.percentile(F.get("x_", i), 0.5).alias(f) for i, f in enumerate(features)]).first()
    flagged = probabilities(model, values).where("probability >= 0.5").select("id", "group", "label", "weight", "x_", F.col("probability").alias("before"))
    changes = [F.struct(F.lit(f).alias("feature"), *[(F.lit(float(typical[f])) if i == j else F.get("x_", j)).alias(g) for j, g in enumerate(features)]) for i, f in enumerate(features)]
    long = flagged.select("id", "before", F.inline(F.array(*changes)))
    after = probabilities(model, VectorAssembler(inputCols=features, outputCol="features").transform(long))
    return after.select("id", "feature", "before", (F.col("before") - F.col("probability")).alias("drop"), (F.col("probability") < 0.5).alias("decisive"))
