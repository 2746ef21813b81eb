"""A source tree analysed: metrics of all its classes and methods, and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.clauses import DEFAULTS, Thresholds
from sieveline.java import facts
from sieveline.operators import detectors, metrics


def class_table(types: DataFrame, of: DataFrame) -> DataFrame:
    """All class metrics of scanned types. CLOC is the class's own effective lines."""
    held = facts.fields(types)
    out = metrics.class_metrics(facts.classes(types), of, held).withColumn("cloc", F.col("loc"))
    for part in (metrics.lcom(of), metrics.lcom3(of, held), facts.coupling(types, of), metrics.rfc(of), metrics.noc(facts.classes(types)), metrics.dit(facts.classes(types))):
        out = out.join(part, "class_id", "left")
    defaults = {"nom": 0, "nof": 0, "noam": 0, "nopa": 0, "wmc": 0, "amw": 0.0, "maxcc": 0, "tcc": 1.0, "atfd": 0, "woc": 1.0, "lcom": 0, "lcom3": 0.0, "cbo": 0, "rfc": 0, "noc": 0, "dit": 0}
    return out.fillna(defaults)


def method_table(of: DataFrame) -> DataFrame:
    return metrics.method_metrics(of).withColumn("cint", F.col("receivers_and_calls"))


def findings(types: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """file, class_name, method (null for classes), lines, smell_type, conditions, score and severity; worst first."""
    of = facts.methods(types)
    by_class = detectors.detect(class_table(types, of).withColumn("class_name", F.col("name")).withColumn("method", F.lit(None).cast("string")), ["file", "class_name", "method", "start_line", "end_line"], detectors.class_strategies(t), t)
    by_method = detectors.detect(method_table(of).withColumn("method", F.col("name")), ["file", "class_name", "method", "start_line", "end_line"], detectors.method_strategies(t), t)
    return by_class.unionByName(by_method).orderBy(F.desc("score"), "file", "start_line", "smell_type", "method")


def analyse(spark: SparkSession, root: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """Findings of all Java files under `root`."""
    return findings(facts.entities(facts.units(facts.java_files(spark, root))), t)
