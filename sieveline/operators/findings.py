"""Findings at their places: rollups to sites, lookups between verdicts, reports and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions.text import fingerprint

#: The findings that a rewrite exists for.
AUTOMATED = ("LongMethod", "BrainMethod", "DeepNesting", "LongParameterList")
SITE = ["file", "class_name", "method", "line"]


def fingerprints(found: DataFrame) -> DataFrame:
    return found.withColumn("fingerprint", fingerprint(F.col("smell_type"), F.col("file"), F.col("class_name"), F.col("method")))


def accepted(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint isn't in the baseline."""
    return fingerprints(found).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def sites(found: DataFrame, automated: Column) -> DataFrame:
    """A row per place: findings, worst severity, greatest score, whether any can be rewritten."""
    return found.groupBy(*SITE).agg(F.count("*").alias("findings"), F.max("severity").alias("worst"), F.max("score").alias("score"), F.bool_or(automated).alias("automated"))


def placed(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """All rows with their place in a total order, from 1. Sorted by ranges and numbered within each, so no task has them all."""
    low = 33  # bits of a row's number in its partition
    own = rows.orderBy(*order).withColumn("own", F.monotonically_increasing_id())
    own = own.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else own.persist()
    part = F.shiftright("own", low)
    before, total = [], 0
    for r in sorted(own.groupBy(part.alias("part")).count().collect()):  # a row per partition
        before.append((r["part"], total))
        total += r["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, start long"))
    place = F.col("start") + F.col("own").bitwiseAND((1 << low) - 1) + 1
    return own.withColumn("part", part).join(starts, "part").withColumn("place", place).drop("own", "part", "start")


def hotspots(found: DataFrame, n: int) -> DataFrame:
    """The files with most sites, then most findings, then by name."""
    per = found.groupBy("file").agg(F.countDistinct(*SITE[1:]).alias("sites"), F.count("*").alias("findings"))
    return per.orderBy(F.desc("sites"), F.desc("findings"), "file").limit(n)


def model_only(model: DataFrame, rules: DataFrame) -> DataFrame:
    """Model verdicts where no rule of any kind fired; one per place and type, the most probable."""
    place = ["file", "class_name", "line"]
    rest = model.join(rules.select(*place).distinct(), place, "left_anti")
    return rest.groupBy(*place, "smell_type").agg(F.max("probability").alias("probability"))


def sarif(found: DataFrame) -> DataFrame:
    """A SARIF 2.1.0 result per finding, as JSON text, with the place of its rule among the sorted distinct types."""
    level = F.when(F.col("severity") >= 3, "error").when(F.col("severity") == 2, "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    marked = fingerprints(found).join(rule_index(found), "smell_type")
    body = F.to_json(F.struct(F.col("smell_type").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints")))
    return marked.select("finding_id", body.alias("result"))


def rule_index(found: DataFrame) -> DataFrame:
    types = found.select("smell_type").distinct()
    return types.withColumn("rule_index", (F.dense_rank().over(Window.orderBy("smell_type")) - 1).cast("long"))


def rates(found: DataFrame, by: list[str], applied: Column, refused: Column) -> DataFrame:
    """Detected, applied, refused and the rate of applied per combination and, with null keys, overall."""
    out = found.rollup(*by).agg(F.count("*").alias("detected"), F.count_if(applied).alias("applied"), F.count_if(refused).alias("refused"))
    return out.withColumn("rate", F.round(F.try_divide(F.col("applied"), F.col("applied") + F.col("refused")), 6))


def csv_rows(found: DataFrame, suggested: Column) -> DataFrame:
    """The rows of a findings report, in its order: worst scores first, then by place."""
    return found.select("smell_type", "severity", F.round("score", 3).alias("score"), "file", "line", "class_name", "method", F.array_join(suggested, "|").alias("refactorings")).orderBy(F.desc("score"), "file", "line", "smell_type", "class_name", "method")


def shown(found: DataFrame, least: int = 1, types: tuple[str, ...] = (), words: str = "") -> DataFrame:
    """All findings of the places where one matches: severity at least, type among, words in any of the names, whatever their case."""
    matches = F.col("severity") >= least
    if types:
        matches = matches & F.col("smell_type").isin(*types)
    if words:
        matches = matches & F.lower(F.concat_ws(" ", "smell_type", "file", "class_name", "method")).contains(words.lower())
    return found.join(found.where(matches).select(*SITE).distinct(), SITE, "left_semi")


def gate(found: DataFrame, least: int) -> DataFrame:
    """One row: whether any finding is at least so severe."""
    return found.where(F.col("severity") >= least).limit(1).agg((F.count("*") > 0).alias("fails"))


def share(part: Column, whole: Column) -> Column:
    """A share in words: none and all only where they are exact."""
    percent = F.floor(100 * part / F.when(whole > 0, whole) + 0.5)
    return F.when(whole == 0, "-").when(part == 0, "0%").when(part == whole, "100%").when(100 * part < whole, "<1%").when(100 * part > 99 * whole, ">99%").otherwise(F.concat(percent.cast("long").cast("string"), F.lit("%")))
