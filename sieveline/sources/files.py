"""Files of reviews, features, reports, baselines, thresholds and judgements, with stated schemas, and the files written.

Nothing is inferred from data. Order within a file, where it decides anything, is taken from the reader's row numbers.
"""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions.clauses import DEFAULTS, RANKS, REFACTORINGS, Thresholds, suggestions
from sieveline.functions.text import fingerprint, owner_name
from sieveline.operators.detectors import rationale

REVIEWS = "id string, reviewer_id string, sample_id string, smell string, severity string, review_timestamp string, type string, code_name string, repository string, commit_hash string, path string, start_line int, end_line int, link string, is_from_industry_relevant_project string"
# The columns of a feature table, in order.
CLASS_METRICS = "AMW ATFD CBO CLOC DIT LCOM LCOM3 MAXCC NOAM NOC NOF NOM NOPA RFC TCC WMC WOC".split()
METHOD_METRICS = "ATFD CC CINT FDP LAA MAXNESTING MLOC NOAV NP".split()
FEATURES = (
    "sample_id string, repository string, smell string, entity_type string, path string, start_line int, end_line int, class_name string, class_kind string, entity_name string, entity_start_line int, entity_end_line int, is_constructor string, "
    "review_count int, is_unanimous string, severity_mean int, severity_max int, severity_min int, severity_unanimous int, smelly_mean string, smelly_max string, smelly_min string, smelly_unanimous string, "
    + ", ".join([f"c_{m} double" for m in CLASS_METRICS] + [f"m_{m} double" for m in METHOD_METRICS])
)
FLAGS = ("is_constructor", "is_unanimous", "smelly_mean", "smelly_max", "smelly_min", "smelly_unanimous")
JUDGEMENTS = "review_id string, refactoring string, smell string, class_name string, method string, file string, ordinal int, behaviour string, benefit string, acceptance string, note string"


def flag(text: Column) -> Column:
    """A verdict written as 1/True/true or 0/False/false; empty is null; anything else is an error."""
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("boolean")).when(text.isin("1", "True", "true"), True).when(text.isin("0", "False", "false"), False).otherwise(F.raise_error(F.concat(F.lit("not a verdict: "), text)).cast("boolean"))


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews with the severity as a rank; sample ids and smells are what identifies a sample."""
    rows = spark.read.csv(path, sep=";", header=True, schema=REVIEWS)
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("severity")) - 1
    return rows.select("id", "reviewer_id", "sample_id", "smell", "severity", F.when(rank >= 0, rank).alias("rank"), "type", "code_name", owner_name(F.col("repository")).alias("repository"), "path", "start_line", "end_line", F.monotonically_increasing_id().alias("row_number"))


def samples(of: DataFrame) -> DataFrame:
    """A row per (sample_id, smell): the place from its first review in the file, and its reviews."""
    place = F.struct("type", "code_name", "repository", "path", "start_line", "end_line")
    return of.groupBy("sample_id", "smell").agg(F.min_by(place, "row_number").alias("place"), F.collect_list(F.struct("reviewer_id", "severity")).alias("reviews")).select("sample_id", "smell", "place.*", "reviews")


def features(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=FEATURES, nullValue="")
    return rows.withColumns({c: flag(F.col(c)) for c in FLAGS})


def complete(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Counts of rows without a label, with one but a metric missing, and usable; the first is tested first."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    named = F.col(label).isNotNull()
    return rows.agg(F.count_if(~named).alias("unlabelled"), F.count_if(named & ~whole).alias("incomplete"), F.count_if(named & whole).alias("usable"), F.count_if(named & whole & F.col(label)).alias("positive"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """file, class, method, rule of an XML report, read line by line: one opening tag stands on a line.

    The last file named before a violation is its file. A report that is cut off or isn't well formed is read as far as
    it goes. Text files are read whole here, so a file's lines are in order in one task.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("report"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    attribute = lambda name: F.regexp_extract("line", f'\\b{name}="([^"]*)"', 1)
    so_far = Window.partitionBy("report").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("line").rlike('<file\\s+name="'), F.regexp_extract("line", '<file\\s+name="([^"]*)"', 1))
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    marked = lines.withColumn("file", F.last(named, ignorenulls=True).over(so_far)).where(F.col("line").rlike("<violation\\s"))
    return marked.select("report", plain(F.col("file")).alias("file"), attribute("class").alias("class"), attribute("method").alias("method"), attribute("rule").alias("rule"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """The fingerprints of a baseline file; another version is an error."""
    whole = spark.read.json(path, schema="version int, findings array<string>", multiLine=True)
    checked = F.when(F.col("version") == 1, F.col("findings")).otherwise(F.raise_error(F.lit("not a baseline of version 1")).cast("array<string>"))
    return whole.select(F.explode(checked).alias("fingerprint"))


STATUS = "repository string, commit_hash string, directory string, ok boolean, java_files long, bytes_written long, reason string"


def manifest(documents: DataFrame, column: str = "value") -> DataFrame:
    """A row per repository of manifests (a JSON object of statuses by name); `done` only if it succeeded, so failures are tried again."""
    entries = documents.select(F.explode(F.from_json(column, f"map<string, struct<{STATUS.replace(' ', ':').replace(',:', ', ')}>>")).alias("name", "status"))
    zero = lambda c: F.coalesce(F.col(f"status.{c}"), F.lit(0).cast("long")).alias(c)
    return entries.select(F.col("name").alias("repository"), "status.commit_hash", "status.directory", F.coalesce("status.ok", F.lit(False)).alias("done"), zero("java_files"), zero("bytes_written"), F.coalesce("status.reason", F.lit("")).alias("reason"))


def thresholds(path: str) -> Thresholds:
    """Limits from a TOML file on the driver."""
    with open(path, "rb") as file:
        return DEFAULTS.overridden(tomllib.load(file))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """Rows with an answer; an unknown answer is an error that names the sheet's row."""
    rows = spark.read.csv(path, header=True, schema=JUDGEMENTS).withColumn("row_number", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) + 1)  # a sheet is filled in by hand
    answered = rows.where("behaviour is not null or benefit is not null or acceptance is not null")
    known = F.col("acceptance").isNull() | F.col("acceptance").isin("accept", "accept_with_changes", "reject")
    return answered.withColumn("acceptance", F.when(known, F.col("acceptance")).otherwise(F.raise_error(F.concat(F.lit("unknown answer in row "), F.col("row_number").cast("string"))).cast("string")))


# What is written. `found` has the columns of java.analysis.findings.


def findings_csv(found: DataFrame, path: str) -> None:
    rows = found.select("smell_type", "severity", F.round("score", 3).alias("score"), F.col("class_name").alias("class"), F.coalesce("method", F.lit("")).alias("method"), "file", "start_line", "end_line", rationale(F.col("conditions")).alias("rationale"), F.array_join(suggestions(F.col("smell_type")), "|").alias("refactorings"))
    rows.write.mode("overwrite").csv(path, header=True)


def findings_json(found: DataFrame, path: str) -> None:
    found.withColumn("score", F.round("score", 3)).withColumn("refactorings", suggestions(F.col("smell_type"))).write.mode("overwrite").json(path)


def write_baseline(found: DataFrame, path: str) -> None:
    """Sorted distinct fingerprints, one document. A baseline is kept in a repository, so it is short."""
    prints = found.select(fingerprint(F.col("smell_type"), F.col("file"), F.col("class_name"), F.col("method")).alias("f")).agg(F.sort_array(F.collect_set("f")).alias("findings"))
    prints.select(F.lit(1).alias("version"), "findings").coalesce(1).write.mode("overwrite").json(path)


def sarif_document(found: DataFrame, name: str = "sieveline") -> str:
    """A SARIF 2.1.0 document of the findings; it is one JSON text, so they must fit the driver."""
    types = [r["smell_type"] for r in found.select("smell_type").distinct().orderBy("smell_type").collect()]
    level = {"minor": "note", "major": "warning", "critical": "error"}
    results = [
        {
            "ruleId": r["smell_type"], "ruleIndex": types.index(r["smell_type"]), "level": level[r["severity"]], "message": {"text": r["rationale"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": r["start_line"], "endLine": r["end_line"]}}}], "partialFingerprints": {"primary": r["print"]},
        }
        for r in found.select("*", rationale(F.col("conditions")).alias("rationale"), fingerprint(F.col("smell_type"), F.col("file"), F.col("class_name"), F.col("method")).alias("print")).toLocalIterator()
    ]
    rules = [{"id": t, "properties": {"refactorings": REFACTORINGS.get(t, [])}} for t in types]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": name, "rules": rules}}, "results": results}]})


def metric_matrix(classes: DataFrame, path: str) -> None:
    """A row per class and a column per metric; missing is 0, four decimals."""
    columns = ["wmc", "amw", "maxcc", "nom", "nof", "noam", "nopa", "cloc", "tcc", "lcom", "lcom3", "atfd", "woc", "cbo", "rfc", "noc", "dit"]
    classes.select("package", F.col("name").alias("class"), "file", "start_line", *[F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 4).alias(c.upper()) for c in columns]).write.mode("overwrite").csv(path, header=True)


def write_features(rows: DataFrame, path: str) -> None:
    """A feature table as Parquet, by smell: readers of one smell skip the others, and a failed write leaves nothing."""
    rows.write.mode("overwrite").partitionBy("smell").parquet(path)
