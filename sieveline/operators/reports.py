"""Reports in words, summaries of reviews, and what is suggested at each place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import scores
from sieveline.functions.names import readable
from sieveline.operators.findings import SITE

#: Files that are named when they can't be read; ranks of severity by name.
NAMED = 5
SEVERITIES = ("minor", "major", "critical")
#: Findings that are only advised, and why no rewrite is applied.
ADVISED = {
    "DataClass": "every reference to the field would have to be found and rewritten",
    "GodClass": "moving members needs call sites this analysis cannot resolve",
    "LargeClass": "moving members needs call sites this analysis cannot resolve",
    "FeatureEnvy": "moving a method needs every call site",
}


def unparsed_note(files: DataFrame, most: int = NAMED) -> DataFrame:
    """One row: how many of `files` (file, unparsed) can't be read, the first of these by name, and how many more. Only those named reach one task."""
    bad = files.where("unparsed").select("file").distinct()
    first = bad.orderBy("file").limit(most).agg(F.array_join(F.sort_array(F.collect_list("file")), ", ").alias("named"))
    return bad.agg(F.count("*").alias("n")).crossJoin(F.broadcast(first)).select("n", "named", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def text_report(found: DataFrame) -> DataFrame:
    """The report as rows (part, place, line): counts by type (part 0, commonest first), severities (1), and each finding (2, by its number).

    `found` has finding_id, smell_type, severity (1 to 3), file, line, class_name, method, rationale and refactorings.
    """
    types = found.groupBy("smell_type").agg(F.count("*").alias("n"), F.min("finding_id").alias("first"))
    summary = types.select(F.lit(0).alias("part"), F.col("first").alias("place"), F.concat(F.lit("  "), F.rpad("smell_type", F.greatest(F.length("smell_type"), F.lit(20)), F.lit(" ")), F.lit(" "), F.col("n").cast("string")).alias("line"))
    counts = [F.count_if(F.col("severity") == k).cast("string") for k in (3, 2, 1)]
    worst = found.agg(F.concat(F.lit("  critical="), counts[0], F.lit("  major="), counts[1], F.lit("  minor="), counts[2]).alias("line")).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"), "line")
    name = F.rpad(F.upper(F.get(F.array(*map(F.lit, SEVERITIES)), (F.col("severity") - 1).cast("int"))), 8, " ")
    place = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "class_name", F.when(F.col("method") != "", F.concat(F.lit("."), "method")).otherwise(""))
    block = F.concat(F.lit("["), name, F.lit("] "), "smell_type", F.lit("\n    "), place, F.lit("\n    why: "), "rationale", F.lit("\n    fix: "), F.array_join("refactorings", ", "))
    return summary.unionByName(worst).unionByName(found.select(F.lit(2).alias("part"), F.col("finding_id").alias("place"), block.alias("line")))


def explained(rows: DataFrame, term: str, glossary: DataFrame) -> DataFrame:
    """`rows` with `name`: what the glossary (alias, name) calls the term, with or without a `c_` or `m_` before it; else the term made readable."""
    bare = F.regexp_replace(F.lower(F.col(term)), "^[cm]_", "")
    found = rows.withColumn("alias", bare).join(glossary.select("alias", F.col("name").alias("known")), "alias", "left").drop("alias")
    return found.withColumn("name", F.coalesce("known", readable(F.col(term)))).drop("known")


def counted_words(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def quality_summary(judged: DataFrame, sizes: DataFrame, categories: tuple[str, ...], rejected: str) -> DataFrame:
    """Per stratum and category its count, zeros included, with the share that isn't rejected, its Wilson interval, and the pooled share.

    `judged` has stratum and category; `sizes` stratum and population. The pooled share weighs strata by population and is
    null if no judged stratum has a known one.
    """
    per = judged.groupBy("stratum").agg(F.count("*").alias("reviewed"), F.count_if(F.col("category") != rejected).alias("good"), *[F.count_if(F.col("category") == c).alias(f"n_{i}") for i, c in enumerate(categories)])
    low, high = scores.wilson(F.col("good"), F.col("reviewed"))
    per = per.join(sizes, "stratum", "left").withColumns({"population": F.coalesce("population", F.lit(0).cast("long")), "acceptable": F.round(F.col("good") / F.col("reviewed"), 4), "low": F.round(low, 4), "high": F.round(high, 4)})
    pooled = per.agg(F.round(F.try_divide(F.sum(F.col("acceptable") * F.col("population")), F.sum("population").cast("double")), 4).alias("pooled"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"n_{i}").alias("n")) for i, c in enumerate(categories)])).alias("cell")
    return per.select("stratum", "reviewed", "population", "acceptable", "low", "high", cells).crossJoin(F.broadcast(pooled)).select("stratum", "cell.category", "cell.n", "reviewed", "population", "acceptable", "low", "high", "pooled")


def suggestions_of(found: DataFrame, automated: Column) -> DataFrame:
    """One finding for each place: the first that can be rewritten, else the worst, then the first."""
    rows = found.withColumn("auto", automated)
    pick = F.struct("auto", F.when(F.col("auto"), 0).otherwise(F.col("severity")), -F.col("finding_id"), "smell_type", "finding_id")
    best = rows.groupBy(*SITE).agg(F.max(pick).alias("best"), F.max("severity").alias("worst"), F.bool_or("auto").alias("automated"))
    label = F.concat("class_name", F.when(F.col("method") != "", F.concat(F.lit("."), F.regexp_replace("method", "\\(.*$", ""))).otherwise(""))
    return best.select("file", "line", label.alias("entity"), "best.smell_type", F.col("best.finding_id").alias("finding_id"), "worst", "automated")
