"""Sentences, repeated phrases, citations and suppression comments in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text
from sieveline.operators import diffs, textops
from sieveline.plans.registry import query
from sieveline.sources.binding import table

_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?][ \n\t]+'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_SENTENCES})::BIGINT AS sentences, list_aggregate(list_transform({_SENTENCES}, lambda x: length(x)), 'max')::BIGINT AS longest FROM documents")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 5, 1) + 1), lambda i: array_to_string(w[i:i + 5], ' '))) AS phrase FROM w)
    SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY phrase HAVING count(DISTINCT doc_id) >= 3""")
def repeated_phrases(spark: SparkSession, d: str) -> DataFrame:
    return textops.repeated_phrases(table(spark, d, "documents"), n=6, least=3)


@query("""WITH s AS (SELECT item_id, list_distinct(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' '), lambda x: length(x) > 3)) AS v FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.v, b.v))::BIGINT AS shared FROM s a JOIN s b ON a.item_id < b.item_id WHERE len(list_intersect(a.v, b.v)) > 0 AND len(list_intersect(a.v, b.v)) >= 0.1 * least(len(a.v), len(b.v))""")
def similar_sentences(spark: SparkSession, d: str) -> DataFrame:
    return textops.overlapping(table(spark, d, "benchmark"), "item_id", "text", share=0.1)


@query(r"SELECT page_id, len(regexp_extract_all(html, 'href=.([^ >]+).'))::BIGINT AS cited, coalesce(nullif(regexp_extract(url, '([a-z]{2})/([0-9]+)', 2), ''), '-') AS number FROM pages")
def citations(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("url", "([a-z]{2})/([0-9]+)", 2)
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("href=.([^ >]+)."), 1)).cast("long").alias("cited"), F.when(number == "", "-").otherwise(number).alias("number"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id, len(lines)::BIGINT AS lines, len(list_filter(lines, lambda x: length(trim(x)) > 0))::BIGINT AS filled, lines[1:2] AS head FROM l""")
def source_range(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: F.length(F.trim(x)) > 0)).cast("long").alias("filled"), F.slice(lines, 1, 2).alias("head"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a, 1 + doc_id % 7 AS s, doc_id % 900 AS e FROM documents), m AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:len(a) - 1] ELSE a END AS a, s, e FROM l),
    r AS (SELECT *, least(s, len(a)) AS first FROM m WHERE e >= s), x AS (SELECT *, least(e, first + 399, len(a)) AS last FROM r)
    SELECT doc_id, first::BIGINT AS start_line, last::BIGINT AS end_line, last < least(e, len(a)) AS truncated, CASE WHEN len(a) = 0 THEN '' ELSE array_to_string(a[first:last], chr(10)) END AS lines FROM x""")
def source_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines around a place in each document; the texts hold no carriage returns."""
    read = text.source_range(F.col("text"), 1 + F.col("doc_id") % 7, F.col("doc_id") % 900).alias("r")
    found = table(spark, d, "documents").select("doc_id", read).where("r is not null")
    return found.select("doc_id", F.col("r.start_line").cast("long").alias("start_line"), F.col("r.end_line").cast("long").alias("end_line"), "r.truncated", F.array_join("r.lines", "\n").alias("lines"))


@query("""WITH e AS (SELECT event_id, ['// smell:ignore(' || event_type || ')', CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'int x;' ELSE '// plain' END, 'void m() {'] AS lines, event_id, event_type FROM events)
    SELECT event_id, event_id % 3 <> 1 AND event_type IN ('click', 'view') AS hidden FROM e""")
def suppression(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    filler = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "int x;").otherwise("// plain")
    lines = F.array(F.concat(F.lit("// smell:ignore("), "event_type", F.lit(")")), filler, F.lit("void m() {"))
    asked = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("none")
    return e.select("event_id", text.suppressed(lines, F.lit(3), asked).alias("hidden"))


@query()
def similar_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts alike by matching blocks, of those that share vocabulary."""
    return diffs.alike(table(spark, d, "benchmark"), "item_id", "text", share=0.1, ratio=0.2).withColumn("ratio", F.round("ratio", 6))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) SELECT doc_id AS key, len(lines)::BIGINT AS removed, (len(lines) + 1)::BIGINT AS added FROM l WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 0, 1 FROM l WHERE doc_id % 2 = 1""")
def line_differences(spark: SparkSession, d: str) -> DataFrame:
    """Every second text with all its lines changed, the others with one line more."""
    text = F.col("text")
    changed = F.concat(F.lit("# "), F.replace(text, F.lit("\n"), F.lit("\n# ")))
    texts = table(spark, d, "documents").select("doc_id", text.alias("old"), F.concat(F.when(F.col("doc_id") % 2 == 0, changed).otherwise(text), F.lit("\n#")).alias("new"))
    return diffs.differences(texts, "doc_id", "old", "new").groupBy("key").agg(F.count_if(F.col("op") == "removed").alias("removed"), F.count_if(F.col("op") == "added").alias("added"))


@query("SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def folded_names(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts of every language."""
    return table(spark, d, "documents").select("doc_id", diffs.folded(F.col("text")).alias("folded"))
