"""Samples against entities, tables of verdicts against each other, and the names and paths that link them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text
from sieveline.operators import matching
from sieveline.plans.registry import query
from sieveline.sources import binding
from sieveline.sources.binding import table, with_sql

_ENTITIES_SQL = """entities AS (SELECT 'f' || (p_partkey % 300) AS file, p_partkey % 40 AS start, p_brand AS name, p_partkey % 40 + p_size AS end_ FROM part),
    samples AS (SELECT l_partkey * 8 + l_linenumber AS sample_id, 'f' || (l_partkey % 330) AS file, l_partkey % 43 AS start, any_value(p_brand) AS name, any_value(l_partkey % 40 + p_size - (l_partkey % 6) // 5) AS end_
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""
_MATCH_SQL = f"""WITH {_ENTITIES_SQL}, n AS (SELECT s.*, (SELECT count(*) FROM entities e WHERE e.file = s.file) AS n_file, (SELECT count(*) FROM entities e WHERE e.file = s.file AND e.start = s.start) AS n_line,
    (SELECT count(*) FROM entities e WHERE e.file = s.file AND e.start = s.start AND e.name = s.name) AS n_named,
    (SELECT count(*) FROM entities e WHERE e.file = s.file AND e.start = s.start AND e.name = s.name AND e.end_ = s.end_) AS n_span FROM samples s),
    m AS (SELECT sample_id, file, CASE WHEN n_file = 0 THEN 'no_file' WHEN n_line = 0 AND file IN ('f7', 'f8') THEN 'syntax_errors' WHEN n_line = 0 THEN 'no_entity' WHEN n_named = 0 THEN 'name_mismatch'
        WHEN n_named > 1 THEN 'ambiguous' WHEN n_span = 0 THEN 'span_mismatch' ELSE 'matched' END AS outcome FROM n)"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    file = lambda k, n: F.concat(F.lit("f"), (k % n).cast("string"))
    k = F.col("p_partkey")
    entities = part.select(file(k, 300).alias("file"), (k % 40).alias("start"), F.col("p_brand").alias("name"), (k % 40 + F.col("p_size")).alias("end"))
    items = table(spark, d, "lineitem").select("l_partkey", "l_linenumber").distinct().join(part, F.col("l_partkey") == k)
    k = F.col("l_partkey")
    samples = items.select((k * 8 + F.col("l_linenumber")).alias("sample_id"), file(k, 330).alias("file"), (k % 43).alias("start"), F.col("p_brand").alias("name"), (k % 40 + F.col("p_size") - F.floor(k % 6 / 5)).alias("end"))
    return matching.match(samples, entities, spark.createDataFrame([("f7",), ("f8",)], "file string"))


@query(_MATCH_SQL + " SELECT * FROM m")
def match_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d)


@query(_MATCH_SQL + " SELECT file, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in matching.OUTCOMES) + " FROM m GROUP BY file")
def match_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return matching.breakdown(_matched(spark, d), "file")


@query("""WITH s AS (SELECT o_orderkey, o_custkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AS p FROM orders)
    SELECT count(*) AS samples, count(*) FILTER (p) AS reachable, count(DISTINCT o_custkey) AS repositories, count(DISTINCT o_custkey) FILTER (p) AS present, round(count(*) FILTER (p) / count(*), 6) AS share FROM s""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    present = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return matching.coverage(table(spark, d, "orders").select("o_orderkey", "o_custkey"), present, "o_custkey")


@query("SELECT o_orderkey AS sample_id, sum(l_quantity)::BIGINT AS lines, count(*) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey")
def replay_join(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(samples, "l_orderkey").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.sum("l_quantity").cast("long").alias("lines"), F.count("*").alias("parts"))


_PATH = "url || chr(92) || 'src' || chr(92) || 'F' || page_id || '.java/'"


@query(f"SELECT page_id, regexp_replace(replace({_PATH}, chr(92), '/'), '^/+|/+$', '', 'g') AS path FROM pages")
def normalise_path(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("url", F.lit("\\src\\F"), F.col("page_id").cast("string"), F.lit(".java/"))
    return table(spark, d, "pages").select("page_id", text.normalised_path(raw).alias("path"))


_CODE = "CASE WHEN p_partkey % 2 = 0 THEN 'org.x.' || replace(p_brand, '#', '') || '#run' || p_size || ' int String' ELSE 'org.x.' || replace(p_brand, '#', '') END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'run' || p_size ELSE replace(p_brand, '#', '') END AS name FROM part")
def simple_name(spark: SparkSession, d: str) -> DataFrame:
    brand = F.concat(F.lit("org.x."), F.replace("p_brand", F.lit("#"), F.lit("")))
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat(brand, F.lit("#run"), F.col("p_size").cast("string"), F.lit(" int String"))).otherwise(brand)
    return table(spark, d, "part").select("p_partkey", text.simple_name(code).alias("name"))


@query("SELECT s_suppkey, 'org' || s_nationkey || '/' || replace(s_name, '#', '-') AS repository FROM supplier")
def owner_name(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("org"), F.col("s_nationkey").cast("string"), F.lit("/"), F.replace("s_name", F.lit("#"), F.lit("-")))
    url = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("git@github.com:"), path, F.lit(".git"))).otherwise(F.concat(F.lit("https://github.com/"), path))
    return table(spark, d, "supplier").select("s_suppkey", text.owner_name(url).alias("repository"))


@query(with_sql("findings") + "SELECT finding_id, file || chr(9) || class_name || chr(9) || split_part(method, '(', 1) AS entity FROM findings")
def entity_key(spark: SparkSession, d: str) -> DataFrame:
    return binding.findings(spark, d).select("finding_id", F.concat_ws("\t", "file", "class_name", F.split_part("method", F.lit("("), F.lit(1))).alias("entity"))


#: Repositories that go by another name now.
MOVES = {"NATION0": "REALM0", "NATION7": "REALM7", "NATION13": "REALM13"}


@query("SELECT n_nationkey, CASE 'NATION' || n_nationkey WHEN 'NATION0' THEN 'REALM0' WHEN 'NATION7' THEN 'REALM7' WHEN 'NATION13' THEN 'REALM13' ELSE 'NATION' || n_nationkey END AS repository FROM nation")
def repo_moves(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("NATION"), F.col("n_nationkey").cast("string"))
    moved = F.try_element_at(F.create_map(*[F.lit(x) for kv in MOVES.items() for x in kv]), name)
    return table(spark, d, "nation").select("n_nationkey", F.coalesce(moved, name).alias("repository"))


@query(with_sql("findings") + """, r AS (SELECT file, class_name, bool_or(smell_type IN ('click', 'view')) AS fired FROM findings GROUP BY ALL)
    SELECT DISTINCT f.file, f.class_name, coalesce(r.fired, false) AS fired FROM findings f LEFT JOIN r ON r.file = f.file AND r.class_name = f.class_name""")
def external_verdicts(spark: SparkSession, d: str) -> DataFrame:
    found = binding.findings(spark, d)
    rules = found.groupBy("file", "class_name").agg(F.collect_set("smell_type").alias("rules"))
    fired = F.coalesce(F.arrays_overlap("rules", F.array(F.lit("click"), F.lit("view"))), F.lit(False))
    return found.select("file", "class_name").distinct().join(rules, ["file", "class_name"], "left").select("file", "class_name", fired.alias("fired"))


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN left(text, 10) END AS named FROM conversations)
    SELECT conv_id, turn, last_value(named IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS file FROM l""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("role") == "user", F.substring("text", 1, 10))
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(named, ignorenulls=True).over(so_far).alias("file"))


@query("SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1))) AS tags, len(regexp_extract_all(html, '<a '))::BIGINT AS links FROM pages")
def report_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sort_array(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1))).alias("tags"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"))
