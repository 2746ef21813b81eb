"""The relations of the code model over the driver's tables.

Nothing in the driver's tables is source code, so each relation has a stand-in whose columns have the right types and
realistic spreads: customers are classes, line items are methods of the class that ordered them, conversations are
reviews, documents are source texts, events are findings. Each is a projection, and a join where the model has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_id, name, package, repository, kind, superclass (null: none)."""
    k = F.col("c_custkey")
    kind = F.when(k % 10 == 0, "interface").when(k % 10 == 1, "enum").when(k % 10 == 2, "record").otherwise("class")
    return table(spark, sf_dir, "customer").select(
        k.alias("class_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("package"), F.col("c_nationkey").alias("repository"),
        kind.alias("kind"), F.when(k % 5 != 0, F.floor(k / 3)).cast("long").alias("superclass"),
    )


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method per line item: its size, complexity, visibility, own field accesses, foreign accesses and calls."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    steps = F.sequence(F.lit(0).cast("long"), F.col("l_linenumber").cast("long"))
    foreign = F.transform(steps, lambda j: F.struct(((F.col("l_suppkey") + F.floor(j / 2)) % 10).cast("long").alias("receiver"), ((F.col("l_partkey") + 3 * j) % 20).cast("long").alias("member")))
    return items.select(
        F.col("o_custkey").alias("class_id"), (F.row_number().over(order) - 1).cast("long").alias("i"),
        (1 + F.col("l_quantity").cast("long") % 7).alias("cc"), F.col("l_quantity").cast("long").alias("mloc"), F.col("l_linenumber").cast("long").alias("np"),
        (F.round(F.col("l_discount") * 100).cast("long") % 6).alias("nesting"), (F.round(F.col("l_tax") * 100).cast("long") % 9).alias("locals"),
        (F.col("l_returnflag") != "R").alias("public"), (F.col("l_linestatus") == "F").alias("static"), (F.col("l_linenumber") == 1).alias("ctor"),
        ((F.col("l_partkey") % 5 == 0) & (F.col("l_linenumber") != 1)).alias("accessor"),
        F.array_distinct(F.array(F.col("l_partkey") % 8, F.col("l_suppkey") % 8)).alias("own"), F.array_distinct(foreign).alias("foreign"),
        F.array_distinct(F.array(F.col("l_partkey") % 15, F.col("l_suppkey") % 15)).alias("calls"),
    )


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight fields per class: public if even, constant if divisible by four."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("field")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("class_id"), k).select("class_id", "field", (F.col("field") % 2 == 0).alias("public"), (F.col("field") % 4 == 0).alias("constant"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review per conversation turn: sample_id, smell, reviewer, rank 0 to 3."""
    smells = F.array(*map(F.lit, ("blob", "data class", "feature envy", "long method")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), F.get(smells, (F.col("conv_id") % 4).cast("int")).alias("smell"), F.col("turn").alias("reviewer"), (F.length("text") % 4).cast("long").alias("rank"))


def judged(spark: SparkSession, sf_dir: str, threshold: float = 150_000.0) -> DataFrame:
    """Truth and prediction per order: key, repository, smell, truth, predicted, value, severities."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    smells = F.array(*map(F.lit, ("blob", "data class", "feature envy", "long method")))
    return orders.select(
        F.col("o_orderkey").alias("key"), F.col("c_nationkey").alias("repository"), F.get(smells, (F.col("o_orderkey") % 4).cast("int")).alias("smell"),
        (F.col("o_orderstatus") == "F").alias("truth"), (F.col("o_totalprice") > threshold).alias("predicted"), F.col("o_totalprice").alias("value"),
        (F.substring("o_orderpriority", 1, 1).cast("long") % 4).alias("reviewed"), (F.floor(F.col("o_totalprice") / 1000).cast("long") % 4).alias("measured"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding per event: its place (file, class, method, line), type, score and severity rank."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("finding_id"), F.concat(F.lit("src/F"), (F.col("user_id") % 97).cast("string"), F.lit(".java")).alias("file"),
        F.concat(F.lit("C"), (F.col("user_id") % 11).cast("string")).alias("class_name"), F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string"), F.lit("()")).alias("method"),
        (F.col("event_id") % 50).alias("line"), F.col("event_type").alias("smell_type"), F.round("value", 6).alias("score"),
        F.when(F.col("value") < 30, 1).when(F.col("value") < 70, 2).otherwise(3).cast("long").alias("severity"),
    )


#: The same relations in SQL, as common table expressions.
SQL = {
    "classes": """classes AS (SELECT c_custkey AS class_id, c_name AS name, c_mktsegment AS package, c_nationkey AS repository,
        CASE c_custkey % 10 WHEN 0 THEN 'interface' WHEN 1 THEN 'enum' WHEN 2 THEN 'record' ELSE 'class' END AS kind,
        CASE WHEN c_custkey % 5 <> 0 THEN c_custkey // 3 END AS superclass FROM customer)""",
    "methods": """methods AS (SELECT o_custkey AS class_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i,
        1 + l_quantity::BIGINT % 7 AS cc, l_quantity::BIGINT AS mloc, l_linenumber::BIGINT AS np, round(l_discount * 100)::BIGINT % 6 AS nesting, round(l_tax * 100)::BIGINT % 9 AS locals,
        l_returnflag <> 'R' AS public, l_linestatus = 'F' AS static, l_linenumber = 1 AS ctor, l_partkey % 5 = 0 AND l_linenumber <> 1 AS accessor,
        list_distinct([l_partkey % 8, l_suppkey % 8]) AS own,
        list_distinct(list_transform(range(0, l_linenumber::BIGINT + 1), lambda j: {'receiver': (l_suppkey + j // 2) % 10, 'member': (l_partkey + 3 * j) % 20})) AS "foreign",
        list_distinct([l_partkey % 15, l_suppkey % 15]) AS calls FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "fields": "fields AS (SELECT c_custkey AS class_id, k AS field, k % 2 = 0 AS public, k % 4 = 0 AS constant FROM customer, range(0, 8) AS r(k))",
    "reviews": """reviews AS (SELECT conv_id AS sample_id, ['blob', 'data class', 'feature envy', 'long method'][conv_id % 4 + 1] AS smell, turn AS reviewer, (length(text) % 4)::BIGINT AS rank FROM conversations)""",
    "judged": """judged AS (SELECT o_orderkey AS key, c_nationkey AS repository, ['blob', 'data class', 'feature envy', 'long method'][o_orderkey % 4 + 1] AS smell, o_orderstatus = 'F' AS truth,
        o_totalprice > 150000 AS predicted, o_totalprice AS value, substr(o_orderpriority, 1, 1)::BIGINT % 4 AS reviewed, floor(o_totalprice / 1000)::BIGINT % 4 AS measured
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "findings": """findings AS (SELECT event_id AS finding_id, 'src/F' || (user_id % 97) || '.java' AS file, 'C' || (user_id % 11) AS class_name, 'm' || (event_id % 7) || '()' AS method,
        event_id % 50 AS line, event_type AS smell_type, round(value, 6) AS score, CASE WHEN value < 30 THEN 1 WHEN value < 70 THEN 2 ELSE 3 END::BIGINT AS severity FROM events)""",
}


def with_sql(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
