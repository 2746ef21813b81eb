"""Java texts scanned and rewritten, and classifiers under grouped folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.java import analysis, facts, rewrites
from sieveline.operators import models
from sieveline.plans.registry import query
from sieveline.sources.binding import table


def java_texts(spark: SparkSession, d: str) -> DataFrame:
    """A class per order and a method per line item: some decisions each, and two accesses to the class of another order."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), (F.col("l_quantity").cast("long") % 4).cast("int").alias("q"))
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("items"))  # an order has few lines; their texts are written after the shuffle

    def method(x: Column) -> Column:
        name = F.concat(F.lit("m"), x["l_linenumber"].cast("string"), F.lit("_"), x["l_partkey"].cast("string"), F.lit("_"), x["l_suppkey"].cast("string"), F.lit("_"), x["price"].cast("string"))
        body = F.concat(F.lit("    total += other.getTotal() + other.total; // if (x) while (y)\n"), F.repeat(F.lit("    if (total > a) { total++; }\n"), x["q"]))
        return F.concat(F.lit("  public void "), name, F.lit("(int a, O"), (F.col("l_orderkey") * 2).cast("string"), F.lit(" other) {\n"), body, F.lit("  }\n"))

    key, written = F.col("l_orderkey").cast("string"), F.array_join(F.sort_array(F.transform("items", method)), "")
    return per.select(F.concat(F.lit("src/O"), key, F.lit(".java")).alias("file"), F.concat(F.lit("package shop;\n/* class Not {} */\npublic class O"), key, F.lit(" {\n  private int total = 0;\n"), written, F.lit("}\n")).alias("content"))


@query("""SELECT 'O' || l_orderkey AS name, count(*) AS nom, sum(1 + l_quantity::BIGINT % 4)::BIGINT AS wmc, max((l_quantity::BIGINT % 4 > 0)::INT)::BIGINT AS deepest, sum(2 + l_quantity::BIGINT % 4)::BIGINT AS lines FROM lineitem GROUP BY l_orderkey""")
def java_parse(spark: SparkSession, d: str) -> DataFrame:
    types = facts.entities(facts.units(java_texts(spark, d), facts.SIZES)).where("size(methods) > 0")
    total = lambda part: F.sum(F.aggregate("methods", F.lit(0).cast("long"), lambda n, m: n + m[part]))
    return types.groupBy("name").agg(F.sum(F.size("methods")).alias("nom"), total("cc").alias("wmc"), F.max(F.array_max("methods.nesting").cast("long")).alias("deepest"), total("mloc").alias("lines"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey FROM lineitem) SELECT 'O' || l_orderkey AS class_name, count(*) AS methods, (count(*) * CASE WHEN l_orderkey * 2 IN (SELECT l_orderkey FROM k) AND l_orderkey > 0 THEN 2 ELSE 0 END)::BIGINT AS in_project,
    (count(*) * CASE WHEN l_orderkey > 0 THEN 2 ELSE 0 END)::BIGINT AS alone FROM lineitem GROUP BY l_orderkey""")
def context_shift(spark: SparkSession, d: str) -> DataFrame:
    """Foreign accesses when the project's types are known, and when each file is measured alone."""
    return facts.foreign_counts(facts.entities(facts.units(java_texts(spark, d), facts.ACCESSES)))


_HEAD = "'class O' || o_orderkey || ' {' || chr(10) || '  ' || CASE o_orderstatus WHEN 'P' THEN 'int' ELSE 'void' END || ' run(int a) {' || chr(10)"


@query(f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'has_else' ELSE 'needs_void' END AS refused,
    {_HEAD} || CASE o_orderstatus WHEN 'F' THEN '    if (!(a > ' || o_orderkey || ' && ok())) {{' || chr(10) || '      return;' || chr(10) || '    }}' || chr(10) || '    go();' || chr(10) || '    stop(a);'
        WHEN 'O' THEN '    if (a > ' || o_orderkey || ' && ok()) {{' || chr(10) || '      go();' || chr(10) || '      stop(a);' || chr(10) || '    }} else {{ }}' ELSE '    if (a > ' || o_orderkey || ' && ok()) {{' || chr(10) || '      go();' || chr(10) || '      stop(a);' || chr(10) || '    }}' END || chr(10) || '  }}' || chr(10) || '}}' || chr(10) AS rewritten FROM orders""")
def guard_clauses(spark: SparkSession, d: str) -> DataFrame:
    """One rewrite per order's class, applied or refused."""
    orders, key = table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    kind = F.when(F.col("o_orderstatus") == "P", "int").otherwise("void")
    tail = F.when(F.col("o_orderstatus") == "O", " else { }").otherwise("")
    text = F.concat(F.lit("class O"), key, F.lit(" {\n  "), kind, F.lit(" run(int a) {\n    if (a > "), key, F.lit(" && ok()) {\n      go();\n      stop(a);\n    }"), tail, F.lit("\n  }\n}\n"))
    files = orders.select(key.alias("file"), text.alias("text"))
    sites = orders.select(key.alias("file"), F.lit(2).alias("line"), F.lit("DeepNesting").alias("smell_type"), F.lit("run").alias("method"))
    return rewrites.planned(sites, files).select(F.col("file").cast("long").alias("o_orderkey"), "refused", "rewritten")


@query("""SELECT 'src/C' || c_custkey || '.java' AS file, CASE c_custkey % 3
    WHEN 0 THEN '@@ -1,3 +1,3 @@' || chr(10) || ' a' || chr(10) || '-' || c_name || chr(10) || '+' || c_name || '!' || chr(10) || ' z' || chr(10)
    WHEN 1 THEN '@@ -1,3 +1,3 @@' || chr(10) || ' a' || chr(10) || '-' || c_name || chr(10) || '-z' || chr(10) || '\ No newline at end of file' || chr(10) || '+' || c_name || '!' || chr(10) || '+z' || chr(10) END AS hunk FROM customer WHERE c_custkey % 3 < 2""")
def unified_patch(spark: SparkSession, d: str) -> DataFrame:
    """The patch of each customer's file without its two lines of names: a changed line, with or without a newline at the end, or no change."""
    kind, text = F.col("c_custkey") % 3, F.concat(F.lit("a\n"), "c_name")
    before = F.concat(text, F.when(kind == 1, "\nz").otherwise("\nz\n"))
    after = F.when(kind == 2, before).otherwise(F.concat(text, F.lit("!\nz\n")))
    file = F.concat(F.lit("src/C"), F.col("c_custkey").cast("string"), F.lit(".java")).alias("file")
    made = rewrites.patches(table(spark, d, "customer").select(file, before.alias("before"), after.alias("after")))
    return made.select("file", F.regexp_replace("patch", r"^--- a/[^\n]*\n\+\+\+ b/[^\n]*\n", "").alias("hunk"))


@query("""WITH s AS (SELECT p_type AS stratum, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY md5('7-' || p_type || '-' || p_partkey), p_partkey) AS rn FROM part) SELECT stratum, p_partkey FROM s WHERE rn <= 3""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three parts of each type, in the order of a hash of seed, type and key."""
    order = F.md5(F.concat(F.lit("7-"), "p_type", F.lit("-"), F.col("p_partkey").cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy("p_type").orderBy(order, "p_partkey"))
    return table(spark, d, "part").withColumn("rn", rank).where("rn <= 3").select(F.col("p_type").alias("stratum"), "p_partkey")


FEATURES = ["items", "quantity", "discount", "tax"]


def _training(spark: SparkSession, d: str) -> DataFrame:
    """Orders as entities: sums over their lines are features, the status is the label, the customer's nation the group."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").cast("double").alias("items"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("nation"), (F.col("o_totalprice") > 150_000).alias("large")).join(lines, "id")
    return models.folded(models.assembled(rows, FEATURES, "large", "nation"))


def _cv(name: str, trees: int = 20) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return models.scored(models.cross_validated(_training(spark, d), models.zoo(trees)[name]))

    query(name={"logistic": "logistic_cv", "forest": "forest_cv", "boosting": "gbt_cv"}[name])(run)


for _name in ("logistic", "forest", "boosting"):
    _cv(_name)


@query()
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """Mean fall of the MCC, over all folds and ten repeats, when a feature is permuted."""
    rows = _training(spark, d).persist()
    found = models.importances_over_folds(rows, models.zoo()["logistic"], FEATURES)
    rows.unpersist()
    return spark.createDataFrame(sorted(found.items()), "feature string, importance double")


@query()
def feature_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Scores with all features of an order, and without its number of items and its quantity."""
    return models.ablation(_training(spark, d), models.zoo()["logistic"], FEATURES, ["items", "quantity"])


@query()
def explain(spark: SparkSession, d: str) -> DataFrame:
    """What each feature of a flagged order takes from its probability when made typical."""
    rows = _training(spark, d)
    return models.explained(models.zoo()["logistic"]().fit(rows), rows, FEATURES)


@query("""WITH e AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS before, count(*) FILTER (event_id % 2 = 1) AS after, count(DISTINCT value > 50) AS names FROM events GROUP BY ALL)
    SELECT user_id, event_type, CASE WHEN names > 1 AND before > 3 THEN 'unknown' WHEN after = 0 THEN 'resolved' ELSE 'persists' END AS resolution FROM e WHERE before > 0""")
def resolution(spark: SparkSession, d: str) -> DataFrame:
    """Whether what was found before is found after: unknown where the name is ambiguous."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("event_id") % 2 == 0).alias("before"), F.count_if(F.col("event_id") % 2 == 1).alias("after"), F.countDistinct(F.col("value") > 50).alias("names")).where("before > 0")
    return n.select("user_id", "event_type", F.when((F.col("names") > 1) & (F.col("before") > 3), "unknown").when(F.col("after") == 0, "resolved").otherwise("persists").alias("resolution"))


def _extractable(kind: str, key: str, inner: str, rewritten: bool) -> str:
    """The SQL text of a method with a loop, before or after the loop becomes a method."""
    loop = f"'    for (int i = 0; i < a; i++) {{' || chr(10) || '      sum += i;' || chr(10) || '      {inner}' || chr(10) || '      go();' || chr(10) || '    }}' || chr(10)"
    start = f"'class O' || {key} || ' {{' || chr(10) || '  int run(int a) {{' || chr(10) || '    {kind} sum = ' || {key} || ';' || chr(10)"
    if not rewritten:
        return f"{start} || {loop} || '    return sum;' || chr(10) || '  }}' || chr(10) || '}}' || chr(10)"
    made = f"chr(10) || chr(10) || '  private int extracted(int a, int sum) {{' || chr(10) || {loop} || '    return sum;' || chr(10) || '  }}'"
    return f"{start} || '    sum = extracted(a, sum);' || chr(10) || '    return sum;' || chr(10) || '  }}' || {made} || chr(10) || '}}' || chr(10)"


@query(f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'escaping_control_flow' ELSE 'unknown_type' END AS refused,
    CASE o_orderstatus WHEN 'F' THEN {_extractable('int', 'o_orderkey', 'go();', True)} WHEN 'O' THEN {_extractable('int', 'o_orderkey', 'if (sum > 9) return i;', False)} ELSE {_extractable('var', 'o_orderkey', 'go();', False)} END AS rewritten FROM orders""")
def extract_method(spark: SparkSession, d: str) -> DataFrame:
    """The loop of each order's class becomes a method, or stays for a reason."""
    orders = table(spark, d, "orders")
    variants = {"F": ("int", "go();"), "O": ("int", "if (sum > 9) return i;"), "P": ("var", "go();")}
    text = F.lit(None).cast("string")
    for status, (kind, inner) in variants.items():
        body = f" {{\n  int run(int a) {{\n    {kind} sum = %s;\n    for (int i = 0; i < a; i++) {{\n      sum += i;\n      {inner}\n      go();\n    }}\n    return sum;\n  }}\n}}\n"
        text = F.when(F.col("o_orderstatus") == status, F.format_string("class O%s" + body, F.col("o_orderkey").cast("string"), F.col("o_orderkey").cast("string"))).otherwise(text)
    key = F.col("o_orderkey").cast("string")
    sites = orders.select(key.alias("file"), F.lit(2).alias("line"), F.lit("LongMethod").alias("smell_type"), F.lit("run").alias("method"))
    return rewrites.planned(sites, orders.select(key.alias("file"), text.alias("text"))).select(F.col("file").cast("long").alias("o_orderkey"), "refused", "rewritten")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not_private' END AS refused, CASE WHEN o_orderstatus = 'P'
    THEN 'class O' || o_orderkey || ' {' || chr(10) || '  void run(int a, int b) { go(a + b); }' || chr(10) || '  void all() { run(' || o_orderkey || ', 2); }' || chr(10) || '}' || chr(10)
    ELSE 'class O' || o_orderkey || ' {' || chr(10) || '  private record RunParameters(int a, int b) {}' || chr(10) || chr(10) || '  private void run(RunParameters parameters) { go(parameters.a() + parameters.b()); }' || chr(10) || '  void all() { run(new RunParameters(' || o_orderkey || ', 2)); }' || chr(10) || '}' || chr(10) END AS rewritten FROM orders""")
def parameter_object(spark: SparkSession, d: str) -> DataFrame:
    """The parameters of each order's class's method become a record, if it is private."""
    orders, key = table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    visible = F.when(F.col("o_orderstatus") == "P", "").otherwise("private ")
    text = F.concat(F.lit("class O"), key, F.lit(" {\n  "), visible, F.lit("void run(int a, int b) { go(a + b); }\n  void all() { run("), key, F.lit(", 2); }\n}\n"))
    sites = orders.select(key.alias("file"), F.lit(2).alias("line"), F.lit("LongParameterList").alias("smell_type"), F.lit("run").alias("method"))
    return rewrites.planned(sites, orders.select(key.alias("file"), text.alias("text"))).select(F.col("file").cast("long").alias("o_orderkey"), "refused", "rewritten")
