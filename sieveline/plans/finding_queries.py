"""Findings at their places, reports of them, and differences between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.operators import findings, setops
from sieveline.plans.registry import query
from sieveline.sources import binding
from sieveline.sources.binding import table, with_sql

_F = with_sql("findings")
_PRINT = "substr(sha256(smell_type || '|' || file || '|' || class_name || '|' || method), 1, 32)"
_AUTO = "smell_type IN ('click', 'purchase')"


def _found(spark: SparkSession, d: str) -> DataFrame:
    return binding.findings(spark, d)


def _auto():
    return F.col("smell_type").isin("click", "purchase")


@query(f"{_F} SELECT finding_id, {_PRINT} AS fingerprint FROM findings")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return findings.fingerprints(_found(spark, d)).select("finding_id", "fingerprint")


@query(f"{_F} SELECT finding_id FROM findings WHERE {_PRINT} NOT IN (SELECT {_PRINT} FROM findings WHERE line < 25)")
def baseline_filter(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    return findings.accepted(found, findings.fingerprints(found.where("line < 25"))).select("finding_id")


@query(f"{_F} SELECT smell_type, severity, count(*) AS n FROM findings GROUP BY ALL")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).groupBy("smell_type", "severity").count().withColumnRenamed("count", "n")


_SITES = f", sites AS (SELECT file, class_name, method, line, count(*) AS findings, max(severity) AS worst, max(score) AS score, bool_or({_AUTO}) AS automated FROM findings GROUP BY ALL)"


@query(f"{_F}{_SITES} SELECT * FROM sites")
def sites(spark: SparkSession, d: str) -> DataFrame:
    return findings.sites(_found(spark, d), _auto())


@query(f"{_F}{_SITES} SELECT *, row_number() OVER (ORDER BY worst DESC, findings DESC, score DESC, file, class_name, method, line) AS place FROM sites")
def sites_by_severity(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("worst"), F.desc("findings"), F.desc("score"), *findings.SITE]
    return findings.placed(findings.sites(_found(spark, d), _auto()), order)


@query(f"{_F}{_SITES} SELECT worst, count(*) AS sites, count(*) FILTER (automated) AS automated FROM sites GROUP BY worst")
def count_by_worst(spark: SparkSession, d: str) -> DataFrame:
    return findings.sites(_found(spark, d), _auto()).groupBy("worst").agg(F.count("*").alias("sites"), F.count_if("automated").alias("automated"))


@query(f"{_F} SELECT file, count(DISTINCT class_name || method || ':' || line) AS sites, count(*) AS findings FROM findings GROUP BY file ORDER BY sites DESC, findings DESC, file LIMIT 5")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return findings.hotspots(_found(spark, d), 5)


_MODEL = ", model AS (SELECT file, class_name, line, smell_type, score / 100 AS probability FROM findings WHERE severity < 2), rules AS (SELECT * FROM findings WHERE severity >= 2 OR severity IS NULL)"


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Findings of the least severity are the model's, all others the rules'."""
    found = _found(spark, d)
    model = F.coalesce(F.col("severity") < 2, F.lit(False))
    return found.where(model).select("file", "class_name", "line", "smell_type", (F.col("score") / 100).alias("probability")), found.where(~model)


@query(f"{_F}{_MODEL}, r AS (SELECT DISTINCT file, class_name, line, smell_type FROM rules), m AS (SELECT file, class_name, line, smell_type, max(probability) AS p FROM model GROUP BY ALL) SELECT r.*, m.p IS NOT NULL AS agreed, round(m.p, 6) AS probability FROM r LEFT JOIN m USING (file, class_name, line, smell_type)")
def agreement_on(spark: SparkSession, d: str) -> DataFrame:
    model, rules = _model(spark, d)
    keys = ["file", "class_name", "line", "smell_type"]
    best = model.groupBy(*keys).agg(F.max("probability").alias("p"))
    return rules.select(*keys).distinct().join(best, keys, "left").select(*keys, F.col("p").isNotNull().alias("agreed"), F.round("p", 6).alias("probability"))


@query(f"{_F}{_MODEL} SELECT file, class_name, line, smell_type, round(max(probability), 6) AS probability FROM model m WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.file = m.file AND r.class_name = m.class_name AND r.line = m.line) GROUP BY ALL")
def model_only(spark: SparkSession, d: str) -> DataFrame:
    return findings.model_only(*_model(spark, d)).withColumn("probability", F.round("probability", 6))


@query(f"{_F}, c AS (SELECT file, class_name, smell_type, round(sum(score), 4) AS share FROM findings GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file, class_name ORDER BY share DESC, smell_type) AS rn FROM c) SELECT file, class_name, rn AS place, smell_type AS feature, share FROM r WHERE rn <= 2")
def top_contributions(spark: SparkSession, d: str) -> DataFrame:
    shares = _found(spark, d).groupBy("file", "class_name", "smell_type").agg(F.round(F.sum("score"), 4).alias("share"))
    rank = F.row_number().over(Window.partitionBy("file", "class_name").orderBy(F.desc("share"), "smell_type"))
    return shares.withColumn("place", rank.cast("long")).where("place <= 2").select("file", "class_name", "place", F.col("smell_type").alias("feature"), "share")


@query(f"{_F} SELECT smell_type, dense_rank() OVER (ORDER BY smell_type) - 1 AS rule_index FROM (SELECT DISTINCT smell_type FROM findings)")
def sarif_rule_index(spark: SparkSession, d: str) -> DataFrame:
    return findings.rule_index(_found(spark, d))


@query(f"""{_F}, i AS (SELECT smell_type, dense_rank() OVER (ORDER BY smell_type) - 1 AS k FROM (SELECT DISTINCT smell_type FROM findings))
    SELECT finding_id, '{{"ruleId":"' || smell_type || '","ruleIndex":' || k || ',"level":"' || CASE severity WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'note' END || '","locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}},"region":{{"startLine":' || greatest(line, 1) || '}}}}}}],"partialFingerprints":{{"primary":"' || {_PRINT} || '"}}}}' AS result
    FROM findings JOIN i USING (smell_type)""")
def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    return findings.sarif(_found(spark, d))


@query(f"{_F} SELECT smell_type AS reason, count(*) AS n, arg_min(file, finding_id) AS example FROM findings WHERE severity < 3 GROUP BY smell_type")
def decline_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).where("severity < 3").groupBy(F.col("smell_type").alias("reason")).agg(F.count("*").alias("n"), F.min_by("file", "finding_id").alias("example"))


@query(f"{_F} SELECT smell_type, severity, count(*) AS detected, count(*) FILTER (line < 20) AS applied, count(*) FILTER (line >= 30) AS refused, round(count(*) FILTER (line < 20) / nullif(count(*) FILTER (line < 20 OR line >= 30), 0), 6) AS rate FROM findings GROUP BY ROLLUP (smell_type, severity)")
def refusal_rates(spark: SparkSession, d: str) -> DataFrame:
    return findings.rates(_found(spark, d), ["smell_type", "severity"], F.col("line") < 20, F.col("line") >= 30)


@query("SELECT o_custkey AS repository, count(*) AS samples FROM orders GROUP BY o_custkey")
def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("repository")).agg(F.count("*").alias("samples")).orderBy(F.desc("samples"), "repository")


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), p AS (SELECT doc_id, list_distinct(w[1:len(w) // 2]) AS old, list_distinct(w) AS new FROM w)
    SELECT doc_id, array_to_string(list_sort(list_filter(new, lambda x: NOT list_contains(old, x))), ' ') AS members FROM p""")
def introduced_members(spark: SparkSession, d: str) -> DataFrame:
    """Words of the whole text that its first half doesn't have."""
    words = F.split("text", " ")
    sides = table(spark, d, "documents").select("doc_id", words.alias("new")).select("doc_id", F.slice("new", F.lit(1), F.floor(F.size("new") / 2).cast("int")).alias("old"), "new")
    return sides.select("doc_id", F.array_join(setops.introduced(F.col("old"), F.col("new")), " ").alias("members"))


_CHANGE = f"{_F}, n AS (SELECT file, smell_type, count(*) FILTER (finding_id % 2 = 0) AS before, count(*) FILTER (finding_id % 2 = 1) AS after FROM findings GROUP BY ALL)"


def _change(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    return setops.multiset_change(found.where("finding_id % 2 = 0"), found.where("finding_id % 2 = 1"), ["file", "smell_type"])


@query(f"{_CHANGE} SELECT file, smell_type, after - before AS more FROM n WHERE after > before")
def introduced_smells(spark: SparkSession, d: str) -> DataFrame:
    return _change(spark, d).where("after > before").select("file", "smell_type", F.col("introduced").alias("more"))


@query(f"{_CHANGE} SELECT file, smell_type, greatest(before - after, 0) AS removed, greatest(after - before, 0) AS introduced, least(before, after) AS kept FROM n")
def write_effect(spark: SparkSession, d: str) -> DataFrame:
    return _change(spark, d).select("file", "smell_type", "removed", "introduced", "kept")


@query(f"{_F}, n AS (SELECT file, list_distinct(list(method) FILTER (line < 25)) AS before, list_distinct(list(method) FILTER (line >= 25)) AS after FROM findings GROUP BY file) SELECT file, coalesce(len(list_filter(after, lambda x: NOT list_contains(coalesce(before, []), x))), 0)::BIGINT AS new FROM n")
def new_errors(spark: SparkSession, d: str) -> DataFrame:
    sets = _found(spark, d).groupBy("file").agg(F.collect_set(F.when(F.col("line") < 25, F.col("method"))).alias("before"), F.collect_set(F.when(F.col("line") >= 25, F.col("method"))).alias("after"))
    return sets.select("file", F.size(F.array_except("after", "before")).cast("long").alias("new"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS old, string_split(replace(text, 'the', 'THE'), chr(10)) AS new FROM documents)
    SELECT doc_id, len(list_filter(list_zip(old, new), lambda p: p[1] <> p[2]))::BIGINT AS changed, len(old)::BIGINT AS lines FROM l""")
def counted_changes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("old"), F.split(F.replace("text", F.lit("the"), F.lit("THE")), "\n").alias("new"))
    return lines.select("doc_id", F.size(F.filter(F.arrays_zip("old", "new"), lambda p: p["old"] != p["new"])).cast("long").alias("changed"), F.size("old").cast("long").alias("lines"))


@query("""WITH e AS (SELECT l_orderkey AS file, l_partkey % 500 AS start, l_partkey % 500 + l_suppkey % 40 AS end_, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 500, l_partkey % 500 + l_suppkey % 40, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)
    SELECT a.file, count(DISTINCT a.i) FILTER (b.i IS NOT NULL) AS conflicts, count(DISTINCT a.i) AS edits FROM e a LEFT JOIN e b ON b.file = a.file AND b.i < a.i AND ((a.start < b.end_ AND b.start < a.end_) OR (a.start = a.end_ AND b.start = b.end_ AND a.start = b.start) OR (a.start = a.end_ AND a.start >= b.start AND a.start < b.end_)) GROUP BY a.file""")
def edit_conflicts(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("l_partkey") % 500).alias("start")
    edits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), start, (F.col("l_partkey") % 500 + F.col("l_suppkey") % 40).alias("end"))
    return setops.conflicts(edits, "file").groupBy("file").agg(F.count_if("conflict").alias("conflicts"), F.count("*").alias("edits"))


_VERDICT = "CASE WHEN value < 5 THEN 'broken_syntax' WHEN value < 20 THEN 'new_errors' WHEN value < 50 THEN 'parses' WHEN value < 80 THEN 'no_new_errors' ELSE 'compiles' END"


@query(f"SELECT event_id, {_VERDICT} AS verdict, value >= 20 AS passed FROM events")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.expr(_VERDICT).alias("verdict"), (F.col("value") >= 20).alias("passed"))


@query(f"""WITH v AS (SELECT user_id, {_VERDICT} AS verdict, lead({_VERDICT}) OVER (PARTITION BY user_id ORDER BY event_id) AS later FROM events) SELECT verdict, later, count(*) AS n FROM v WHERE later IS NOT NULL GROUP BY ALL""")
def verdict_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("verdict", F.expr(_VERDICT))
    later = F.lead("verdict").over(Window.partitionBy("user_id").orderBy("event_id"))
    return rows.withColumn("later", later).where("later is not null").groupBy("verdict", "later").agg(F.count("*").alias("n"))


@query(f"{_F}, o AS (SELECT finding_id, file, severity, row_number() OVER (PARTITION BY file ORDER BY finding_id) - 1 AS ordinal FROM findings) SELECT finding_id, file, ordinal FROM o WHERE severity = 3")
def ordinal_in_file(spark: SparkSession, d: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("file").orderBy("finding_id")) - 1
    return _found(spark, d).withColumn("ordinal", at.cast("long")).where("severity = 3").select("finding_id", "file", "ordinal")


@query(f"{_F} SELECT finding_id, upper(left(smell_type, 3)) || '-' || printf('%05d', row_number() OVER (PARTITION BY smell_type ORDER BY finding_id)) AS label FROM findings")
def review_labels(spark: SparkSession, d: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("smell_type").orderBy("finding_id"))
    number = at.cast("string")
    filled = F.lpad(number, F.greatest(F.length(number), F.lit(5)), F.lit("0"))  # longer numbers aren't cut
    return _found(spark, d).select("finding_id", F.concat(F.upper(F.substring("smell_type", 1, 3)), F.lit("-"), filled).alias("label"))


@query("""WITH l AS (SELECT conv_id, turn, role, length(text) > 1000 AS changed FROM conversations), c AS (SELECT conv_id, turn, role, bool_or(changed) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS shown FROM l) SELECT conv_id, turn, role FROM c WHERE shown""")
def diff_context(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "conversations").select("conv_id", "turn", "role", (F.length("text") > 1000).alias("changed"))
    return setops.context(lines, "conv_id", "turn", "changed", 1).select("conv_id", "turn", "role")


@query("""SELECT 'cited' AS side, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)
    UNION ALL SELECT 'listed', count(*) FROM customer WHERE c_acctbal > 1000 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def referential_audit(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    listed = table(spark, d, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("k"))
    one = lambda side, rows: rows.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return one("cited", cited.join(listed, "k", "left_anti")).unionByName(one("listed", listed.join(cited, "k", "left_anti")))


@query(f"{_F}, t AS (SELECT smell_type, count(*) AS n FROM findings GROUP BY smell_type) SELECT sum(n)::BIGINT AS parts, (SELECT count(*) FROM findings) AS total, sum(n) = (SELECT count(*) FROM findings) AS agrees FROM t")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    counted = _found(spark, d).rollup("smell_type").agg(F.count("*").alias("n"), F.grouping("smell_type").alias("whole"))
    both = counted.agg(F.sum(F.when(F.col("whole") == 0, F.col("n"))).alias("parts"), F.max(F.when(F.col("whole") == 1, F.col("n"))).alias("total"))
    return both.withColumn("agrees", F.col("parts") == F.col("total"))


@query(f"{_F} SELECT finding_id FROM findings f WHERE EXISTS (SELECT 1 FROM findings g WHERE g.file = f.file AND g.class_name = f.class_name AND g.method = f.method AND g.line = f.line AND severity >= 2 AND smell_type IN ('click', 'view') AND contains(lower(smell_type || ' ' || g.file || ' ' || g.class_name || ' ' || g.method), 'f1'))")
def shown_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.shown(_found(spark, d), 2, ("click", "view"), "F1").select("finding_id")


@query(f"{_F} SELECT count(*) > 0 AS fails FROM findings WHERE severity >= 3")
def severity_gate(spark: SparkSession, d: str) -> DataFrame:
    return findings.gate(_found(spark, d), 3)


@query(f"{_F}, t AS (SELECT file, count(*) FILTER (severity = 3) AS p, count(*) AS n FROM findings GROUP BY file) SELECT file, CASE WHEN p = 0 THEN '0%' WHEN p = n THEN '100%' WHEN 100 * p < n THEN '<1%' WHEN 100 * p > 99 * n THEN '>99%' ELSE floor(100 * p / n + 0.5)::BIGINT || '%' END AS critical FROM t")
def critical_share(spark: SparkSession, d: str) -> DataFrame:
    per = _found(spark, d).groupBy("file").agg(F.count_if(F.col("severity") == 3).alias("p"), F.count("*").alias("n"))
    return per.select("file", findings.share(F.col("p"), F.col("n")).alias("critical"))


@query(f"""{_F} SELECT smell_type, severity, round(score, 3) AS score, file, line, class_name, method, CASE smell_type WHEN 'click' THEN 'EncapsulateField' ELSE '' END AS refactorings FROM findings""")
def findings_report(spark: SparkSession, d: str) -> DataFrame:
    return findings.csv_rows(_found(spark, d), F.when(F.col("smell_type") == "click", F.array(F.lit("EncapsulateField"))).otherwise(F.array().cast("array<string>")))


@query("""SELECT event_id, event_id % 2 = 0 AND event_type IN ('click', 'view') OR event_id % 2 = 1 AND event_id % 7 = 0 AS hidden FROM events""")
def annotation_suppression(spark: SparkSession, d: str) -> DataFrame:
    from sieveline.functions.text import suppressed_by_annotation

    e = table(spark, d, "events")
    named = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"x", "smell:'), "event_type", F.lit('"'))).when(F.col("event_id") % 7 == 0, '"smell"').otherwise('"other"')
    lines = F.array(F.lit("// @SuppressWarnings(\"smell\")"), F.concat(F.lit("@SuppressWarnings("), named, F.lit(")")), F.lit("void m() {"))
    asked = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("none")
    return e.select("event_id", suppressed_by_annotation(lines, F.lit(2), asked).alias("hidden"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not_github' WHEN 2 THEN NULL ELSE 'no_repository' END AS refused, CASE WHEN page_id % 2 = 0 THEN 'own' || page_id || '/repo' END AS repository, CASE page_id % 4 WHEN 0 THEN 'HEAD' WHEN 2 THEN 'v1/x' END AS ref FROM pages""")
def import_links(spark: SparkSession, d: str) -> DataFrame:
    from sieveline.sources.archives import repository

    k = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    link = F.when(kind == 0, F.concat(F.lit("git@github.com:own"), k, F.lit("/repo.git"))).when(kind == 1, F.col("url")).when(kind == 2, F.concat(F.lit("https://github.com/own"), k, F.lit("/repo/tree/v1/x"))).otherwise(F.concat(F.lit("own"), k))
    return table(spark, d, "pages").select("page_id", repository(link).alias("r")).select("page_id", "r.refused", F.when(F.col("r.refused").isNull(), F.concat_ws("/", "r.owner", "r.name")).alias("repository"), "r.ref")
