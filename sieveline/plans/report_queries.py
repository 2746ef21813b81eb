"""Reports, replayed features, paired differences and comparisons of passes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import names, scores
from sieveline.functions.scores import COUNTS
from sieveline.operators import comparison, detectors, inference, replay, reports
from sieveline.plans import metric_queries as mq
from sieveline.plans.registry import query
from sieveline.sources import binding, files
from sieveline.sources.binding import table, with_sql
from sieveline.streaming import ingest

_F = with_sql("findings")
_J = with_sql("judged")
_CELLS = "count(*) FILTER (truth AND p)::BIGINT AS tp, count(*) FILTER (NOT truth AND p)::BIGINT AS fp, count(*) FILTER (truth AND NOT p)::BIGINT AS fn, count(*) FILTER (NOT truth AND NOT p)::BIGINT AS tn"
_MCC = "(tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE), 0)"


@query(f"""{_F}, t AS (SELECT smell_type, count(*) AS n, min(finding_id) AS first FROM findings GROUP BY smell_type)
    SELECT 0 AS part, first AS place, '  ' || rpad(smell_type, greatest(length(smell_type), 20)::INT, ' ') || ' ' || n AS line FROM t
    UNION ALL SELECT 1, 0, '  critical=' || count(*) FILTER (severity = 3) || '  major=' || count(*) FILTER (severity = 2) || '  minor=' || count(*) FILTER (severity = 1) FROM findings
    UNION ALL SELECT 2, finding_id, '[' || rpad(CASE severity WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'MAJOR' ELSE 'MINOR' END, 8, ' ') || '] ' || smell_type || chr(10) || '    ' || file || ':' || line || ' ' || class_name || '.' || method
        || chr(10) || '    why: severity ' || severity || chr(10) || '    fix: ' || CASE WHEN smell_type = 'click' THEN 'ExtractMethod, MoveMethod' ELSE '' END FROM findings""")
def text_report(spark: SparkSession, d: str) -> DataFrame:
    fixes = F.when(F.col("smell_type") == "click", F.array(F.lit("ExtractMethod"), F.lit("MoveMethod"))).otherwise(F.array().cast("array<string>"))
    return reports.text_report(binding.findings(spark, d).withColumn("rationale", F.concat(F.lit("severity "), F.col("severity").cast("string"))).withColumn("refactorings", fixes))


@query(f"""{_F} SELECT finding_id, CASE smell_type WHEN 'click' THEN 'something was pressed' WHEN 'view' THEN 'something was shown' ELSE smell_type END || ' (' || smell_type || ')' AS name,
    CASE WHEN line = 1 THEN '1 line' ELSE line || ' lines' END AS after FROM findings""")
def plain_report(spark: SparkSession, d: str) -> DataFrame:
    glossary = spark.createDataFrame([("click", "something was pressed"), ("view", "something was shown")], "alias string, name string")
    prefixed = F.concat(F.when(F.col("line") < 25, "c_").otherwise("m_"), "smell_type")
    rows = binding.findings(spark, d).withColumn("term", F.when(F.col("smell_type").isin("click", "view"), prefixed).otherwise(F.col("smell_type")))
    found = reports.explained(rows, "term", F.broadcast(glossary))
    return found.select("finding_id", F.concat("name", F.lit(" ("), "smell_type", F.lit(")")).alias("name"), reports.counted_words(F.col("line"), "line", "lines").alias("after"))


@query(f"""WITH u AS (SELECT DISTINCT url AS file FROM pages WHERE strlen(html) < 2000) SELECT (SELECT count(*) FROM u) AS n, (SELECT string_agg(file, ', ' ORDER BY file) FROM (SELECT file FROM u ORDER BY file LIMIT {reports.NAMED})) AS named,
    greatest((SELECT count(*) FROM u) - {reports.NAMED}, 0) AS more""")
def unparsed_note(spark: SparkSession, d: str) -> DataFrame:
    return reports.unparsed_note(table(spark, d, "pages").select(F.col("url").alias("file"), (F.octet_length("html") < 2000).alias("unparsed")))


@query(mq.ALL_SQL + " SELECT * FROM found")
def replay_detectors(spark: SparkSession, d: str) -> DataFrame:
    """All strategies over entities that were flattened to feature rows and made from these again."""
    rows = replay.feature_rows(mq.class_entities(spark, d), mq.method_entities(spark, d))
    of_class = detectors.detect(replay.class_entities(rows), ["class_id"], detectors.class_strategies(mq.TUNED)).withColumn("i", F.lit(-1).cast("long"))
    of_method = detectors.detect(replay.method_entities(rows), ["class_id", "i"], detectors.method_strategies())
    return of_class.unionByName(of_method).select("class_id", "i", "smell_type", "severity", F.round("score", 6).alias("score"))


@query(f"""{_J}, p AS (SELECT repository, 'value' AS predictor, truth, predicted AS p FROM judged UNION ALL SELECT repository, 'reviewed', truth, reviewed > 1 FROM judged UNION ALL SELECT repository, 'never', truth, false FROM judged),
    cells AS (SELECT repository, predictor, {_CELLS} FROM p GROUP BY ALL), draws AS (SELECT k AS draw, n_nationkey AS repository, (n_nationkey * 7 + k * 3) % 4 AS weight FROM nation, range(0, 40) AS r(k)),
    s AS (SELECT predictor, draw, sum(tp * weight) AS tp, sum(fp * weight) AS fp, sum(fn * weight) AS fn, sum(tn * weight) AS tn FROM cells JOIN draws USING (repository) GROUP BY ALL),
    m AS (SELECT predictor, draw, {_MCC} AS mcc FROM s), x AS (SELECT a.predictor, b.mcc - a.mcc AS d FROM m a JOIN m b ON a.draw = b.draw AND b.predictor = 'value' WHERE a.predictor <> 'value' AND a.mcc IS NOT NULL AND b.mcc IS NOT NULL),
    i AS (SELECT predictor, count(*) AS draws, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.975), 6) AS high, round(avg((d > 0)::INT), 6) AS above FROM x GROUP BY predictor)
    SELECT *, low > 0 OR high < 0 AS excludes_zero FROM i""")
def paired_differences(spark: SparkSession, d: str) -> DataFrame:
    judged = binding.judged(spark, d)
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("predictor"), c.alias("p")) for k, c in (("value", F.col("predicted")), ("reviewed", F.col("reviewed") > 1), ("never", F.lit(False)))])).alias("x")
    cells = judged.select("repository", "truth", said).select("repository", "truth", "x.*").groupBy("repository", "predictor").agg(*scores.confusion(F.col("truth"), F.col("p")))
    draws = table(spark, d, "nation").select(F.col("n_nationkey").alias("repository"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("draw")).withColumn("weight", (F.col("repository") * 7 + F.col("draw") * 3) % 4)
    return inference.paired_differences(cells.select("repository", "predictor", *COUNTS), "repository", draws, "predictor", "value")


@query("SELECT o_custkey AS sample_id, arg_max(o_orderstatus, o_orderkey) AS verdict, max(o_orderkey) AS row FROM orders GROUP BY o_custkey")
def last_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderkey").alias("row"))
    return comparison.last_of(rows, ["sample_id"], "row")


@query("""WITH v AS (SELECT DISTINCT l_returnflag AS predictor, l_linenumber AS sample_id FROM lineitem WHERE l_returnflag <> 'A' OR l_linenumber <> 3), w AS (SELECT DISTINCT l_linenumber AS sample_id FROM lineitem)
    SELECT predictor, sample_id FROM v WHERE predictor IN (SELECT predictor FROM v GROUP BY predictor HAVING count(*) = (SELECT count(*) FROM w))""")
def aligned_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Predictors that have a verdict on every sample; one lacks a sample."""
    items = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("predictor"), F.col("l_linenumber").alias("sample_id"))
    return comparison.aligned(items, items.where("predictor <> 'A' or sample_id <> 3"), "sample_id", "predictor").select("predictor", "sample_id")


_W = "(p + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)"


@query(f"""WITH j AS (SELECT o_orderpriority AS stratum, CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'P' THEN 'revise' ELSE 'reject' END AS category FROM orders), s AS (SELECT stratum, count(*)::DOUBLE AS n, count(*) FILTER (category <> 'reject') / count(*) AS p FROM j GROUP BY stratum),
    sizes AS (SELECT o_orderpriority AS stratum, count(DISTINCT o_custkey) AS population FROM orders WHERE o_totalprice > 100000 GROUP BY 1),
    q AS (SELECT stratum, n::BIGINT AS reviewed, coalesce(population, 0) AS population, round(p, 4) AS acceptable, round(greatest({_W.format(s='-')}, 0), 4) AS low, round(least({_W.format(s='+')}, 1), 4) AS high FROM s LEFT JOIN sizes USING (stratum))
    SELECT q.stratum, c.category, (SELECT count(*) FROM j WHERE j.stratum = q.stratum AND j.category = c.category) AS n, reviewed, population, acceptable, low, high, (SELECT round(sum(acceptable * population) / sum(population), 4) FROM q) AS pooled
    FROM q, (VALUES ('accept'), ('revise'), ('reject'), ('unsure')) AS c(category)""")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    category = F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "P", "revise").otherwise("reject")
    sizes = orders.where("o_totalprice > 100000").groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.countDistinct("o_custkey").alias("population"))
    return reports.quality_summary(orders.select(F.col("o_orderpriority").alias("stratum"), category.alias("category")), sizes, ("accept", "revise", "reject", "unsure"), "reject")


@query("SELECT l_returnflag AS smell, count(*) AS n, round(quantile_cont(l_quantity::DOUBLE, 0.5), 6) AS before, round(quantile_cont(l_quantity::DOUBLE * (1 - l_discount), 0.5), 6) AS after, round(quantile_cont(l_quantity::DOUBLE * (1 - l_discount), 0.5) - quantile_cont(l_quantity::DOUBLE, 0.5), 6) AS shift FROM lineitem GROUP BY l_returnflag")
def metric_shift(spark: SparkSession, d: str) -> DataFrame:
    before = F.col("l_quantity").cast("double")
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("smell"), before.alias("b"), (before * (1 - F.col("l_discount"))).alias("a"))
    return comparison.metric_shift(rows, ["smell"], "b", "a")


@query(f"""{_J} SELECT smell, count(*) AS entities, count(*) FILTER (predicted) AS flagged_whole, count(*) FILTER (reviewed > 1) AS flagged_alone, count(*) FILTER (predicted = (reviewed > 1)) AS agree,
    count(*) FILTER (predicted AND reviewed <= 1) AS lost, count(*) FILTER (NOT predicted AND reviewed > 1) AS false_alarm FROM judged GROUP BY smell""")
def context_counters(spark: SparkSession, d: str) -> DataFrame:
    return comparison.context_counters(binding.judged(spark, d), F.col("predicted"), F.col("reviewed") > 1, ["smell"])


@query("""SELECT 'quantity' AS feature, count(*) AS compared, count(*) FILTER (l_quantity <> l_linenumber) AS moved FROM lineitem UNION ALL SELECT 'dates', count(*), count(*) FILTER (l_suppkey <> l_partkey) FROM lineitem""")
def moved_measurements(spark: SparkSession, d: str) -> DataFrame:
    return comparison.moved(table(spark, d, "lineitem"), {"quantity": ("l_quantity", "l_linenumber"), "dates": ("l_suppkey", "l_partkey")})


@query(f"""{_F}, c AS (SELECT file, class_name, smell_type AS feature, round(sum(score), 4) AS contribution, max(severity) > 2 AND min(score) > 1 AS decisive FROM findings GROUP BY ALL), p AS (SELECT file, class_name, arg_max(feature, (contribution, feature)) FILTER (decisive) AS feature FROM c GROUP BY ALL)
    SELECT feature, count(*) AS n, (SELECT count(*) FROM p) AS flagged, (SELECT count(feature) FROM p) AS explained, round((SELECT count(feature) FROM p) / (SELECT count(*) FROM p), 4) AS share FROM p WHERE feature IS NOT NULL GROUP BY feature""")
def decisive_features(spark: SparkSession, d: str) -> DataFrame:
    per = binding.findings(spark, d).groupBy("file", "class_name", F.col("smell_type").alias("feature")).agg(F.round(F.sum("score"), 4).alias("contribution"), ((F.max("severity") > 2) & (F.min("score") > 1)).alias("decisive"))
    return comparison.decisive(per, ["file", "class_name"])


@query(f"""{_F}, c AS (SELECT smell_type AS feature, round(sum(score), 3) AS importance FROM findings GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS place FROM c) SELECT * FROM r WHERE place <= 6""")
def top_features(spark: SparkSession, d: str) -> DataFrame:
    per = binding.findings(spark, d).groupBy(F.col("smell_type").alias("feature")).agg(F.round(F.sum("score"), 3).alias("importance"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).cast("long")).where("place <= 6")  # a row per feature


@query(f"""{_J}, f AS (SELECT repository, (dense_rank() OVER (ORDER BY repository) - 1) % 5 AS fold FROM (SELECT DISTINCT repository FROM judged)), r AS (SELECT smell, fold, truth FROM judged JOIN f USING (repository)),
    n AS (SELECT smell, fold, count(*) AS n, count(*) FILTER (truth) AS yes FROM r GROUP BY ALL), s AS (SELECT a.*, (SELECT sum(b.yes) * 2 > sum(b.n) FROM n b WHERE b.smell = a.smell AND b.fold <> a.fold) AS said FROM n a)
    SELECT smell, coalesce(sum(yes) FILTER (said), 0)::BIGINT AS tp, coalesce(sum(n - yes) FILTER (said), 0)::BIGINT AS fp, coalesce(sum(yes) FILTER (NOT said), 0)::BIGINT AS fn, coalesce(sum(n - yes) FILTER (NOT said), 0)::BIGINT AS tn FROM s GROUP BY smell""")
def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    judged = binding.judged(spark, d)
    return comparison.majority(judged.join(inference.folds(judged, "repository", 5), "repository"), ["smell"], "fold", "truth")


@query("""SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS uri, regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g') AS slug, regexp_replace('LongParameterListOf' || page_id, '([a-z])([A-Z])', '\\1 \\2', 'g') AS title FROM pages""")
def readable_names(spark: SparkSession, d: str) -> DataFrame:
    title = names.readable(F.concat(F.lit("LongParameterListOf"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", names.artifact_uri(F.col("url"), "http://").alias("uri"), names.slug(F.col("url")).alias("slug"), title.alias("title"))


@query("""SELECT DISTINCT CASE WHEN c_nationkey < 12 THEN '/p' || c_nationkey || '/src/main/java' ELSE '/p' || c_nationkey || '/com/acme' END AS root FROM customer""")
def source_roots(spark: SparkSession, d: str) -> DataFrame:
    folder = F.concat(F.lit("/p"), F.col("c_nationkey").cast("string"))
    path = F.when(F.col("c_nationkey") < 12, F.concat(folder, F.lit("/src/main/java/com/acme/"), "c_name", F.lit(".java"))).otherwise(F.concat(folder, F.lit("/com/acme/"), "c_name", F.lit(".java")))
    return table(spark, d, "customer").select(names.source_root(path, F.when(F.col("c_nationkey") < 12, "com.acme")).alias("root")).distinct()


@query(f"""{_F}, r AS (SELECT *, smell_type IN ('click', 'purchase') AS auto FROM findings), s AS (SELECT *, row_number() OVER (PARTITION BY file, class_name, method, line ORDER BY auto DESC, CASE WHEN auto THEN 0 ELSE severity END DESC, finding_id) AS rn, max(severity) OVER w AS worst, bool_or(auto) OVER w AS automated FROM r WINDOW w AS (PARTITION BY file, class_name, method, line))
    SELECT file, line, class_name || '.' || regexp_replace(method, '\\(.*$', '') AS entity, smell_type, finding_id, worst, automated FROM s WHERE rn = 1""")
def suggestions_of_sites(spark: SparkSession, d: str) -> DataFrame:
    return reports.suggestions_of(binding.findings(spark, d), F.col("smell_type").isin("click", "purchase"))


@query(f"""{_F}, a AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, finding_id) - 1 AS ordinal FROM findings WHERE smell_type IN ('click', 'purchase') AND method <> '') SELECT finding_id, file, ordinal FROM a""")
def automated_sites(spark: SparkSession, d: str) -> DataFrame:
    found = binding.findings(spark, d).where("smell_type in ('click', 'purchase') and method <> ''")
    return found.select("finding_id", "file", (F.row_number().over(Window.partitionBy("file").orderBy("line", "finding_id")) - 1).cast("long").alias("ordinal"))


@query("""WITH t AS (SELECT c_nationkey AS library, min(c_mktsegment) AS version FROM customer WHERE c_nationkey < 20 GROUP BY 1), r AS (SELECT c_nationkey AS library, max(c_mktsegment) AS version FROM customer WHERE c_nationkey > 3 AND c_acctbal > 9000 GROUP BY 1)
    SELECT coalesce(t.library, r.library) AS library, t.version AS trained, r.version AS running FROM t FULL JOIN r ON t.library = r.library WHERE t.version IS DISTINCT FROM r.version""")
def library_versions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "library")
    trained = c.where("library < 20").groupBy("library").agg(F.min("c_mktsegment").alias("version"))
    running = c.where("library > 3 and c_acctbal > 9000").groupBy("library").agg(F.max("c_mktsegment").alias("version"))
    return comparison.differing(trained, running, "library", "version")


@query("SELECT source AS target, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(*) <= 300 AND coalesce(sum(strlen(text)), 0) <= 1000000 AS allowed FROM documents GROUP BY source")
def scan_budget(spark: SparkSession, d: str) -> DataFrame:
    return comparison.over_budget(table(spark, d, "documents").withColumnRenamed("source", "target"), ["target"], F.octet_length("text"), 300, 1_000_000)


@query("""SELECT 'r' || s_suppkey AS repository, s_name AS commit_hash, 'd/' || s_suppkey AS directory, s_nationkey % 2 = 0 AS done, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey ELSE 0 END::BIGINT AS java_files, 0::BIGINT AS bytes_written,
    CASE WHEN s_nationkey % 2 = 0 THEN '' ELSE 'timeout' END AS reason FROM supplier""")
def fetch_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of one repository each, written as JSON and read again; a failed one lacks its count, a good one its reason."""
    ok, key = F.col("s_nationkey") % 2 == 0, F.col("s_suppkey").cast("string")
    name = F.concat(F.lit("r"), key)
    status = F.struct(name.alias("repository"), F.col("s_name").alias("commit_hash"), F.concat(F.lit("d/"), key).alias("directory"), ok.alias("ok"), F.when(ok, F.col("s_nationkey")).alias("java_files"), F.when(~ok, "timeout").alias("reason"))
    return files.manifest(table(spark, d, "supplier").select(F.to_json(F.create_map(name, status)).alias("value")))


@query("""WITH r AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS label, o_totalprice >= 50000 AS whole FROM orders)
    SELECT count(*) FILTER (label IS NULL) AS unlabelled, count(*) FILTER (label IS NOT NULL AND NOT whole) AS incomplete, count(*) FILTER (label IS NOT NULL AND whole) AS usable, count(*) FILTER (label AND whole) AS positive FROM r""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("label"), F.col("o_orderkey").alias("a"), F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("b"))
    return files.complete(rows, ["a", "b"], "label")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 5 minutes, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
    SELECT start, event_type, n, total FROM w WHERE start + INTERVAL 15 minutes <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """A stream of the events, counted by type and window; windows that may still get rows, ten minutes before the last, aren't written."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counted = ingest.events_by_minute(stream.withColumn("ts", F.col("ts").cast("timestamp")))  # a watermark needs an instant
    return ingest.landed(spark, counted).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
