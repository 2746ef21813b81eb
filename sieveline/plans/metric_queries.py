"""Metrics of classes and methods, and the detection strategies over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.clauses import REFACTORINGS, Thresholds, suggestions
from sieveline.operators import detectors, metrics
from sieveline.plans.registry import query
from sieveline.sources import binding
from sieveline.sources.binding import with_sql

_PAIRS = """SELECT a.class_id, count(*) AS pairs, count(*) FILTER (list_has_any(a.own, b.own)) AS sharing
    FROM body a JOIN body b ON a.class_id = b.class_id AND a.i < b.i GROUP BY a.class_id"""
#: Class and method metrics in SQL, from plain pairs of methods.
METRICS_SQL = with_sql("classes", "methods", "fields") + f""",
    mm AS (SELECT *, len("foreign")::BIGINT AS atfd, len(list_distinct(list_transform("foreign", lambda x: x.receiver)))::BIGINT AS fdp, len(own)::BIGINT AS n_own FROM methods),
    msz AS (SELECT class_id, count(*) FILTER (NOT ctor) AS nom, count(*) FILTER (accessor) AS noam, sum(cc)::BIGINT AS wmc, avg(cc) AS amw, max(cc) AS maxcc, sum(mloc)::BIGINT AS cloc,
        count(*) FILTER (public AND NOT ctor) AS open, count(*) FILTER (public AND NOT ctor AND NOT accessor) AS functional FROM methods GROUP BY class_id),
    fsz AS (SELECT class_id, count(*) AS nof, count(*) FILTER (public AND NOT constant) AS nopa FROM fields GROUP BY class_id),
    body AS (SELECT * FROM methods WHERE public AND NOT static AND NOT ctor),
    visible AS ({_PAIRS}),
    atf AS (SELECT class_id, count(DISTINCT x) AS atfd FROM (SELECT class_id, unnest("foreign") AS x FROM methods) GROUP BY class_id),
    cm AS (SELECT c.*, nom, nof, noam, nopa, wmc, amw, maxcc, cloc, CASE WHEN b.class_id IS NULL THEN NULL ELSE coalesce(sharing / pairs, 1.0) END AS tcc, atfd,
        coalesce(functional / nullif(coalesce(open, 0) + coalesce(nopa, 0), 0), 1.0) AS woc
        FROM classes c LEFT JOIN msz USING (class_id) LEFT JOIN fsz USING (class_id) LEFT JOIN (SELECT DISTINCT class_id FROM body) b USING (class_id) LEFT JOIN visible USING (class_id) LEFT JOIN atf USING (class_id))
"""


def _methods(spark: SparkSession, d: str) -> DataFrame:
    return binding.methods(spark, d)


@query(METRICS_SQL + "SELECT class_id, coalesce(nom, 0) AS nom, coalesce(nof, 0) AS nof, coalesce(noam, 0) AS noam, coalesce(nopa, 0) AS nopa FROM fsz FULL JOIN msz USING (class_id)")
def class_size(spark: SparkSession, d: str) -> DataFrame:
    return metrics.size(_methods(spark, d), binding.fields(spark, d))


@query(METRICS_SQL + "SELECT class_id, wmc, round(amw, 6) AS amw, maxcc, cloc FROM msz")
def class_complexity(spark: SparkSession, d: str) -> DataFrame:
    return metrics.complexity(_methods(spark, d)).withColumn("amw", F.round("amw", 6))


@query(METRICS_SQL + "SELECT class_id, round(tcc, 9) AS tcc FROM cm WHERE tcc IS NOT NULL")
def tcc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tcc(_methods(spark, d)).withColumn("tcc", F.round("tcc", 9))


@query(with_sql("methods") + f", body AS (SELECT * FROM methods WHERE NOT ctor), p AS ({_PAIRS}) SELECT class_id, greatest(coalesce(pairs, 0) - 2 * coalesce(sharing, 0), 0)::BIGINT AS lcom FROM (SELECT DISTINCT class_id FROM body) LEFT JOIN p USING (class_id)")
def lcom_ck(spark: SparkSession, d: str) -> DataFrame:
    return metrics.lcom(_methods(spark, d))


@query(with_sql("methods", "fields") + """, m AS (SELECT class_id, count(*) AS m, sum(len(own)) AS accesses FROM methods WHERE NOT ctor GROUP BY class_id), f AS (SELECT class_id, count(*) AS f FROM fields GROUP BY class_id)
    SELECT class_id, round(CASE WHEN m <= 1 OR f IS NULL THEN 0 ELSE (accesses / f - m) / (1 - m) END::DOUBLE, 9) AS lcom3 FROM m LEFT JOIN f USING (class_id)""")
def lcom3(spark: SparkSession, d: str) -> DataFrame:
    return metrics.lcom3(_methods(spark, d), binding.fields(spark, d)).withColumn("lcom3", F.round("lcom3", 9))


@query(METRICS_SQL + "SELECT * FROM atf")
def class_atfd(spark: SparkSession, d: str) -> DataFrame:
    return metrics.atfd(_methods(spark, d))


@query(with_sql("classes", "methods") + """, t AS (SELECT class_id, superclass AS type FROM classes UNION SELECT class_id, unnest(list_transform("foreign", lambda x: x.receiver)) FROM methods)
    SELECT c.class_id, count(t.type) AS cbo FROM classes c LEFT JOIN t ON t.class_id = c.class_id AND t.type <> c.class_id AND t.type NOT IN (3, 7) GROUP BY c.class_id""")
def cbo(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cbo(binding.classes(spark, d), _methods(spark, d), ignored=(3, 7))


@query(with_sql("methods") + "SELECT class_id, count(*) + (SELECT count(DISTINCT x) FROM (SELECT unnest(calls) AS x FROM methods n WHERE n.class_id = m.class_id)) AS rfc FROM methods m GROUP BY class_id")
def rfc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rfc(_methods(spark, d))


@query(METRICS_SQL + "SELECT class_id, round(woc, 9) AS woc FROM cm")
def woc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.woc(binding.classes(spark, d), _methods(spark, d), binding.fields(spark, d)).withColumn("woc", F.round("woc", 9))


@query(with_sql("classes") + "SELECT c.class_id, count(k.class_id) AS noc FROM classes c LEFT JOIN classes k ON k.superclass = c.class_id GROUP BY c.class_id")
def noc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.noc(binding.classes(spark, d))


@query(with_sql("classes") + """, up AS (SELECT class_id, superclass AS at, CASE WHEN superclass IS NULL THEN 0 ELSE 1 END AS d FROM classes
    UNION ALL SELECT up.class_id, c.superclass, up.d + 1 FROM up JOIN classes c ON c.class_id = up.at WHERE c.superclass IS NOT NULL) SELECT class_id, max(d)::BIGINT AS dit FROM up GROUP BY class_id""")
def dit(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dit(binding.classes(spark, d))


@query("""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(trim(x), '[{}();,]*') AND NOT starts_with(trim(x), '//') AND NOT starts_with(trim(x), '*')))::BIGINT AS loc FROM documents""")
def effective_loc(spark: SparkSession, d: str) -> DataFrame:
    from sieveline.functions.text import effective_loc as loc

    return binding.table(spark, d, "documents").select("doc_id", loc(F.col("text")).alias("loc"))


@query(METRICS_SQL + "SELECT class_id, i, atfd, fdp, round(coalesce(n_own / nullif(n_own + atfd, 0), 1.0), 9) AS laa, locals + n_own + atfd AS noav, fdp + len(calls) AS cint FROM mm")
def method_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.method_metrics(_methods(spark, d)).select("class_id", "i", "atfd", "fdp", F.round("laa", 9).alias("laa"), "noav", F.col("cint").cast("long").alias("cint"))


def class_entities(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_metrics(binding.classes(spark, d), _methods(spark, d), binding.fields(spark, d))


def method_entities(spark: SparkSession, d: str) -> DataFrame:
    return metrics.method_metrics(_methods(spark, d))


#: Limits at which the bound classes differ: by default nearly all of them are large and none is a data class.
TUNED = Thresholds(large_class_loc=1300, large_class_nom=55, data_class_woc=0.8, data_class_wmc_low=100, data_class_wmc_high=160)

def _over(v: str, t: float | str) -> str:
    return f"least({v} / {t}, 5)"


def _under(v: str, t: str) -> str:
    return f"least(CASE WHEN {v} <= 0 THEN 5 ELSE {t} / {v} END, 5)"


_OK = "kind NOT IN ('interface', 'enum')"
_T = "(1.0::DOUBLE / 3)"
_MEMBERS = "(nopa + noam)"
#: Strategy -> where it fires and its score, in SQL.
FIRES = {
    "GodClass": (f"{_OK} AND wmc >= 47 AND coalesce(tcc, 1) < {_T} AND atfd > 5", f"({_over('wmc', 47)} + {_under('tcc', _T)} + {_over('atfd', 5)}) / 3"),
    "DataClass": (f"{_OK} AND woc < 0.8 AND (({_MEMBERS} > 5 AND wmc < 100) OR ({_MEMBERS} > 10 AND wmc < 160))", f"CASE WHEN {_MEMBERS} > 5 AND wmc < 100 THEN ({_under('woc', '0.8')} + {_over(_MEMBERS, 5)} + {_under('wmc', '100.0')}) / 3 ELSE ({_under('woc', '0.8')} + {_over(_MEMBERS, 10)} + {_under('wmc', '160.0')}) / 3 END"),
    "LargeClass": (f"{_OK} AND (coalesce(cloc, 0) > 1300 OR coalesce(nom, 0) > 55)", f"CASE WHEN cloc > 1300 AND nom > 55 THEN ({_over('cloc', 1300)} + {_over('nom', 55)}) / 2 WHEN cloc > 1300 THEN {_over('cloc', 1300)} ELSE {_over('nom', 55)} END"),
}
METHOD_FIRES = {
    "FeatureEnvy": (f"NOT ctor AND NOT accessor AND atfd > 5 AND laa < {_T} AND fdp <= 5", f"({_over('atfd', 5)} + {_under('laa', _T)} + {_under('fdp', '5.0')}) / 3"),
    "LongMethod": ("mloc > 30", _over("mloc", 30)),
    "BrainMethod": ("mloc > 35 AND cc >= 4 AND nesting >= 3 AND noav > 10", f"({_over('mloc', 35)} + {_over('cc', 4)} + {_over('nesting', 3)} + {_over('noav', 10)}) / 4"),
    "LongParameterList": ("np > 5", _over("np", 5)),
    "DeepNesting": ("nesting > 3", _over("nesting", 3)),
}
_MX = METRICS_SQL + ", mx AS (SELECT *, coalesce(n_own / nullif(n_own + atfd, 0), 1.0) AS laa, locals + n_own + atfd AS noav FROM mm)"


def _fires(name: str, where: str, score: str, key: str, source: str) -> str:
    return f"SELECT class_id, {key} AS i, '{name}' AS smell_type, round({score}, 6) AS score, CASE WHEN {score} < 1.5 THEN 'minor' WHEN {score} < 2.5 THEN 'major' ELSE 'critical' END AS severity FROM {source} WHERE {where}"


ALL_SQL = _MX + ", found AS (" + " UNION ALL ".join([_fires(n, w, s, "-1", "cm") for n, (w, s) in FIRES.items()] + [_fires(n, w, s, "i", "mx") for n, (w, s) in METHOD_FIRES.items()]) + ")"


def all_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every strategy over every class and method; i is -1 for classes."""
    of_class = detectors.detect(class_entities(spark, d), ["class_id"], detectors.class_strategies(TUNED)).withColumn("i", F.lit(-1).cast("long"))
    of_method = detectors.detect(method_entities(spark, d), ["class_id", "i"], detectors.method_strategies())
    return of_class.unionByName(of_method)


_COLUMNS = ("class_id", "i", "smell_type", "severity")


@query(ALL_SQL + " SELECT * FROM found")
def detect_all(spark: SparkSession, d: str) -> DataFrame:
    return all_findings(spark, d).select(*_COLUMNS, F.round("score", 6).alias("score"))


def _one(strategy: str, key: str) -> None:
    of_class = strategy in FIRES

    def run(spark: SparkSession, d: str) -> DataFrame:
        entities, named, keys = (class_entities(spark, d), detectors.class_strategies(TUNED), ["class_id"]) if of_class else (method_entities(spark, d), detectors.method_strategies(), ["class_id", "i"])
        found = detectors.detect(entities, keys, {strategy: named[strategy]})
        return found.select(*keys, "smell_type", "severity", F.round("score", 6).alias("score"), F.size("conditions").cast("long").alias("n_conditions"))

    where, score = (FIRES if of_class else METHOD_FIRES)[strategy]
    n = {"GodClass": "3", "DataClass": "3", "FeatureEnvy": "3", "BrainMethod": "4", "LargeClass": "CASE WHEN cloc > 1300 AND nom > 55 THEN 2 ELSE 1 END"}.get(strategy, "1")
    columns = "class_id" if of_class else "class_id, i"
    query(f"{_MX} SELECT {columns}, '{strategy}' AS smell_type, CASE WHEN {score} < 1.5 THEN 'minor' WHEN {score} < 2.5 THEN 'major' ELSE 'critical' END AS severity, round({score}, 6) AS score, ({n})::BIGINT AS n_conditions FROM {'cm' if of_class else 'mx'} WHERE {where}", key)(run)


for _strategy, _key in (("GodClass", "detect_god_class"), ("DataClass", "detect_data_class"), ("LargeClass", "detect_large_class"), ("FeatureEnvy", "detect_feature_envy"), ("LongMethod", "detect_long_method"), ("BrainMethod", "detect_brain_method"), ("LongParameterList", "detect_long_params"), ("DeepNesting", "detect_deep_nesting")):
    _one(_strategy, _key)

_SUGGESTED = "MAP {" + ", ".join(f"'{k}': '{'|'.join(v)}'" for k, v in REFACTORINGS.items()) + "}"


@query(f"{ALL_SQL} SELECT smell_type, {_SUGGESTED}[smell_type] AS refactorings, count(*) AS n FROM found GROUP BY smell_type")
def suggest(spark: SparkSession, d: str) -> DataFrame:
    return all_findings(spark, d).groupBy("smell_type").agg(F.count("*").alias("n")).select("smell_type", F.array_join(suggestions(F.col("smell_type")), "|").alias("refactorings"), "n")


_RANK = "CASE severity WHEN 'minor' THEN 1 WHEN 'major' THEN 2 WHEN 'critical' THEN 3 END"


@query(f"{ALL_SQL} SELECT class_id, arg_max(severity, {_RANK}) AS worst, count(*) AS findings FROM found GROUP BY class_id")
def worst_severity(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("severity") == "minor", 1).when(F.col("severity") == "major", 2).otherwise(3)
    return all_findings(spark, d).groupBy("class_id").agg(F.max_by("severity", rank).alias("worst"), F.count("*").alias("findings"))


@query(f"""{ALL_SQL} SELECT c.class_id, coalesce(bool_or(smell_type IN ('GodClass')), false) AS strategy, coalesce(bool_or(smell_type IN ('GodClass', 'LargeClass')), false) AS with_size
    FROM classes c LEFT JOIN found f ON f.class_id = c.class_id AND i = -1 GROUP BY c.class_id""")
def variant_fired(spark: SparkSession, d: str) -> DataFrame:
    fired = all_findings(spark, d).where("i = -1").groupBy("class_id").agg(F.collect_set("smell_type").alias("fired"))
    variant = lambda *names: F.coalesce(F.arrays_overlap("fired", F.array(*map(F.lit, names))), F.lit(False))
    return binding.classes(spark, d).select("class_id").join(fired, "class_id", "left").select("class_id", variant("GodClass").alias("strategy"), variant("GodClass", "LargeClass").alias("with_size"))


@query(f"{METRICS_SQL} SELECT class_id, wmc, nom FROM cm WHERE tcc = 1 AND wmc >= 47")
def saturated(spark: SparkSession, d: str) -> DataFrame:
    """Classes so cohesive by definition that no limit reaches them, though they are complex."""
    return class_entities(spark, d).where("tcc = 1 AND wmc >= 47").select("class_id", "wmc", "nom").orderBy(F.desc("wmc"), "class_id")
