"""Detection strategies: clauses over metrics, which of them fired, and how far.

A strategy is an array of clauses and a condition; all strategies are evaluated in one pass over the entities. Missing
metrics have a default that doesn't fire, clause by clause, but for FDP, whose 0 satisfies its clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.clauses import DEFAULTS, Thresholds, clause, satisfied, score, severity


def _v(metric: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(metric).cast("double"), F.lit(default))


def _all(*clauses: Column) -> Column:
    held = F.lit(True)
    for c in clauses:
        held = held & satisfied(c)
    return F.when(held, F.array(*clauses))


def class_strategies(t: Thresholds = DEFAULTS) -> dict[str, Column]:
    """Strategy -> the clauses that fired, null if it doesn't; over class metrics."""
    wmc, members = _v("wmc"), F.coalesce(F.col("nopa"), F.lit(0)) + F.coalesce(F.col("noam"), F.lit(0))
    woc = clause("WOC", "<", t.data_class_woc, _v("woc", 1.0))
    few = [clause("NOPA+NOAM", ">", t.data_class_public_members, members), clause("WMC", "<", t.data_class_wmc_low, wmc)]
    many = [clause("NOPA+NOAM", ">", t.data_class_public_members_many, members), clause("WMC", "<", t.data_class_wmc_high, wmc)]
    large = F.filter(F.array(clause("CLOC", ">", t.large_class_loc, _v("cloc")), clause("NOM", ">", t.large_class_nom, _v("nom"))), satisfied)
    found = {
        "GodClass": _all(clause("WMC", ">=", t.god_class_wmc, wmc), clause("TCC", "<", t.god_class_tcc, _v("tcc", 1.0)), clause("ATFD", ">", t.god_class_atfd, _v("atfd"))),
        "DataClass": F.coalesce(_all(woc, *few), _all(woc, *many)),
        "LargeClass": F.when(F.size(large) > 0, large),
    }
    return {k: F.when(~F.col("kind").isin("interface", "enum"), c) for k, c in found.items()}


def method_strategies(t: Thresholds = DEFAULTS) -> dict[str, Column]:
    envy = _all(clause("ATFD", ">", t.feature_envy_atfd, _v("atfd")), clause("LAA", "<", t.feature_envy_laa, _v("laa", 1.0)), clause("FDP", "<=", t.feature_envy_fdp, _v("fdp")))
    return {
        "FeatureEnvy": F.when(~F.col("ctor") & ~F.col("accessor"), envy),
        "LongMethod": _all(clause("MLOC", ">", t.long_method_loc, _v("mloc"))),
        "BrainMethod": _all(clause("MLOC", ">", t.brain_method_loc, _v("mloc")), clause("CC", ">=", t.brain_method_cc, _v("cc")), clause("MAXNESTING", ">=", t.brain_method_nesting, _v("nesting")), clause("NOAV", ">", t.brain_method_noav, _v("noav"))),
        "LongParameterList": _all(clause("NP", ">", t.long_parameter_list_np, _v("np"))),
        "DeepNesting": _all(clause("MAXNESTING", ">", t.deep_nesting, _v("nesting"))),
    }


def detect(entities: DataFrame, keys: list[str], strategies: dict[str, Column], t: Thresholds = DEFAULTS) -> DataFrame:
    """A row per entity and strategy that fires: keys, smell_type, conditions, score, severity. One pass, no union."""
    fired = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("smell_type"), c.alias("conditions"))) for k, c in strategies.items()]))
    rows = entities.select(*keys, F.explode(fired).alias("found")).select(*keys, "found.*")
    return rows.withColumn("score", score(F.col("conditions"), t.excess_cap)).withColumn("severity", severity(F.col("score"), t))


def rationale(conditions: Column) -> Column:
    """The clauses in words, in order; values with at most six decimals, without trailing zeros."""
    plain = lambda x: F.regexp_replace(F.format_string("%.6f", x), "\\.?0+$", "")
    return F.array_join(F.transform(conditions, lambda c: F.concat_ws(" ", c["metric"], F.lit("="), plain(c["value"]), F.concat(F.lit("("), c["operator"]), F.concat(plain(c["threshold"]), F.lit(")")))), ", ")
