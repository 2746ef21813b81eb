"""Threshold clauses as structs (metric, operator, threshold, value), their excess, and severities."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """The names and default limits of the detection strategies and of severities."""

    god_class_wmc: float = 47
    god_class_tcc: float = 1 / 3
    god_class_atfd: float = 5
    data_class_woc: float = 1 / 3
    data_class_public_members: float = 5
    data_class_wmc_low: float = 31
    data_class_public_members_many: float = 10
    data_class_wmc_high: float = 47
    feature_envy_atfd: float = 5
    feature_envy_laa: float = 1 / 3
    feature_envy_fdp: float = 5
    long_method_loc: float = 30
    brain_method_loc: float = 35
    brain_method_cc: float = 4
    brain_method_nesting: float = 3
    brain_method_noav: float = 10
    long_parameter_list_np: float = 5
    deep_nesting: float = 3
    large_class_loc: float = 200
    large_class_nom: float = 20
    excess_cap: float = 5
    severity_major: float = 1.5
    severity_critical: float = 2.5

    def overridden(self, values: dict[str, float]) -> Thresholds:
        """With some values replaced; unknown names, non-numbers and values that aren't positive are errors."""
        known = {f.name for f in fields(self)}
        if unknown := sorted(values.keys() - known):
            raise ValueError(f"unknown thresholds: {', '.join(unknown)}")
        for name, value in values.items():
            if isinstance(value, bool) or not isinstance(value, int | float) or value <= 0:
                raise ValueError(f"{name} must be a positive number")
        return replace(self, **values)


DEFAULTS = Thresholds()


def clause(metric: str, operator: str, threshold: float | Column, value: Column) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.struct(F.lit(metric).alias("metric"), F.lit(operator).alias("operator"), limit.cast("double").alias("threshold"), value.cast("double").alias("value"))


def satisfied(c: Column) -> Column:
    op, value, limit = c["operator"], c["value"], c["threshold"]
    return F.when(op == ">", value > limit).when(op == ">=", value >= limit).when(op == "<", value < limit).when(op == "<=", value <= limit).otherwise(F.raise_error(F.concat(F.lit("unknown operator "), op)).cast("boolean"))


def excess(c: Column) -> Column:
    """How far a value is beyond its limit, as a ratio over 1; never divides by zero."""
    value, limit = c["value"], c["threshold"]
    up = F.when(limit <= 0, 1 + value).otherwise(value / F.when(limit > 0, limit))
    down = F.when((value <= 0) & (limit <= 0), 1.0).when(value <= 0, F.lit(float("inf"))).otherwise(limit / F.when(value > 0, value))
    return F.when(c["operator"].isin(">", ">="), up).otherwise(down)


def score(clauses: Column, cap: float = DEFAULTS.excess_cap) -> Column:
    """Mean of capped excesses; 1 without clauses."""
    capped = F.transform(clauses, lambda c: F.least(excess(c), F.lit(float(cap))))
    return F.when(F.size(clauses) == 0, 1.0).otherwise(F.aggregate(capped, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(clauses) > 0, F.size(clauses)))


def severity(of: Column, t: Thresholds = DEFAULTS) -> Column:
    return F.when(of < t.severity_major, "minor").when(of < t.severity_critical, "major").otherwise("critical")


RANKS = ("none", "minor", "major", "critical")


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, RANKS)), rank.cast("int"))


#: What each finding suggests, best first.
REFACTORINGS = {
    "GodClass": ["ExtractClass", "MoveMethod", "ExtractSubclass"],
    "DataClass": ["EncapsulateField", "MoveMethod"],
    "LargeClass": ["ExtractClass", "ExtractSubclass"],
    "FeatureEnvy": ["MoveMethod", "ExtractMethod"],
    "LongMethod": ["ExtractMethod", "DecomposeConditional"],
    "BrainMethod": ["ExtractMethod", "ReplaceConditionalWithPolymorphism"],
    "LongParameterList": ["IntroduceParameterObject", "PreserveWholeObject"],
    "DeepNesting": ["ReplaceNestedConditionalWithGuardClauses", "ExtractMethod"],
}


def suggestions(smell_type: Column) -> Column:
    entries = [x for k, v in REFACTORINGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.try_element_at(F.create_map(*entries), smell_type)
