"""All queries over the driver's tables and the SQL that each must agree with."""

from sieveline.plans import finding_queries, inference_queries, matching_queries, metric_queries, model_queries, report_queries, scoring_queries, text_queries  # noqa: F401
from sieveline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
