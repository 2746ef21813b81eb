"""Columns: clauses and severities, ratios of counts, names and paths. No Python runs in any of them."""
