"""Feature rows: one flat row for each class and method, and the entities that strategies read, made from them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_rows(classes: DataFrame, methods: DataFrame, class_key: str = "class_id", method_key: str = "i") -> DataFrame:
    """Class rows (no method key) with `c_` columns, and method rows with their class's `c_` columns and their own `m_` columns."""
    c = classes.select(class_key, *[F.col(x).alias(f"c_{x}") for x in classes.columns if x != class_key])
    m = methods.select(class_key, method_key, *[F.col(x).alias(f"m_{x}") for x in methods.columns if x not in (class_key, method_key)])
    return c.unionByName(m.join(c, class_key, "left"), allowMissingColumns=True)


def class_entities(rows: DataFrame, class_key: str = "class_id", method_key: str = "i") -> DataFrame:
    own = [c for c in rows.columns if c.startswith("c_")]
    return rows.where(F.col(method_key).isNull()).select(class_key, *[F.col(c).alias(c[2:]) for c in own])


def method_entities(rows: DataFrame, class_key: str = "class_id", method_key: str = "i") -> DataFrame:
    own = [c for c in rows.columns if c.startswith("m_")]
    return rows.where(F.col(method_key).isNotNull()).select(class_key, method_key, *[F.col(c).alias(c[2:]) for c in own])
