"""Queries against their SQL on rows that the smallest tables lack."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sieveline.plans.catalogue import ORACLE, QUERIES
from sieveline.sources import binding

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no tables")


def agree(spark, folder, name, **tables):
    """The query's rows over these tables, once they equal those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        c.sql(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(c.sql(ORACLE[name]).select(*[f'"{x}"' for x in got.columns]).fetchall(), key=str)
    return rows


def test_woc_of_classes_without_methods_and_of_methods_without_a_class(spark, tmp_path):
    customer, orders = binding.table(spark, D, "customer"), binding.table(spark, D, "orders")
    idle = customer.limit(2).withColumn("c_custkey", F.monotonically_increasing_id() + 10**9)
    lost = orders.withColumn("o_custkey", F.when(F.col("o_custkey") % 7 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")))
    rows = agree(spark, tmp_path, "woc", customer=customer.unionByName(idle), orders=lost, lineitem=binding.table(spark, D, "lineitem"))
    assert len(rows) == customer.count() + 2 and {w for c, w in rows if c >= 10**9} == {1.0}


def test_context_shift_scans_its_files_once(spark):
    plan = QUERIES["context_shift"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "MapInArrow" not in plan  # what was scanned is a checkpoint


TREE = """class A { B b; C c; String s; int own; void m() { b.x = 1; b.getY(); c.z = own; s.v = 2; D.q = 3; b.x = 4; } void n(B other) { other.getX(); other.run(); } }
class B { void m(A a) { a.own = 1; this.x = 2; } } class B { A a; void m() { a.own = 1; Map.k = 2; } void n() { a.own = 3; } } class C { int none; } interface E { }"""


def test_foreign_counts_are_those_of_methods(spark):
    from sieveline.java import facts

    files = spark.createDataFrame([("A.java", TREE), ("B.java", "class F { C c; F f; void m() { c.none = 1; f.x = 2; G.y = 3; } } class Z {"), ("C.java", None)], "file string, content string")
    types = facts.entities(facts.units(files))
    sums = lambda known, name: {r[0]: tuple(r)[1:] for r in facts.methods(types, known).groupBy("class_name").agg(F.count("*"), F.sum(F.size("foreign"))).collect()}
    known, alone = sums(True, "in_project"), sums(False, "alone")
    want = sorted((k, known[k][0], known[k][1], alone[k][1]) for k in known)
    for parts in (facts.UNITS, facts.ACCESSES):
        assert sorted(map(tuple, facts.foreign_counts(facts.entities(facts.units(files, parts))).collect())) == want
    assert want == [("A", 2, 4, 5), ("B", 3, 3, 3), ("F", 1, 1, 2)]
