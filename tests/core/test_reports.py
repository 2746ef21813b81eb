import pytest

from sieveline.functions import names
from sieveline.operators import comparison, inference, metrics, reports
from pyspark.sql import functions as F


def test_depths_of_long_chains_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (2000, 9999)]
    got = {r.class_id: r.dit for r in metrics.dit(spark.createDataFrame(rows, "class_id long, superclass long")).collect()}
    assert all(got[i] == i for i in range(200)) and [got[i] for i in (1000, 1001, 1002, 1003)] == [0] * 4 and got[2000] == 1


@pytest.mark.parametrize("n, named, more", [(0, "", 0), (3, "f0, f1, f2", 0), (5, "f0, f1, f2, f3, f4", 0), (8, "f0, f1, f2, f3, f4", 3)])
def test_unparsed_files_are_named(spark, n, named, more):
    files = spark.createDataFrame([(f"f{i}", True) for i in range(n)] + [("ok", False), ("null", None)], "file string, unparsed boolean")
    assert tuple(reports.unparsed_note(files).first()) == (n, named, more)


def test_a_pooled_share_without_known_sizes_is_null(spark):
    judged = spark.createDataFrame([("a", "yes"), ("a", "no")], "stratum string, category string")
    sizes = spark.createDataFrame([("b", 10)], "stratum string, population long")
    got = reports.quality_summary(judged, sizes, ("yes", "no", "never"), "no").collect()
    assert {(r.category, r.n) for r in got} == {("yes", 1), ("no", 1), ("never", 0)} and all(r.pooled is None and r.population == 0 for r in got)


def test_a_difference_that_clears_zero(spark):
    cells = [("model", g, 10, 0, 0, 10) for g in "abc"] + [("coin", g, 5, 5, 5, 5) for g in "abc"] + [("never", g, 0, 0, 10, 10) for g in "abc"]
    frame = spark.createDataFrame(cells, "predictor string, group string, tp long, fp long, fn long, tn long")
    draws = spark.createDataFrame([(k, g, 1 + (k + i) % 2) for k in range(20) for i, g in enumerate("abc")], "draw long, group string, weight long")
    got = {r.predictor: r for r in inference.paired_differences(frame, "group", draws, "predictor", "model").collect()}
    assert got.keys() == {"coin"} and got["coin"].excludes_zero and (got["coin"].low, got["coin"].high, got["coin"].above, got["coin"].draws) == (1.0, 1.0, 1.0, 20)


def test_predictors_without_a_verdict_are_dropped_whole(spark):
    table = spark.createDataFrame([(i,) for i in (1, 2, 3)], "k long")
    verdicts = spark.createDataFrame([("p", i, True) for i in (1, 2, 3, 4)] + [("q", 1, True), ("q", 2, False), ("q", 2, False)], "who string, k long, flagged boolean")
    assert {(r.who, r.k) for r in comparison.aligned(table, verdicts, "k", "who").collect()} == {("p", 1), ("p", 2), ("p", 3)}


def test_names(spark):
    row = spark.range(1).select(
        names.readable(F.lit("LongParameterList")).alias("a"), names.artifact_uri(F.lit("/w/x/A.java"), "/w").alias("b"), names.artifact_uri(F.lit("/v/A.java"), "/w").alias("c"),
        names.artifact_uri(F.lit("x\\A.java"), "/w").alias("d"), names.source_root(F.lit("/p/src/com/acme/A.java"), F.lit("com.acme")).alias("e"), names.source_root(F.lit("/p/A.java"), F.lit(None).cast("string")).alias("f"),
    ).first()
    assert tuple(row) == ("Long Parameter List", "x/A.java", "/v/A.java", "x/A.java", "/p/src", "/p")
