import json

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text
from sieveline.java import rewrites
from sieveline.operators import models
from sieveline.sources import files


@pytest.mark.parametrize(
    "body, start, end, want",
    [
        ("a\nb\nc", 2, 3, (2, 3, False, ["b", "c"])),
        ("a\r\nb\n", 1, 9, (1, 2, False, ["a", "b"])),
        ("a", 5, 6, (1, 1, False, ["a"])),
        ("", 1, 2, (0, 0, False, [])),
        ("a\nb", 2, 1, None),
        ("x\n" * 500, 11, 500, (11, 410, True, ["x"] * 400)),
        ("x\n" * 500, 11, 410, (11, 410, False, ["x"] * 400)),
        (None, 1, 2, (None, None, None, None)),
    ],
)
def test_ranges_of_lines(spark, body, start, end, want):
    got = spark.createDataFrame([(body, start, end)], "t string, s int, e int").select(text.source_range(F.col("t"), F.col("s"), F.col("e")).alias("r")).first().r
    if body is None:
        assert got is None or got.lines is None
    else:
        assert (got and tuple(got)) == want


def test_patches_mark_a_missing_newline_and_leave_out_what_is_not_text(spark):
    rows = [("a", b"x\ny", b"x\nz"), ("b", b"x\n", b"x\n"), ("c", b"\xff", b"x"), ("d", None, b"x"), ("e", b"", b"x\n")]
    got = dict(rewrites.patches(spark.createDataFrame(rows, "file string, before binary, after binary")).collect())
    marker = "\\ No newline at end of file\n"
    assert got == {"a": f"--- a/a\n+++ b/a\n@@ -1,2 +1,2 @@\n x\n-y\n{marker}+z\n{marker}", "e": "--- a/e\n+++ b/e\n@@ -0,0 +1 @@\n+x\n"}


def test_a_repository_is_done_only_if_it_succeeded(spark):
    entry = {"repository": "r", "commit_hash": "c", "directory": "d", "ok": True, "java_files": 3, "bytes_written": 9, "reason": ""}
    document = json.dumps({"r": entry, "s": {"repository": "s", "ok": False, "reason": "timeout"}, "t": {"repository": "t"}})
    got = {r.repository: (r.done, r.java_files, r.reason) for r in files.manifest(spark.createDataFrame([(document,), ("{}",), (None,)], "value string")).collect()}
    assert got == {"r": (True, 3, ""), "s": (False, 0, "timeout"), "t": (False, 0, "")}


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(400).selectExpr("id", "cast(id % 20 as string) AS repo", "cast(id % 7 AS double) AS a", "cast((id * 13) % 5 AS double) AS b", "id % 7 > 3 AS y")
    return models.folded(models.assembled(rows, ["a", "b"], "y", "repo"))


def test_a_model_is_kept_and_refused(spark, table, tmp_path, monkeypatch):
    path, model = f"{tmp_path}/m", models.zoo()["logistic"]().fit(table)
    with pytest.raises(models.Unavailable) as refused:
        models.load(spark, path, ["a", "b"])
    assert refused.value.code == "not_trained"
    models.save(spark, model, path, ["a", "b"], 400)
    again, features, n = models.load(spark, path, ["b", "a", "c"])
    assert features == ["a", "b"] and n == 400
    scores = lambda m: {r.id: r.probability for r in models.probabilities(m, table).collect()}
    assert scores(again) == scores(model)
    with pytest.raises(models.Unavailable) as refused:
        models.load(spark, path, ["a"])
    assert refused.value.code == "feature_missing"
    monkeypatch.setattr(models, "running_versions", lambda: {"pyspark": "0", "numpy": "0"})
    with pytest.raises(models.Unavailable) as refused:
        models.load(spark, path, ["a", "b"])
    assert refused.value.code == "library_mismatch"


def test_a_permuted_feature_keeps_its_values(table):
    rows = [(r.feature, r.repeat, list(r.features)) for r in models.permuted(table, ["a", "b"], 3).collect()]
    whole = [list(r.features) for r in table.collect()]
    for feature, at in (("a", 0), ("b", 1)):
        for repeat in range(3):
            got = [x for f, r, x in rows if (f, r) == (feature, repeat)]
            assert sorted(x[at] for x in got) == sorted(x[at] for x in whole) and sorted(x[1 - at] for x in got) == sorted(x[1 - at] for x in whole)
            assert sorted(got) != sorted(whole)


def test_without_the_telling_feature_scores_fall(table):
    got = {r.features: r.mcc or 0.0 for r in models.ablation(table, models.zoo()["logistic"], ["a", "b"], ["a"]).collect()}
    assert got["all"] > 0.9 and got["without"] < 0.5
