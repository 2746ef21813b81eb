import json
import math

import pytest
from pyspark.sql import functions as F

from sieveline.functions import clauses, scores, text
from sieveline.operators import detectors, inference, matching, metrics, models, scoring, setops
from sieveline.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_excess_and_severity(spark):
    c = lambda op, t, v: clauses.clause("X", op, t, F.lit(float(v)))
    cases = [(">", 10, 25, 2.5), (">=", 10, 10, 1.0), ("<", 10, 4, 2.5), ("<=", 5, 0, math.inf), ("<", 0.5, -1, math.inf), (">", 0, 3, 4.0)]
    assert one(spark, *[clauses.excess(c(op, t, v)) for op, t, v, _ in cases]) == tuple(x for *_, x in cases)
    assert one(spark, *[clauses.satisfied(c(op, 10, v)) for op, v in ((">", 10), (">=", 10), ("<", 10), ("<=", 10), (">", 11))]) == (False, True, False, True, True)
    capped = F.array(c("<", 1, 0), c(">", 10, 20))
    assert one(spark, clauses.score(capped), clauses.score(F.filter(capped, lambda x: F.lit(False)))) == (3.5, 1.0)
    assert one(spark, *[clauses.severity(F.lit(x)) for x in (1.49, 1.5, 2.49, 2.5)]) == ("minor", "major", "major", "critical")
    with pytest.raises(Exception, match="unknown operator"):
        one(spark, clauses.satisfied(c("=", 1, 1)))


def test_overrides():
    assert clauses.DEFAULTS.overridden({"deep_nesting": 4}).deep_nesting == 4
    for bad in ({"nothing": 1}, {"deep_nesting": 0}, {"deep_nesting": True}, {"deep_nesting": "3"}):
        with pytest.raises(ValueError):
            clauses.DEFAULTS.overridden(bad)


METHODS = "class_id long, i long, cc long, mloc long, np long, nesting long, locals long, public boolean, static boolean, ctor boolean, accessor boolean, own array<string>, foreign array<struct<receiver:string,member:string>>, calls array<string>"


def methods(spark, owns, **more):
    base = {"cc": 1, "mloc": 1, "np": 0, "nesting": 0, "locals": 0, "public": True, "static": False, "ctor": False, "accessor": False, "foreign": [], "calls": []} | more
    return spark.createDataFrame([(1, i, *(base[k] for k in ("cc", "mloc", "np", "nesting", "locals", "public", "static", "ctor", "accessor")), own, base["foreign"], base["calls"]) for i, own in enumerate(owns)], METHODS)


def test_cohesion(spark):
    pairs = methods(spark, [["a"], ["a"], ["b"], ["b"], ["c"], ["c"]])
    fields = spark.createDataFrame([(1, f, True, False) for f in "abc"], "class_id long, field string, public boolean, constant boolean")
    assert metrics.tcc(pairs).first().tcc == pytest.approx(0.2)
    assert metrics.lcom(pairs).first().lcom == 9
    assert metrics.lcom3(pairs, fields).first().lcom3 == pytest.approx(0.8)
    assert metrics.tcc(methods(spark, [["a"]])).first().tcc == 1.0
    assert metrics.tcc(methods(spark, [["a", "b"], ["b"], ["a"]])).first().tcc == pytest.approx(2 / 3)
    assert metrics.lcom(methods(spark, [[], [], ["a"]])).first().lcom == 3


def test_inheritance(spark):
    c = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 7)], "class_id long, superclass long")
    assert {r.class_id: r.dit for r in metrics.dit(c).collect()} == {1: 0, 2: 1, 3: 2, 4: 1, 5: 0, 6: 0, 7: 0}
    assert {r.class_id: r.noc for r in metrics.noc(c).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1}


BASE = {"kind": "class", "wmc": 50, "tcc": 0.2, "atfd": 6, "woc": 0.2, "nopa": 8, "noam": 4, "cloc": 10, "nom": 3}


@pytest.mark.parametrize(
    "change, fires",
    [
        ({}, {"GodClass"}), ({"wmc": 46}, {"DataClass"}), ({"wmc": 47, "tcc": 1 / 3}, set()), ({"wmc": 47, "atfd": 5}, set()), ({"wmc": 20, "nopa": 2}, {"DataClass"}), ({"wmc": 31, "nopa": 2}, set()),
        ({"kind": "interface"}, set()), ({"kind": "record"}, {"GodClass"}), ({"cloc": 201, "tcc": None}, {"LargeClass"}), ({"nom": 21, "wmc": None, "woc": None}, {"LargeClass"}),
    ],
)
def test_strategies_fire_or_are_a_clause_short(spark, change, fires):
    row = BASE | change
    frame = spark.createDataFrame([tuple(row.values())], "kind string, wmc long, tcc double, atfd long, woc double, nopa long, noam long, cloc long, nom long")
    assert {r.smell_type for r in detectors.detect(frame, [], detectors.class_strategies()).collect()} == fires


def test_reported_clauses(spark):
    frame = spark.createDataFrame([(*(BASE | {"cloc": 300, "tcc": None, "woc": None}).values(),)], "kind string, wmc long, tcc double, atfd long, woc double, nopa long, noam long, cloc long, nom long")
    found = detectors.detect(frame, [], detectors.class_strategies()).withColumn("why", detectors.rationale(F.col("conditions"))).first()
    assert (found.smell_type, found.why, found.severity) == ("LargeClass", "CLOC = 300 (> 200)", "major")


def test_scores(spark):
    cells = spark.createDataFrame([(6, 2, 1, 3), (0, 0, 0, 5), (0, 3, 0, 0)], "tp long, fp long, fn long, tn long").select(*scores.all_scores(), F.round(scores.cohen_kappa(), 6).alias("kappa")).collect()
    assert cells[0][:4] == (0.75, 0.857143, 0.8, 0.75) and cells[0].mcc == pytest.approx(16 / math.sqrt(8 * 7 * 5 * 4), abs=1e-6)
    assert cells[1][:3] == (None, None, None) and cells[1].mcc is None and cells[1].accuracy == 1.0
    low, high = scores.wilson(F.lit(8), F.lit(10))
    assert one(spark, F.round(low, 4), F.round(high, 4)) == (0.4902, 0.9433)
    assert one(spark, *scores.wilson(F.lit(0), F.lit(0))) == (0.0, 1.0)


def test_labels(spark):
    rows = spark.createDataFrame([("a", "x", 0), ("a", "x", 1), ("b", "x", 2), ("b", "x", 3), ("c", "x", 0), ("c", "x", 0), ("c", "x", 3), ("d", "y", 1), ("d", "x", None)], "sample_id string, smell string, rank long")
    got = {(r.sample_id, r.smell): (r.reviews, r["mean"], r["max"], r["min"], r.unanimous) for r in scoring.aggregated(rows).collect()}
    assert got == {("a", "x"): (2, 1, 1, 0, None), ("b", "x"): (2, 3, 3, 2, None), ("c", "x"): (3, 1, 3, 0, None), ("d", "y"): (1, 1, 1, 1, 1), ("d", "x"): (0, None, None, None, None)}


def test_ranks_and_separation(spark):
    v = spark.createDataFrame([("a", float(x), x > 2) for x in (1, 2, 2, 3, 4)], "g string, v double, p boolean")
    assert scoring.nearest_rank(v, ["g"], "v", {"q1": 0.25, "q2": 0.5, "top": 1.0}).first()[1:] == (2.0, 2.0, 4.0)
    assert scoring.separation(v, ["g"], "v", F.col("p")).first().auc == 1.0
    assert scoring.separation(v, ["g"], "v", F.col("v") == 2).first().auc == pytest.approx((2 * 1 + 0) / 6)
    assert scoring.separation(v.where("p"), ["g"], "v", F.col("p")).first().auc is None


def test_matches_in_order(spark):
    entities = spark.createDataFrame([("f", 1, "A", 9), ("f", 1, "B", 5), ("f", 3, "C", 4), ("f", 3, "C", 8), ("bad", 1, "Z", 2)], "file string, start int, name string, end int")
    samples = spark.createDataFrame([(1, "g", "A", 1, 9), (2, "bad", "A", 7, 9), (3, "f", "A", 7, 9), (4, "f", "X", 1, 9), (5, "f", "C", 3, 4), (6, "f", "A", 1, 8), (7, "f", "A", 1, 9)], "sample_id int, file string, name string, start int, end int")
    got = {r.sample_id: r.outcome for r in matching.match(samples, entities, entities.where("file = 'bad'")).collect()}
    assert [got[k] for k in range(1, 8)] == list(matching.OUTCOMES)


def test_names_and_paths(spark):
    assert one(spark, text.normalised_path(F.lit("\\a\\b/c/")), text.simple_name(F.lit("p.q.C")), text.simple_name(F.lit("p.C#run int X")), text.owner_name(F.lit("git@github.com:o/n.git")), text.owner_name(F.lit("https://github.com/o/n"))) == ("a/b/c", "C", "run", "o/n", "o/n")
    import hashlib

    assert one(spark, text.fingerprint(F.lit("LongMethod"), F.lit("com.example"), F.lit("Job"), F.lit("run()")))[0] == hashlib.sha256(b"LongMethod|com.example|Job|run()").hexdigest()[:32]


def test_loc_in_sql_is_the_scanners(spark):
    from sieveline.java.scanner import effective_loc

    source = "a;\n\n{\n} else {\n});\n// x\n/* b\n c\n*/\n* d\nreturn x; // e\n/* f */ g();\n;;\n/** k */"
    assert one(spark, text.effective_loc(F.lit(source)))[0] == effective_loc(source.split("\n")) == 3


def test_conflicts_and_changes(spark):
    edits = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 8, 10), ("b", 3, 3), ("b", 3, 3), ("c", 0, 9), ("c", 1, 2), ("c", 4, 5)], "f string, start int, end int")
    assert sorted((r.f, r.start) for r in setops.conflicts(edits, "f").where("conflict").collect()) == [("a", 8), ("b", 3), ("c", 1), ("c", 4)]
    before, after = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("aab", "abbc"))
    assert {r.k: (r.removed, r.introduced, r.kept) for r in setops.multiset_change(before, after, ["k"]).collect()} == {"a": (1, 0, 1), "b": (0, 1, 1), "c": (0, 1, 0)}


def test_resampling(spark):
    cells = spark.createDataFrame([("x", 3, 1, 0, 2), ("y", 0, 0, 2, 4)], "group string, tp long, fp long, fn long, tn long")
    draws = inference.bootstrap_draws(spark, ["x", "y"], 50, 1)
    assert {r["n"] for r in draws.groupBy("draw").agg(F.sum("weight").alias("n")).collect()} == {2}
    got = inference.resampled(cells, "group", draws)
    assert got.count() == 50 and inference.interval(got, "mcc").first().draws <= 50
    assert inference.greedy_folds([("a", 9), ("b", 5), ("c", 5), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_models_keep_groups_apart(spark):
    rows = spark.range(400).selectExpr("id", "cast(id % 20 as string) AS repo", "cast(id % 7 AS double) AS a", "cast((id * 13) % 5 AS double) AS b", "id % 7 > 3 AS y")
    table = models.folded(models.assembled(rows, ["a", "b"], "y", "repo"))
    assert table.groupBy("group").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    predicted = models.cross_validated(table, models.zoo()["logistic"])
    assert predicted.count() == 400 and models.scored(predicted).first().mcc > 0.9
    model = models.zoo()["logistic"]().fit(table)
    falls = models.importances(model, table, ["a", "b"], 1)
    assert falls["a"] > 0.5 > abs(falls["b"])
    why = models.explained(model, table, ["a", "b"])
    assert why.where("feature = 'a' AND decisive").count() > 0 and why.where("feature = 'b' AND decisive").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id;reviewer_id;sample_id;smell;severity;review_timestamp;type;code_name;repository;commit_hash;path;start_line;end_line;link;x\n1;7;s1;blob;minor;t;class;p.C;git@github.com:o/n.git;h;/a/C.java;3;9;l;y\n2;8;s1;blob;none;t;class;p.D;git@github.com:o/n.git;h;/a/D.java;4;9;l;y\n3;8;s1;data class;major;t;class;p.C;git@github.com:o/n.git;h;/a/C.java;3;9;l;y\n")
    found = files.reviews(spark, f"file://{tmp_path}/r.csv")
    s = {(r.sample_id, r.smell): r for r in files.samples(found).collect()}
    assert len(s) == 2 and s["s1", "blob"].code_name == "p.C" and len(s["s1", "blob"].reviews) == 2
    (tmp_path / "x.xml").write_text('<pmd>\n<file name="a/A&amp;B.java">\n<violation beginline="1" rule="GodClass" class="A" method="m">\ntext <\n</violation>\n<violation rule="DataClass" class="B"/>\n</file>\n<file name="c.java">\n<violation rule="X" class="C">')
    assert [tuple(r)[1:] for r in files.report(spark, f"file://{tmp_path}/x.xml").orderBy("rule").collect()] == [("a/A&B.java", "B", "", "DataClass"), ("a/A&B.java", "A", "m", "GodClass"), ("c.java", "C", "", "X")]
    (tmp_path / "b.json").write_text(json.dumps({"version": 1, "findings": ["f1", "f2"]}))
    assert {r.fingerprint for r in files.baseline(spark, f"file://{tmp_path}/b.json").collect()} == {"f1", "f2"}
    (tmp_path / "b2.json").write_text(json.dumps({"version": 2, "findings": []}))
    with pytest.raises(Exception, match="version 1"):
        files.baseline(spark, f"file://{tmp_path}/b2.json").collect()
    (tmp_path / "t.toml").write_text("deep_nesting = 5\n")
    assert files.thresholds(str(tmp_path / "t.toml")).deep_nesting == 5
    columns = [c.split()[0] for c in files.FEATURES.split(", ")]
    assert len(columns) == 49
    row = lambda **v: ",".join(str(v.get(c, "")) for c in columns)
    (tmp_path / "f.csv").write_text("\n".join([",".join(columns), row(sample_id="a", smelly_mean="1", c_WMC=3.0), row(sample_id="b", smelly_mean="0"), row(sample_id="c", c_WMC=1.0)]) + "\n")
    assert tuple(files.complete(files.features(spark, f"file://{tmp_path}/f.csv"), ["c_WMC"], "smelly_mean").first()) == (1, 1, 1, 1)
    (tmp_path / "j.csv").write_text("review_id,refactoring,smell,class_name,method,file,ordinal,behaviour,benefit,acceptance,note\nA01,G,D,C,m,f,0,,,,\nA02,G,D,C,m,f,1,same,yes,accept,\n")
    assert files.judgements(spark, f"file://{tmp_path}/j.csv").count() == 1
    with open(tmp_path / "j.csv", "a") as f:
        f.write("A03,G,D,C,m,f,1,same,yes,perhaps,\n")
    with pytest.raises(Exception, match="row 4"):
        files.judgements(spark, f"file://{tmp_path}/j.csv").collect()
    with pytest.raises(Exception, match="not a verdict"):
        one(spark, files.flag(F.lit("maybe")))


def test_reports_of_a_source_tree(spark, tmp_path):
    from sieveline.java import analysis, facts

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text("public class A { void deep(int a) { if (a>0) { if (a>1) { if (a>2) { if (a>3) { a--; } } } } } void many(int a, int b, int c, int d, int e, int f) {} }")
    found = analysis.analyse(spark, f"file://{tmp_path}").cache()
    assert {(r.method, r.smell_type) for r in found.collect()} == {("deep", "DeepNesting"), ("many", "LongParameterList")}
    document = json.loads(files.sarif_document(found))
    assert document["version"] == "2.1.0" and [r["id"] for r in document["runs"][0]["tool"]["driver"]["rules"]] == ["DeepNesting", "LongParameterList"] and len(document["runs"][0]["results"]) == 2
    files.findings_csv(found, f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).columns[-1] == "refactorings"
    files.write_baseline(found, f"file://{tmp_path}/base")
    assert files.baseline(spark, f"file://{tmp_path}/base").count() == 2
    files.findings_json(found, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2
    types = facts.entities(facts.units(facts.java_files(spark, f"file://{tmp_path}/src")))
    files.metric_matrix(analysis.class_table(types, facts.methods(types)), f"file://{tmp_path}/matrix")
    assert spark.read.csv(f"file://{tmp_path}/matrix", header=True).first()["WMC"] == "6.0"


def test_ingest_resumes(spark, tmp_path):
    from sieveline.streaming import ingest

    (tmp_path / "in").mkdir()
    at = lambda x: f"file://{tmp_path}/{x}"
    (tmp_path / "in" / "A.java").write_text("class A {}")
    ingest.measured(spark, at("in"), at("out"), at("check"))
    (tmp_path / "in" / "B.java").write_text("class B {}")
    ingest.measured(spark, at("in"), at("out"), at("check"))
    ingest.measured(spark, at("in"), at("out"), at("check"))
    got = spark.read.parquet(at("out"))
    assert got.count() == 2 and got.select("batch").distinct().count() == 2


def test_late_events(spark, tmp_path):
    from sieveline.streaming import ingest

    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:04:00", "a", 2.0), ("2024-01-01 00:06:00", "b", 4.0), ("2024-01-01 02:00:00", "a", 0.0)], "t string, event_type string, value double").selectExpr("cast(t as timestamp) ts", "event_type", "value")
    rows.write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/e")
    q = ingest.events_by_minute(stream).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n, r.total) for r in spark.sql("SELECT * FROM late").collect()} >= {("a", 2, 3.0), ("b", 1, 4.0)}


def test_archives(spark, tmp_path):
    import io
    import tarfile

    from sieveline.sources import archives

    links = {
        "": "link_empty", "ftp://github.com/a/b": "bad_scheme", "https://u:p@github.com/a/b": "credentials_in_link", "https://gitlab.com/a/b": "not_github", "https://github.com/a": "no_repository", "https://github.com/-a/b": "bad_repository",
        "https://github.com/a/b/tree/../x": "bad_ref", "https://github.com/a/b/tree/m#L1": "bad_ref", "a/b": None, "git@github.com:a/b.git": None, "https://www.github.com/a/b.git": None, "https://github.com/a/b/tree/dev": None,
    }
    got = {r.link: r.r for r in spark.createDataFrame([(x,) for x in links], "link string").withColumn("r", archives.repository(F.col("link"))).collect()}
    assert {k: r.refused for k, r in got.items()} == links
    assert got["https://github.com/a/b/tree/dev"].ref == "dev" and tuple(got["git@github.com:a/b.git"])[:3] == ("a", "b", "HEAD")

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in (("r-1/src/A.java", b"class A {}"), ("r-1/../../x.java", b"bad"), ("/etc/Z.java", b"bad"), ("r-1/README.md", b"no"), ("r-1/Big.java", b" " * 5_000_000)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "a.tar.gz").write_bytes(out.getvalue())
    (tmp_path / "b.tar.gz").write_bytes(b"nothing")
    rows = archives.java_files(spark, f"file://{tmp_path}").collect()
    assert sorted((r.file, r.refused) for r in rows if r.file) == [("src/A.java", None)] and [r.refused for r in rows if not r.file] == ["not_an_archive"]
    with pytest.raises(ValueError, match="too_much_source"):
        list(archives.java_members(out.getvalue(), files=0))
    assert archives.vocabulary(spark).count() == len(archives.GLOSSARY)


def test_suppression(spark):
    lines = ["// smell:ignore(GodClass, LongMethod)", "", "/* note */", "@SuppressWarnings({\"x\", \"smell:DeepNesting\"})", "void m() {", "// smell:ignore", "int x;", "void n() {"]
    frame = spark.createDataFrame([(lines, n, t) for n in (4, 8) for t in ("GodClass", "DeepNesting")], "l array<string>, n int, t string")
    got = frame.select("n", "t", text.suppressed(F.col("l"), F.col("n"), F.col("t")).alias("c"), text.suppressed_by_annotation(F.col("l"), F.col("n"), F.col("t")).alias("a")).collect()
    assert {(r.n, r.t): (r.c, r.a) for r in got} == {(4, "GodClass"): (True, False), (4, "DeepNesting"): (False, True), (8, "GodClass"): (False, False), (8, "DeepNesting"): (False, False)}


def test_diffs(spark):
    import random

    from sieveline.operators import diffs

    random.seed(1)
    for _ in range(60):
        old, new = ([random.choice("abc") for _ in range(random.randrange(9))] for _ in range(2))
        steps = diffs.line_diff(old, new)
        assert [old[i] for op, i, _ in steps if op != "added"] == old and [new[j] for op, _, j in steps if op != "removed"] == new
        assert all(old[i] == new[j] for op, i, j in steps if op == "kept")
    assert [op for op, *_ in diffs.line_diff(list("xaby"), list("xcdy"), cells=1)] == ["kept", "removed", "removed", "added", "added", "kept"]
    frame = spark.createDataFrame([(1, "a\nb\nc", "a\nc\nd"), (2, None, "x")], "id long, o string, n string")
    assert [(r.op, r.old_line, r.new_line) for r in diffs.differences(frame, "id", "o", "n").where("key = 1").orderBy("place").collect()] == [("kept", 0, 0), ("removed", 1, None), ("kept", 2, 1), ("added", None, 2)]
    texts = spark.createDataFrame([(1, "the window function ranks rows"), (2, "the window function ranks many rows"), (3, "nothing like other sentences")], "id long, text string")
    assert [(r.a, r.b) for r in diffs.alike(texts, "id", "text").collect()] == [(1, 2)]
    assert one(spark, diffs.folded(F.lit("Érić Ñ")))[0] == "eric n"
