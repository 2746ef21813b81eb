import shutil
import subprocess

import pytest

from sieveline.java import rewrites
from sieveline.java.scanner import scan

CODE = """class A {
\tvoid run(int a) {
\t\tif (a > 1 || ok()) {
\t\t\tgo(); // first

\t\t\tif (a > 2) {
\t\t\t\tstop();
\t\t\t}
\t\t}
\t}
\tvoid go() {}  void stop() {}  boolean ok() { return true; }
}
"""


def test_guard_clauses():
    edits, why = rewrites.guard_clause(CODE, "run", 2)
    assert why is None
    new = rewrites.applied(CODE, edits)
    assert "\t\tif (!(a > 1 || ok())) {\n\t\t\treturn;\n\t\t}\n\t\tgo(); // first\n\n\t\tif (a > 2) {\n\t\t\tstop();\n\t\t}\n\t}" in new
    assert (scan(CODE)[2][0].methods[0].nesting, scan(new)[2][0].methods[0].nesting) == (2, 1)


@pytest.mark.skipif(shutil.which("javac") is None, reason="no compiler")
def test_the_rewrite_compiles(tmp_path):
    (tmp_path / "A.java").write_text(rewrites.applied(CODE, rewrites.guard_clause(CODE, "run", 2)[0]))
    assert subprocess.run(["javac", "-d", str(tmp_path), str(tmp_path / "A.java")], capture_output=True, timeout=60).returncode == 0


@pytest.mark.parametrize(
    "body, why",
    [
        ("int m() { if (a) { return 1; } return 0; }", "needs_void"),
        ("void m() { if (a) { x(); } y(); }", "not_single_conditional"),
        ("void m() { x(); }", "not_single_conditional"),
        ("void m() { if (a) { x(); } else { y(); } }", "has_else"),
        ("void m() { if (a) x(); }", "branch_not_block"),
        ("void m() { if (a) { } }", "branch_empty"),
        ("void m() { if (a) { x(); } }", "irregular_indent"),
        ("abstract void m();", "no_body"),
        ("void n() { }", "not_located"),
    ],
)
def test_refusals(body, why):
    assert rewrites.guard_clause(f"class A {{\n  {body}\n}}", "m", 2) == ([], why)


def test_edits():
    assert rewrites.applied("abcdef", [(4, 6, ""), (0, 1, "xy"), (2, 2, "-")]) == "xyb-cd"
    assert not rewrites.overlap((0, 2, ""), (2, 4, "")) and rewrites.overlap((1, 1, "a"), (1, 1, "b")) and not rewrites.overlap((2, 2, ""), (0, 2, ""))
    with pytest.raises(ValueError, match="overlap"):
        rewrites.applied("abc", [(0, 2, ""), (1, 3, "")])
    with pytest.raises(ValueError, match="outside"):
        rewrites.applied("abc", [(0, 9, "")])


def test_verdicts(spark):
    rows = [(False, None, None, "broken_syntax"), (True, None, None, "parses"), (True, ["a"], [], "compiles"), (True, ["a"], ["a", "b"], "new_errors"), (True, ["a", "b"], ["a"], "no_new_errors"), (True, None, ["a"], "new_errors")]
    frame = spark.createDataFrame(rows, "parses boolean, before array<string>, after array<string>, want string")
    from pyspark.sql import functions as F

    assert all(r.got == r.want for r in frame.withColumn("got", rewrites.verdict(F.col("parses"), F.col("before"), F.col("after"))).collect())


def test_plans(spark):
    sites = spark.createDataFrame([("A.java", 2, "DeepNesting", "run"), ("A.java", 2, "DeepNesting", "run"), ("A.java", 11, "LongMethod", "go")], "file string, line int, smell_type string, method string")
    got = rewrites.planned(sites, spark.createDataFrame([("A.java", CODE)], "file string, text string")).collect()
    assert sorted(str(r.refused) for r in got) == ["None", "deferred", "no_block"]
    assert len({r.rewritten for r in got}) == 1 and "return;" in got[0].rewritten
    assert any(line.startswith("+") for line in rewrites.unified(CODE, got[0].rewritten, "A.java"))


LONG = """import java.util.*;
class B {
    private int seen;
    int total(List<String> names, final int limit) throws java.io.IOException {
        int sum = 0;
        int unused;
        String last = "";
        for (String n : names) {
            if (n.length() > limit) {
                continue;
            }
            sum += n.length();
            seen++;
            Runnable r = () -> { System.out.println(n); return; };
        }
        return sum + last.length();
    }
}
"""


def test_extract_method():
    edits, why = rewrites.extract_method(LONG.replace("return; };", "};"), "total", 4)
    assert why is None
    new = rewrites.applied(LONG.replace("return; };", "};"), edits)
    assert "        sum = extracted(limit, names, sum);\n        return sum" in new
    assert "    private int extracted(int limit, List<String> names, int sum) throws java.io.IOException {\n        for (String n" in new and "return sum;\n    }\n}" in new


@pytest.mark.skipif(shutil.which("javac") is None, reason="no compiler")
def test_the_extracted_method_compiles(tmp_path):
    text = LONG.replace("return; };", "};")
    (tmp_path / "B.java").write_text(rewrites.applied(text, rewrites.extract_method(text, "total", 4)[0]))
    done = subprocess.run(["javac", "-d", str(tmp_path), str(tmp_path / "B.java")], capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize(
    "head, body, why",
    [
        ("void m(int a)", "go();", "no_block"),
        ("void m(int a)", "while (a > 0) {\n\n\n\nreturn;\n}", "escaping_control_flow"),
        ("void m(int a)", "while (a > 0) {\n\n\nif (x) {\nbreak; } }", None),
        ("void m(int a)", "if (a > 0) {\n\n\n\nbreak;\n}", "escaping_control_flow"),
        ("int m(int a)", "int b = 1; if (a > 0) {\n\n\na = 2; b = 3;\n}\n return a + b;", "several_outputs"),
        ("int m(int a)", "int b; if (a > 0) {\n\n\n b = 3;\n} else { b = 4; }\n return b;", "not_surely_assigned"),
        ("void m(int a)", "var b = f(); if (a > 0) {\n\n\n\n b.go();\n}", "unknown_type"),
        ("<T> void m(T a)", "if (a > 0) {\n\n\n\n b.go();\n}", "type_parameters"),
        ("static void m(int... a)", "if (x) {\n\n\n\n go(a[0]);\n}", "unknown_type"),
    ],
)
def test_extractions_that_are_refused(head, body, why):
    assert rewrites.extract_method(f"class A {{\n  {head} {{\n    {body}\n  }}\n}}", "m", 2)[1] == why


@pytest.mark.skipif(shutil.which("javac") is None, reason="no compiler")
def test_checked_rewrites(spark):
    from sieveline.java import verify

    fine, worse, old = "class A { int f() { return 1; } }", "class A { int f() { return x; } }", "class A { int f() { return y; } }"
    rows = [("ok/A.java", fine, fine, "compiles"), ("b/A.java", fine, worse, "new_errors"), ("c/A.java", old, old, "no_new_errors"), ("d/A.java", fine, fine[:-1], "broken_syntax")]
    frame = spark.createDataFrame(rows, "file string, before string, after string, want string").coalesce(1)
    assert {r.file: r.verdict for r in verify.checked(frame).collect()} == {f: w for f, _, _, w in rows}


WIDE = """class D {
    int go() { return join(1, "a" + 2, null) + this.join(3, "b", new int[] {4}); }
    private int join(int a, final String b, int[] c) {
        java.util.function.IntSupplier s = () -> a + b.length();
        return a > 3 ? join(a - 1, b, c) : s.getAsInt();
    }
}
"""


def test_parameter_object():
    edits, why = rewrites.parameter_object(WIDE, "join", 3)
    assert why is None
    new = rewrites.applied(WIDE, edits)
    assert "    private record JoinParameters(int a, String b, int[] c) {}\n\n    private int join(JoinParameters parameters) {" in new
    assert 'join(new JoinParameters(1, "a" + 2, null)) + this.join(new JoinParameters(3, "b", new int[] {4}))' in new
    assert "parameters.a() > 3 ? join(new JoinParameters(parameters.a() - 1, parameters.b(), parameters.c()))" in new


@pytest.mark.skipif(shutil.which("javac") is None, reason="no compiler")
def test_the_parameter_object_compiles(tmp_path):
    (tmp_path / "D.java").write_text(rewrites.applied(WIDE, rewrites.parameter_object(WIDE, "join", 3)[0]))
    done = subprocess.run(["javac", "-d", str(tmp_path), str(tmp_path / "D.java")], capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize(
    "member, more, why",
    [
        ("void m(int a, int b) { }", "", "not_private"),
        ("private void m(int a) { }", "", "too_few_parameters"),
        ("private <T> void m(T a, int b) { }", "", "type_parameters"),
        ("private void m(int a, int... b) { }", "", "varargs"),
        ("private void m(int a, int b) { a = 1; }", "", "parameter_assigned"),
        ("private void m(int a, int b) { f(a -> b); }", "", "shadowed"),
        ("private void m(int a, int b) { }", "void m(int a) { }", "overloaded"),
        ("private void m(int a, int b) { }", "void n() { other.m(1, 2); }", "unresolved_reference"),
        ("private void m(int a, int b) { }", "Object n() { return this::m; }", "unresolved_reference"),
        ("private int m(int a, int b) { return 1; }", "int n() { return m(m(1, 2), 3); }", "nested_call"),
    ],
)
def test_parameter_objects_that_are_refused(member, more, why):
    assert rewrites.parameter_object(f"class A {{\n  {member}\n  {more}\n}}", "m", 2) == ([], why)


def test_a_nested_class_is_refused():
    assert rewrites.parameter_object("class A { class B {\n  private void m(int a, int b) { }\n} }", "m", 2) == ([], "nested_class")
