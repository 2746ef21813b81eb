import math
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import quality
from tests.llm import cases

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered)


def test_measures_of_a_table(spark):
    got = quality.measured(cases.frame(spark)).collect()
    want = [(r[0], *base(r[1])) for r in cases.rows()]
    assert sorted(((r.doc_id, *(r[m] for m in quality.MEASURES)) for r in got), key=str) == sorted(want, key=str)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "\n", " ", "# ", "é\t", "c\n"]), max_size=80).map("".join), min_size=30, max_size=30))
def test_measures_of_any_text(spark, texts):
    got = quality.measured(spark.createDataFrame([(i, x, None) for i, x in enumerate(texts)], "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert [tuple(r[m] for m in quality.MEASURES) for r in got] == [base(x) for x in texts]


def test_echoes(spark):
    frame = spark.createDataFrame([(1, "a a a b b c", None), (2, "a", None), (3, None, None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.n_echo_words for r in quality.measured(frame).collect()} == {1: 3, 2: 0, 3: 0}


def binomial(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_the_bound_is_exact(spark):
    for k, n, rate in [(0, 10, 0.1), (3, 50, 0.1), (2, 1000, 0.0025), (0, 0, 0.01)]:
        got = spark.range(1).select(quality.binomial_at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), rate)).first()[0]
        assert math.isclose(got, binomial(k, n, rate), rel_tol=1e-9)


def documents(spark, n=4000):
    """Clean documents, some with a symbol or two, and junk full of them, in two languages."""
    alphabet, rows = string.ascii_lowercase, []
    for i in range(n):
        words = [alphabet[(i * 7 + k * k) % 26] * (1 + (i + k) % 7) + str(i * 100 + k) for k in range(40)]
        junk = i % 5 == 0
        text = " ".join(w + "###" for w in words) if junk else " ".join(words) + (" &" if i % 7 == 0 else "")
        rows.append((i, text, ("en", "fr")[i % 2], int(not junk)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, good int")


def test_cutoffs_are_those_of_brute_force(spark):
    docs = documents(spark)
    labels = docs.select("doc_id", F.col("good").alias("quality"), F.lit("x").alias("n_words"))
    alpha, delta = 0.01, 0.05
    rows = [(r.doc_id, r.lang, r.good, base(r.text)) for r in docs.collect()]
    ratios = lambda m: {"symbols_per_char": m[2] / max(m[1], 1), "dup_lines_per_word": m[3] / max(m[0], 1), "repeat_share": m[4] / max(m[0], 1), "chars_per_word": m[1] / max(m[0], 1), "echo_share": 0.0}
    for sequence in (quality.SEQUENCE, (("symbols_per_char", 0.5), ("chars_per_word", 7.0), ("symbols_per_char", 0.3)), (("symbols_per_char", 0.3), ("symbols_per_char", 0.0))):
        got = {r.doc_id: r.kept for r in quality.judge(docs, labels, alpha, delta, sequence).collect()}
        upto = {}
        for lang in ("en", "fr"):
            certified = []
            for k in range(1, len(sequence) + 1):
                out = [any(ratios(m)[r] > c for r, c in sequence[:k]) for _, x, _, m in rows if x == lang]
                good = [bool(g) for _, x, g, _ in rows if x == lang]
                wrong = sum(o and g for o, g in zip(out, good, strict=True))
                if wrong > alpha * sum(good) or binomial(wrong, sum(good), alpha) > delta / 3:
                    break
                certified.append((k, sum(o and not g for o, g in zip(out, good, strict=True))))
            most = max((b for _, b in certified), default=0)
            upto[lang] = next((k for k, b in certified if b > 0 and b >= 0.99 * most), 0)
        assert got == {i: not any(ratios(m)[r] > c for r, c in sequence[: upto[x]]) for i, x, _, m in rows}
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels, alpha, delta).collect()}
    assert not any(got[i] for i, _, g, _ in rows if not g) and all(got[i] for i, _, g, _ in rows if g)


def test_without_labels_only_the_base_rules_hold(spark):
    docs = documents(spark, 50)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in quality.judge(docs, none).collect())


def test_repeated_rows_are_one_trial(spark):
    docs = documents(spark, 25).withColumn("good", F.lit(1))  # every fifth is full of symbols, and labelled good all the same
    docs = docs.where("doc_id % 5 <> 0").unionByName(spark.createDataFrame([(1000 + i, " ".join(f"bad{i}x{k}###" for k in range(40)), "en", 0) for i in range(5)], docs.schema))
    labels = docs.select("doc_id", F.col("good").alias("quality"))
    kept = lambda d, lab: {(r.doc_id, r.kept) for r in quality.judge(d, lab).collect()}
    assert all(k for _, k in kept(docs, labels))  # 20 good documents guarantee nothing
    many = docs.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("i")
    assert all(k for _, k in kept(many, labels))
    copies = docs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(30)))).withColumn("doc_id", F.col("doc_id") + 10_000 * F.col("i")).drop("i")
    assert all(k for _, k in kept(copies, copies.select("doc_id", F.col("good").alias("quality"))))


def test_every_language_has_its_own_cutoffs(spark):
    docs = documents(spark, 4000)
    rare = docs.withColumn("lang", F.concat(F.lit("x"), (F.col("doc_id") % 4).cast("string")))
    more = spark.range(100).select((F.col("id") + 100_000).alias("doc_id"), F.lit("short").alias("text"), F.concat(F.lit("z"), F.col("id").cast("string")).alias("lang"), F.lit(1).alias("good"))
    got = {r.doc_id: r.kept for r in quality.judge(rare.unionByName(more), docs.select("doc_id", F.col("good").alias("quality"))).collect()}
    assert all(got[r.doc_id] == bool(r.good) for r in docs.collect())


def test_cases(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, None, 0), (1, 0, None), (None, 1, 1), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(cases.frame(spark), labels).collect()
    want = []
    for r in cases.rows():
        m = base(r[1])
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        want.append((r[0], *m, failed, not failed))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert quality.judge(cases.empty(spark), labels.limit(0)).count() == 0
