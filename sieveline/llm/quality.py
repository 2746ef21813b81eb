"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every text gets base measures (words, symbols, repeated lines, repeated eight-word windows, echoed words). Rules compare ratios of
them with cutoffs. The cutoffs form one sequence of ever stricter configurations: each step lets one rule reject more.
Per stratum, a configuration passes if the exact binomial probability that it would reject as few of the good labelled
documents as it does, were its true rate of false rejections alpha, is at most delta / strata. Steps are tested in
order up to the first that fails, so testing many of them costs nothing (a fixed sequence), and the division by the
strata (Bonferroni) covers all of these: with probability 1 - delta every stratum keeps its rate of false rejections, of
all rules together, at or under alpha. Of the steps that pass, the first is taken that rejects nearly all (`ENOUGH`) of the
labelled bad documents that any of them does; without any, none.

A trial is a distinct text: rows that repeat a labelled doc_id, and labelled copies of one text, count once (as good only
if all labels say so), since the bound is of independent trials. Near copies are trials of their own, so a corpus whose
labelled part is full of them should be deduplicated first.

Strata are the languages, and one for null; their cutoffs (a row for each) are broadcast if counted to be few, else joined.
Null text has no words and fails the base rules. Repeated rows are judged each; a doc_id with several labels is good if
all say so. With no labels, or none good, only the base rules apply. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.llm.common import join_spread, written

WHITE = " \t\n\x0b\f\r"
_GAP = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Largest rate of false rejections in a stratum, and the probability that the guarantee fails anywhere.
ALPHA, DELTA = 0.02, 0.05
#: Share of the bad documents that could be rejected at which the sequence is stricter than needed.
ENOUGH = 0.99
#: The sequence: a rule rejects where its ratio of measures is over the cutoff. Later steps add to earlier ones.
SEQUENCE: tuple[tuple[str, float], ...] = (
    *(("symbols_per_char", c) for c in (0.32, 0.24, 0.16, 0.12, 0.1, 0.08, 0.06)),
    *(("echo_share", c) for c in (0.6, 0.5, 0.4, 0.3, 0.2)),
    *(("repeat_share", c) for c in (0.25, 0.2, 0.15, 0.1, 0.06)),
    *(("dup_lines_per_word", c) for c in (0.08, 0.04, 0.02, 0.01)),
    *(("chars_per_word", c) for c in (25.0, 18.0, 14.0)),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the text's hash, the five base measures of every row, and `n_echo_words`, its words that are those before them."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    trimmed = narrow.withColumn("bare", F.btrim("text", F.lit(WHITE))).withColumn("text_hash", F.xxhash64("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    worded = trimmed.select(
        "doc_id", "lang", "text_hash", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", _GAP)).alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    windows = worded.select(
        "doc_id", "lang", "text_hash", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w, i: (i > 0) & (w == F.get(F.col("words"), i - 1)))).cast("long").alias("n_echo_words"),
        F.when(n >= WINDOW, F.transform(F.slice("words", F.lit(1), n - (WINDOW - 1)), lambda _, i: F.xxhash64(F.slice(F.col("words"), i + 1, F.lit(WINDOW))))).alias("windows"),
    )
    # Positions of windows found twice or more: equal neighbours once windows and positions are sorted together.
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    sorted_ = windows.withColumn("sorted", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda s, i: F.coalesce(s["h"] == F.get(F.col("sorted"), i)["h"], F.lit(False))
    flagged = sorted_.withColumn("at", F.sort_array(F.transform(F.filter("sorted", lambda s, i: near(s, i - 1) | near(s, i + 1)), lambda s: s["i"])))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return flagged.select("doc_id", "lang", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_echo_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ratio(rule: str) -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_char": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "echo_share": F.col("n_echo_words") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
    }[rule]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_at_most(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of a binomial X with n trials at `rate`, exactly: its terms are summed, each from the one before."""
    odds = F.log(F.lit(rate / (1 - rate)))
    start = F.struct((n * F.log(F.lit(1 - rate))).alias("term"), F.exp(n * F.log(F.lit(1 - rate))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i.cast("double")) + odds
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, step, lambda a: a["sum"])


def first_step(sequence: tuple[tuple[str, float], ...]) -> Column:
    """The first step of the sequence that rejects a document, from 1; null if none does."""
    return F.array_min(F.array(*[F.when(ratio(r) > c, F.lit(k)) for k, (r, c) in enumerate(sequence, 1)]))


def chosen_steps(holdout: DataFrame, strata: int, steps: int, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """`stratum` and its step (`upto`, 0: none) from labelled documents (stratum, step, good). A row per stratum and step is all that is sorted."""
    total = holdout.groupBy("stratum").agg(F.count_if("good").alias("n"))
    seen = holdout.where("step is not null").groupBy("stratum", "step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    grid = total.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).join(seen, ["stratum", "step"], "left")
    so_far = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    counted = grid.select("stratum", "step", "n", F.coalesce(F.sum("good").over(so_far), F.lit(0)).alias("good"), F.coalesce(F.sum("bad").over(so_far), F.lit(0)).alias("bad"))
    few = F.col("good") <= alpha * F.col("n")
    passes = few & (binomial_at_most(F.when(few, F.col("good")).otherwise(0), F.col("n"), alpha) <= delta / strata)
    certified = counted.withColumn("ok", F.min(passes.cast("int")).over(so_far)).where("ok = 1")
    most = certified.withColumn("most", F.max("bad").over(Window.partitionBy("stratum")))
    return most.where((F.col("bad") > 0) & (F.col("bad") >= ENOUGH * F.col("most"))).groupBy("stratum").agg(F.min("step").alias("upto"))


def trials(table: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, step, good: one row per distinct labelled text of the judged `table` that passes the base rules."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    labelled = table.where("not base_failed and doc_id is not null").join(known, "doc_id")
    one = labelled.groupBy("doc_id").agg(F.min(F.struct("text_hash", "stratum", "step")).alias("x"), F.first("good").alias("good")).select("x.*", "good")
    return one.groupBy("stratum", "text_hash").agg(F.min("step").alias("step"), F.min("good").alias("good")).drop("text_hash")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, sequence: tuple[tuple[str, float], ...] = SEQUENCE) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every row of `docs` (doc_id, text, lang)."""
    table = written(measured(docs), "quality").withColumn("base_failed", base_failed()).withColumn("step", first_step(sequence))
    table = table.withColumn("stratum", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("none")))
    strata = table.where("lang is not null").select("lang").distinct().count() + 1
    limits = written(chosen_steps(trials(table, labels), strata, len(sequence), alpha, delta), "cutoffs")
    over = F.coalesce(F.col("step") <= F.col("upto"), F.lit(False))
    return join_spread(table, limits, "stratum", ["doc_id", "text_hash"]).select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~over).alias("kept"))
