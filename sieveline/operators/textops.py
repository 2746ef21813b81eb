"""Phrases and vocabularies that texts share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as text_


def repeated_phrases(docs: DataFrame, n: int, least: int) -> DataFrame:
    """Runs of n words that occur in at least so many documents, with their counts.

    Phrases are counted per document first; the second count is over documents, so a phrase that is everywhere is
    summed in part by every task.
    """
    # Words are a column of their own: within the transform they would be split again for every run.
    grams = docs.select("doc_id", F.split("text", " ").alias("words")).select("doc_id", F.explode(text_.grams(F.col("words"), n)).alias("phrase"))
    per_doc = grams.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))
    return per_doc.groupBy("phrase").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where(F.col("docs") >= least)


def overlapping(texts: DataFrame, key: str, text: str, share: float, letters: int = 4) -> DataFrame:
    """Pairs of texts whose vocabularies of longer words share at least a word, and a share of the smaller one.

    Pairs are met by their rarest words only: with a share s of the smaller vocabulary in common, one of a text's
    rarest (1 - s) of its words and one more is common, so the frequent words never are a join key.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z ]", " ")), " "), lambda x: F.length(x) >= letters))
    sets = texts.select(F.col(key).alias("a"), words.alias("va"))
    counts = sets.select(F.explode("va").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = sets.select("a", F.size("va").alias("na"), F.explode("va").alias("word")).join(counts, "word")
    ordered = ranked.groupBy("a", "na").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w"))
    prefix = ordered.select("a", F.explode(F.slice("w", F.lit(1), F.col("na") - F.greatest(F.ceil(F.lit(share) * F.col("na")), F.lit(1)).cast("int") + 1)).alias("w")).select("a", F.col("w.word").alias("word"))
    every = ranked.select(F.col("a").alias("b"), F.col("na").alias("nb"), "word")
    # A text's prefix meets all words of texts that are no smaller; ties both ways, then ordered.
    met = prefix.join(every, "word").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = met.join(sets, "a").join(sets.select(F.col("a").alias("b"), F.col("va").alias("vb")), "b")
    shared = F.size(F.array_intersect("va", "vb")).cast("long")
    return both.select("a", "b", shared.alias("shared"), F.least(F.size("va"), F.size("vb")).alias("smaller")).where((F.col("shared") > 0) & (F.col("shared") >= share * F.col("smaller"))).select("a", "b", "shared")
