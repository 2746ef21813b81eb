"""From raw documents to packed training sequences: five stages, each by one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's `docs`. All but the last return the columns of documents. What a stage rejects is named by doc_id, so the rows
of one doc_id stand or fall together. Rows without a doc_id are judged like all others, under a number that is made from
their text (2**62 and up, so that of near-duplicates one with a doc_id stays); equal ones stand or fall together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import langid, mixing, neardup, packing, quality
from sieveline.llm.common import settled, table, written
from sieveline.llm.registry import vocabulary

#: Rejected ids (8 bytes each) up to which they are broadcast.
BROADCAST_IDS = 2_000_000


def key() -> Column:
    """The doc_id, or a number in its place."""
    made = F.lit(1 << 62) + F.xxhash64("text", "lang", "source").bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(F.col("doc_id").cast("long"), made)


def judged(docs: DataFrame) -> DataFrame:
    return docs.select(key().alias("doc_id"), "text", "lang")


def keyed(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """`docs` with or without the keys in `ids` (doc_id), by a semi or anti join; its columns stay as they are."""
    name = "key_"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, key()).join(ids.withColumnRenamed("doc_id", name), name, how).drop(name)


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """`docs` but for the keys in `rejected` (doc_id); texts are shuffled only if there are too many of these to broadcast."""
    ids = written(rejected.select("doc_id").distinct(), "rejected")
    return keyed(docs, F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a rule whose false rejections are under control go."""
    return without(docs, quality.judge(judged(docs), table(spark, sf_dir, "labels")).where("not kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose score is under that of nearly all held-out documents of their language."""
    found = written(langid.identify(judged(docs), langid.train(judged(docs))), "languages")
    return without(docs, langid.doubted(found, judged(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; of repeated ids one row does."""
    left = without(docs, neardup.near_duplicates(judged(docs)).where("not kept"))
    repeated = written(judged(docs).groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    one = keyed(left, repeated, "left_semi").groupBy(key()).agg(F.first(F.struct("*")).alias("row")).select("row.*")
    return keyed(left, repeated, "left_anti").unionByName(one)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated towards the square root of their share of the characters."""
    return mixing.replicated(docs).select([F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in the training sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: The stages' networks, sketches and local search can't be put in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
