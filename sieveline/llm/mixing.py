"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is its target share of the mixture's characters over its own share. Each document's
number of copies is a Poisson variate with that mean: a uniform variate made by hashing the seed and the document is
put through the inverse of the distribution. Means over `SPLIT` are drawn as sums of independent variates, so that
the distribution's terms never underflow. Every document is exploded by its count, and all copies are shuffled: each
goes to the partition that a hash of seed, document and copy names, and is sorted there by another such hash.

Nothing depends on partitioning or on row order, so a lost task is recomputed alike. Documents are never grouped by
source (only counted, with partial sums), so a source with most rows makes no large task. The table of sources and
rates is joined, not collected. Null sources are one source of their own; null texts have no characters; a source
without characters is kept at rate 1; a null doc_id is hashed as null; repeated rows get equal counts; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import written

#: Share of a source in the mixture without stated weights: its characters to this power, scaled to sum to 1.
TEMPERATURE = 0.5
#: Characters of the mixture, as a multiple of those of the input.
BUDGET = 1.0
SEED = 17
SPLIT = 64.0
#: Sources (a few bytes each) up to which their rates are broadcast.
BROADCAST_SOURCES = 10_000
COPY, RATE = "mix_copy", "mix_rate"
#: Characters of a partition of the mixture: a larger input gets more partitions than the session's number.
PART_CHARS = 1 << 27


def uniform(*parts: Column | str) -> Column:
    """In [0, 1), with 52 bits, from the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p) if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE) -> DataFrame:
    """source and its mean repetition rate in `mix_rate`. With `weights`, sources that they don't name have weight 0."""
    return _rates(docs, weights, budget, temperature)[0]


def _rates(docs: DataFrame, weights: dict[str | None, float] | None, budget: float, temperature: float) -> tuple[DataFrame, float]:
    """The rates, and all characters of `docs`."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("double")).alias("chars"))
    if weights is None:
        share = F.pow("chars", F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    weighed = written(sizes.withColumn("share", F.when(F.col("chars") > 0, share).otherwise(0.0)), "sources")
    total = weighed.agg(F.sum("chars").alias("chars"), F.sum("share").alias("share")).first()
    if not total["share"]:
        return weighed.select("source", F.lit(1.0).alias(RATE)), total["chars"] or 0.0
    rate = F.lit(budget) * F.col("share") / F.lit(total["share"]) * F.lit(total["chars"]) / F.col("chars")
    return weighed.select("source", F.when(F.col("chars") > 0, rate).otherwise(1.0).alias(RATE)), total["chars"]


def poisson(rate: Column, u: Column) -> Column:
    """The least k whose cumulative probability exceeds u. Terms are added until then; the tail beyond them has no weight in 52 bits."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"), F.when(F.exp(-rate) > u, 0).otherwise(-1).alias("k"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * rate / i
        total = a["sum"] + term
        return F.struct(term.alias("term"), total.alias("sum"), F.when(a["k"] >= 0, a["k"]).when(total > u, i).otherwise(-1).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: F.when(a["k"] >= 0, a["k"]).otherwise(most))


def copies(rate: Column, key: Column, seed: int) -> Column:
    """The Poisson count of a document with this key; rates over SPLIT are parted evenly."""
    parts = F.greatest(F.ceil(rate / SPLIT), F.lit(1)).cast("int")
    return F.when(rate > 0, F.aggregate(F.transform(F.sequence(F.lit(1), parts), lambda i: poisson(rate / parts, uniform(F.lit(seed), key, i))), F.lit(0), lambda a, x: a + x)).otherwise(0)


def column(docs: DataFrame, name: str) -> int:
    """The place of a column: the one of exactly this name, else the first that Spark takes for it."""
    same = [i for i, c in enumerate(docs.columns) if c == name] or [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"there is no column {name}")
    return same[0]


def replicated(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """The columns of `docs`, and the copy's number from 1 in `mix_copy`, shuffled. `docs` needs doc_id, source and text.

    Whatever other columns `docs` has are kept as they are; if one is called `mix_copy` already (in any case), the new
    column's name gets underscores until it is free.
    """
    names, copy = docs.columns, COPY
    while copy in {c.lower() for c in names}:
        copy += "_"
    # Within, columns are named by their places, so that no name of the caller's can clash.
    doc_id, source, text = (f"c{column(docs, x)}" for x in ("doc_id", "source", "text"))
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))
    table, chars = _rates(own.select(F.col(source).alias("source"), F.col(text).alias("text")), weights, budget, TEMPERATURE)
    key = F.col(doc_id).cast("string")
    # The table goes to all executors only if it is short; else both sides are shuffled, and AQE parts a source with most rows.
    table = F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table
    drawn = own.join(table, own[source].eqNullSafe(table["source"]), "left").withColumn("copy", copies(F.col(RATE), key, seed))
    exploded = drawn.where(F.col("copy") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copy"))))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(budget * chars / PART_CHARS))
    return (
        exploded.withColumn("place", F.xxhash64(F.lit(seed), key, "copy"))
        .withColumn("order", F.xxhash64(F.lit(~seed), key, "copy"))
        .repartition(parts, "place")
        .sortWithinPartitions("order")
        .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("copy").alias(copy))
    )
