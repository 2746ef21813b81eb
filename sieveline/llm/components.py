"""Connected components of a graph of links, by least labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import checkpointed

#: Links (16 bytes each) up to which one task joins them; more are joined in rounds over all executors.
ONE_TASK = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a-b and the smallest node that each reaches: least labels and pointer jumping in arrays."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], least)  # labels of labels too, so that trees are hung under each other whole
        np.minimum.at(label, label[right], least)
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def in_one_task(links: DataFrame) -> DataFrame:
    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            node, label = joined(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["node", "label"])

    return links.coalesce(1).mapInArrow(labelled, "node long, label long")


def in_rounds(links: DataFrame) -> DataFrame:
    both = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("node"), F.col("b").alias("near")).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("label")))
    while True:
        told = both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("told")), "near").groupBy("node").agg(F.min("told").alias("told"))
        least = labels.join(told, "node", "left").select("node", F.col("label").alias("before"), F.least("label", "told").alias("label"))
        over = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = checkpointed(least.join(over, "label", "left").select("node", "before", F.least("label", "further").alias("label")))
        changed = jumped.where("label <> before").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def components(links: DataFrame, stored: bool = False) -> DataFrame:
    """`links` (a, b) -> node, label: the smallest node that each node of a link reaches.

    A round gives every node the least label of its neighbours (partial minima, so a hub's links make no large group)
    and then its label's label; the rounds grow as the logarithm of the longest path. A short list of links is joined
    so within one task. Only counts reach the driver. Links of a node with itself don't count.
    Links that the caller has `stored` aren't written again: for each file that it makes, an executor starts processes (Hadoop's
    chmod, without its native library), and until such a process runs its own program it counts the executor's memory again.
    """
    links = links.select("a", "b").where("a <> b")
    links = links if stored else checkpointed(links)
    return in_one_task(links) if links.count() <= ONE_TASK else in_rounds(links)
