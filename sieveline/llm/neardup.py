"""Near-duplicate groups by SetSketch registers, banded, estimated by likelihood and confirmed on full shingle sets.

**Sketch.** A document's set is its distinct word shingles. Each of registers holds the minimum over the
set of an exponentially distributed hash, on an exponentially spaced scale and truncated: max(0, min(q+1,
floor(1 - log_b(minimum)))). The maximum of two registers is the register of the union, so sketches merge, and equal
registers are about as likely as sets are similar.

**Candidates.** Documents with equal sets are one class, represented by the smallest id. Representatives that agree in
all registers of a band share a bucket. Buckets are made into stars, never into all pairs: first within each task's
documents, so that only one leader a bucket and task is shuffled, then among leaders. The pairs of stars are estimated
by maximum likelihood over which register is larger, and the likely ones are confirmed on full sets of shingles.

**Search across components.** Links make components. A bucket whose members are then in several components may still
hold links between members that aren't leaders: there, every member outside the bucket's largest component is compared,
by its registers, with the members of other components. Of a likely pair nothing is stored but that its two documents
take part, in the first band that the two share. Those documents meet once more in the same part of the bucket with their
texts, and an exact join of their full sets (prefixes of the rarest shingles, by size) finds the links between components;
a pair that other links have joined by then is skipped, so a part returns a forest, never its pairs. So the components are
those of all links that the bands see; at the similarity of the threshold a pair is missed by all bands with probability
`MISSED`, under one in a million, and ruled out by its estimate with 3.4e-6 (`SLACK` standard deviations).

Buckets are parted into blocks of members by blocks of outsiders, by number and by size of sets, and a task holds one pair
of blocks. What is stored is a row for each member and block that it meets: for buckets under `BLOCK` members as many rows
as members, beyond that as many times more as there are blocks of outsiders. Families of very many documents that all
lie near the threshold without a link are the dear case: time grows with the square of such a family, rows with the square
over `BLOCK`.

Nulls and texts without words have empty sets and link with nothing. Rows with a null doc_id are kept unlinked, with a
null component. Repeated rows of a doc_id are one document. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import BROADCAST_ROWS, checkpointed, intermediates, join_spread, slices, written
from sieveline.llm.components import components

WORDS, PERCENT = 5, 80
#: Registers in a band, and the probability that a pair at the threshold shares no band, which gives the number of bands.
ROWS, MISSED = 5, 7e-7
#: Registers besides those of bands, for estimates.
MORE = 60
#: The scale of registers: base, rate of the exponential variates, largest value less one.
BASE, RATE, TOP = 1.001, 20.0, 65_534
SEED = 7
#: Standard deviations below the threshold at which an estimate still is a candidate.
SLACK = 4.5
#: Words that a task remembers the hashes of; representatives that a task makes stars of at once.
CACHE, CHUNK = 250_000, 20_000
#: Members, and shingles of these, in a block of a bucket.
BLOCK, BLOCK_SHINGLES = 1_000, 1 << 20

_U = np.uint64


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingles:
    """Hashed sets of word shingles. Words are runs of bytes other than white space, A-Z in lower case."""

    def __init__(self, words: int = WORDS, cache: int = CACHE):
        import xxhash

        self.digest, self.words, self.cache, self.known = xxhash.xxh3_64_intdigest, words, cache, {}
        self.weights = _constants(words, SEED)

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles; of the whole sequence if it is shorter; none without words."""
        listed = text.lower().split() if text else []
        if not listed:
            return np.empty(0, np.uint64)
        if len(self.known) > self.cache:
            self.known.clear()
        known, digest = self.known, self.digest
        for x in set(listed):
            if x not in known:
                known[x] = digest(x)
        h = np.fromiter(map(known.__getitem__, listed), np.uint64, len(listed))
        if len(h) < self.words:  # the length goes in, so that it equals no full shingle
            return _mixed(np.array([(h * self.weights[: len(h)]).sum(dtype=np.uint64) + _U(len(h))]))
        n = len(h) - self.words + 1
        s = np.zeros(n, np.uint64)
        for k, w in enumerate(self.weights):
            s += h[k : k + n] * w
        return np.unique(_mixed(s))


class SetSketch:
    def __init__(self, registers: int, seed: int = SEED):
        self.m = registers
        self.add, self.times = _constants(registers, seed + 1), _constants(registers, seed + 2)

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, m) of non-empty sets: truncated minima, all sets at once."""
        flat, starts = np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets[:-1]])
        least = np.empty((self.m, len(sets)), np.uint64)
        work = np.empty_like(flat)
        for i in range(self.m):
            np.bitwise_xor(flat, self.add[i], out=work)
            np.multiply(work, self.times[i], out=work)
            least[i] = np.minimum.reduceat(work, starts)
        u = (least.T.astype(np.float64) + 0.5) / 2.0**64
        return self.truncated(-np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE)

    @staticmethod
    def truncated(minima: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(1 - np.log(minima) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands): the bucket of each band, as signed 64-bit numbers."""
    weights = _constants(bands * rows, SEED + 3).reshape(bands, rows)
    salts = _constants(bands, SEED + 4)
    parts = registers[:, : bands * rows].astype(np.uint64).reshape(len(registers), bands, rows)
    return _mixed((parts * weights).sum(2, dtype=np.uint64) + salts).view(np.int64)


def estimated(na: np.ndarray, nb: np.ndarray, larger: np.ndarray, smaller: np.ndarray, m: int) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, from the sets' sizes and how many registers are larger or smaller.

    A register of set A is larger with probability p(u - vJ), of B with p(v - uJ), for u and v the sets' shares of their
    sizes' sum and p(x) = -log_b(1 - x (b-1)/b). The log-likelihood is concave in J, so its slope is bisected.
    """
    na, nb = np.asarray(na, np.float64), np.asarray(nb, np.float64)
    u, v = na / (na + nb), nb / (na + nb)
    c, scale = (BASE - 1) / BASE, math.log(BASE)
    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    equal = m - larger - smaller
    for _ in range(30):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = -np.log1p(-c * x) / scale, -np.log1p(-c * y) / scale
        dp, dq = -v * c / ((1 - c * x) * scale), -u * c / ((1 - c * y) * scale)
        slope = larger * dp / p + smaller * dq / q - equal * (dp + dq) / np.maximum(1 - p - q, 1e-12)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def margin(percent: int, m: int) -> float:
    s = percent / 100
    return s - SLACK * math.sqrt(s * (1 - s) / m)


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands that miss a pair at the threshold with probability MISSED at most: 36 of 5 registers for 80 percent."""
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-((min(percent, 99) / 100) ** rows))))


_SKETCH = "doc_id long, n_shingles long, sig1 long, sig2 long, registers binary"


def sketches(docs: DataFrame, words: int = WORDS, bands: int = bands_for(PERCENT), rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit signature of the set and its registers (null without shingles), per row."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sketch = Shingles(words), SetSketch(bands * rows + MORE)
        for batch in slices(batches):
            sets = [shingles.of(x) for x in batch.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            held: list[bytes | None] = [None] * len(sets)
            a = 0
            while a < len(full):  # a million hashes or so at once
                b, n = a, 0
                while b < len(full) and (b == a or n < 1 << 20):
                    n += len(sets[full[b]])
                    b += 1
                for i, r in zip(full[a:b], sketch.registers([sets[i] for i in full[a:b]]), strict=True):
                    held[i] = r.tobytes()
                a = b
            sums = np.array([[s.sum(dtype=np.uint64), _mixed(s).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(held, pa.binary())], ["doc_id", "n_shingles", "sig1", "sig2", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(drawn, _SKETCH)


def stars(held: DataFrame, bands: int = bands_for(PERCENT), rows: int = ROWS) -> DataFrame:
    """`held` (doc_id, registers) -> bucket, a, b: a star for each bucket of several documents, over leaders of tasks' stars."""
    names = ["place", "bucket", "a", "b"]

    def star(bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted by bucket and doc: the first of each bucket, and at which of these a row's is."""
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        return np.flatnonzero(new), np.cumsum(new) - 1

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        keys: list[np.ndarray] = []

        def made() -> Iterator[pa.RecordBatch]:
            bucket, doc = np.concatenate(keys).ravel(), np.repeat(np.concatenate(docs), bands)
            docs.clear(), keys.clear()
            # The order of documents within a bucket differs from bucket to bucket, so that leaders do.
            order = np.lexsort((_mixed(doc.view(np.uint64) ^ bucket.view(np.uint64)), bucket))
            bucket, doc = bucket[order], doc[order]
            first, of = star(bucket, doc)
            rest = np.setdiff1d(np.arange(len(doc)), first, assume_unique=True)
            for place, at, to in ((bucket[first], first, None), (doc[rest], rest, doc[first][of[rest]])):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bucket[at]), pa.array(doc[at]), pa.nulls(len(at), pa.int64()) if to is None else pa.array(to)], names)

        for batch in batches:
            if batch.num_rows:
                docs.append(batch.column(0).to_numpy())
                keys.append(band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1), bands, rows))
            if sum(map(len, docs)) >= CHUNK:
                yield from made()
        if docs:
            yield from made()

    def among_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = (None, None)  # of the bucket that the last batch ended in
        for batch in batches:
            bucket, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            b = batch.column(2)
            linked = np.asarray(b.is_valid())
            at = np.flatnonzero(~linked)
            parts = [(bucket[linked], b.filter(pa.array(linked)).to_numpy(), a[linked])]
            if len(at):
                first, of = star(bucket[at], a[at])
                lead = a[at][first]
                if leader[0] is not None and bucket[at[0]] == leader[0]:
                    lead = lead.copy()
                    lead[0] = leader[1]
                leader = (bucket[at[-1]], lead[-1])
                other = lead[of] != a[at]
                parts.append((bucket[at][other], lead[of][other], a[at][other]))
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["bucket", "a", "b"])

    dealt = held.select("doc_id", "registers").mapInArrow(local, "place long, bucket long, a long, b long").repartition("place").sortWithinPartitions("bucket")
    return dealt.select("bucket", "a", "b").mapInArrow(among_leaders, "bucket long, a long, b long").where("a <> b")


def likely(pairs: DataFrame, held: DataFrame, percent: int, m: int) -> DataFrame:
    """Of the pairs (a, b), those that registers and sizes don't rule out."""
    least = margin(percent, m)
    one = lambda x: held.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    met = pairs.join(one("a"), "a").join(one("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, m) for i in (4, 5))
                s = estimated(batch.column(2).to_numpy(), batch.column(3).to_numpy(), (ra > rb).sum(1), (ra < rb).sum(1), m)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(s >= least))

    return met.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(tested, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs, those whose full sets are similar enough."""
    texts = needed_texts(checkpointed(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()), docs)
    met = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("t_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t_b")), "b")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = shingles.of(x), shingles.of(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                kept.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return met.select("a", "b", "t_a", "t_b").mapInArrow(tested, "a long, b long")


def blocks(edges: DataFrame, labels: DataFrame, held: DataFrame) -> DataFrame:
    """The members of the buckets that hold several components, as (bucket, i, j, doc_id, label, asks, outside, n_shingles).

    Each is in its block i with every block j of outsiders; an outsider also asks, from its block j, every block i.
    Every sort and hash table of a task takes pages of 16 MB however few its rows are, so members and sizes are written
    between the joins, and each join is made once: a task has one of them at a time.
    """
    told = labels.select(F.col("node").alias("doc_id"), "label")
    few = told.count() <= BROADCAST_ROWS
    described = held.select("doc_id", "n_shingles").join(F.broadcast(told) if few else told, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    described = described if few else checkpointed(described)
    members = edges.select("bucket", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    members = checkpointed(members.join(described, "doc_id").select("bucket", "doc_id", "label", "n_shingles"))
    by_label = members.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("t"))
    sizes = by_label.groupBy("bucket").agg(F.max(F.struct("n", "label", "t")).alias("x"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.count("*").alias("labels"))
    parts = lambda n, t: F.greatest(F.ceil(n / BLOCK), F.ceil(t / BLOCK_SHINGLES)).cast("int")
    # A bucket of two is its star's one pair, which has been tested.
    sizes = sizes.where("labels > 1 and n > 2").select("bucket", F.col("x.label").alias("most"), parts(F.col("n"), F.col("t")).alias("own"), parts(F.col("n") - F.col("x.n"), F.col("t") - F.col("x.t")).alias("asking"))
    placed = join_spread(members, checkpointed(sizes), "bucket", ["doc_id"]).where("own is not null").withColumn("outside", F.col("label") != F.col("most"))
    one = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    meeting = lambda i, j, asks: F.struct(i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"))
    own = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda j: meeting(one("own", 1), j, False))
    asking = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: meeting(i, one("asking", 2), True))
    met = placed.withColumn("at", F.explode(F.when(F.col("outside"), F.concat(own, asking)).otherwise(own)))
    return met.select("bucket", "at.i", "at.j", "doc_id", "label", "at.asks", "outside", "n_shingles")


_TAKING_PART = "bucket long, i int, j int, doc_id long, label long, asks boolean, outside boolean"


def taking_part(placed: DataFrame, held: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """Of the rows of `blocks`, those whose document is in a likely pair across components that shares no earlier band."""
    m = bands * rows + MORE
    least = margin(percent, m)

    def searched(group: pd.DataFrame) -> pd.DataFrame:
        asks, outside = group["asks"].to_numpy(bool), group["outside"].to_numpy(bool)
        doc, of, n, bucket = group["doc_id"].to_numpy(), group["label"].to_numpy(), group["n_shingles"].to_numpy(), group["bucket"].iloc[0]
        registers = np.frombuffer(b"".join(group["registers"]), np.uint16).reshape(len(group), m)
        keys = band_keys(registers, bands, rows)
        own = np.flatnonzero(~asks)
        taken = np.zeros(len(group), bool)
        for i in np.flatnonzero(asks).tolist():
            # Two outsiders are met from the smaller one only.
            at = own[(of[own] != of[i]) & (np.minimum(n[own], n[i]) * 100 >= np.maximum(n[own], n[i]) * percent) & (~outside[own] | (doc[own] > doc[i]))]
            if len(at):
                at = at[keys[i][(keys[at] == keys[i]).argmax(1)] == bucket]
            if len(at):
                larger, smaller = (registers[i] > registers[at]).sum(1), (registers[i] < registers[at]).sum(1)
                at = at[estimated(np.full(len(at), n[i]), n[at], larger, smaller, m) >= least]
                taken[at] = True
                taken[i] |= len(at) > 0
        return group.loc[taken, [x.split()[0] for x in _TAKING_PART.split(", ")]]

    return placed.join(held.select("doc_id", "registers"), "doc_id").groupBy("bucket", "i", "j").applyInPandas(searched, _TAKING_PART)


class Joined:
    """Components by their least members; `join` says whether two were apart."""

    def __init__(self, labels: np.ndarray):
        self.parent = np.unique(labels, return_inverse=True)[1].tolist()
        self.up = list(range(max(self.parent, default=-1) + 1))

    def root(self, i: int) -> int:
        x = self.parent[i]
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        self.parent[i] = x
        return x

    def join(self, i: int, k: int) -> bool:
        x, y = self.root(i), self.root(k)
        self.up[max(x, y)] = min(x, y)
        return x != y


def exact_links(sets: list[np.ndarray], labels: np.ndarray, percent: int, meets: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets of different labels, as few as join all that are similar enough.

    Sets so similar share one of the rarest elements of each, as many as the smaller may lack and one more. Sets come by
    size; each asks an index of such elements of the smaller ones before it. With `meets` (asks, owns: a row of each) only
    pairs of one that asks and one that owns count.
    """
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    sets, size, labels = [sets[i] for i in order], size[order], labels[order]
    groups = Joined(labels)
    element, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(element), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(element))
    owner = np.repeat(np.arange(len(sets)), size)
    key = np.sort((owner << 32) | rank[place])  # by set, rarest first
    rank, at = key & 0xFFFFFFFF, np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
    held = at <= (size - (2 * percent * size + 99 + percent) // (100 + percent))[owner]
    asked = at <= (size - (percent * size + 99) // 100)[owner]
    by = np.argsort(rank[held], kind="stable")
    index_rank, index_set = rank[held][by], owner[held][by]
    low, high = np.searchsorted(index_rank, rank[asked], "left"), np.searchsorted(index_rank, rank[asked], "right")
    ends = np.cumsum(np.bincount(owner[asked], minlength=len(sets)))
    links = []
    for y, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
        found = [index_set[p:q] for p, q in zip(low[a:b].tolist(), high[a:b].tolist(), strict=True) if q > p]
        near = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        near = near[(near < y) & (size[near] * 100 >= size[y] * percent)]
        if meets is not None and len(near):
            asks, owns = meets[:, order[near]]
            near = near[(asks & meets[1, order[y]]) | (owns & meets[0, order[y]])]
        for x in near.tolist():
            if groups.root(x) != groups.root(y):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both and 100 * both >= percent * (size[x] + size[y] - both) and groups.join(x, y):
                    links.append((int(order[x]), int(order[y])))
    return links


def needed_texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and text (bytes) of the documents in `ids`, one row each."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    few = ids.count() <= 2_000_000  # 8 bytes each
    return written(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")


def confirmed_within(taking: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) across components among the documents of `taking` that meet in a pair of blocks."""
    taking = checkpointed(taking)
    texts = needed_texts(checkpointed(taking.select("doc_id").distinct()), docs)

    def tested(group: pd.DataFrame) -> pd.DataFrame:
        shingles = Shingles(words)
        asks = group.groupby("doc_id")["asks"]
        meets = np.array([asks.max().to_numpy(bool), ~asks.min().to_numpy(bool)])
        one = group.drop_duplicates("doc_id").sort_values("doc_id")
        doc = one["doc_id"].to_numpy()
        links = exact_links([shingles.of(x) for x in one["text"]], one["label"].to_numpy(), percent, meets)
        return pd.DataFrame([(min(doc[i], doc[k]), max(doc[i], doc[k])) for i, k in links], columns=["a", "b"], dtype=np.int64)

    return taking.join(texts, "doc_id").select("bucket", "i", "j", "doc_id", "label", "asks", "text").groupBy("bucket", "i", "j").applyInPandas(tested, "a long, b long")


def all_links(held: DataFrame, docs: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """Links (a, b) whose components are those of all links between the representatives `held`; they are stored."""
    m = bands * rows + MORE
    edges = written(stars(held, bands, rows), "stars")
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = checkpointed(confirmed(checkpointed(likely(pairs, held, percent, m)), docs, words, percent))
    placed = blocks(edges, checkpointed(components(links, stored=True)), held)
    return links.union(checkpointed(confirmed_within(taking_part(placed, held, percent, bands, rows), docs, words, percent)))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text)."""
    bands = bands_for(percent, rows)
    drawn = written(sketches(docs, words, bands, rows), "sketches")
    sets = drawn.where("doc_id is not null and n_shingles > 0")
    equal = checkpointed(sets.groupBy("n_shingles", "sig1", "sig2").agg(F.min("doc_id").alias("class"), F.count("*").alias("n")).where("n > 1").select(F.struct("n_shingles", "sig1", "sig2").alias("sig"), "class"))
    named = join_spread(sets.withColumn("sig", F.struct("n_shingles", "sig1", "sig2")), equal, "sig", ["doc_id"]).withColumn("class", F.coalesce("class", "doc_id"))
    # One row of a doc_id is taken here, once: every use of `held` would sort its registers for it, and might take another.
    held = written(named.where("class = doc_id").select("doc_id", "n_shingles", "registers").dropDuplicates(["doc_id"]), "classes")
    with intermediates(docs.sparkSession):
        links = all_links(held, docs, words, percent, bands, rows)
    labels = components(links, stored=True).select(F.col("node").alias("class"), "label")
    classes = named.select("doc_id", "class").where("class <> doc_id").distinct()
    member = classes.join(labels, "class", "left").select("doc_id", F.coalesce("label", "class").alias("component_id"))
    known = labels.select(F.col("class").alias("doc_id"), F.col("label").alias("component_id")).union(member)
    known = known.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    found = drawn.select("doc_id", "n_shingles").join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
