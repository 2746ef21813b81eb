"""Best-fit packing with swap-based local search.

Texts become token ids (by pre-token, as in `tokens`), are cut into pieces of at most `capacity`, and the pieces are
dealt at random into blocks of about `block_pieces`, whatever their number: a block is the unit of work, so its memory
is bounded and a larger corpus only has more blocks. Each block is seeded best-fit decreasing and then improved:
documents of the emptiest bin are moved, exchanged one for one or two for one with those of fuller underfull bins, by
the change that raises the sum of squared fills most, until bins empty. The search has no bound on steps: it ends when
the lower bound of bins is met or when no bin has a change left. Dealing pieces to blocks costs at most a bin or so each.

Only piece lengths reach the packer, never ids or texts. Null text is an empty document (its closing id alone);
repeated rows are packed each; an empty table packs to an empty one; equal lengths are taken in the order of doc_id.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import checkpointed, slices
from sieveline.llm.tokens import CACHE, PreTokens

CAPACITY = 4096
#: Id that closes every document.
END_ID = 1
BLOCK_PIECES = 65_536

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class PieceIds(PreTokens):
    """Token ids of whole texts, as little-endian unsigned 32-bit integers, put together from those of pre-tokens."""

    def __init__(self, path: str, cache: int = CACHE):
        super().__init__(path)
        self.cache, self.known = cache, {}

    def encoded(self, text: str) -> bytes:
        pre_tokens = self.split(text)
        if missing := [x for x in set(pre_tokens) if x not in self.known]:
            if len(self.known) + len(missing) > self.cache:
                self.known.clear()
                missing = list(set(pre_tokens))
            self.known.update((x, struct.pack(f"<{len(ids)}I", *ids)) for x, ids in self.ids(missing))
        return b"".join(map(self.known.__getitem__, pre_tokens))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, names = PieceIds(tokenizer), np.array([end_id], "<u4").tobytes(), ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(coder.encoded(text) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


class Bins:
    """Bins of one block: `of[i]` is the bin of item i, `fill[b]` what bin b holds."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.of = np.full(len(sizes), -1, np.int64)
        self.fill: list[int] = []

    def seed(self) -> None:
        """Best fit, longest first. `open_` has a bit for every amount of free space that some bin has."""
        open_, by_space = 0, [[] for _ in range(self.capacity + 1)]
        for i in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[i])
            fits = open_ >> size
            if fits:
                space = size + (fits & -fits).bit_length() - 1
                b = by_space[space].pop()
                if not by_space[space]:
                    open_ ^= 1 << space
            else:
                b, space = len(self.fill), self.capacity
                self.fill.append(0)
            self.of[i] = b
            self.fill[b] += size
            left = space - size
            if left:
                if not by_space[left]:
                    open_ |= 1 << left
                by_space[left].append(b)

    def improve(self) -> int:
        """Rounds of local search until one changes nothing or the lower bound of bins is met; returns the changes made.

        Every change raises the sum of squared fills, a whole number with a bound, so the rounds end.
        """
        least = -(-int(self.sizes.sum()) // self.capacity)
        made = 0
        while sum(f > 0 for f in self.fill) > least and (changes := Round(self).run(least)):
            made += changes
        return made


class Round:
    """One round: each underfull bin, emptiest first, gives to the fuller ones until it is empty or nothing helps.

    Items of one size are alike, so the search is over sizes: those of a bin (distinct ones sum to at most the capacity,
    so they and their pairs are few) against those of all others. Of the bins that hold an item of some size, the one
    with most space gains most by an exchange for it; a heap for each size names it. Bins that gave, and stuck ones once a
    fuller one has its turn, are out of the round.
    """

    def __init__(self, bins: Bins):
        self.bins, self.capacity = bins, bins.capacity
        self.fill = bins.fill
        self.items: dict[int, dict[int, list[int]]] = {}
        for i, (b, size) in enumerate(zip(bins.of.tolist(), bins.sizes.tolist(), strict=True)):
            if self.fill[b] < self.capacity:
                self.items.setdefault(b, {}).setdefault(size, []).append(i)
        self.values = np.array(sorted({size for held in self.items.values() for size in held}), np.int64)
        self.at = {size: k for k, size in enumerate(self.values.tolist())}
        #: By size, the most space of a bin that holds it (-1: none does), and the heap that tells which.
        self.space = np.full(len(self.values), -1, np.int64)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in self.values]
        self.open_ = 0
        self.by_space: dict[int, dict[int, None]] = {}
        self.taking: set[int] = set()
        for b in self.items:
            self._enter(b)

    def run(self, least: int) -> int:
        made, alive = 0, sum(f > 0 for f in self.fill)
        waiting = [(self.fill[b], b) for b in self.items]
        heapq.heapify(waiting)
        stuck: set[int] = set()
        level = 0
        while waiting and alive > least:
            fill, b = heapq.heappop(waiting)
            if b not in self.taking or fill != self.fill[b]:  # full by now, or listed again with what it gained
                continue
            if fill > level:  # those that gained meanwhile wait for their turn
                for other in sorted(x for x in stuck & self.taking if self.fill[x] < fill):
                    self._leave(other)
                stuck, level = set(), fill
            self._leave(b)
            while self.fill[b] and (to := self._give(b)) is not None:
                made += 1
                if to in self.taking:
                    heapq.heappush(waiting, (self.fill[to], to))
            alive -= not self.fill[b]
            if self.fill[b] == fill:  # others as full may still give to it
                self._enter(b)
                stuck.add(b)
        return made

    def _give(self, b: int) -> int | None:
        """Makes the best change out of bin b, a move before an exchange; returns the bin that gained."""
        held = self.items[b]
        own = sorted(held)
        for size in reversed(own):  # to the tightest bin
            if fits := self.open_ >> size:
                to = next(iter(self.by_space[size + (fits & -fits).bit_length() - 1]))
                self._exchange(b, to, [size], [])
                return to
        sums = {size: (size,) for size in own}
        for k, one in enumerate(own):
            for two in own[k if len(held[one]) > 1 else k + 1 :]:
                sums.setdefault(one + two, (one, two))
        by = np.array(sorted(sums), np.int64)
        place = np.searchsorted(by, self.values + self.space, side="right") - 1  # the most that the bin can take for this item
        gain = np.where((self.space >= 0) & (place >= 0), by[np.maximum(place, 0)] - self.values, 0)
        k = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[k] <= 0:
            return None
        to = self.heaps[k][0][1]
        self._exchange(b, to, list(sums[int(by[place[k]])]), [int(self.values[k])])
        return to

    def _exchange(self, b: int, to: int, out: list[int], back: list[int]) -> None:
        self._leave(to)
        for giver, taker, sizes in ((b, to, out), (to, b, back)):
            for size in sizes:
                i = self.items[giver][size].pop()
                if not self.items[giver][size]:
                    del self.items[giver][size]
                self.items[taker].setdefault(size, []).append(i)
                self.bins.of[i] = taker
                self.fill[giver] -= size
                self.fill[taker] += size
        if self.fill[to] < self.capacity:
            self._enter(to)

    def _enter(self, b: int) -> None:
        space = self.capacity - self.fill[b]
        self.taking.add(b)
        self.open_ |= 1 << space
        self.by_space.setdefault(space, {})[b] = None
        for size in self.items[b]:
            k = self.at[size]
            heapq.heappush(self.heaps[k], (-space, b))
            self.space[k] = max(self.space[k], space)

    def _leave(self, b: int) -> None:
        space = self.capacity - self.fill[b]
        self.taking.discard(b)
        del self.by_space[space][b]
        if not self.by_space[space]:
            self.open_ ^= 1 << space
        for size in self.items[b]:
            heap = self.heaps[k := self.at[size]]
            while heap and not self._holds(heap[0], size):
                heapq.heappop(heap)
            self.space[k] = -heap[0][0] if heap else -1

    def _holds(self, entry: tuple[int, int], size: int) -> bool:
        """Whether a heap's entry is still so."""
        space, b = entry
        return b in self.taking and self.capacity - self.fill[b] == -space and size in self.items[b]


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of every item, numbered from 0 without gaps."""
    bins = Bins(np.asarray(sizes, np.int64), capacity)
    bins.seed()
    bins.improve()
    return np.unique(bins.of, return_inverse=True)[1]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Packs every row of `docs` (doc_id, text); returns a row per piece with its sequence and its offset there.

    A row with a null doc_id is packed under null. Columns other than doc_id and text are ignored.
    """
    cut = checkpointed(pieces(docs, tokenizer, capacity, end_id))
    blocks = max(1, math.ceil(cut.count() / block_pieces))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))

    def packed(block: pa.Table) -> pa.Table:
        keys = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        block = block.take(pc.sort_indices(block, sort_keys=keys))
        length = block["length"].to_numpy()
        at = pack_block(length, capacity)
        order = np.argsort(at, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.r_[True, np.diff(at[order]) != 0] if len(at) else np.array([], bool)
        offset = np.empty(len(at), np.int64)
        offset[order] = before - before[first][at[order]]
        number = (block["block"][0].as_py() << 32) if len(at) else 0
        return block.drop_columns(["block"]).append_column("sequence_id", pa.array(number + at.astype(np.int64))).append_column("offset", pa.array(offset))

    return dealt.groupBy("block").applyInArrow(packed, PACKED)
