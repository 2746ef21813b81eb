"""Language-model scoring with a log-frequency Bloom filter of quantised bigram counts.

**Tokens.** Words (runs of bytes other than white space, A-Z in lower case) are known by 64-bit hashes, which are made for
whole batches of text at once: a word's bytes, each a random number, are a polynomial's coefficients, so all words' values
come from one running sum. A text ends in one end token; what comes before its first word is an end token as well.

**Counts.** One pass over the training texts counts words and bigrams within each task and deals them to parts by their
hashes, as blobs of bytes; a part's blobs are merged into exact counts. A common word comes at most once from each chunk of a
task, so it makes no large group. The commonest words, at most `HEAD`, are broadcast with their counts; all words' exact
counts stay a table, which rarer words of a text reach by a shuffled join (for the base score and n_known).

**Model.** A bigram model of all words: P(word | word before) is a Dirichlet mixture of bigram counts and unigram shares.
A bigram's count c is quantised to a level q, one of the two around it: a hash of the bigram draws which, so that the level
stands for c in the mean, and sums over bigrams come out right. Levels are a fifth apart. The filter holds (bigram, 1)
... (bigram, q), and the largest j up to which all are members gives the count back. It holds the words' own counts as
well, for those that aren't broadcast.

**Filter.** Its size follows from the counted levels, `LEVEL_BITS` bits each, so that it is a member by mistake in 0.1
percent of questions, at every input's size. It is built by parts and broadcast in slices of `SLICE_BITS` at most. A task
asks one slice after the other, so its memory is bounded and nothing is cut; the more slices there are, the more text (up to
`GATHERED` bytes) it gathers before it asks them.

Null text is empty (its end token alone). A null doc_id is trained on, and kept. Repeated rows are scored each. With
nothing to train on, every token is unseen. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import intermediates, shared_path, written

HEAD = 1 << 18
#: Parts of the filter at least; bytes of training text for each, where that makes more.
PARTS, PART_BYTES = 256, 1 << 22
#: Bits of the filter for each level that it holds, and probes: (1 - exp(-4 / 20)) ** 4 is 0.0011. Bits that are broadcast at once.
LEVEL_BITS, PROBES, SLICE_BITS = 20, 4, 1 << 28
#: Weight of the unigrams, and what is added to unigram counts.
PRIOR, ADDED = 300.0, 0.1
#: What the levels stand for: whole numbers, each the next or a fifth more than the one before.
QUANTUM = 1.2
LEVELS = np.unique(np.concatenate([[0.0], np.ceil(QUANTUM ** np.arange(220) - 1e-9)]))
#: Tokens that a task counts before it passes them on.
FLUSH = 1 << 21
#: Steps of the histogram by which the least count of the broadcast words is found, to a factor of e.
STEPS = 64
#: Bytes of text that a task scores at once: with one slice, for each further slice, and at most.
SCORED, GATHERED = 1 << 22, 1 << 24
#: Bytes of text that are hashed in one sum.
SPAN = 1 << 20

# The end token can't be a word, as it has white space in it.
END_WORD = b" "
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C17


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes:
    """Hashes of the words of texts: sums of random numbers, one for each byte, times powers of an odd base, modulo 2**64."""

    def __init__(self, span: int = SPAN):
        self.span = span
        self.byte = _mixed(np.arange(1, 257).astype(_U) * _U(0xD1B54A32D192ED03)) | _U(1)
        self.byte[_SPACE] = 0
        self.power, self.inverse = (self._powers(x) for x in (_BASE, pow(_BASE, -1, 1 << 64)))

    def _powers(self, base: int) -> np.ndarray:
        out, k = np.ones(self.span, _U), 1
        while k < self.span:
            n = min(k, self.span - k)
            out[k : k + n] = out[:n] * _U(pow(base, k, 1 << 64))
            k += n
        return out

    def _spans(self, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool, bool]]:
        """Sums, starts and lengths of the words' parts in each span of the data; whether its first and last byte are in words."""
        for at in range(0, len(data), self.span):
            b = np.frombuffer(data, np.uint8, min(self.span, len(data) - at), at)
            inside = ~_SPACE[b]
            edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
            edges = np.concatenate([[0] if inside[0] else [], edges, [len(b)] if inside[-1] else []]).astype(np.int64)
            start, end = edges[::2], edges[1::2]
            sums = self.byte[b]
            sums *= self.power[: len(b)]
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(sums, dtype=_U)])
            yield (sums[end] - sums[start]) * self.inverse[start], start + at, end - start, bool(inside[0]), bool(inside[-1])

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes, one text after the other, and how many words each text has."""
        data = b"\n".join(x or b"" for x in texts).lower()
        hashes, starts = [np.empty(0, _U)], [np.empty(0, np.int64)]
        length, opened = 0, False  # bytes of the last word so far; whether it may go on
        for h, start, size, first, last in self._spans(data):
            if opened and first:  # what lies in this span is added behind what lay before
                hashes[-1][-1:] += h[:1] * _U(pow(_BASE, length, 1 << 64))
                length, h, start, size = (length + int(size[0]) if len(h) == 1 else 0), h[1:], start[1:], size[1:]
            if len(h):
                hashes.append(h)
                starts.append(start)
                length = int(size[-1])
            opened = last
        ends = np.cumsum([len(x or b"") + 1 for x in texts])
        before = np.searchsorted(np.concatenate(starts), np.concatenate([[0], ends]).astype(np.int64))
        return _mixed(np.concatenate(hashes)), np.diff(before)

    def tokens(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' hashes, an end token after each text, and how many tokens each text has."""
        words, n = self.of(texts)
        out = np.full(len(words) + len(texts), word_hash(END_WORD), _U)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(n + 1) - 1] = False
        out[keep] = words
        return out, n + 1


def word_hash(word: bytes) -> np.uint64:
    """The hash of one word, or of the end token."""
    if word == END_WORD:
        return _U(0x5D1E1E4B5D1E1E4B)
    return WordHashes(max(1, len(word))).of([word])[0][0]


def held_out(modulus: int = 10, remainder: int = 0) -> Column:
    """Whether a row is kept out of training; a null doc_id never is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: Bytes of an event's name. Two events meet by chance far more rarely than the filter errs.
EVENT_BYTES = 6


def pair_events(tokens: np.ndarray) -> np.ndarray:
    """Names of the bigrams that end in each of the tokens; before the first there is an end token."""
    before = np.concatenate([np.array([word_hash(END_WORD)], _U), tokens[:-1]])
    return _mixed(_mixed(before + _U(0x9E3779B97F4A7C15)) * _U(3) + tokens) >> _U(64 - 8 * EVENT_BYTES)


def word_events(hashes: np.ndarray) -> np.ndarray:
    """Names of words among the bigrams."""
    return _mixed(hashes ^ _U(0xD1B54A32D192ED03)) >> _U(64 - 8 * EVENT_BYTES)


def part_of(events: np.ndarray, parts: int) -> np.ndarray:
    """The part of the filter, by an event's highest bits: sorted events are sorted by part. `parts` is a power of two."""
    return (events >> _U(8 * EVENT_BYTES - parts.bit_length() + 1)).astype(np.int64)


class LogFrequencyFilter:
    """Bits of `n` parts from `first` on, of `parts` in all; all that is asked of an event lies in one part."""

    def __init__(self, bits: np.ndarray, parts: int = PARTS, first: int = 0, n: int | None = None):
        self.bits, self.parts, self.first = bits, parts, first
        self.part_bits = len(bits) * 8 // (n or parts)

    @staticmethod
    def middle(q: np.ndarray) -> np.ndarray:
        """The counts that levels stand for; 0 for 0."""
        return LEVELS[q]

    @staticmethod
    def quantised(counts: np.ndarray, events: np.ndarray) -> np.ndarray:
        """A level for each count from 1: of the two around it, drawn by the event's hash so that it is the count in the mean."""
        q = np.searchsorted(LEVELS, counts, side="right") - 1
        low, high = LEVELS[q], LEVELS[np.minimum(q + 1, len(LEVELS) - 1)]
        chance = np.where(high > low, (counts - low) / np.maximum(high - low, 1e-9), 0.0)
        return q + ((_mixed(events + _U(0x2545F4914F6CDD1D)) >> _U(11)).astype(np.float64) * 2.0**-53 < chance)

    @staticmethod
    def places(events: np.ndarray, level: int, probe: int, part_bits: int) -> np.ndarray:
        salted = events * _U(0x9E3779B97F4A7C15) + _U((level * PROBES + probe + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        return _mixed(salted) % _U(part_bits)

    @classmethod
    def build_part(cls, events: np.ndarray, q: np.ndarray, part_bits: int) -> np.ndarray:
        flags = np.zeros(part_bits, np.uint8)
        for level in range(1, int(q.max(initial=0)) + 1):
            events, q = events[q >= level], q[q >= level]
            for probe in range(PROBES):
                flags[cls.places(events, level, probe, part_bits)] = 1
        return np.packbits(flags)

    def levels(self, events: np.ndarray) -> np.ndarray:
        """The largest level up to which all are members: repeated probes, of those still in."""
        q = np.zeros(len(events), np.int64)
        at, start = np.arange(len(events)), (part_of(events, self.parts) - self.first).astype(_U) * _U(self.part_bits)
        level = 0
        while len(at):
            level += 1
            for probe in range(PROBES):
                place = start + self.places(events, level, probe, self.part_bits)
                inside = (self.bits[place >> _U(3)] >> (_U(7) - (place & _U(7))).astype(np.uint8) & 1).astype(bool)
                at, start, events = at[inside], start[inside], events[inside]
            q[at] = level
        return q


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Whole numbers in so many bytes each, a row for each."""
    return np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def unpacked(data: list[bytes], width: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(data), np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.reshape(-1).view("<u8")


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys in one, in order, with the sums of their counts (1 each, if none are given)."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts, at)


#: `words`: whether the keys are 8-byte hashes of words, else 6-byte names of bigrams. Counts have one byte; larger ones repeat their key.
BLOBS = "part long, words boolean, keys binary, counts binary"


def dealt(keys: np.ndarray, counts: np.ndarray, words: bool, parts: int) -> pa.RecordBatch:
    """A row for each part of the filter, its keys in bytes: rows of a table would cost more than what they hold."""
    if len(keys) and counts.max() > 255:
        times = -(-counts // 255)
        last = np.cumsum(times) - 1
        keys, rest = np.repeat(keys, times), counts - 255 * (times - 1)
        counts = np.full(len(keys), 255)
        counts[last] = rest
    part = part_of(word_events(keys) if words else keys, parts)
    if words:
        order = np.argsort(part, kind="stable")
        keys, counts, part = keys[order], counts[order], part[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
    ends = [*at[1:].tolist(), len(keys)]
    columns = [[rows[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=False)] for rows in (packed(keys, 8 if words else EVENT_BYTES), packed(counts, 1))]
    return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array([words] * len(at), pa.bool_()), *(pa.array(x, pa.binary()) for x in columns)], ["part", "words", "keys", "counts"])


def counted(train: DataFrame, parts: int) -> DataFrame:
    """`BLOBS` of the words and bigrams of `train` (text: bytes), summed within chunks of `FLUSH` tokens."""

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate(held)
            held.clear()
            yield dealt(*summed(pair_events(tokens)), False, parts)
            yield dealt(*summed(tokens), True, parts)

        for table in gathered(batches, SCORED):
            held.append(hashes.tokens(table.column(0).to_pylist())[0])
            size += len(held[-1])
            if size >= FLUSH:
                yield from out()
                size = 0
        if held:
            yield from out()

    return train.select("text").mapInArrow(counting, BLOBS)


MERGED = "part long, words binary, word_counts binary, events binary, q binary, total long, n_words long, levels long"


def merged(blobs: DataFrame) -> DataFrame:
    """A row for each part: its words' hashes and counts, its events (words' own among them) and their levels, and sums of these."""

    def merging(table: pa.Table) -> pa.Table:
        own = np.array(table.column("words").to_pylist(), bool)
        keys, counts = (table.column(c).to_pylist() for c in ("keys", "counts"))
        pick = lambda x, which: [v for v, w in zip(x, own.tolist(), strict=True) if w == which]
        words, n = summed(unpacked(pick(keys, True), 8), unpacked(pick(counts, True), 1).astype(np.int64))
        events, c = summed(unpacked(pick(keys, False), EVENT_BYTES), unpacked(pick(counts, False), 1).astype(np.int64))
        events, c = np.concatenate([events, word_events(words)]), np.concatenate([c, n])
        q = LogFrequencyFilter.quantised(c, events)
        row = [int(table.column("part")[0].as_py()), words.tobytes(), n.tobytes(), packed(events, EVENT_BYTES).tobytes(), q.astype(np.uint8).tobytes(), int(n.sum()), len(words), int(q.sum())]
        kinds = [pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 3]
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in MERGED.split(", ")])

    return blobs.groupBy("part").applyInArrow(merging, MERGED)


def words_of(parts: DataFrame) -> DataFrame:
    """h (the word's hash) and c of all words and the end token."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["h", "c"])

    return parts.select("words", "word_counts").mapInArrow(listed, "h long, c long")


def head_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the words over a least count that leaves at most `most` of them; it is found from a histogram of logarithms."""
    step = F.floor(F.log(F.col("c").cast("double")) * STEPS)
    histogram = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for at, n in histogram:
        if total + n > most:
            break
        total, least = total + n, at
    if least is None:
        return np.empty(0, _U), np.empty(0, np.int64)
    rows = counts.where(step >= least).select("h", "c").toArrow()
    hashes, c = rows["h"].to_numpy().view(_U), rows["c"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], c[order]


class Model:
    """What scoring needs but for the filter's slices: the broadcast words' exact counts and the totals."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, prior: float = PRIOR):
        self.hashes, self.counts, self.prior = hashes, counts.astype(np.float64), prior
        self.mass = total + ADDED * (distinct + 1)

    def exact(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of broadcast words; -1 for the rest."""
        if not len(self.hashes):
            return np.full(len(tokens), -1.0)
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, self.counts[at], -1.0)

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / self.mass)

    def log_pairs(self, pair: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 P(word | word before) from the counts of the pair, of the word before and of the word."""
        held = np.minimum(pair, before)  # a pair isn't commoner than its first word
        return np.log10((held + self.prior * np.minimum((own + ADDED) / self.mass, 1.0)) / (before + self.prior))


def filter_of(counts: DataFrame, parts: int, bits: int) -> tuple[DataFrame, int, int]:
    """The bits of each part, the number of parts, and how many bits each has."""
    part_bits = max(1024, -(-bits // (parts * 8)) * 8)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, e, q in zip(*(batch.column(i) for i in range(3)), strict=True):
                held = LogFrequencyFilter.build_part(unpacked([e.as_py()], EVENT_BYTES), np.frombuffer(q.as_py(), np.uint8), part_bits)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["part", "bits"])

    return written(counts.select("part", "events", "q").mapInArrow(built, "part long, bits binary"), "filter"), parts, part_bits


#: First part, number of parts, parts of the whole filter, and the broadcast bits of a slice.
Slice = tuple[int, int, int, object]


def slices_of(spark, built: DataFrame, parts: int, part_bits: int, slice_bits: int) -> list[Slice]:
    """The driver holds one at a time."""
    each = max(1, min(parts, slice_bits // part_bits))
    out = []
    for first in range(0, parts, each):
        n = min(each, parts - first)
        bits = np.zeros(n * part_bits // 8, np.uint8)
        for r in built.where(F.col("part").between(first, first + n - 1)).toLocalIterator():
            at = (r["part"] - first) * part_bits // 8
            bits[at : at + part_bits // 8] = np.frombuffer(r["bits"], np.uint8)
        out.append((first, n, parts, spark.sparkContext.broadcast(bits)))
    return out


def levels_in(slices: list[Slice], events: np.ndarray) -> np.ndarray:
    """The levels of events, by asking each slice for its own."""
    q = np.zeros(len(events), np.uint8)
    of = np.searchsorted(np.array([first for first, *_ in slices]), part_of(events, slices[0][2]), side="right") - 1
    ends = np.cumsum(np.bincount(of, minlength=len(slices)))
    order = np.argsort(of.astype(np.uint16 if len(slices) <= 1 << 16 else np.int64), kind="stable").astype(np.uint32)
    for (first, n, parts, bits), a, b in zip(slices, np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        if b > a:
            q[order[a:b]] = LogFrequencyFilter(bits.value, parts, first, n).levels(events[order[a:b]])
            if len(slices) > 1:
                bits.__dict__.pop("_value", None)  # read again from the executor's disk when it is needed
    return q


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches together, up to about so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if held and sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


_TAIL = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))


def tails(text: np.ndarray, tokens: np.ndarray, n: int) -> pa.Array:
    """For each of n texts the distinct tokens and how often they occur in it, from each token's text."""
    order = np.lexsort((tokens, text))
    text, tokens = text[order], tokens[order]
    at = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (tokens[1:] != tokens[:-1])])) if len(text) else text
    times = np.diff(np.append(at, len(text)))
    offsets = np.searchsorted(text[at], np.arange(n + 1)).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(times.astype(np.int64))], ["h", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets), rows).cast(_TAIL)


def score(docs: DataFrame, head_size: int = HEAD, bits: int | None = None, prior: float = PRIOR, slice_bits: int = SLICE_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs` (doc_id, text).

    `bits` fixes the filter's size, which else follows from what it holds.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held_out().alias("held_out"))
    train = narrow.where("not held_out")
    size = train.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    parts = max(PARTS, 1 << (size // PART_BYTES).bit_length())
    path = shared_path(spark, "words")
    with intermediates(spark):
        counts = written(merged(counted(train, parts)), "counts")
        total, distinct, levels = (int(x or 0) for x in counts.agg(F.sum("total"), F.sum("n_words"), F.sum("levels")).first())
        vocabulary = written(words_of(counts), "words", path)
        slices = slices_of(spark, *filter_of(counts, parts, levels * LEVEL_BITS if bits is None else bits), slice_bits)
    model = spark.sparkContext.broadcast(cloudpickle.dumps(Model(*head_words(vocabulary, head_size), total, distinct, prior)))  # by value, as executors may lack this package
    at_once = min(GATHERED, SCORED * len(slices))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = pickle.loads(model.value), WordHashes()
        for table in gathered(batches, at_once):
            # In short runs of texts, but the filter is asked for all of them together.
            runs, asked = [], []
            for part in gathered(iter(table.to_batches(64)), SCORED // 4):
                tokens, n = hashes.tokens(part.column(2).to_pylist())
                own, starts = m.exact(tokens), np.cumsum(n) - n
                rare = np.flatnonzero(own < 0)
                base = np.add.reduceat(np.where(own >= 0, m.log_base(np.maximum(own, 0)), 0.0), starts)
                known = np.add.reduceat((own >= 0).astype(np.int64), starts)
                tail = tails(np.searchsorted(starts, rare, side="right") - 1, tokens[rare], len(n))
                runs.append((part.select([0, 1, 3]), own, n, starts, rare, [pa.array(n), pa.array(known), pa.array(base)], tail))
                asked += [pair_events(tokens), word_events(tokens[rare])]
            q = levels_in(slices, np.concatenate(asked))
            ends = np.cumsum([len(x) for x in asked]).tolist()
            asked.clear()
            for k, (part, own, n, starts, rare, columns, tail) in enumerate(runs):
                own[rare] = LEVELS[q[ends[2 * k] : ends[2 * k + 1]]]
                before = np.append(own[n[0] - 1], own[:-1])  # before the first text there is an end token too
                pairs = np.add.reduceat(m.log_pairs(LEVELS[q[ends[2 * k] - len(own) : ends[2 * k]]], before, own), starts)
                columns = [*part.columns, *columns, pa.array(pairs), tail]
                yield from pa.Table.from_arrays(columns, ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "pairs", "tail"]).combine_chunks().to_batches()

    numbered = narrow.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", "held_out")
    local = written(numbered.mapInArrow(scored, "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, pairs double, tail array<struct<h:long,n:long>>"), "scores")
    rare = local.select("uid", F.explode("tail").alias("t")).select("uid", F.col("t.h").alias("h"), F.col("t.n").alias("n")).join(vocabulary, "h", "left")
    log_base = F.log10((F.coalesce("c", F.lit(0)) + ADDED) / F.lit(total + ADDED * (distinct + 1)))
    of_rare = rare.groupBy("uid").agg(F.sum(F.col("n") * log_base).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    joined = local.drop("tail").join(of_rare, "uid", "left")
    rare_score = F.coalesce("rare", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_score).alias("base_score"), F.col("pairs").alias("score"),
    )
