"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads windows of `WINDOW` bytes in both directions and labels every position; a document's probabilities
are the mean of its positions' over the bytes of letters (ASCII letters and all bytes of other characters), of the
whole text. It is trained by backpropagation through time, on the driver, on a sample of stated size: at most
`SAMPLE_DOCS` documents of each language, a passage of `PASSAGE` characters of each.
Prediction is a map over Arrow batches with the weights (a few kilobytes) in the closure: no shuffle.

`thresholds` gives a least score for each language from held-out labelled documents, which tells text in no learned language
from text in one.

Null texts and texts without a letter are `und` with score 0; so is everything where nothing could be learned. Null
languages are never learned from; repeated rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.llm.common import join_spread, slices, written

UNKNOWN = "und"
WINDOW = 96
HIDDEN = 8
#: The training sample: documents of each language, and characters of each document.
SAMPLE_DOCS, PASSAGE = 300, 600
#: Of a language's held-out documents that are predicted rightly, the share whose scores its threshold may reach; how far it
#: lies from a blind guess (0) to the least of the others' scores (1); and the documents that are needed to say so.
LOW, REACH, ENOUGH = 0.005, 0.9, 100
STEPS, BATCH, RATE, SEED = 320, 128, 0.02, 11
#: Windows that the network reads at once.
STRIDE = 2048


def _letters() -> np.ndarray:
    byte = np.arange(256)
    return ((byte >= 128) | ((byte | 32) >= 97) & ((byte | 32) <= 122)).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights: `e` (2, 256, 3h) gates' inputs by byte, `u` (2, h, 3h) recurrence, `w` (2h, k), `b` (k). Gates: update, reset, candidate."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        self.e = rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (2, hidden, 3 * hidden)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        self.b = np.zeros(len(languages), np.float32)

    def states(self, windows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, 2, batch, h), both directions in order of position, and, if kept, what training needs of each step."""
        n, t = windows.shape
        h = self.h
        out, kept, state = np.empty((t, 2, n, h), np.float32), [], np.zeros((2, n, h), np.float32)
        for k in range(t):
            x = np.stack([self.e[0][windows[:, k]], self.e[1][windows[:, t - 1 - k]]])
            g = state @ self.u
            zr = _sigmoid(x[..., : 2 * h] + g[..., : 2 * h])
            z, r, gn = zr[..., :h], zr[..., h:], g[..., 2 * h :]
            c = np.tanh(x[..., 2 * h :] + r * gn)
            if keep:
                kept.append((state, z, r, gn, c))
            state = c + z * (state - c)
            out[k, 0], out[t - 1 - k, 1] = state[0], state[1]
        return out, kept

    def step(self, windows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over positions, and its gradients for e, u, w and b."""
        out, kept = self.states(windows, keep=True)
        t, _, n, h = out.shape
        both = np.concatenate([out[:, 0], out[:, 1]], 2)
        logit = both @ self.w + self.b
        p = np.exp(logit - logit.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        share = (weight.T / max(weight.sum(), 1.0)).astype(np.float32)
        loss = -float((np.log(np.maximum(p[:, np.arange(n), label], 1e-9)) * share).sum())
        d = p * share[..., None]
        d[:, np.arange(n), label] -= share
        dw, db, dboth = np.einsum("tnh,tnk->hk", both, d), d.sum((0, 1)), d @ self.w.T
        de, du, dstate = np.zeros_like(self.e), np.zeros_like(self.u), np.zeros((2, n, h), np.float32)
        for k in range(t - 1, -1, -1):
            dstate[0] += dboth[k, :, :h]
            dstate[1] += dboth[t - 1 - k, :, h:]
            before, z, r, gn, c = kept[k]
            dc = dstate * (1 - z) * (1 - c * c)
            dz = dstate * (before - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dc * r], 2)
            du += before.transpose(0, 2, 1) @ dg
            dx = np.concatenate([dz, dr, dc], 2)
            np.add.at(de[0], windows[:, k], dx[0])
            np.add.at(de[1], windows[:, t - 1 - k], dx[1])
            dstate = dstate * z + dg @ self.u.transpose(0, 2, 1)
        return loss, [de, du, dw, db]

    def fit(self, windows: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam; returns the losses."""
        rng, letter, losses = np.random.default_rng(seed), _letters(), []
        weights = [self.e, self.u, self.w, self.b]
        first, second = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
        by_label = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        for i in range(1, steps + 1):
            at = np.concatenate([rng.choice(x, max(1, batch // len(by_label))) for x in by_label if len(x)])
            loss, grads = self.step(windows[at], label[at], letter[windows[at]])
            losses.append(loss)
            now = rate * (1 - 0.9 * i / steps)
            for x, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= now * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-6)
        return losses

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per window the sum of its letters' probabilities (n, k), and the number of letters."""
        letter = _letters()
        sums, counts = np.empty((len(windows), len(self.languages)), np.float64), np.empty(len(windows), np.float64)
        for a in range(0, len(windows), STRIDE):
            part = windows[a : a + STRIDE]
            out, _ = self.states(part)
            weight = letter[part].T
            logit = out[:, 0] @ self.w[: self.h] + out[:, 1] @ self.w[self.h :] + self.b
            logit -= logit.max(2, keepdims=True)
            p = np.exp(logit, out=logit)
            p *= (weight / p.sum(2))[..., None]
            sums[a : a + STRIDE], counts[a : a + STRIDE] = p.sum(0), weight.sum(0)
        return sums, counts

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, k); a text without letters gets zeros."""
        sizes = np.array([len(x) for x in texts])
        windows = -(-sizes // WINDOW)
        ends = np.cumsum(windows)
        flat = np.zeros(int(ends[-1]) * WINDOW if len(ends) else 0, np.uint8)
        for text, end, n in zip(texts, ends.tolist(), windows.tolist(), strict=True):
            at = (end - n) * WINDOW
            flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
        sums, counts = self.pooled(flat.reshape(-1, WINDOW))
        total, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        owner = np.repeat(np.arange(len(texts)), windows)
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(owner, sums[:, k], len(texts))
        seen[:] = np.bincount(owner, counts, len(texts))
        return total / np.maximum(seen, 1)[:, None]


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a row is kept out of training; a null doc_id never is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(docs: DataFrame, seed: int = SEED) -> Network | None:
    """A network fitted to the sample of rows of `docs` (doc_id, text, lang) that aren't held out; None without any."""
    usable = docs.where("lang is not null and text is not null and text rlike '\\\\p{L}'").where(~held_out())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    key = F.xxhash64("doc_id", "text", F.lit(seed))
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(min(1.0, 4 * SAMPLE_DOCS / n))).otherwise(chance)
    drawn = usable.select("lang", "text", key.alias("key")).where(F.pmod("key", F.lit(1 << 30)) < chance * (1 << 30))
    # The passage starts anywhere in the text, so that all of a text is seen in training, not beginnings.
    start = F.pmod(F.shiftright("key", 30), F.greatest(F.length("text") - PASSAGE, F.lit(1))).cast("int") + 1
    first = Window.partitionBy("lang").orderBy("key")
    rows = drawn.select("lang", "key", F.substring("text", start, F.lit(PASSAGE)).alias("passage")).withColumn("at", F.row_number().over(first)).where(F.col("at") <= SAMPLE_DOCS).orderBy("lang", "at").collect()
    languages = sorted(counts)
    windows, label = [], []
    for r in rows:
        data = r["passage"].encode()
        for a in range(0, len(data), WINDOW):
            windows.append(data[a : a + WINDOW].ljust(WINDOW, b"\0"))
            label.append(languages.index(r["lang"]))
    if not windows:
        return None
    network = Network(languages, seed=seed)
    network.fit(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), np.array(label), seed=seed)
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs` (doc_id, text)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.when(F.col("text").rlike("\\p{L}"), F.encode("text", "UTF-8")).alias("data"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = batch.column(2).to_pylist()
            lang, score = [UNKNOWN] * len(data), [0.0] * len(data)
            at = [i for i, x in enumerate(data) if x is not None]
            if network is not None and at:
                p = network.document_probabilities([data[i] for i in at])
                for i, k, s in zip(at, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    lang[i], score[i] = network.languages[k], min(1.0, s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return narrow.mapInArrow(labelled, "doc_id long, held_out boolean, lang_pred string, score double")


def thresholds(found: DataFrame, docs: DataFrame) -> DataFrame:
    """lang_pred and `least`, a row per language: the score under which a prediction is doubted.

    From the rows of `found` (as of `identify`) that are held out and agree with the lang of `docs` (doc_id, lang): a low
    quantile of their scores, drawn a little towards that of a blind guess. A language with too few has no row.
    """
    known = docs.where("lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang_pred")).distinct()
    right = found.where("held_out").join(known, ["doc_id", "lang_pred"])
    guess = 1.0 / max(1, known.select("lang_pred").distinct().count())
    low = F.percentile_approx("score", F.lit(LOW), F.lit(10_000))
    return right.groupBy("lang_pred").agg(F.least(low, guess + REACH * (low - guess)).alias("least"), F.count("*").alias("n")).where(F.col("n") >= ENOUGH).drop("n")


def doubted(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of `found` that are in no language, or under their language's threshold."""
    least = written(thresholds(found, docs), "thresholds")  # a row per language
    return join_spread(found, least, "lang_pred", ["doc_id", "score"]).where((F.col("lang_pred") == UNKNOWN) | F.coalesce(F.col("score") < F.col("least"), F.lit(False)))
