"""Line differences, likeness of sentences and folded names: what built-in functions can't say, in Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.textops import overlapping

#: Cells of the table of longest common subsequences beyond which the differing middle is replaced whole.
CELLS = 2_000_000


def line_diff(old: list[str], new: list[str], cells: int = CELLS) -> list[tuple[str, int | None, int | None]]:
    """(kept, removed or added; line of the old text; of the new), from a longest common subsequence of lines."""
    a = 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    b = 0
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    x, y = old[a : len(old) - b], new[a : len(new) - b]
    out: list[tuple[str, int | None, int | None]] = [("kept", i, i) for i in range(a)]
    if len(x) * len(y) > cells:
        out += [("removed", a + i, None) for i in range(len(x))] + [("added", None, a + j) for j in range(len(y))]
    else:
        # Lines of one side alone are in no common subsequence: the table is over the others, found by how many of them come before.
        both = set(x) & set(y)
        cx, cy = [v for v in x if v in both], [v for v in y if v in both]
        at_x, at_y = ([0, *accumulate(int(v in both) for v in side)] for side in (x, y))
        best = np.zeros((len(cx) + 1, len(cy) + 1), np.int32)
        for i in range(len(cx) - 1, -1, -1):
            for j in range(len(cy) - 1, -1, -1):
                best[i, j] = best[i + 1, j + 1] + 1 if cx[i] == cy[j] else max(best[i + 1, j], best[i, j + 1])
        i = j = 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i] == y[j]:
                out.append(("kept", a + i, a + j))
                i, j = i + 1, j + 1
            elif i < len(x) and (j == len(y) or best[at_x[i + 1], at_y[j]] >= best[at_x[i], at_y[j + 1]]):
                out.append(("removed", a + i, None))
                i += 1
            else:
                out.append(("added", None, a + j))
                j += 1
    return out + [("kept", len(old) - b + k, len(new) - b + k) for k in range(b)]


def differences(texts: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """A row per line of every pair of texts: key, place, op, old_line, new_line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = [(k, n, *step) for k, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for n, step in enumerate(line_diff((x or "").split("\n"), (y or "").split("\n")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "place", "op", "old_line", "new_line"])

    return texts.select(F.col(key).cast("long"), old, new).mapInArrow(run, "key long, place int, op string, old_line int, new_line int")


def alike(texts: DataFrame, key: str, text: str, share: float = 0.4, ratio: float = 0.4, gap: float = 0.6) -> DataFrame:
    """Pairs whose vocabularies overlap, whose lengths are near, and whose matching blocks cover enough. Cheap tests come first."""
    pairs = overlapping(texts, key, text, share)
    side = lambda x: texts.select(F.col(key).alias(x), F.col(text).alias(f"t_{x}"))
    near = F.abs(F.length("t_a") - F.length("t_b")) <= gap * F.greatest(F.length("t_a"), F.length("t_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = [difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(r, pa.float64())], ["a", "b", "ratio"])

    met = pairs.join(side("a"), "a").join(side("b"), "b").where(near).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "t_a", "t_b")
    return met.mapInArrow(run, "a long, b long, ratio double").where(F.col("ratio") >= ratio)


def folded(text: Column) -> Column:
    """Lower case without accents."""

    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower())

    return F.pandas_udf(fold, "string")(text)
