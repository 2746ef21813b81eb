"""Rewrites checked: does the text still scan, and does the compiler find errors that it didn't find before?"""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.java.rewrites import verdict
from sieveline.java.scanner import scan

LIMIT_S = 60
_ERROR = re.compile(r"^.*?:\d+: error: (.*)$", re.MULTILINE)


def compiler_errors(file: str, text: str, limit: int = LIMIT_S) -> list[str] | None:
    """Messages without lines, as these move; None without a compiler or beyond the time limit."""
    if shutil.which("javac") is None:
        return None
    with tempfile.TemporaryDirectory() as folder:  # the task's own; it is gone when this returns
        path = Path(folder, Path(file).name)
        path.write_text(text)
        try:
            done = subprocess.run(["javac", "-proc:none", "-d", folder, "-Xmaxerrs", "10000", str(path)], capture_output=True, text=True, timeout=limit)
        except subprocess.TimeoutExpired:
            return None
    return [] if done.returncode == 0 else sorted(set(_ERROR.findall(done.stderr))) or ["unknown"]


def checked(rewrites: DataFrame) -> DataFrame:
    """file, before, after (texts) -> file and verdict. Each file is compiled by itself, as it is and rewritten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for file, before, after in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parses = not scan(after)[4]
                errors = compiler_errors(file, after) if parses else None
                rows.append((file, parses, compiler_errors(file, before) if errors else [], errors))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "parses", "old", "new"])

    told = rewrites.select("file", "before", "after").mapInArrow(run, "file string, parses boolean, old array<string>, new array<string>")
    return told.select("file", verdict(F.col("parses"), F.col("old"), F.col("new")).alias("verdict"))
