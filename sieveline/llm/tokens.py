"""Token counts: pieces are counted once per distinct pre-token, joined to each text's pre-token frequencies and summed.

The join is map-side. Every task keeps a dictionary from pre-token to piece count (bounded at `CACHE` entries, emptied
when full), so a pre-token is counted once per task that meets it, and again after the dictionary was emptied; no ids of
a text are made and nothing is shuffled: one pass, linear in the text, whatever the vocabulary's size. Null text counts
as empty; an empty table gives an empty result; repeated rows give repeated rows.

The split is that of one family of tokenizer files (lower case, words, single digits, runs of other characters, byte-level
merges). A file with another normaliser, split or model is refused with ValueError, never miscounted.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import slices

#: Pre-tokens that a task remembers at most.
CACHE = 250_000
TOKENIZER = "word_bpe_49k.json"

# Fixed values of the tokenizer file: its normaliser and split, as its JSON states them.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# Fixed values of the tokenizer file: its split pattern over characters below U+0250, where letters are these ranges.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼½¾"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\t-\\r \\x85\\xa0{_LETTERS}{_DIGITS}]+")
_BEYOND = re.compile("[^\\x00-ɏ]")
# Fixed values of byte-level vocabularies: these bytes are written as the characters of their numbers, the rest in order from U+0100.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class PreTokens:
    """Splits texts into the tokenizer's pre-tokens and knows the ids of each distinct one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        if said["normalizer"] != _NORMALISER or said["pre_tokenizer"] != _SPLITTER or said["model"]["type"] != "BPE" or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in said["added_tokens"]):
            raise ValueError(f"{path}: its normaliser, split or added tokens aren't those that are counted here")
        self.whole = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.mark = os.path.commonprefix(list(special)) or None

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order. Special strings stand for themselves, as the library takes them from the raw text."""
        if self.cut is not None and (self.mark is None or self.mark in text):
            parts = self.cut.split(text)
            if len(parts) > 1:
                return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        lowered = text.lower()  # some letters under U+0250 have their lower case beyond it
        if text.isascii() or _BEYOND.search(text) is None and _BEYOND.search(lowered) is None:
            return _SPLIT.findall(lowered)
        text = self.whole.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, pre_tokens: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each with its ids, from the vocabulary's merges alone: it is normalised and split already."""
        merge = self.whole.model.tokenize
        for x in pre_tokens:
            if x in self.special:
                yield x, [self.special[x]]
            else:
                yield x, [t.id for t in merge(x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(_BYTES))]


class PieceCounts(PreTokens):
    def __init__(self, path: str, cache: int = CACHE):
        super().__init__(path)
        self.cache, self.counts = cache, {}

    def count(self, text: str) -> int:
        frequencies = Counter(self.split(text))
        if missing := [x for x in frequencies if x not in self.counts]:
            if len(self.counts) + len(missing) > self.cache:
                self.counts.clear()
                missing = list(frequencies)
            self.counts.update((x, len(ids)) for x, ids in self.ids(missing))
        of = self.counts
        return sum(of[x] * n for x, n in frequencies.items())


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `docs`; `tokenizer` is the path of a tokenizers file.

    Null text: 0 bytes, 0 tokens. A null doc_id is kept. Columns other than doc_id and text are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceCounts(tokenizer)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pieces.count(x) for x in batch.column(2).to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return narrow.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
