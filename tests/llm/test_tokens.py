import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm.packing import Bins, PieceIds, pack, pack_block
from sieveline.llm.registry import vocabulary
from sieveline.llm.tokens import PieceCounts, count_tokens

CODER = PieceIds(vocabulary())
COUNTER = PieceCounts(vocabulary(), cache=50)
CASES = [None, "", " ", "it's  WE'LL don''s <|endoftext|>a<|startoftext|> <|x|>", "É½³ ÀÖØö x\x1cy\x85z\xa0w", "Σας İstanbul ΑΣ é  漢字 ที่", "\x00\x01!", "a" * 30_000, "word " * 9_000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece int, length string"


def library(text):
    return CODER.whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", CASES)
def test_ids_equal_the_librarys(text):
    assert np.frombuffer(CODER.encoded(text or ""), "<u4").tolist() == library(text)
    assert COUNTER.count(text or "") == len(library(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    assert np.frombuffer(CODER.encoded(text), "<u4").tolist() == library(text)


#: Letters under U+0250 whose lower case lies beyond it, and what they stand beside.
FAR = [chr(c) for c in range(0x250) if any(ord(x) >= 0x250 for x in chr(c).lower())]


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from([*FAR, *"aZ19!.'-_ \n²½éß\u0301\u212a\u212b\u1e9e<|"]), max_size=12).map("".join))
def test_letters_whose_lower_case_leaves_the_block(text):
    assert len(FAR) >= 23
    assert np.frombuffer(CODER.encoded(text), "<u4").tolist() == library(text)
    assert COUNTER.count(text) == len(library(text))


def test_every_capital_beside_every_kind_of_character():
    for c in map(chr, range(0x250)):
        text = "".join(f"{c}{x}{c} {x}{c}" for x in "!a9'-é½\u0301")
        assert np.frombuffer(CODER.encoded(text), "<u4").tolist() == library(text)


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    with open(vocabulary(), encoding="utf-8") as file:
        said = json.load(file)
    for key, value in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("added_tokens", [said["added_tokens"][0] | {"normalized": True}])):
        path = tmp_path / f"{key}.json"
        path.write_text(json.dumps(said | {key: value}))
        with pytest.raises(ValueError, match="aren't those"):
            PieceCounts(str(path))


def frame(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, x, None, None, None, 7, "x") for i, x in enumerate(texts)], SCHEMA)


def test_counts_of_a_table(spark):
    got = sorted(map(tuple, count_tokens(frame(spark, CASES), vocabulary()).collect()), key=str)
    want = sorted(((i if i != 3 else None, len((x or "").encode()), len(library(x)), len(library(x)) > 2048) for i, x in enumerate(CASES)), key=str)
    assert got == want
    assert count_tokens(frame(spark, []), vocabulary()).count() == 0


def test_packing_of_a_table(spark):
    import zlib

    texts = [*CASES, *["same words here"] * 5]
    large = 2**62 + 1
    from pyspark.sql import functions as F

    rows = [r for r in pack(frame(spark, texts).withColumn("doc_id", F.col("doc_id") + large), vocabulary(), block_pieces=8).withColumn("doc_id", F.col("doc_id") - large).collect()]
    want = []
    for i, x in enumerate(texts):
        ids = [*library(x), 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want.append((i if i != 3 else None, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(frame(spark, []), vocabulary()).count() == 0


def test_local_search_empties_bins_that_best_fit_leaves():
    sizes = np.random.default_rng(1).integers(900, 2500, 2000)
    bins = Bins(sizes, 4096)
    bins.seed()
    before, squares = len(bins.fill), sum(x * x for x in bins.fill)
    assert bins.improve() > 0
    assert sum(x * x for x in bins.fill) > squares
    assert sum(x > 0 for x in bins.fill) < before
    at = pack_block(sizes)
    assert np.bincount(at, sizes).max() <= 4096 and at.max() + 1 < before


def test_a_block_of_small_items_is_full():
    sizes = np.random.default_rng(2).integers(1, 900, 5000)
    assert pack_block(sizes).max() + 1 == -(-sizes.sum() // 4096)
