"""Queries over whole texts and all rows, against brute force."""

import unicodedata

from sieveline.plans.catalogue import QUERIES


def _documents(spark, tmp_path):
    line = "été Straße the quick line "
    rows = [(i, "\n".join(f"{line}{i} {k}" for k in range(1 + 30 * i)) + f" last{i}", lang) for i, lang in enumerate(["fr", "de", "en", "es", "en"])]
    rows.append((5, "", "en"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    return rows, str(tmp_path)


def test_differences_are_of_whole_texts(spark, tmp_path):
    rows, d = _documents(spark, tmp_path)
    got = {r.key: (r.removed, r.added) for r in QUERIES["line_differences"](spark, d).collect()}
    n = {i: len(t.split("\n")) for i, t, _ in rows}
    assert got == {i: (n[i], n[i] + 1) if i % 2 == 0 else (0, 1) for i in n}


def test_all_languages_are_folded_whole(spark, tmp_path):
    rows, d = _documents(spark, tmp_path)
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()
    assert {r.doc_id: r.folded for r in QUERIES["folded_names"](spark, d).collect()} == {i: plain(t) for i, t, _ in rows}


def test_members_of_whole_texts_are_introduced(spark, tmp_path):
    rows, d = _documents(spark, tmp_path)
    want = {}
    for i, t, _ in rows:
        w = t.split(" ")
        want[i] = " ".join(sorted(set(w) - set(w[: len(w) // 2])))
    assert {r.doc_id: r.members for r in QUERIES["introduced_members"](spark, d).collect()} == want
    assert "last4" in want[4]
