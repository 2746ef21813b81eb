import hashlib
import math
from collections import Counter, defaultdict

import pytest

from sieveline.llm import mixing
from tests.llm import cases


def uniform(*parts):
    text = ":".join("null" if p is None else str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def poisson(rate, u):
    k, term = 0, math.exp(-rate)
    total = term
    while total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def expected(rows, weights=None, budget=1.0, seed=mixing.SEED):
    chars = defaultdict(float)
    for _, text, source in rows:
        chars[source] += len(text or "")
    share = {s: (math.sqrt(n) if weights is None else weights.get(s, 0.0)) if n else 0.0 for s, n in chars.items()}
    out = Counter()
    for doc, _, source in rows:
        rate = budget * share[source] / sum(share.values()) * sum(chars.values()) / chars[source] if chars[source] and sum(share.values()) else 1.0
        parts = max(1, math.ceil(rate / mixing.SPLIT))
        n = sum(poisson(rate / parts, uniform(seed, doc, i)) for i in range(1, parts + 1)) if rate else 0
        for k in range(1, n + 1):
            out[doc, k] += 1
    return out


@pytest.mark.parametrize("weights, budget", [(None, 1.0), ({"a": 3, "hot": 1}, 2.0), ({None: 1, "c": 1}, 1.0), ({"b": 1}, 1.0), ({}, 1.0), ({"a": 1}, 500.0)])
def test_counts_are_those_of_brute_force(spark, weights, budget):
    docs = cases.frame(spark).drop("key").withColumnRenamed("block", "mix_source2")
    got = mixing.replicated(docs, weights, budget)
    assert got.columns == [*docs.columns, "mix_copy"]
    assert Counter((r.doc_id, r.mix_copy) for r in got.collect()) == expected([(r[0], r[1], r[3]) for r in cases.rows()], weights, budget)


@pytest.mark.parametrize("extra", ["mix_rate", "MIX_RATE", "mix_source", "mix_place", "mix_order", "mix_copy", "Mix_Copy", "copy", "c0", "place", "a.b", "`q`"])
def test_any_extra_column_is_kept(spark, extra):
    docs = spark.createDataFrame([(*r[:4], float(i)) for i, r in enumerate(cases.rows())], "doc_id long, text string, lang string, source string, extra double").withColumnRenamed("extra", extra)
    got = mixing.replicated(docs)
    assert got.columns[:5] == docs.columns and got.columns[5] == ("mix_copy_" if extra.lower() == "mix_copy" else "mix_copy")
    want = {i: (r[0], r[1]) for i, r in enumerate(cases.rows())}
    rows = [tuple(r) for r in got.collect()]
    assert rows and all(want[int(r[4])] == (r[0], r[1]) for r in rows)
    assert Counter((r[0], r[5]) for r in rows) == expected([(r[0], r[1], r[3]) for r in cases.rows()])


def test_partitions_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_CHARS", 10_000)
    got = mixing.replicated(cases.frame(spark))
    assert got.rdd.getNumPartitions() > 20
    assert Counter((r.doc_id, r.mix_copy) for r in got.collect()) == expected([(r[0], r[1], r[3]) for r in cases.rows()])


def test_shuffled_rates_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    got = mixing.replicated(cases.frame(spark))
    assert Counter((r.doc_id, r.mix_copy) for r in got.collect()) == expected([(r[0], r[1], r[3]) for r in cases.rows()])


def test_shares_come_near_their_targets(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN 'rare' ELSE 'rest' END AS source")
    n = Counter(r.source for r in mixing.replicated(docs, {"hot": 1, "rare": 1, "rest": 2}).collect())
    assert abs(n["hot"] - 5000) < 300 and abs(n["rare"] - 5000) < 300 and abs(n["rest"] - 10_000) < 400


def test_the_order_mixes_sources(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text", "IF(id < 2000, 'a', 'b') AS source")
    order = [r.source for r in mixing.replicated(docs).collect()]
    changes = sum(x != y for x, y in zip(order, order[1:], strict=False))
    assert 0.4 < changes / len(order) < 0.6


def test_empty(spark):
    assert mixing.replicated(cases.empty(spark)).count() == 0
