import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sieveline.llm import lm
from tests.llm import cases


def base(rows):
    split = lambda x: [*(x or "").encode().lower().split(), b" "]
    out = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    seen = Counter(w for (_, x), held in zip(rows, out, strict=True) if not held for w in split(x))
    total, mass = sum(seen.values()), sum(seen.values()) + 0.1 * (len(seen) + 1)
    return [(i, held, len(split(x)), sum(w in seen for w in split(x)), total, sum(math.log10((seen[w] + 0.1) / mass) for w in split(x))) for (i, x), held in zip(rows, out, strict=True)]


@pytest.mark.parametrize("sizes", [{}, {"head_size": 40}, {"head_size": 3}, {"head_size": 0}])
def test_base_scores_are_those_of_brute_force(spark, sizes):
    got = sorted(map(tuple, lm.score(cases.frame(spark), bits=1 << 20, **sizes).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(base([(r[0], r[1]) for r in cases.rows()]), key=lambda r: (str(r[0]), r[2]))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and g[6] <= 0


def test_empty_tables(spark):
    assert lm.score(cases.empty(spark), bits=1 << 16).count() == 0
    only_held_out = spark.createDataFrame([(i, "a b") for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    rows = lm.score(only_held_out, bits=1 << 16).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and r.score <= 0 for r in rows)


def filled(events, q, parts=lm.PARTS, part_bits=1 << 14):
    bits = np.zeros(parts * part_bits // 8, np.uint8)
    part = lm.part_of(events, parts)
    for p in np.unique(part).tolist():
        bits[p * part_bits // 8 : (p + 1) * part_bits // 8] = lm.LogFrequencyFilter.build_part(events[part == p], q[part == p], part_bits)
    return lm.LogFrequencyFilter(bits, parts)


def test_the_filter_gives_quantised_counts_back():
    rng = np.random.default_rng(1)
    events = np.unique(rng.integers(0, 1 << 48, 20_000, dtype=np.uint64))
    counts = np.maximum(1, (rng.pareto(0.8, len(events)) * 2).astype(np.int64))
    q = lm.LogFrequencyFilter.quantised(counts, events)
    held = filled(events, q)
    got = held.levels(events)
    assert (got >= q).all() and (got > q).mean() < 0.02  # never less; more only by false membership
    assert (held.levels(np.setdiff1d(rng.integers(0, 1 << 48, 5000, dtype=np.uint64), events)) > 0).mean() < 0.02
    middle = held.middle(q)
    assert (middle <= counts * 1.5).all() and (middle * 1.5 >= counts).all()


def test_levels_are_right_in_the_mean():
    events = np.arange(200_000, dtype=np.uint64)
    for c in (1, 2, 3, 4, 5, 7, 11, 100, 12345):
        got = lm.LogFrequencyFilter.middle(lm.LogFrequencyFilter.quantised(np.full(len(events), c), events))
        assert abs(got.mean() / c - 1) < 0.005


def test_probabilities_sum_to_one_but_for_false_members():
    rng = np.random.default_rng(2)
    words = lm._mixed(np.arange(1, 400).astype(np.uint64))
    share = rng.dirichlet(np.ones(len(words)) * 0.2, 40)
    pairs = np.array([rng.multinomial(20_000, x) for x in share])
    own = pairs.sum(0)
    model = lm.Model(words[np.argsort(words)], own[np.argsort(words)], int(own.sum()), len(words), 20.0)
    assert (model.exact(words) == own).all() and model.exact(np.array([5], np.uint64)) == [-1]
    events = np.array([lm.pair_events(np.array([a, b], np.uint64))[1] for a in words[:40] for b in words])
    c = pairs.ravel()
    order = np.argsort(events)
    order = order[c[order] > 0]
    held = filled(events[order], lm.LogFrequencyFilter.quantised(c[order], events[order]), part_bits=1 << 13)
    count = held.middle(held.levels(events)).reshape(40, -1)
    for row in count:
        assert abs((10 ** model.log_pairs(row, np.full(len(words), 20_000.0), own.astype(float))).sum() - 1) < 0.02


def test_words_are_hashed_alike_wherever_they_stand():
    rng = np.random.default_rng(3)
    texts = [None, b"", b" ", b"One two\tTHREE\n", "é à\x85\xa0ß".encode(), b"x" * 5000, b"a " * 900, *(bytes(rng.choice(list(b"aB \n"), 60).tolist()) for _ in range(60))]
    listed = [(x or b"").lower().split() for x in texts]
    for span in (7, 64, 1 << 20):
        hashes, n = lm.WordHashes(span).of(texts)
        assert n.tolist() == [len(x) for x in listed]
        flat = [w for x in listed for w in x]
        assert hashes.tolist() == [int(lm.word_hash(w)) for w in flat]
        assert len(set(hashes.tolist())) == len(set(flat))
    tokens, n = lm.WordHashes(64).tokens(texts)
    assert [int(tokens[i]) for i in np.cumsum(n) - 1] == [int(lm.word_hash(lm.END_WORD))] * len(texts)


def test_hashes_of_like_words_differ():
    import itertools

    words = [bytes(x) for k in (1, 2, 3) for x in itertools.product(b"abcdefghijklmnopqrstuvwxyz0123456789", repeat=k)] + [str(i).encode() for i in range(1000, 300_000)]
    assert len(np.unique(lm.WordHashes().of([b" ".join(words)])[0])) == len(words)


def brute_scores(rows, prior):
    """Scores from exact counts."""
    split = lambda x: [*(x or "").encode().lower().split(), b" "]
    train = [split(x) for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    own, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([b" ", *t], t, strict=False))
    mass = sum(own.values()) + 0.1 * (len(own) + 1)
    return {i: sum(math.log10((min(pairs[p], own[p[0]]) + prior * (own[p[1]] + 0.1) / mass) / (own[p[0]] + prior)) for p in zip([b" ", *split(x)], split(x), strict=False)) for i, x in rows}


@pytest.mark.parametrize("head_size", [1000, 0])
def test_scores_are_those_of_exact_counts(spark, head_size):
    """Counts of 1 to 3 are held exactly, so only false members differ."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 12) % 4000)) for i in range(300)] + [(1000, None), (1001, "")]
    want = brute_scores(rows, 5.0)
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), head_size=head_size, bits=1 << 22, prior=5.0).collect()}
    assert got.keys() == want.keys()
    assert abs(sum(got.values()) / sum(want.values()) - 1) < 0.01
    assert all(abs(got[i] - want[i]) < 0.15 * abs(want[i]) + 0.3 for i in want)


def test_word_order_is_learned(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(800):
        at, text = int(rng.integers(50)), []
        for _ in range(30):
            text.append(words[at])
            at = (at * 7 + int(rng.integers(3))) % 50
        rows.append((i, " ".join(text)))
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), bits=1 << 20).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and all(r.score > r.base_score / 1.8 for r in held)


def _rare_chains(spark):
    """Many words, each always after the same other one; all are far from the commonest."""
    rows = [(i, " ".join(f"a{(i * 7 + k) % 3000} b{(i * 7 + k) % 3000}" for k in range(20))) for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_rare_words_keep_their_bigrams_and_slices_cut_nothing(spark):
    docs = _rare_chains(spark)
    own = {r.doc_id: r.score for r in lm.score(docs, head_size=10, prior=2.0).collect()}
    sliced = {r.doc_id: r.score for r in lm.score(docs, head_size=10, prior=2.0, slice_bits=1 << 14).collect()}
    exact = {r.doc_id: r.score for r in lm.score(docs, prior=2.0).collect()}
    swapped = docs.selectExpr("doc_id", "array_join(reverse(split(text, ' ')), ' ') as text").where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")
    trained = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0")
    backwards = {r.doc_id: r.score for r in lm.score(trained.unionByName(swapped), head_size=10, prior=2.0).collect() if r.held_out}
    assert own.keys() == sliced.keys() and all(math.isclose(own[i], sliced[i], rel_tol=1e-12) for i in own)
    assert all(own[i] > 0.6 * backwards[i] for i in backwards)  # the order of words that aren't broadcast counts
    assert abs(sum(own.values()) / sum(exact.values()) - 1) < 0.03  # counts from the filter are near those held exactly


def test_the_filter_grows_with_its_levels(spark, monkeypatch):
    sizes = []
    kept = lm.slices_of
    monkeypatch.setattr(lm, "slices_of", lambda spark, built, parts, part_bits, slice_bits: sizes.append(parts * part_bits) or kept(spark, built, parts, part_bits, slice_bits))
    for n in (4000, 16000):
        rng = np.random.default_rng(5)
        lm.score(spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 10 * n, 20))) for i in range(n)], "doc_id long, text string")).count()
    assert sizes[1] > 3.5 * sizes[0]
