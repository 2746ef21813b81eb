import numpy as np
import pytest

from sieveline.llm import neardup
from sieveline.llm.components import components, in_rounds
from tests.llm import cases


def shingles(text, words):
    listed = (text or "").encode().lower().split()
    if len(listed) < words:
        return {tuple(listed)} if listed else set()
    return {tuple(listed[i : i + words]) for i in range(len(listed) - words + 1)}


def brute(rows, words, percent):
    sets = {i: shingles(x, words) for i, x in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def copies(n, words, edits, seed):
    """Copies of one text with some words changed in each: many pairs are near the threshold, on either side."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 10**6, words)]
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits)):
            text[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("words, percent", [(4, 80), (5, 80), (2, 60)])
def test_groups_are_those_of_brute_force(spark, words, percent):
    texts = [*copies(120, 60, 7, 1), *copies(60, 150, 12, 2), *copies(40, 30, 5, 3), *["one text"] * 30, "a", "A", "a b", None, "", *copies(1, 5000, 2, 4) * 2]
    rows = [(i * 3 % 1009, x) for i, x in enumerate(texts)]
    frame = spark.createDataFrame([(i, x, "c") for i, x in rows], "doc_id long, text string, label string").repartition(6)
    assert got(neardup.near_duplicates(frame, words, percent)) == brute(rows, words, percent)


def test_chains_and_parted_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "CHUNK", 50)
    words = [f"w{k}" for k in range(400)]
    rows = [(1000 - i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(60)] + [(2000 + i, x) for i, x in enumerate(copies(80, 60, 7, 5))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(frame, 4, 80)) == brute(rows, 4, 80)


def family(n, core=600, tail=76):
    """Documents that share a passage and lie just under the threshold, so that nothing is linked."""
    shared = " ".join(f"core{k}" for k in range(core))
    return [(i, shared + " " + " ".join(f"t{i}x{k}" for k in range(tail))) for i in range(n)]


@pytest.mark.parametrize("n", [100, 200, 400])
def test_what_is_stored_of_a_family_near_the_threshold(spark, monkeypatch, n):
    stored = []

    def counted(frame):
        """Rows, and elements of arrays in them."""
        frame = kept(frame)
        lists = [c for c, kind in frame.dtypes if kind.startswith("array")]
        stored.append(frame.count() + sum(frame.selectExpr(f"sum(size(`{c}`))").first()[0] or 0 for c in lists))
        return frame

    kept = neardup.checkpointed
    monkeypatch.setattr(neardup, "checkpointed", counted)
    monkeypatch.setattr(neardup, "BLOCK", 60)
    monkeypatch.setattr(neardup, "written", lambda df, label, w=neardup.written: stored.append((frame := w(df, label)).count()) or frame)
    rows = family(n)
    assert got(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)) == {i: (673, i) for i, _ in rows}
    assert max(stored) <= n * neardup.bands_for(80) * -(-n // 60)  # a row for each block that a member meets


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_exact_links_join_what_brute_force_joins(percent):
    rng = np.random.default_rng(percent)
    for _ in range(40):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(np.r_[rng.choice(base, rng.integers(20, 60), replace=False), rng.integers(0, 2**63, rng.integers(0, 15), dtype=np.uint64)]) for _ in range(40)]
        labels = rng.integers(0, 30, 40)
        meets = rng.random((2, 40)) < 0.7
        for roles in (None, meets):
            want, found = neardup.Joined(labels), neardup.Joined(labels)
            for i in range(40):
                for k in range(i):
                    both = len(np.intersect1d(sets[i], sets[k]))
                    met = roles is None or roles[0, i] & roles[1, k] | roles[0, k] & roles[1, i]
                    if met and 100 * both >= percent * (len(sets[i]) + len(sets[k]) - both):
                        want.join(i, k)
            links = neardup.exact_links(sets, labels, percent, roles)
            assert all(found.join(i, k) for i, k in links)  # none is needless
            same = lambda x: [x.root(i) == x.root(k) for i in range(40) for k in range(i)]
            assert same(found) == same(want)


def test_links_that_no_star_has(spark, monkeypatch):
    """Groups of which most pairs are a little under the threshold and few over it, in blocks smaller than they are."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rng = np.random.default_rng(9)
    core = [f"c{k}" for k in range(100)]
    rows = []
    for i in range(150):
        tail = [f"t{i // 2 if i % 10 < 4 else 1000 + i}x{k}" for k in range(14)]
        at = sorted(rng.choice(14, 2, replace=False))
        for k in at:
            tail[k] = f"y{i}"
        rows.append((i, " ".join(core + tail)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(neardup.near_duplicates(frame, 4, 80)) == brute(rows, 4, 80)


def test_cases(spark):
    found = neardup.near_duplicates(cases.frame(spark)).collect()
    assert len(found) == len(cases.rows())
    want = brute([(r[0], r[1]) for r in cases.rows() if r[0] is not None], 5, 80)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert neardup.near_duplicates(cases.empty(spark)).count() == 0


def test_registers_merge_and_estimate():
    sketch, rng = neardup.SetSketch(4000), np.random.default_rng(1)
    for common, own in [(800, 100), (300, 300), (50, 500)]:
        a, b = (np.unique(rng.integers(0, 2**63, own, dtype=np.uint64)) for _ in range(2))
        c = rng.integers(0, 2**63, common, dtype=np.uint64)
        x, y, union = sketch.registers([np.r_[a, c], np.r_[b, c], np.r_[a, b, c]])
        assert (np.maximum(x, y) == union).all()
        s = neardup.estimated([own + common], [own + common], np.array([(x > y).sum()]), np.array([(x < y).sum()]), 4000)[0]
        assert abs(s - common / (common + 2 * own)) < 0.04


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [tuple(sorted(x)) for x in rng.integers(3000, 3400, (250, 2)).tolist()] + [(7000, 7000)]
    parent = {x: x for p in links for x in p}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {i: root(i) for i in parent if any(i in p and p[0] != p[1] for p in links)}
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.label for r in components(frame).collect()} == want
    assert {r.node: r.label for r in in_rounds(frame.where("a <> b")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_task_makes_one_join_of_buckets_at_a_time(spark, monkeypatch):
    """Sorts take pages of 16 MB each, however few rows they have: a plan of `blocks` has one join, and none sorts registers."""
    import sieveline.llm.common as common

    plans, seen = [], []
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0, raising=False)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()

    def blocks(edges, labels, held, make=neardup.blocks, kept=neardup.checkpointed):
        seen.append(plan(held))
        monkeypatch.setattr(neardup, "checkpointed", lambda df: plans.append(plan(df)) or kept(df))
        placed = make(edges, labels, held)
        monkeypatch.setattr(neardup, "checkpointed", kept)
        plans.append(plan(placed))
        return placed

    monkeypatch.setattr(neardup, "blocks", blocks)
    rows = list(enumerate(copies(60, 60, 12, 5))) + [(3, "a row of the same number")]
    found = got(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80))
    assert found.keys() == set(range(60)) and len(set(found.values())) > 1
    assert plans and max(p.count("Join ") for p in plans) == 1
    assert "Aggregate" not in seen[0]


def test_links_are_stored_once(spark, monkeypatch):
    from sieveline.llm import components as module

    again = []
    monkeypatch.setattr(module, "checkpointed", lambda df, kept=module.checkpointed: again.append(df.columns) or kept(df))
    rows = list(enumerate(copies(60, 60, 12, 5)))
    assert got(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)) == brute(rows, 4, 80)
    assert not again
