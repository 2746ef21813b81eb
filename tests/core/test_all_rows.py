"""Queries that return every row, against brute force."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sieveline.plans.catalogue import QUERIES
from sieveline.sources import binding

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no tables")


def test_every_repository_has_its_size(spark):
    orders = binding.table(spark, D, "orders")
    got = QUERIES["group_sizes"](spark, D).collect()
    counts = {r.o_custkey: r["count"] for r in orders.groupBy("o_custkey").count().collect()}
    assert [(r.repository, r.samples) for r in got] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    # More than the tables here hold.
    assert "Limit" not in QUERIES["group_sizes"](spark, D)._jdf.queryExecution().optimizedPlan().toString()


def test_every_site_has_its_place(spark):
    got = sorted(QUERIES["sites_by_severity"](spark, D).collect(), key=lambda r: r.place)
    want = sorted(QUERIES["sites"](spark, D).collect(), key=lambda r: (-r.worst, -r.findings, -r.score, r.file, r.class_name, r.method, r.line))
    assert len(want) > 50 and [r.place for r in got] == list(range(1, len(want) + 1))
    assert [tuple(r)[:-1] for r in got] == [tuple(r[c] for c in got[0].asDict() if c != "place") for r in want]


def test_each_finding_is_a_rules_or_a_models(spark):
    found = binding.findings(spark, D).collect()
    key = lambda r: (r.file, r.class_name, r.line, r.smell_type)
    rules, model = {key(r) for r in found if r.severity >= 2}, {}
    for r in found:
        if r.severity < 2:
            model[key(r)] = max(model.get(key(r), 0), r.score / 100)
    assert {key(r) for r in QUERIES["agreement_on"](spark, D).collect()} == rules
    assert {key(r): r.agreed for r in QUERIES["agreement_on"](spark, D).collect()} == {k: k in model for k in rules}
    places = {k[:3] for k in rules}
    assert {key(r): r.probability for r in QUERIES["model_only"](spark, D).collect()} == pytest.approx({k: p for k, p in model.items() if k[:3] not in places}, abs=1e-6)


def test_all_orders_are_compared(spark):
    judged = binding.judged(spark, D).count()
    got = QUERIES["ab_agreement"](spark, D).collect()
    assert sum(r.both + r.rules_only + r.model_only + r.neither for r in got) == judged
    assert all(r.tp + r.fp + r.fn + r.tn == n for r in QUERIES["ab_combined"](spark, D).collect() for n in [sum(x.both + x.rules_only + x.model_only + x.neither for x in got if x.smell == r.smell)])
    orders = binding.table(spark, D, "orders")
    assert sum(r.n for r in QUERIES["accept_by_verdict"](spark, D).collect()) == orders.count()
    cited = {r.o_custkey for r in orders.select("o_custkey").distinct().collect()}
    listed = {r.c_custkey for r in binding.table(spark, D, "customer").where("c_acctbal > 1000").collect()}
    assert {r.side: r.n for r in QUERIES["referential_audit"](spark, D).collect()} == {"cited": len(cited - listed), "listed": len(listed - cited)}


def test_all_findings_are_labelled_and_looked_up(spark):
    found = binding.findings(spark, D).collect()
    labels = QUERIES["review_labels"](spark, D).collect()
    assert {r.finding_id for r in labels} == {r.finding_id for r in found} and len({r.label for r in labels}) == len(found)
    fired = {(r.file, r.class_name): False for r in found}
    for r in found:
        fired[r.file, r.class_name] |= r.smell_type in ("click", "view")
    assert {(r.file, r.class_name): r.fired for r in QUERIES["external_verdicts"](spark, D).collect()} == fired
