"""Nearest ranks against sorted lists."""

import random

from sieveline.operators.scoring import nearest_rank


def test_nearest_rank_of_sorted_values(spark):
    random.seed(1)
    groups = {"ties": [1.0] * 50 + [2.0] * 3, "one": [4.0], "all": [random.random() for _ in range(101)], "few": [float(random.randint(0, 4)) for _ in range(80)], "none": [None, 1.0, None]}
    shares = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    want = {g: [sorted(vs, key=lambda x: (x is not None, x))[min(len(vs) - 1, int(q * len(vs)))] for q in shares.values()] for g, vs in groups.items()}
    assert {r[0]: list(r[1:]) for r in nearest_rank(rows, ["g"], "v", shares).collect()} == want
    assert nearest_rank(rows.limit(0), ["g"], "v", shares).count() == 0
