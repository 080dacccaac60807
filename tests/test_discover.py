"""Statistics of all similarities without meeting a pair, and groups of the search."""

import numpy as np
import pytest

from callweave.operators import discover


def test_spread_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(7, 5)), rng.normal(size=(90, 5))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "key int, v array<double>")
    items = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(4)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    sims = unit(q) @ unit(x).T
    for r in discover.spread(queries, items).collect():
        assert r.mean == pytest.approx(sims[r.key].mean()) and r.std == pytest.approx(sims[r.key].std())
    same = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0, 0.0],)] * 3, "v array<double>")
    assert {r.std for r in discover.spread(queries, same).collect()} == {0.0}


def test_groups(spark):
    pairs = spark.createDataFrame([(1, c) for c in range(4)], "profile_id int, opportunity_id int")
    verdicts = spark.createDataFrame([(1, 0, "LIKELY_NOT_ELIGIBLE"), (1, 1, "CHECK"), (1, 2, "ELIGIBLE"), (1, 3, "CHECK")], "profile_id int, opportunity_id int, status string")
    mine = spark.createDataFrame([(1, ["film"])], "profile_id int, disciplines array<string>")
    theirs = spark.createDataFrame([(0, ["film"]), (1, ["dance"]), (2, ["all"]), (3, None)], "opportunity_id int, disciplines array<string>")
    assert {r.opportunity_id: r.grp for r in discover.groups(pairs, verdicts, mine, theirs).collect()} == {0: "not_eligible", 1: "other_discipline", 2: "fit", 3: "fit"}
