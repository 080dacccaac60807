"""Many models at once against single fits; folds of whole groups against a plain greedy walk."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from callweave.operators import learning, many_models

RNG = np.random.default_rng(3)


def rows(n=400, width=6, labels=3):
    x = RNG.normal(size=(n, width))
    w = RNG.normal(size=(width, labels))
    y = x @ w + RNG.normal(size=(n, labels)) > 0.4
    return [(i, [k for k in range(labels) if y[i, k]], int(i % 4), float((i * 37 % n) / n), x[i].tolist()) for i in range(n)]


SCHEMA = "key int, y array<int>, fold int, place double, v array<double>"


def test_coefficients_equal_single_fits(spark):
    data = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    models = [many_models.Model(k, fold, share, penalty) for k in (0, 2) for fold, share, penalty in ((0, 1.0, 0.01), (3, 0.6, 0.1), (-1, 1.0, 0.02))]
    fitted = many_models.fit(data, models, 6, 3, tolerance=1e-9)
    for m, model in enumerate(models):
        seen = data.where((F.col("fold") != model.fold) & (F.col("place") <= model.share)).select(F.array_contains("y", model.label).cast("double").alias("label"), array_to_vector("v").alias("features"))
        one = LogisticRegression(regParam=model.penalty, standardization=False, tol=1e-12, maxIter=500).fit(seen)
        assert np.abs(fitted.weights[:, m] - np.r_[one.coefficients.toArray(), one.intercept]).max() < 1e-6
    alone = many_models.fit(data, models[:1], 6, 3, tolerance=1e-9)
    assert np.abs(alone.weights[:, 0] - fitted.weights[:, 0]).max() < 1e-6 and fitted.passes < 2 * alone.passes


def test_balanced_and_hinge_models_are_at_a_minimum(spark):
    data = spark.createDataFrame(rows(), SCHEMA)
    models = [many_models.Model(1, 2, 1.0, 0.05, loss, True) for loss in ("logistic", "hinge")]
    fitted = many_models.fit(data, models, 6, 3, tolerance=1e-9)
    kept = [r for r in data.collect() if r.fold != 2]
    x, s = np.array([r.v for r in kept]), np.array([1.0 if 1 in r.y else -1.0 for r in kept])
    weight = np.where(s > 0, 0.5 / (s > 0).sum(), 0.5 / (s < 0).sum())

    def value(w, hinge):
        m = s * (x @ w[:-1] + w[-1])
        return (weight * (np.maximum(0, 1 - m) ** 2 if hinge else np.logaddexp(0, -m))).sum() + 0.025 * (w[:-1] ** 2).sum()

    for k, hinge in enumerate((False, True)):
        best = value(fitted.weights[:, k], hinge)
        assert all(best <= value(fitted.weights[:, k] + RNG.normal(size=7) * 1e-3, hinge) + 1e-12 for _ in range(50))


def test_sparse_rows_equal_dense_ones(spark):
    few = [(r[0], r[1], r[2], r[3], [v if abs(v) > 0.7 else 0.0 for v in r[4]]) for r in rows(200)]
    dense = spark.createDataFrame(few, SCHEMA)
    sparse = spark.createDataFrame([(*r[:4], [i for i, v in enumerate(r[4]) if v], [v for v in r[4] if v]) for r in few], "key int, y array<int>, fold int, place double, idx array<int>, val array<double>")
    models = [many_models.Model(0, 1, 1.0, 0.01, scale=0)]
    scales = np.array([[1.0, 2.0, 0.0, 1.0, 0.5, 1.0]])
    one = lambda v: [x * k for x, k in zip(v, scales[0])]
    scaled = [(*r[:4], (np.array(one(r[4])) / max(np.linalg.norm(one(r[4])), 1e-12)).tolist()) for r in few]
    dense = spark.createDataFrame(scaled, SCHEMA)
    a = many_models.fit(dense, [many_models.Model(0, 1, 1.0, 0.01)], 6, 3, tolerance=1e-9)
    b = many_models.fit(sparse, models, 6, 3, scales, tolerance=1e-9)
    assert np.abs(a.weights - b.weights).max() < 1e-6 and b.weights[2, 0] == 0
    scores = [{(r.key, r.model): r.score for r in many_models.out_of_fold(d, f, 6, 3).collect()} for d, f in ((dense, a), (sparse, b))]
    assert scores[0].keys() == scores[1].keys() and len(scores[0]) == sum(r[2] == 1 for r in few)
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-5
    none = many_models.fit(sparse.where("false"), models, 6, 3, scales)
    assert not none.weights.any()


def plain_folds(counts, order, folds):
    labels = sorted({x for c in counts.values() for x in c})
    total = {x: sum(c.get(x, 0) for c in counts.values()) for x in labels}
    have = [{x: 0 for x in labels} for _ in range(folds)]
    out = {}
    for g in order:
        best = None
        for f in range(folds):
            dev = 0.0
            for x in labels:
                shares = [(have[k][x] + (counts[g].get(x, 0) if k == f else 0)) / total[x] for k in range(folds)]
                mean = sum(shares) / folds
                dev += (sum((s - mean) ** 2 for s in shares) / folds) ** 0.5
            tried = (round(dev / len(labels), 12), sum(have[f].values()), f)
            best = min(best or tried, tried)
        out[g] = best[2]
        for x, n in counts[g].items():
            have[best[2]][x] += n
    return out


def test_greedy_folds(spark):
    rnd = random.Random(2)
    data = [(f"g{rnd.randrange(40)}", rnd.choice("aaab" if rnd.random() < 0.5 else "bccd")) for _ in range(900)] + [(f"g{i}", "d") for i in range(5) for _ in range(20)]
    df = spark.createDataFrame(data, "grp string, label string")
    counts = {}
    for g, x in data:
        counts.setdefault(g, {}).setdefault(x, 0)
        counts[g][x] += 1

    def spread(c):
        v = [c.get(x, 0) for x in "abcd"]
        return sum((n - sum(v) / 4) ** 2 for n in v)

    from callweave.operators.annotate import seeded

    order = {r.g: r.o for r in spark.createDataFrame([(g,) for g in counts], "g string").select("g", seeded(F.col("g"), seed=1).alias("o")).collect()}
    want = plain_folds(counts, sorted(counts, key=lambda g: (-spread(counts[g]), order[g], g)), 4)
    got = learning.stratified_folds(df, "grp", "label", 4)
    assert {r.grp: r.fold for r in got.collect()} == want
    ours, turn = (learning.share_deviation(df, deal(df, "grp", "label", 4), "grp", "label").first() for deal in (learning.stratified_folds, learning.dealt_folds))
    assert ours.n_leaked == 0 and ours.deviation < turn.deviation
    stretches = learning.stratified_folds(df, "grp", "label", 4, together=7)
    assert stretches.count() == len(counts) and learning.share_deviation(df, stretches, "grp", "label").first().n_leaked == 0


def test_learning_curve_rises_and_nests(spark):
    x = RNG.normal(size=(600, 5))
    label = np.where(x[:, 0] + 0.3 * x[:, 1] > 0, "a", "b")
    df = spark.createDataFrame([(int(i // 6), str(label[i]), int(i // 6 % 3), x[i].tolist()) for i in range(600)], "grp int, label string, fold int, v array<double>")
    got = learning.learning_curve(df, [0.05, 0.5, 1.0], 3).collect()
    assert [r.n_groups for r in got] == [5, 50, 100] and got[2].macro_f1 > 0.9 and got[2].macro_f1 >= got[0].macro_f1


@pytest.mark.parametrize("grams", [1, 2])
def test_terms_and_their_rows_by_fold(spark, grams):
    df = spark.createDataFrame([("Red red fish", 0, [0]), ("red, FISH!", 1, [1]), (None, 1, [0]), ("", 0, [0])], "text string, fold int, y array<int>")
    data, terms = many_models.text_rows(df, ["y", "fold"], grams, 2)
    want = {"red": {0: 1, 1: 1}, "fish": {0: 1, 1: 1}} | ({"red fish": {0: 1, 1: 1}} if grams == 2 else {})
    assert {g: by for g, _, by in terms} == want
    at = {g: i for i, (g, _, _) in enumerate(terms)}
    first = next(dict(zip(r.idx, r.val)) for r in data.collect() if r.fold == 0 and r.idx)
    assert first[at["red"]] == 2.0 and first[at["fish"]] == 1.0
