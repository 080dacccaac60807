"""Training jobs: text and vector classifiers over folds, the match score, means over seeds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators import many_models
from callweave.operators.annotate import seeded
from callweave.operators.ordered import running_sum
from callweave.plans.scratch import materialise


def dealt_folds(df: DataFrame, group: str, label: str, folds: int, seed: int = 1) -> DataFrame:
    """V01, the plain way: ``grp, fold``, where groups of each most frequent label are dealt in turn.

    Turns are running sums over range partitions; a tie goes to the larger label.
    """
    counts = df.groupBy(F.col(group).alias("grp"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    main = counts.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main")).withColumn("o", seeded(F.col("grp"), seed=seed))
    return running_sum(main, F.lit(1), ["o", "grp"], ["main"]).select("grp", ((F.col("run") - 1) % folds).cast("int").alias("fold"))


#: Groups that one task deals in a row.
DEALT_TOGETHER = 10_000


def stratified_folds(df: DataFrame, group: str, label: str, folds: int, seed: int = 1, together: int = DEALT_TOGETHER) -> DataFrame:
    """``grp, fold``: whole groups in folds whose label shares are alike.

    Groups come with the largest spread of label counts first (ties in a seeded order). Each
    goes to the fold with which the labels' shares in the folds deviate least; ties to the
    fold of fewest rows, then to the lowest. Up to ``together`` groups are dealt by one task
    in this order; of more, each stretch of so many is dealt by itself, the folds' numbers
    turned by one from stretch to stretch.
    """
    counts = df.groupBy(F.col(group).alias("grp"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    labels = [r.label for r in counts.select("label").distinct().orderBy("label").collect()]  # a row a label
    per = counts.groupBy("grp").agg(*(F.sum(F.when(F.col("label").eqNullSafe(x), F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i, x in enumerate(labels)))
    vector = F.array(*(F.col(f"n{i}") for i in range(len(labels))))
    mean = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x) / max(1, len(labels))
    spread = F.aggregate(F.transform(vector, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    ordered = per.select("grp", vector.alias("v"), (-spread).alias("s"), seeded(F.col("grp"), seed=seed).alias("o"))
    placed = running_sum(ordered, F.lit(1), ["s", "o", "grp"]).withColumn("stretch", F.floor((F.col("run") - 1) / together))
    kind = dict(placed.dtypes)["grp"]

    def deal(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("run").to_numpy(), kind="stable")
        v = np.array(t.column("v").to_pylist(), float).reshape(len(order), -1)
        turn = int(t.column("stretch")[0].as_py())
        fold = np.zeros(len(order), np.int64)
        fold[order] = (greedy_folds(v[order], folds) + turn) % folds
        return pa.table({"grp": t.column("grp"), "fold": pa.array(fold.astype(np.int32))})

    return placed.groupBy("stretch").applyInArrow(deal, f"grp {kind}, fold int")


def greedy_folds(v: np.ndarray, folds: int) -> np.ndarray:
    """The fold of each group (row of label counts), dealt in their order."""
    have, total = np.zeros((folds, v.shape[1])), np.maximum(v.sum(axis=0), 1)
    out = np.zeros(len(v), np.int64)
    for i, own in enumerate(v):
        tried = np.repeat(have[None], folds, axis=0)
        tried[np.arange(folds), np.arange(folds)] += own
        deviation = np.round((tried / total).std(axis=1).mean(axis=1), 12)
        best = min(range(folds), key=lambda f: (deviation[f], have[f].sum(), f))
        have[best] += own
        out[i] = best
    return out


def share_deviation(df: DataFrame, folds: DataFrame, group: str, label: str) -> DataFrame:
    """``deviation``, the mean over labels of the deviation of their shares in the folds, and ``n_leaked``, groups in more than one fold."""
    named = df.select(F.col(group).alias("grp"), F.col(label).alias("label")).join(folds, "grp")
    n = named.groupBy("label").agg(F.count("*").alias("n"))
    every = folds.select("fold").distinct().crossJoin(n)  # folds times labels
    shares = every.join(named.groupBy("fold", "label").agg(F.count("*").alias("k")), ["fold", "label"], "left").withColumn("share", F.coalesce("k", F.lit(0)) / F.col("n"))
    leaked = folds.groupBy("grp").agg(F.count_distinct("fold").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_leaked"))
    return shares.groupBy("label").agg(F.stddev_pop("share").alias("d")).agg(F.round(F.avg("d"), 6).alias("deviation")).join(F.broadcast(leaked))  # a row each


def labels_missing(df: DataFrame, label: str, fold: str) -> DataFrame:
    """``fold, label`` of labels that a fold has no row of."""
    seen = df.select(F.col(fold).alias("fold"), F.col(label).alias("label")).distinct()
    every = seen.select("fold").distinct().crossJoin(seen.select("label").distinct())  # folds times labels
    return every.join(seen, ["fold", "label"], "left_anti")


def grid_search(df: DataFrame, grid: Sequence[tuple[str, float, int, float]], folds: int, tolerance: float = 1e-4, most_passes: int = 60) -> DataFrame:
    """``model, c, grams, least_df, macro_f1`` over out-of-fold predictions of ``text, label, fold`` rows.

    Models: balanced logistic regression ("lr") or a linear machine ("svm"), one against the
    rest. Terms are counted once for all folds; a model's scale takes out terms that are too
    rare in the folds that it sees or too long for it, and weighs the others by their
    inverse document frequency there; rows have length 1. All points, folds and labels are fitted in the same
    passes. One row a grid point comes to the driver.
    """
    rows = df.where("text is not null and label is not null")
    labels = [r.label for r in rows.select("label").distinct().orderBy("label").collect()]
    number = F.create_map(*(F.lit(x) for i, n in enumerate(labels) for x in (n, i)))
    keyed = rows.select("text", F.array(F.element_at(number, F.col("label"))).alias("y"), F.col("fold").cast("int").alias("fold"), F.lit(0.0).alias("place"))
    data, terms = many_models.text_rows(keyed, ["y", "fold", "place"], max(g for _, _, g, _ in grid), int(min(least for *_, least in grid)))
    size = {r.fold: r["count"] for r in data.groupBy("fold").count().collect()}
    scales, models = [], []
    for kind, c, grams, least in grid:
        for fold in range(folds):
            seen = np.array([sum(n for f, n in df_.items() if f != fold) for _, _, df_ in terms], float)
            total = sum(n for f, n in size.items() if f != fold)
            fits = (seen >= least) & (np.array([n for _, n, _ in terms]) <= grams)
            scales.append(np.where(fits, np.log((total + 1) / (seen + 1)), 0.0))
            models += [many_models.Model(k, fold, 1.0, 1 / c, "logistic" if kind == "lr" else "hinge", True, len(scales) - 1) for k in range(1 if len(labels) == 2 else 0, len(labels))]
    fitted = many_models.fit(data, models, len(terms), len(labels), np.array(scales), tolerance, most_passes)
    guessed = _guesses(data, fitted, len(terms), len(labels), per_point=folds)
    out = []
    for point, (kind, c, grams, least) in enumerate(grid):
        own = [(t, g, n) for p, t, g, n in guessed if p == point]
        out.append((kind, float(c), grams, float(least), round(macro_f1(own, len(labels)), 4)))
    return df.sparkSession.createDataFrame(out, "model string, c double, grams int, least_df double, macro_f1 double")


def _guesses(data: DataFrame, fitted: many_models.Fit, width: int, labels: int, per_point: int) -> list[tuple[int, int, int, int]]:
    """(point, true label, guessed label, rows) over out-of-fold scores, counted in the tasks; models lie point by point, fold by fold, label by label."""
    each = 1 if labels == 2 else labels
    points = len(fitted.models) // (each * per_point)
    fold, scale = np.array([m.fold for m in fitted.models]), np.array([m.scale for m in fitted.models])
    sent = data.sparkSession.sparkContext.broadcast((fitted.effective(), fitted.scales))

    def make(batches):
        weights, scales = sent.value
        counts = np.zeros((points, labels, labels), np.int64)
        for rows in many_models.pieces(batches, width, labels):
            score = rows.scores(weights, rows.units(scales, scale))
            truth = rows.target.argmax(axis=1)
            own = np.where(rows.fold[:, None] == fold, score, -np.inf).reshape(rows.n, points, per_point, each).max(axis=2)
            guess = (own[:, :, 0] > 0).astype(int) if each == 1 else own.argmax(axis=2)
            for p in range(points):
                np.add.at(counts[p], (truth, guess[:, p]), 1)
        p, t, g = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (p, t, g)), pa.array(counts[p, t, g])], names=["p", "t", "g", "n"])

    found = data.mapInArrow(make, "p int, t int, g int, n bigint").groupBy("p", "t", "g").agg(F.sum("n").alias("n")).collect()  # points x labels x labels
    return [(r.p, r.t, r.g, r.n) for r in found]


def macro_f1(counts: Sequence[tuple[int, int, int]], labels: int) -> float:
    """The mean F1 over labels from (true, guessed, rows); labels that never occur have 0."""
    m = np.zeros((labels, labels))
    for t, g, n in counts:
        m[t, g] += n
    both = m.sum(axis=0) + m.sum(axis=1)
    return float(np.mean(np.where(both > 0, 2 * np.diag(m) / np.maximum(both, 1), 0))) if labels else 0.0


def learning_curve(df: DataFrame, shares: Sequence[float], folds: int, penalty: float = 0.01, tolerance: float = 1e-6) -> DataFrame:
    """``share, n_groups, macro_f1`` of models trained on nested shares of the groups of ``grp, label, fold, v`` rows.

    Groups are in a seeded order, the first part of which is a share, so a larger share
    holds all groups of a smaller one. Each fold is told by models that did not see it. All
    shares, folds and labels are fitted in the same passes.
    """
    labels = [r.label for r in df.select("label").distinct().orderBy("label").collect()]
    number = F.create_map(*(F.lit(x) for i, n in enumerate(labels) for x in (n, i)))
    groups = df.select("grp").distinct().withColumn("o", seeded(F.col("grp"), seed=1))
    placed = materialise(running_sum(groups, F.lit(1), ["o", "grp"]).select("grp", (F.col("run") / F.col("total")).alias("place")), "places")
    rows = df.join(placed, "grp").select(F.array(F.element_at(number, F.col("label"))).alias("y"), F.col("fold").cast("int").alias("fold"), "place", F.col("v").cast("array<double>").alias("v"))
    data = materialise(rows, "training")
    width = len((data.select("v").first() or [[]])[0])
    models = [many_models.Model(k, fold, share, penalty, "logistic", True) for share in shares for fold in range(folds) for k in range(1 if len(labels) == 2 else 0, len(labels))]
    fitted = many_models.fit(data, models, width, len(labels), tolerance=tolerance)
    guessed = _guesses(data, fitted, width, len(labels), per_point=folds)
    n = placed.agg(*(F.count_if(F.col("place") <= s).alias(f"s{i}") for i, s in enumerate(shares))).first()
    out = [(float(s), int(n[i]), round(macro_f1([x[1:] for x in guessed if x[0] == i], len(labels)), 4)) for i, s in enumerate(shares)]
    return df.sparkSession.createDataFrame(out, "share double, n_groups bigint, macro_f1 double")


def one_vs_rest(df: DataFrame, labels: Sequence[str], folds: int, penalty: float = 0.01, tolerance: float = 1e-7) -> DataFrame:
    """``key, label, p``: out-of-fold probabilities of a logistic model a label over vectors.

    ``key, v (array<double>), labels (array<string>), fold`` in; a model sees all rows but its
    fold's. All models are fitted in the same passes.
    """
    number = F.create_map(*(F.lit(x) for i, n in enumerate(labels) for x in (n, i)))
    marks = F.array_compact(F.transform("labels", lambda x: F.try_element_at(number, x)))
    data = materialise(df.where("v is not null").select("key", marks.alias("y"), F.col("fold").cast("int").alias("fold"), F.lit(0.0).alias("place"), "v"), "training")
    width = len((data.select("v").first() or [[]])[0])
    models = [many_models.Model(k, fold, 1.0, penalty) for k in range(len(labels)) for fold in range(folds)]
    fitted = many_models.fit(data, models, width, len(labels), tolerance=tolerance)
    names = F.array(*map(F.lit, labels))
    scored = many_models.out_of_fold(data, fitted, width, len(labels))
    return scored.select("key", F.get(names, (F.col("model") / folds).cast("int")).alias("label"), (1 / (1 + F.exp(-F.col("score")))).alias("p"))


def match_probabilities(df: DataFrame, features: Sequence[str], folds: int, penalty: float = 1e-4, tolerance: float = 1e-6) -> DataFrame:
    """``persona, item, y, p``: out-of-fold probabilities that a judged pair is of the best grade, personas kept together.

    ``persona, item, grade`` and features in; a persona's fold comes from its hash. Features
    are centred and scaled by their mean and deviation over all rows.
    """
    fold = F.pmod(F.crc32(F.concat(F.lit("fold/"), F.col("persona").cast("string")).cast("binary")), F.lit(folds)).cast("int")
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = [(F.col(c).cast("double") - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0) for c in features]
    key = F.struct("persona", "item", (F.col("grade") == 2).cast("int").alias("y"))
    rows = df.select(key.alias("key"), F.when(F.col("grade") == 2, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("y"), fold.alias("fold"), F.lit(0.0).alias("place"), F.array(*scaled).alias("v"))
    data = materialise(rows, "training")
    fitted = many_models.fit(data, [many_models.Model(0, k, 1.0, penalty) for k in range(folds)], len(features), 1, tolerance=tolerance)
    return many_models.out_of_fold(data, fitted, len(features), 1).select("key.persona", "key.item", "key.y", (1 / (1 + F.exp(-F.col("score")))).alias("p"))


def over_seeds(df: DataFrame, model: str, scores: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each score over a model's runs."""
    stats = [f(c).alias(f"{c}_{n}") for c in scores for n, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("std", lambda c: F.round(F.stddev_samp(c), 6)))]
    return df.groupBy(model).agg(F.count("*").alias("n"), *stats)
