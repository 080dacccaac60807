"""Queries that train: folds of whole groups, learning curves, scores over seeds. SQL can't express them; tests hold brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import learning
from callweave.plans.registry import query
from callweave.plans.scratch import materialise


@query()
def v01_greedy_folds(t):
    return learning.stratified_folds(t("annotations"), "grp", "label", 4)


@query()
def v01_share_deviation(t):
    """How much label shares deviate over the folds: groups dealt with regard to their labels, and in turn."""
    rows, out = t("annotations"), None
    for name, deal in (("greedy", learning.stratified_folds), ("in turn", learning.dealt_folds)):
        folds = materialise(deal(rows, "grp", "label", 4), "folds")
        found = learning.share_deviation(rows, folds, "grp", "label").withColumn("way", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def _vectors(t, seed: int = 1):
    """Vectors with their label, and folds of whole groups of eight neighbours."""
    rows = t("embeddings").select(F.floor(F.col("vec_id") / 8).alias("grp"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    folds = materialise(learning.stratified_folds(rows, "grp", "label", 3, seed), "folds")
    return rows.join(folds, "grp")


@query()
def v09_trained_curve(t):
    return learning.learning_curve(_vectors(t), [0.25, 0.5, 0.75, 1.0], 3)


@query()
def v06_trained_seeds(t):
    """Mean and deviation of the macro F1 over three seeds of the folds."""
    runs = None
    for seed in (1, 2, 3):
        run = learning.learning_curve(_vectors(t, seed), [1.0], 3).select(F.lit("vectors").alias("model"), F.col("macro_f1").alias("f1"))
        runs = run if runs is None else runs.union(run)
    return learning.over_seeds(runs, "model", ["f1"])
