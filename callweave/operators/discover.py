""""Matched to you" as one job: kept pairs with their verdict groups, nearest first, with percent and shared words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.operators import matching
from callweave.operators.many_models import summed
from callweave.plans.scratch import materialise


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors ``v`` of a batch, each of length 1; zero vectors stay."""
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def unit_rows(df: DataFrame, key: str, name: str) -> DataFrame:
    """``name`` (the ``key``) and ``__name``, its vector of length 1; rows without a vector are left out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(_unit(batch)), pa.list_(pa.float64()))], names=[name, f"__{name}"])

    kind = dict(df.dtypes)[key]
    return df.where(F.size("v") > 0).select(F.col(key).alias("key"), "v").mapInArrow(make, f"{name} {kind}, __{name} array<double>")


def spread(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``key, mean, std`` of each query's cosine with all items, without meeting any pair.

    The sum of a query's products with unit vectors is its product with their sum, and the
    sum of squares its quadratic form with the sum of their outer products; tasks add up
    both, dimensions squared in size. ``queries``: ``key, v``; ``items``: ``v``.
    """
    rows = items.select("v").where(F.size("v") > 0)
    width = len((rows.select("v").first() or [[]])[0])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            x = _unit(batch) if batch.num_rows else np.zeros((0, width))
            yield np.r_[len(x), x.sum(axis=0), (x.T @ x).ravel()]

    found = summed(rows, make, 1 + width + width * width)
    n, total, outer = max(found[0], 1), found[1 : 1 + width], found[1 + width :].reshape(width, width)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _unit(batch) if batch.num_rows else np.zeros((0, width))
            mean = q @ total / n
            std = np.sqrt(np.maximum(0, ((q @ outer) * q).sum(axis=1) / n - mean * mean))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(mean), pa.array(np.where(std < 1e-9, 0.0, std))], names=["key", "mean", "std"])

    kind = dict(queries.dtypes)["key"]
    return queries.select("key", "v").where(F.size("v") == width).mapInArrow(tell, f"key {kind}, mean double, std double")


def groups(pairs: DataFrame, verdicts: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """``profile_id, opportunity_id, grp, mismatch`` of pairs: not_eligible, other_discipline or fit.

    ``mine``: ``profile_id, disciplines``; ``theirs``: ``opportunity_id, disciplines``.
    """
    known = pairs.join(verdicts.select("profile_id", "opportunity_id", "status"), ["profile_id", "opportunity_id"])
    full = known.join(mine.select("profile_id", F.col("disciplines").alias("__m")), "profile_id", "left").join(theirs.select("opportunity_id", F.col("disciplines").alias("__t")), "opportunity_id", "left")
    told = full.withColumn("mismatch", matching.discipline_mismatch(F.col("__m"), F.col("__t")))
    grp = F.when(F.col("status") == "LIKELY_NOT_ELIGIBLE", "not_eligible").when(F.col("mismatch"), "other_discipline").otherwise("fit")
    return told.select("profile_id", "opportunity_id", grp.alias("grp"), "mismatch")


def matched(grouped: DataFrame, queries: DataFrame, items: DataFrame, mine: DataFrame, theirs: DataFrame, specific: DataFrame, k: int, weights: tuple[float, float, float] = (1.0, 0.3, -0.5), intercept: float = -1.0) -> DataFrame:
    """``profile_id, grp, pos, opportunity_id, percent, n_shared, sim``.

    ``grouped``: pairs that the preferences keep, from ``groups``; ``queries``: ``key, v`` of
    profiles; ``items``: ``item, v`` of all calls, which the statistics see; ``mine``, ``theirs``:
    ``key, text``. Of each profile and group the ``k`` nearest stay, before any words are
    read; these are put in order by percent, then by nearness, ties to the smaller call.
    Pairs without a vector on either side are left out.
    """
    near = grouped.join(unit_rows(queries, "key", "profile_id"), "profile_id").join(unit_rows(items, "item", "opportunity_id"), "opportunity_id")
    sim = F.round(F.aggregate(F.zip_with("__profile_id", "__opportunity_id", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 12)
    w = Window.partitionBy("profile_id", "grp").orderBy(F.desc("sim"), "opportunity_id")
    kept = near.select("profile_id", "opportunity_id", "grp", "mismatch", sim.alias("sim")).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
    kept = materialise(kept, "kept")
    # each text's specific words as one list, so that pairs are not multiplied by words
    word = specific.select("word")
    listed = lambda texts, key, name: texts.select(F.col("key").alias(key), F.explode(matching.topic_words(F.col("text"))).alias("word")).join(word, "word").groupBy(key).agg(F.collect_list("word").alias(name))
    both = kept.join(listed(mine, "profile_id", "__a"), "profile_id", "left").join(listed(theirs, "opportunity_id", "__b"), "opportunity_id", "left")
    shared = both.withColumn("n_shared", F.size(F.array_intersect("__a", "__b")).cast("bigint")).drop("__a", "__b")
    full = shared.join(spread(queries, items).withColumnRenamed("key", "profile_id"), "profile_id")
    rated = matching.match_percent(full.withColumn("n_shared", F.coalesce("n_shared", F.lit(0))), weights, intercept)
    order = Window.partitionBy("profile_id", "grp").orderBy(F.desc("percent"), F.desc("sim"), "opportunity_id")
    return rated.withColumn("pos", F.row_number().over(order)).select("profile_id", "grp", "pos", "opportunity_id", "percent", "n_shared", "sim")
