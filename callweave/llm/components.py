"""Connected components by alternating large-star and small-star steps.

Before each pair of steps every partition replaces its links by stars around the smallest
node of what they connect. A node has one link down to a smaller node for each partition
then, so only the links up to larger nodes can be very many. Minima are made from the links
down alone; links up are met in a join that Spark splits where a node has very many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.plans.scratch import materialise

#: Links that are replaced by stars together: a bound on a task's memory.
TOGETHER = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest one that these links connect it with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while ((up := least[least]) != least).any():
            least = up
    far = least != np.arange(len(nodes))
    return nodes[far], nodes[least[far]]


def contracted(links: DataFrame) -> DataFrame:
    """The links ``u, v`` with each partition's replaced by stars, of ``u`` larger than ``v``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0
        for batch in batches:
            us.append(batch.column("u").to_numpy())
            vs.append(batch.column("v").to_numpy())
            held += batch.num_rows
            if held >= TOGETHER:
                yield packed(us, vs)
                us, vs, held = [], [], 0
        if held:
            yield packed(us, vs)

    def packed(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
        u, v = stars(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return links.select("u", "v").mapInArrow(make, "u bigint, v bigint")


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours; ``u`` is larger than ``v``."""
    # written, so that both sides of the join come from files: Spark broadcasts a small side and splits a node with many links
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least").select(F.col("u").alias("v"), "m")
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these; a node may not have very many of them."""
    least = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    # the smallest neighbour's own link is the one with v = m
    return least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether each node has one link down at most, and no node links both up and down."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 and down > 0").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of the links ``u, v``: the smallest node reachable.

    Self links and repeats do no harm; nulls are left out; no links give no rows. Each round
    is written to the shared folder; only whether it is the last comes to the driver.
    """
    links = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u <> v")
    now = materialise(links, "links")
    for _ in range(most_rounds):
        now = materialise(contracted(now), "links")
        if are_stars(now):
            break
        now = materialise(small_star(large_star(now)), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
