"""Hierarchical weighted hash tree: region, rack and shard by weighted hash draws.

A row descends the tree. On each level every child draws ``-ln(u) / weight`` with ``u``
hashed from the key and the child's path, and the smallest draw wins, so that a child gets
rows in proportion to its weight, and a change of one weight moves rows only into or out of
the subtree that has it. Draws use MD5, so other engines can repeat them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Leaf:
    """One shard with its place in the tree and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """``shards`` equal shards, put into racks and regions in order."""
    if shards < 1:
        raise ValueError("a tree needs at least one shard")
    rack = lambda s: s // per_rack
    return [Leaf(f"g{rack(s) // racks_per_region}", f"r{rack(s)}", s) for s in range(shards)]


def grown(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region and rack of its own.

    No other subtree's weight changes, so rows move into the new shard only.
    """
    s = max(x.shard for x in leaves) + 1
    return [*leaves, Leaf(f"g+{s}", f"r+{s}", s, weight)]


def _uniform(key: Column, path: Column) -> Column:
    """In (0, 1): 52 bits of MD5 over the child's path and the key."""
    digits = F.substring(F.md5(F.concat(path, F.lit("/"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def _descend(key: Column, children: Column) -> Column:
    """The ``at`` of the child with the smallest draw, the first of these on a tie."""
    draws = F.transform(children, lambda c: F.struct((-F.log(_uniform(key, c["path"])) / c["weight"]).alias("draw"), c["at"].alias("at")))
    return F.array_min(draws)["at"]


def _children(nodes: Sequence[tuple[str, float, int]]) -> Column:
    return F.array(*(F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(at).alias("at")) for p, w, at in nodes))


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of a key. Shards of weight 0 get nothing; null keys count as an empty key."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")
    tree: dict[str, dict[str, list[Leaf]]] = {}
    for x in live:
        tree.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    regions, racks, shards = [], [], []  # racks[i]: children of region i; shards[j]: children of rack j
    for g, inner in tree.items():
        own = []
        for r, xs in inner.items():
            own.append((f"{g}/{r}", sum(x.weight for x in xs), len(shards)))
            shards.append(_children([(f"{g}/{r}/{x.shard}", x.weight, x.shard) for x in xs]))
        regions.append((g, sum(w for _, w, _ in own), len(racks)))
        racks.append(_children(own))
    region = _descend(key, _children(regions))
    rack = _descend(key, F.get(F.array(*racks), region))
    return _descend(key, F.get(F.array(*shards), rack))


def assign_shards(df: DataFrame, leaves: Sequence[Leaf], id_col: str = "doc_id", text_col: str = "text", buckets: int = 256) -> DataFrame:
    """Shard and slot of every row, and its shard if the tree grows by one.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. ``size``: UTF-8 bytes
    of the text plus 16. ``slot``: 0, 1, ... without a gap in each shard, in the order of
    (bucket of the id's hash, id, checksum); rows equal in all of these get their slots in
    any order. Only ids are read to count the ``shards x buckets`` groups, and no window
    spans a whole shard. Null texts count as empty; rows with a null id go where the empty
    key goes; an empty table gives an empty table; other columns are left out.
    """
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    placed = df.select(key.alias("doc_id"), text.alias("__t")).select(
        "doc_id",
        (F.octet_length("__t").cast("bigint") + 16).alias("size"),
        F.crc32(F.col("__t").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), leaves).alias("shard"),
        shard_of(F.col("doc_id"), grown(leaves)).alias("grown_shard"),
        _bucket(F.col("doc_id"), buckets).alias("__b"),
    )
    groups = df.select(shard_of(key, leaves).alias("shard"), _bucket(key, buckets).alias("__b")).groupBy("shard", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("shard", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("shard", "__b").orderBy("doc_id", "text_crc32", "size")
    # at most len(leaves) * buckets rows, so the broadcast has a bound that no input moves
    return (
        placed.withColumn("__i", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "__b"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("__o") + F.col("__i") - 1).alias("slot"), "grown_shard")
    )


def _bucket(key: Column, buckets: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit("slot/"), F.coalesce(key.cast("string"), F.lit("")))), 1, 7)
    return F.conv(digits, 16, 10).cast("int") % buckets
