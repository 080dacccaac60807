"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform turn a unit vector pseudo-
randomly; its bucket in a table is the nearest signed axis, and in large tables also that of
a second, smaller cross-polytope. A query ranks the buckets of all tables together by how
near their axes are, and probes the first of them; how many is measured on a bounded sample
of queries. Queries and vectors that meet in a bucket are scored in one task by a matrix
product, and the best are scored again, exactly, on the original vectors. Large buckets are
dealt into cells of bounded size, in each of which queries keep their best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from callweave.plans.scratch import materialise

VECTORS_IN_CELL = 16_384
QUERIES_IN_CELL = 2_048
#: Vectors that a bucket should hold; finer buckets are made up to ``MOST_EXTRA`` axes of a second polytope.
IN_BUCKET = 800
MOST_EXTRA = 32
#: Queries that set the number of probes.
TUNED_ON = 64


@dataclass(frozen=True)
class Index:
    """``tables`` rotations with ``buckets`` each; a query looks into the ``probes`` best of all.

    ``longest``: the largest norm. With ``lifted``, where norms differ, a coordinate is
    added that makes all norms equal, so that the largest inner product is the nearest.
    ``extra``: signed axes of the second polytope, 1 without. ``kind``: the components' type.
    """

    dimension: int
    longest: float
    lifted: bool
    kind: str = "<f8"
    extra: int = 1
    tables: int = 8
    probes: int = 96
    seed: int = 5

    @property
    def width(self) -> int:
        return 1 << max(1, int(np.ceil(np.log2(self.dimension + self.lifted))))

    @property
    def buckets(self) -> int:
        return 2 * self.width * self.extra


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x


def _signed(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, -x], axis=1)


def axes(x: np.ndarray, index: Index, queries: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each table the rows' coordinates on the signed axes of both polytopes; vectors are lifted to one norm, queries are not."""
    wide = np.zeros((len(x), index.width))
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    wide[:, : index.dimension] = x / (norms if queries or not index.lifted else index.longest)
    if index.lifted and not queries:
        wide[:, index.dimension] = np.sqrt(np.maximum(0, 1 - (norms[:, 0] / index.longest) ** 2))
    for t in range(index.tables):
        parts = []
        for part in range(2 if index.extra > 1 else 1):
            rng, turned = np.random.default_rng([index.seed, t, part]), wide
            for _ in range(3):
                turned = hadamard(turned * rng.choice([-1.0, 1.0], index.width)) / np.sqrt(index.width)
            parts.append(_signed(turned if part == 0 else turned[:, : index.extra // 2]))
        yield parts[0], parts[1] if len(parts) > 1 else np.zeros((len(x), 1))


def own_buckets(x: np.ndarray, index: Index) -> np.ndarray:
    """The bucket of each vector in each table, numbered through all tables."""
    return np.stack([t * index.buckets + a.argmax(axis=1) * index.extra + b.argmax(axis=1) for t, (a, b) in enumerate(axes(x, index, False))], axis=1)


def nearness(x: np.ndarray, index: Index) -> np.ndarray:
    """How near each query is to every bucket of all tables."""
    return np.concatenate([(a[:, :, None] + b[:, None, :]).reshape(len(x), -1) for a, b in axes(x, index, True)], axis=1)


def probed(x: np.ndarray, index: Index) -> np.ndarray:
    """The buckets that each query probes."""
    near = nearness(x, index)
    if index.probes >= near.shape[1]:
        return np.broadcast_to(np.arange(near.shape[1]), near.shape)
    return np.argpartition(-near, index.probes - 1, axis=1)[:, : index.probes]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part: not null, not zero, all components finite."""
    single = isinstance(df.schema[vector_col].dataType, T.ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def fit(vectors: DataFrame, **how) -> Index | None:
    """The index of all vectors of the most frequent length (the larger on a tie); None without any."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.min(norm).alias("least"))
    top = size.orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return None
    kind = "<f4" if isinstance(vectors.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    index = Index(top["d"], top["most"], top["least"] < top["most"] * (1 - 1e-4), kind, **how)
    if "extra" not in how:
        extra = 1
        while extra < min(MOST_EXTRA, index.width) and top["n"] > IN_BUCKET * index.buckets * extra:
            extra *= 2
        index = replace(index, extra=extra if extra > 1 else 1)
    return index


def _matrix(batch: pa.RecordBatch, index: Index) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, index.dimension).astype(np.float64)


def _unpacked(column: pa.ChunkedArray, index: Index) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), index.kind).reshape(-1, index.dimension).astype(np.float64)


def _sample(rows: DataFrame, most: int, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the ``most`` rows of different ids with the smallest hashes."""
    table = rows.orderBy(F.xxhash64("vec_id", F.lit(index.seed)), "vec_id").limit(most).toArrow()
    ids, first = np.unique(table.column("vec_id").to_numpy(), return_index=True)
    return ids, _unpacked(table.column("v"), index)[first]


def packed(same: DataFrame, is_query, index: Index) -> DataFrame:
    """``vec_id, v`` (packed components), ``q`` (whether a query), ``own`` (bucket in each table)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = _matrix(batch, index)
                own = own_buckets(x, index).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * index.tables), pa.array(own.ravel()))
                raw = pa.array([r.tobytes() for r in x.astype(index.kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), raw, batch.column("q"), lists], names=["vec_id", "v", "q", "own"])

    rows = same.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("q"))
    return rows.mapInArrow(make, "vec_id bigint, v binary, q boolean, own array<int>")


def tuned(rows: DataFrame, index: Index, k: int, share: float = 0.98) -> Index:
    """The index with so many probes that TUNED_ON sample queries meet ``share`` of their k nearest, found by comparing them with all rows."""
    names, q = _sample(rows.where("q"), TUNED_ON, index)
    if not len(names):
        return index
    near = nearness(q, index)
    rank = np.empty(near.shape, np.int32)
    np.put_along_axis(rank, np.argsort(-near, axis=1, kind="stable"), np.arange(near.shape[1], dtype=np.int32)[None, :], axis=1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            if not len(ids):
                continue
            own = np.array(batch.column("own").flatten()).reshape(-1, index.tables)
            s = q @ _unpacked(batch.column("v"), index).T
            s[names[:, None] == ids[None, :]] = -np.inf
            top = np.argpartition(-s, min(k, len(ids)) - 1, axis=1)[:, :k]
            at = np.repeat(np.arange(len(q)), top.shape[1])
            needed = rank[at[:, None], own[top.ravel()]].min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(s[at, top.ravel()]), pa.array(needed)], names=["at", "s", "needed"])

    found = rows.select("vec_id", "v", "own").mapInArrow(best, "at bigint, s double, needed int").where("s > double('-inf')")
    w = Window.partitionBy("at").orderBy(F.desc("s"), "needed")
    ranks = sorted(r["needed"] for r in found.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).select("needed").collect())
    return replace(index, probes=ranks[int(np.ceil(share * len(ranks))) - 1] + 1) if ranks else index


def with_probes(queries: DataFrame, index: Index) -> DataFrame:
    """``vec_id, v, probe``: each query's buckets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                probes = probed(_unpacked(batch.column("v"), index), index).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(probes) + 1, dtype=np.int32) * probes.shape[1]), pa.array(probes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], names=["vec_id", "v", "probe"])

    return queries.select("vec_id", "v").mapInArrow(make, "vec_id bigint, v binary, probe array<int>")


def _cells(vectors: DataFrame, queries: DataFrame, seed: int) -> DataFrame:
    """Rows of ``b, vec_id, v`` dealt into cells of one bucket, in which every pair meets once.

    Sizes are counted by bucket; their table has at most a row a bucket, which the index bounds.
    """
    size = lambda df, most, name: df.groupBy("b").agg(F.ceil(F.count("*") / most).alias(name))
    sizes = F.broadcast(size(vectors.select("b"), VECTORS_IN_CELL, "nv").join(size(queries.select("b"), QUERIES_IN_CELL, "nq"), "b"))
    salt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    v = vectors.join(sizes, "b").select("b", salt("nv").alias("i"), each("nq").alias("j"), F.lit(False).alias("side"), "vec_id", "v")
    q = queries.join(sizes, "b").select("b", each("nv").alias("i"), salt("nq").alias("j"), F.lit(True).alias("side"), "vec_id", "v")
    return v.union(q)


def _best(cells: DataFrame, index: Index, k: int) -> DataFrame:
    """In each cell, each query's k best vectors by exact score, ties to the smaller id."""

    def score(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(zero_copy_only=False), table.column("vec_id").to_numpy()
        x = _unpacked(table.column("v"), index)
        at, base = np.flatnonzero(side), np.flatnonzero(~side)
        if len(base):  # of equal vectors only the k + 1 smallest ids can be among a query's k best
            mark = (x[base].view(np.uint64) * np.random.default_rng(index.seed).integers(0, 2**63, index.dimension, np.uint64)).sum(axis=1)
            order = np.lexsort((ids[base], mark))
            run = (mark[order][1:] == mark[order][:-1]) & (x[base[order[1:]]] == x[base[order[:-1]]]).all(axis=1)
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(np.r_[False, run], 0, np.arange(len(order))))
            base = base[order[place <= k]]
        kind = np.float32 if index.longest < 1e15 else np.float64
        names, vectors, rough_v = ids[base], x[base], x[base].astype(kind)
        slack = index.longest * np.finfo(kind).eps * (index.dimension + 8)
        out = [], [], []
        for lo in range(0, len(at), 256):
            part = at[lo : lo + 256]
            rough = x[part].astype(kind) @ rough_v.T
            rough[ids[part][:, None] == names[None, :]] = -np.inf
            floor = np.full(len(part), -np.inf)
            if len(names) > k:
                floor = np.partition(rough, len(names) - k, axis=1)[:, len(names) - k] - 2 * slack * np.linalg.norm(x[part], axis=1)
            r, c = np.nonzero((rough >= floor[:, None]) & (rough > -np.inf))
            exact = np.concatenate([(x[part[r[i : i + 50_000]]] * vectors[c[i : i + 50_000]]).sum(axis=1) for i in range(0, len(r), 50_000)] or [np.zeros(0)])
            order = np.lexsort((names[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < k
            for to, values in zip(out, (ids[part][r[keep]], names[c[keep]], exact[keep]), strict=True):
                to.append(values)
        cat = lambda xs, t: pa.array(np.concatenate([*xs, np.zeros(0, t)]).astype(t))
        return pa.table({"query_id": cat(out[0], np.int64), "vec_id": cat(out[1], np.int64), "score": cat(out[2], np.float64)})

    found = cells.groupBy("b", "i", "j").applyInArrow(score, "query_id bigint, vec_id bigint, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", share: float = 0.98, **how) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k vectors of largest inner product that are found.

    ``is_query``: a condition on ``vec_id``. A query is no candidate of its own. Vectors that
    are null, zero, of another than the most frequent length, or hold null or non-finite
    components take no part; a null id neither. Rows with one id count once, by their best
    score; equal scores go to the smaller id. ``share``: what the sample queries must find
    of their k nearest, which sets the probes unless ``probes`` is given. Where the buckets
    hold fewer than k candidates of a query, though more exist, it is compared with all
    vectors, in blocks. Other columns are left out; an empty table gives none.
    """
    vectors = usable(df, id_col, vector_col)
    index = fit(vectors, **how)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = materialise(packed(vectors.where(F.size("v") == index.dimension), is_query, index), "packed")
    if "probes" not in how:
        index = tuned(rows, index, k, share)
    queries = materialise(with_probes(rows.where("q"), index), "probes")
    lists = rows.select(F.explode("own").alias("b"), "vec_id", "v"), queries.select(F.explode("probe").alias("b"), "vec_id", "v")
    found = materialise(_best(_cells(*lists, index.seed), index, k), "found")
    total = rows.select("vec_id").distinct().count()
    counted = queries.select(F.col("vec_id").alias("query_id")).distinct().join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    short = materialise(counted.where(F.coalesce("n", F.lit(0)) < min(k, total - 1)).select(F.col("query_id").alias("vec_id")), "short")
    if not short.isEmpty():
        one = F.lit(0).alias("b")
        again = queries.join(short, "vec_id").select(one, "vec_id", "v")
        found = found.union(_best(_cells(rows.select(one, "vec_id", "v"), again, index.seed), index, k)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
