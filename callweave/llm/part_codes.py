"""Vector codes: codebooks for parts of vectors, fitted over Hilbert-sorted flat blocks.

1. Components become integers and each vector is cut into equal parts.
2. Each part position's parts are sorted along a Hilbert curve and packed into flat blocks of
   neighbours. A block stores its rows, its components, the box of their least and largest
   values, and their sums.
3. In each round, distances from the corners of a block's box leave a shortlist of entries:
   one that is farther than another from its own best corner is out. A block with one entry
   left goes to it whole, by its stored sums; in the others exact integer kernels compare
   each part with the shortlist alone.
4. Sums and counts are added up by part, entry and component; the driver only holds codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.plans.scratch import materialise

#: Components that the curve runs through at most, and the bits of its places.
CURVE_AXES, CURVE_BITS = 31, 62
#: Parts that a kernel compares at a time.
TOGETHER = 1 << 14
#: Parts of labels that very many rows share, in the join with their sums.
LABEL_PARTS = 16


@dataclass(frozen=True)
class Params:
    """``parts`` a vector, ``entries`` a codebook, ``rounds`` of fitting; components are floor(``scale`` * x); ``block`` parts in a block."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    block: int = 64


def whole_vectors(df: DataFrame, p: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``row, vec_id, label, v array<bigint>`` of the rows whose vector is neither null nor holds null or non-finite components."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.where(v.isNotNull() & ~bad)
    exact = F.transform(v, lambda x: F.floor(x.cast("double") * p.scale))
    # rows are named once and written, so that a task that runs again gives the same names
    return materialise(kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), exact.alias("v")), "vectors")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points (n, axes) with ``bits`` bits an axis, by the transpose of Skilling (2004)."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(axes):
            hit = (x[:, i] >> b & 1).astype(bool)
            swap = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(hit, low, swap)
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[:, -1] >> b & 1, (1 << b) - 1, 0)
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = out << 1 | (x[:, i] >> b & 1)
    return out


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def parts_table(vectors: DataFrame, p: Params, width: int, low: int, high: int) -> DataFrame:
    """``part, place, row, data``: each part of ``width`` components with its place on the curve between ``low`` and ``high``."""
    axes = min(width, CURVE_AXES)
    bits = max(1, min(16, CURVE_BITS // max(1, axes)))
    step = max(1, -(-(high - low + 1) // (1 << bits)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            v = _matrix(batch.column("v"), p.parts * width)
            for part in range(p.parts):
                own = np.ascontiguousarray(v[:, part * width : (part + 1) * width])
                place = hilbert((own[:, :axes] - low) // step, bits) if axes else np.zeros(len(own), np.int64)
                small = own.astype(_kind(low, high))
                data = [x.tobytes() for x in small]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(place), rows, pa.array(data, pa.binary())], names=["part", "place", "row", "data"])

    return vectors.select("row", "v").mapInArrow(make, "part int, place bigint, row bigint, data binary")


def _kind(low: int, high: int) -> str:
    return next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)


BLOCKS = "part int, n int, low array<bigint>, high array<bigint>, sums array<bigint>, rows binary, data binary"


def blocks(parts: DataFrame, p: Params, width: int, kind: str) -> DataFrame:
    """Flat blocks (BLOCKS) of ``block`` neighbours along each part's curve; equal places are dealt by row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            rows = batch.column("row").to_numpy()
            data = np.frombuffer(b"".join(batch.column("data").to_pylist()), kind).reshape(len(part), width)
            cuts = np.flatnonzero(np.diff(part)) + 1
            out = []
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(part)], strict=True):
                for at in range(a, b, p.block):
                    x = data[at : min(at + p.block, b)]
                    wide = x.astype(np.int64)
                    out.append((int(part[at]), len(x), wide.min(axis=0), wide.max(axis=0), wide.sum(axis=0), rows[at : at + len(x)].tobytes(), x.tobytes()))
            columns = list(zip(*out, strict=True))
            lists = [pa.array([x.tolist() for x in c], pa.list_(pa.int64())) for c in columns[2:5]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *lists, pa.array(columns[5], pa.binary()), pa.array(columns[6], pa.binary())], names=[c.split()[0] for c in BLOCKS.split(", ")])

    order = ("part", "place", "row")
    return parts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(make, BLOCKS)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(blocks, entries): whether a part in the block's box may be nearest to the entry.

    An entry goes if another is nearer to every point of the box: the difference of two
    squared distances is linear in the point, so it is greatest in the corner that lies
    farthest towards the entry.
    """
    square = (book * book).sum(axis=1)
    # 2 x (f - e) is least in that corner; greatest d(x, f) - d(x, e), a component at a time
    most = np.broadcast_to(square[None, None, :] - square[None, :, None], (len(low), len(book), len(book))).copy()
    for k in range(low.shape[1]):
        step = 2 * (book[None, :, k] - book[:, None, k])  # [e, f]
        most -= np.where(step > 0, low[:, None, None, k], high[:, None, None, k]) * step
    return ~(most < 0).any(axis=2)


def nearest(x: np.ndarray, book: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For parts (n, width) the nearest entry of the ascending places ``short``, ties to the lower, and its squared distance."""
    codes, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), TOGETHER):
        own = x[at : at + TOGETHER].astype(np.int64)
        d = np.zeros((len(short), len(own)), np.int64)
        for k in range(own.shape[1]):
            e = own[None, :, k] - book[short, None, k]
            d += e * e
        best = d.argmin(axis=0)
        codes[at : at + TOGETHER], least[at : at + TOGETHER] = short[best], d[best, np.arange(len(own))]
    return codes, least


@dataclass(frozen=True)
class Group:
    """Blocks of one part with one shortlist: their places in the batch, the places of their parts, codes and distances (None if one entry takes all)."""

    part: int
    short: np.ndarray
    blocks: np.ndarray
    at: np.ndarray | None = None
    code: np.ndarray | None = None
    distance: np.ndarray | None = None


def assigned(batch: pa.RecordBatch, books: np.ndarray, x: np.ndarray, whole: bool) -> Iterator[Group]:
    """The blocks of a batch, with the components ``x`` of all their parts, in groups of one shortlist; ``whole`` passes on single entries."""
    width = books.shape[2]
    part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
    start = np.cumsum(n) - n
    low, high = _matrix(batch.column("low"), width), _matrix(batch.column("high"), width)
    for own in np.unique(part).tolist():
        every = np.flatnonzero(part == own)
        lists, group = np.unique(shortlists(low[every], high[every], books[own]), axis=0, return_inverse=True)
        for g, row in enumerate(lists):
            short, found = np.flatnonzero(row), every[group.ravel() == g]
            if whole and len(short) == 1:
                yield Group(own, short, found)
                continue
            at = np.repeat(start[found] - np.cumsum(n[found]) + n[found], n[found]) + np.arange(n[found].sum())
            yield Group(own, short, found, at, *nearest(x[at], books[own], short))


def _components(batch: pa.RecordBatch, kind: str, width: int) -> np.ndarray:
    n = int(batch.column("n").to_numpy().sum())
    return np.frombuffer(b"".join(batch.column("data").to_pylist()), kind).reshape(n, width)


def round_sums(table: DataFrame, books: np.ndarray, kind: str) -> DataFrame:
    """``part, entry, component, total``; component -1 counts the parts of an entry."""
    width = books.shape[2]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((*books.shape[:2], width + 1), np.int64)
        for batch in batches:
            n, own_sums, x = batch.column("n").to_numpy(), _matrix(batch.column("sums"), width), _components(batch, kind, width)
            for g in assigned(batch, books, x, whole=True):
                if g.code is None:
                    sums[g.part, g.short[0]] += np.r_[own_sums[g.blocks].sum(axis=0), n[g.blocks].sum()]
                    continue
                for entry in np.unique(g.code).tolist():
                    mine = x[g.at[g.code == entry]]
                    sums[g.part, entry] += np.r_[mine.sum(axis=0, dtype=np.int64), len(mine)]
        part, entry, component = np.nonzero(sums)
        named = np.where(component == width, -1, component)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(named.astype(np.int32)), pa.array(sums[part, entry, component])], names=["part", "entry", "component", "total"])

    return table.select("part", "n", "low", "high", "sums", "data").mapInArrow(make, "part int, entry int, component int, total bigint")


def next_books(found: DataFrame, books: np.ndarray) -> np.ndarray:
    """The means, rounded down, of the parts of each entry; entries without parts stay. Parts x entries x components rows come to the driver."""
    out = books.copy()
    rows = found.groupBy("part", "entry", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect()
    counts = {(r.part, r.entry): int(r.s) for r in rows if r.component < 0}
    for part, entry in counts:
        out[part, entry] = 0  # sums of zero have no row
    for r in rows:
        if r.component >= 0:
            out[r.part, r.entry, r.component] = int(r.s) // counts[r.part, r.entry]
    return out


def first_books(vectors: DataFrame, p: Params, width: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids, ties to the lesser vector; null ids come last."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(p.entries).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), p.parts, width).transpose(1, 0, 2)


@dataclass(frozen=True)
class Codes:
    """Codebooks (part, entry, component), and ``row, vec_id, label, code, error`` for each vector."""

    books: np.ndarray
    rows: DataFrame

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def codes_of(table: DataFrame, books: np.ndarray, kind: str) -> DataFrame:
    """``row, part, code, error`` of every part."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("rows").to_pylist()), np.int64)
            for g in assigned(batch, books, _components(batch, kind, books.shape[2]), whole=False):
                part = np.full(len(g.at), g.part, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(rows[g.at]), pa.array(part), pa.array(g.code.astype(np.int32)), pa.array(g.distance)], names=["row", "part", "code", "error"])

    return table.select("part", "n", "low", "high", "rows", "data").mapInArrow(make, "row bigint, part int, code int, error bigint")


def fit(df: DataFrame, p: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes:
    """Fits codebooks and gives every vector its code.

    Rows whose vector is null or holds null or non-finite components are left out; all
    others count, repeated rows and null ids too. All vectors need one length that ``parts``
    divides, and components so small that squared distances fit into 64 bits; otherwise the
    call fails. Vectors of no components have all codes 0. A table without vectors has empty
    codebooks and no rows.
    """
    vectors = whole_vectors(df, p, id_col, vector_col, label_col)
    seen = vectors.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    if seen.a is None:
        return Codes(np.zeros((p.parts, 0, 0), np.int64), vectors.select("row", "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")))
    if seen.a != seen.b or seen.a % p.parts:
        raise ValueError(f"vectors have {seen.a} to {seen.b} components; one length that {p.parts} divides is needed")
    width, low, high = seen.a // p.parts, seen.low or 0, seen.high or 0
    if 8 * seen.a * max(-low, high) ** 2 >= 1 << 63:
        raise ValueError("components are too large for exact squared distances in 64 bits")
    kind = _kind(low, high)
    books = first_books(vectors, p, width)
    table = materialise(blocks(parts_table(vectors, p, width, low, high), p, width, kind), "blocks")
    for _ in range(p.rounds):
        books = next_books(round_sums(table, books, kind), books)
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda x: F.lower(F.lpad(F.hex(x["code"]), 2, "0"))), "")
    coded = codes_of(table, books, kind).groupBy("row").agg(digits.alias("code"), F.sum("error").alias("error"))
    return Codes(books, vectors.select("row", "vec_id", "label").join(coded, "row"))


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` of all rows with an equal label; nulls are equal. Labels of many rows are met in parts."""
    written = materialise(rows.withColumn("__part", F.pmod(F.xxhash64("row"), F.lit(LABEL_PARTS)).cast("int")), "coded")
    sums = written.groupBy(F.col("label").alias("__label")).agg(F.sum("error").cast("bigint").alias("label_error"))
    dealt = sums.withColumn("__own", F.explode(F.sequence(F.lit(0), F.lit(LABEL_PARTS - 1))))
    joined = written.join(dealt, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__part") == F.col("__own")))
    return joined.select(*rows.columns, "label_error")
