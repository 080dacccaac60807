"""MinHash near-duplicates: universal hash minima, banding, verification, components.

1. Documents with one word sequence form a class; only classes go on.
2. A class's set of word shingles is hashed by many universal functions. Their minima make
   up its signature, and bands of the signature are bucket keys.
3. Every member of a bucket is tied to the bucket's smallest class. These ties connect
   whole buckets, so any two classes that share a bucket are in one candidate group.
4. Within a candidate group, pairs whose signatures agree are verified first, on full sets;
   what these links do not connect is then compared exactly, whatever its signatures, so
   that no link is lost. Groups beyond one block are dealt into blocks of bounded numbers
   and sizes: all members against the first block, then the members outside the largest
   component found against all blocks. No pair is emitted; each cell of blocks returns a
   forest of its links.
5. The links' components, by alternating stars, are the near-duplicate classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.llm.components import components
from callweave.plans.scratch import materialise


@dataclass(frozen=True)
class Params:
    """``bands`` of ``rows`` minima: two sets of similarity 0.8 share no band 8 times in a million.

    ``block`` and ``block_shingles``: classes, and the sum of their set sizes, in one block;
    a task compares two blocks.
    """

    words: int = 5
    percent: int = 80
    bands: int = 50
    rows: int = 7
    block: int = 512
    block_shingles: int = 1 << 19
    seed: int = 7


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles.

    A-Z become small letters; words are parted by ASCII white space. A text of fewer words
    has its whole sequence as one shingle; without words the set is empty.
    """
    words = (text or "").encode().lower().split()  # bytes: only ASCII is folded and parted
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n, width = max(1, len(h) - k + 1), min(k, len(h))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of (a x + b) mod 2^64 over the set, upper half, for each universal function."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 512):  # blocks that stay in cache
        part = a[:, None] * x[None, at : at + 512]
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def functions(p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    n = p.bands * p.rows
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """``doc_id, class (digest of the word sequence), n_shingles, bands array<bigint>``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = functions(p)
        seen: dict[bytes, tuple[int, bytes]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                digests, sizes, bands = [], [], []
                for text in batch.column("text").to_pylist():
                    digest = hashlib.blake2b(b" ".join((text or "").encode().lower().split()), digest_size=16).digest()
                    if digest not in seen:
                        s = shingles(text, p.words)
                        keys = b""
                        if len(s):
                            rows = minima(s, a, b).reshape(p.bands, p.rows)
                            keys = b"".join(xxhash.xxh3_64_digest(r.tobytes(), seed=i) for i, r in enumerate(rows))
                        if len(seen) > 20_000:
                            seen.clear()
                        seen[digest] = (len(s), keys)
                    n, keys = seen[digest]
                    digests.append(digest)
                    sizes.append(n)
                    bands.append(keys)
                ends = np.cumsum([0, *(len(k) // 8 for k in bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(bands), np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "class", "n_shingles", "bands"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id bigint, class binary, n_shingles bigint, bands array<bigint>")


def forest(sets: list[np.ndarray], first: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Links that span the components of the pairs (i, j) with i in ``first`` and similarity of ``percent`` or more.

    Signatures set the order alone: pairs whose minima agree are verified on full sets
    first. Pairs that no component holds then are all counted exactly, through a matrix over
    the shingles that two or more sets hold.
    """
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    parent, out = np.arange(m), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def link(i: int, j: int) -> None:
        x, y = root(i), root(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))

    a, b = functions(Params(bands=8, rows=8, seed=p.seed + 1))
    marks = np.stack([minima(s, a, b) for s in sets]) if m else np.zeros((0, len(a)), np.uint32)
    rows = np.flatnonzero(first & (size > 0))
    for i in rows.tolist():
        missed = 0
        for j in np.flatnonzero((marks == marks[i]).sum(axis=1) >= len(a) * (p.percent / 100 - 0.1)).tolist():
            if j != i and size[j] and root(i) != root(j):
                n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * n >= p.percent * (size[i] + size[j] - n):
                    link(i, j)
                else:
                    missed += 1
                    if missed == 8:  # the exact count below decides about the others
                        break
    roots = np.array([root(i) for i in range(m)])
    if not len(rows) or len(np.unique(roots[size > 0])) < 2:
        return out
    names, inv, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[inv]
    owner = np.repeat(np.arange(m), size)[column >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(rows), m), np.int32)
    for lo in range(0, int((times > 1).sum()), 4096):  # columns in blocks bound the memory
        x, y = np.searchsorted(column, (lo, lo + 4096))
        dense = np.zeros((m, 4096), np.float32)
        dense[owner[x:y], column[x:y] - lo] = 1
        common += np.rint(dense[rows] @ dense.T).astype(np.int32)
    close = (100 * common >= p.percent * (size[rows][:, None] + size[None, :] - common)) & (size > 0)[None, :] & (roots[rows][:, None] != roots[None, :])
    for r, j in zip(*np.nonzero(close), strict=True):
        link(int(rows[r]), int(j))
    return out


def linked(cells: DataFrame, p: Params) -> DataFrame:
    """Links ``u, v`` from cells of ``cell, node, first, text``: each cell is one task's comparison."""

    def compare(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")
        texts = table.column("text").to_pylist()
        first = table.column("first").to_numpy(zero_copy_only=False)
        sets = [shingles(texts[i], p.words) for i in order]
        pairs = forest(sets, first[order], p)
        named = nodes[order]
        return pa.table({"u": pa.array([int(named[i]) for i, _ in pairs], pa.int64()), "v": pa.array([int(named[j]) for _, j in pairs], pa.int64())})

    return cells.groupBy("cell").applyInArrow(compare, "u bigint, v bigint")


def candidate_groups(reps: DataFrame) -> DataFrame:
    """``node, component`` over ties of bucket members to their bucket's smallest class."""
    keys = reps.select("node", F.explode("bands").alias("key"))
    centres = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("__n")).where("__n > 1").select("key", "centre")
    ties = keys.join(centres, "key").where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
    return components(ties)


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets;
    ``component_id`` is the smallest id reachable over links, and only its document is kept.
    Texts without words have an empty set and are linked with nothing; neither are rows with
    a null id, which are all kept, with a null component. Rows that share an id count as one
    document with the links of all its texts. Other columns are left out.
    """
    base = materialise(signatures(docs, p), "signatures")
    some = base.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(some.groupBy("class").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")), "classes")
    groups = materialise(candidate_groups(classes), "candidates")
    # blocks follow the number of classes and the sizes of their sets
    sized = groups.join(classes.select("node", "n"), "node").groupBy("component").agg(F.greatest(F.count("*") / p.block, F.sum("n") / p.block_shingles).alias("__m"))
    # a class is read again by its smallest document; texts that share the id with it come along
    member = groups.join(sized, "component").select("node", "component", "__m", F.ceil("__m").cast("int").alias("blocks"))
    # "merge": one plan at every size, as members grow with the input
    texts = docs.select(F.col("doc_id").alias("node"), "text").where("text is not null").join(member.hint("merge"), "node")
    group_texts = materialise(texts.withColumn("block", F.pmod(F.xxhash64("node", F.lit(p.seed)), F.col("blocks").cast("bigint")).cast("int")), "texts")
    one = group_texts.select(F.concat_ws("/", "component", "block").alias("cell"), "node", F.lit(True).alias("first"), "text", "blocks")
    small = linked(one.where("blocks = 1").drop("blocks"), p)
    large = group_texts.where("blocks > 1")
    # all members against the group's first block
    pivot = large.where("block = 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.concat_ws("/", "component", "block").alias("cell")
    cells = pivot.select(name, "node", F.lit(True).alias("first"), "text").union(large.where("block > 0").select(name, "node", F.lit(False), "text"))
    found = materialise(small.union(linked(cells, p)), "found")
    exact = components(found)
    if not large.isEmpty():
        # the components known so far go in as stars, which are joined by what is left
        known = exact.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        exact = components(known.union(_rest(large, exact, p)))
    owner = classes.select("class", "node").join(exact, "node", "left").select("class", F.coalesce("component", "node").alias("__c"))
    return base.join(owner, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("__c", "doc_id").alias("component_id"),
        (F.coalesce("__c", "doc_id") == F.col("doc_id")).alias("__kept"),
    ).select("doc_id", "n_shingles", "component_id", F.coalesce("__kept", F.lit(True)).alias("kept"))


def _rest(large: DataFrame, known: DataFrame, p: Params) -> DataFrame:
    """Links between blocks of large groups, of all pairs that no component holds yet.

    Members of a group's largest component need no comparison with each other. All other
    members, in blocks of their own, are compared with all blocks of the group.
    """
    label = large.select("component", "node", "block", "blocks", "text").join(known.withColumnRenamed("component", "__l"), "node", "left")
    label = materialise(label.withColumn("__l", F.coalesce("__l", "node")), "labels")
    counts = label.groupBy("component", "__l").agg(F.count("*").alias("__n"))
    main = counts.groupBy("component").agg(F.max_by("__l", F.struct("__n", "__l")).alias("__main"))
    apart = label.join(main, "component").where(F.col("__l") != F.col("__main"))
    per = apart.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / p.block, F.sum(F.octet_length("text")) / (8 * p.block_shingles))).cast("int").alias("__r"))
    # queries: the members apart, each in one of __r blocks; they go to every block of the group
    query = apart.join(per, "component").withColumn("__q", F.pmod(F.xxhash64("node", F.lit(p.seed + 2)), F.col("__r").cast("bigint")).cast("int"))
    query = query.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = label.join(per, "component").withColumn("__q", F.explode(F.sequence(F.lit(0), F.col("__r") - 1)))
    cell = F.concat_ws("/", "component", "block", "__q").alias("cell")
    both = query.select(cell, "node", F.lit(True).alias("first"), "text").union(others.select(cell, "node", F.lit(False), "text"))
    # a member apart meets itself in its own block; equal sets of one node link to themselves only
    return linked(both, p).where("u <> v")
