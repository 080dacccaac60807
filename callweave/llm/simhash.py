"""SimHash near-duplicates by deletion variants of segments.

1. Documents with one fingerprint form a class; only classes go on.
2. A fingerprint is cut into so few segments that, of two within ``most_bits``, one segment
   differs by one bit at most. Each segment gives as many variants as it has bits, each with
   that bit taken out; two segments that differ by at most one bit share a variant.
3. Classes meet in an equality join on variants. A bucket keeps its variant's bit in mind: in
   the bucket of a segment's first bit all pairs are verified, in the others those that differ
   at the bit, so that a pair meets once for each segment that brings it together.
4. Buckets of many classes are dealt into cells of two blocks; within a cell a forest of the
   verified links is returned, never all pairs.
5. The links' components, by alternating stars, are the near-duplicate classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.components import components
from callweave.plans.scratch import materialise

BITS = 64
WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are parted into words at a time, and shingles whose bits are counted at a time.
PIECE, TOGETHER = 1 << 20, 1 << 15
#: Buckets of at most so many classes are compared pair by pair in one step for all of a size.
SMALL = 8
#: Fingerprints with over a thousandth of all rows, at most a thousand, are joined in so many parts.
PARTS = 64


@dataclass(frozen=True)
class Params:
    """Shingles of ``words`` words, hashed with ``seed``; links at ``most_bits`` differing bits or fewer.

    ``block``: classes in one block of a large bucket; a task compares two blocks.
    """

    words: int = 4
    most_bits: int = 4
    seed: int = 42
    block: int = 4096

    @property
    def segments(self) -> list[tuple[int, int]]:
        """(first bit, bits) of each: with one more than half of ``most_bits`` of them, one differs by a bit at most."""
        n = max(2, self.most_bits // 2 + 1)
        ends = [BITS * i // n for i in range(n + 1)]
        return [(a, b - a) for a, b in zip(ends, ends[1:])]


def fingerprint(text: str | None, p: Params = Params()) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned number.

    A-Z become small letters; words are parted by ASCII white space. A text of fewer words
    has its whole sequence as one shingle; without words the fingerprint is zero. Long texts
    are read piece by piece.
    """
    raw = (text or "").encode().lower()  # bytes: only ASCII is folded and parted
    counts, n, at, carry = np.zeros(BITS, np.int64), 0, 0, []
    while at < len(raw):
        end = len(raw)
        if at + PIECE < end and (m := WHITE.search(raw, at + PIECE)):
            end = m.start()
        words = carry + raw[at:end].split()
        at = end
        if len(words) < p.words and at < len(raw):
            carry = words
            continue
        width = min(p.words, len(words))
        if not width or (n and len(words) < p.words):
            continue
        joined = b" ".join(words)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        firsts = starts[: len(words) - width + 1].tolist()
        lasts = (starts[width:] - 1).tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], p.seed) for a, b in zip(firsts, lasts, strict=True)), np.uint64, len(firsts))
        for k in range(0, len(h), TOGETHER):
            counts += np.unpackbits(h[k : k + TOGETHER, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
        carry = words[len(words) - p.words + 1 :] if len(words) >= p.words else words
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each whole text, as a signed number of the same bits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), p) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, "doc_id bigint, fp bigint")


def _key(place: int, value):
    """A bucket: the bit taken out, and the segment without it."""
    return (place << 40) | value


def variants(classes: DataFrame, p: Params) -> DataFrame:
    """``key, fp, node`` for every segment of ``fp, node`` and every bit of it taken out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                fp = batch.column("fp").to_numpy(zero_copy_only=False)
                keys = []
                for first, width in p.segments:
                    value = (fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << width) - 1)
                    keys += [_key(first + i, (value & ~np.uint64(1 << i)).astype(np.int64)) for i in range(width)]
                node = batch.column("node").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(fp, BITS)), pa.array(np.tile(node, BITS))], names=["key", "fp", "node"])

    return classes.select("fp", "node").mapInArrow(make, "key bigint, fp bigint, node bigint")


def large_buckets(classes: DataFrame, p: Params) -> DataFrame:
    """``key, blocks`` of the buckets that may hold over ``block`` classes.

    A bucket holds the classes of one or two values of its segment, so that three counts a
    class find them all: one of the values has over half a block.
    """
    value = lambda first, width: F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
    parts = F.array(*[F.struct(F.lit(i).alias("i"), value(*s).alias("v")) for i, s in enumerate(p.segments)])
    values = classes.select(F.explode(parts).alias("s")).groupBy("s.i", "s.v").count().where(F.col("count") > p.block // 2)
    firsts = F.array(*[F.lit(a) for a, _ in p.segments])
    widths = F.array(*[F.lit(n) for _, n in p.segments])
    bits = values.withColumn("b", F.explode(F.sequence(F.lit(0), F.element_at(widths, F.col("i") + 1) - 1)))
    key = F.shiftleft((F.element_at(firsts, F.col("i") + 1) + F.col("b")).cast("bigint"), 40).bitwiseOR(F.expr("v & ~shiftleft(1L, b)"))
    # the bucket's other value, if it is not in this table, has half a block at most
    return bits.groupBy(key.alias("key")).agg(F.ceil((F.sum("count") + p.block // 2) / p.block).cast("int").alias("blocks"))


def _close(x: np.ndarray, y: np.ndarray, bit: int, p: Params) -> np.ndarray:
    d = x ^ y
    ok = np.bitwise_count(d) <= p.most_bits
    return ok if bit < 0 else ok & ((d >> np.uint64(bit)) & np.uint64(1) == 1)


def forest(fp: np.ndarray, bit: int, p: Params) -> list[tuple[int, int]]:
    """Places (i, j) of links that span the components of the close pairs; ``bit``, unless negative, must differ in a pair."""
    left, out = np.arange(len(fp)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = _close(fp[left], fp[i], bit, p)
            if near.any():
                found = left[near].tolist()
                out += [(i, j) for j in found]
                todo += found
                left = left[~near]
    return out


def links(cells: DataFrame, p: Params) -> DataFrame:
    """Verified links ``u, v`` between nodes from ``key, pair, fp, node``: rows of one (key, pair) meet."""
    firsts = [a for a, _ in p.segments]

    def meet(key: np.ndarray, pair: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        starts = np.r_[0, cuts]
        sizes = np.diff(np.r_[starts, len(key)])
        place = key[starts] >> 40
        bit = np.where(np.isin(place, firsts), -1, place)
        u, v = [], []
        for m in range(2, SMALL + 1):
            at, own = starts[sizes == m], bit[sizes == m]
            for i in range(m if len(at) else 0):
                for j in range(i):
                    d = fp[at + i] ^ fp[at + j]
                    ok = (np.bitwise_count(d) <= p.most_bits) & ((own < 0) | ((d >> np.maximum(own, 0).astype(np.uint64)) & np.uint64(1) == 1))
                    u.append(node[at[ok] + i])
                    v.append(node[at[ok] + j])
        for s, n, b in zip(*(x[sizes > SMALL].tolist() for x in (starts, sizes, bit)), strict=True):
            if found := forest(fp[s : s + n], b, p):
                i, j = np.array(found).T
                u.append(node[s + i])
                v.append(node[s + j])
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u or none)), pa.array(np.concatenate(v or none))], names=["u", "v"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "pair", "fp", "node")]
            now[2] = now[2].view(np.uint64)
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(rest[0]):
                continue
            # the last bucket may go on in the next batch
            same = (rest[0] == rest[0][-1]) & (rest[1] == rest[1][-1])
            end = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            if end:
                yield meet(*(x[:end] for x in rest))
                rest = [x[end:] for x in rest]
        if rest is not None and len(rest[0]):
            yield meet(*rest)

    dealt = cells.select("key", "pair", "fp", "node").repartition("key", "pair").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(make, "u bigint, v bigint")


def class_links(classes: DataFrame, p: Params) -> DataFrame:
    """Links ``u, v`` between the nodes of ``fp, node`` that connect all whose fingerprints differ by ``most_bits`` at most."""
    every = variants(classes, p)
    large = materialise(large_buckets(classes, p), "large")
    small = every.withColumn("pair", F.lit(0))
    if large.isEmpty():
        return links(small, p)
    block = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("bigint")).cast("int")
    split = every.join(large, "key").withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = split.withColumn("pair", F.least("b", "o").cast("bigint") * F.col("blocks") + F.greatest("b", "o"))
    columns = ["key", F.col("pair").cast("bigint").alias("pair"), "fp", "node"]
    return links(small.join(large, "key", "left_anti").select(*columns).union(pairs.select(*columns)), p)


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per document ``doc_id, fingerprint (16 hex digits), component_id, kept``.

    Documents are linked if their fingerprints differ by ``most_bits`` bits or fewer;
    ``component_id`` is the smallest id reachable over links, and only its document is kept.
    Null and empty texts have fingerprint zero, which is linked like any other. Rows with a
    null id are linked with nothing: they have a null component and are kept. Rows that
    share an id count as one document with the links of all its texts. Very long texts are
    read whole, piece by piece; an empty table gives none; other columns are left out.
    """
    base = materialise(fingerprints(docs, p), "fingerprints")
    known = base.where("doc_id is not null")
    classes = materialise(known.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    found = class_links(classes, p)
    repeated = materialise(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():  # an id's texts belong together
        texts = known.join(repeated, "doc_id").distinct().join(classes.select("fp", "node"), "fp")
        found = found.union(texts.select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    owner = classes.join(components(found), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    # a fingerprint of very many documents meets its owner in parts
    total = classes.agg(F.sum("n")).first()[0] or 0
    often = materialise(classes.where(F.col("n") > max(PARTS * PARTS, total // 1000)).select("fp", F.lit(PARTS).alias("__parts")), "often")
    marked = lambda df: df.join(F.broadcast(often), "fp", "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    dealt = marked(base).withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.col("__parts").cast("bigint")).cast("int"))
    owners = marked(owner).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    joined = dealt.join(owners, ["fp", "__part"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
