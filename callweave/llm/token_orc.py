"""Token ids in ORC: integer run lengths, row indexes, and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded in place, and written one file a
partition. Each row has its place within its file, so a reader finds the start of every
document from the totals of the files alone, stripes are read in parallel, and a search for
an id skips files, stripes and row groups by their statistics and Bloom filters.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.llm import bpe

FILE = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>"
ROW_GROUP = 2_000


#: Runs of white space that the rank encoder's splitter has no stack for.
LONG_RUN = re.compile(r"\s{2000}")


@lru_cache(2)
def encoder(vocabulary_path: str, ranks_path: str) -> Callable[[str], bytes]:
    """Packed ids of a text by the rank file of the vocabulary; texts with a very long run of white space go through the pair index, with equal ids."""
    v = bpe.vocabulary(vocabulary_path)
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=v.special)

    def encode(text: str) -> bytes:
        if LONG_RUN.search(text):
            return v.encode([text])[0]
        return np.array(fast.encode(text, allowed_special="all"), "<u4").tobytes()

    return encode


def encode_sorted(docs: DataFrame, vocabulary_path: str, ranks_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of a token file in ascending id order, each document ended by ``end_id``.

    Null texts hold the end id alone; null ids come first; rows with one id are ordered by
    their text. The text is what is shuffled, as it is smaller than its ids.
    """
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = keyed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(vocabulary_path, ranks_path), TaskContext.get().partitionId(), 0
        tail = int(end_id).to_bytes(4, "little")
        for whole in batches:
            for batch in bpe.slices(whole, "text"):
                packed = [encode(t) + tail for t in batch.column("text").to_pylist()]
                sizes = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
                ends = np.cumsum(sizes)
                values = np.frombuffer(b"".join(packed), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + ends - sizes), pa.array(sizes), ids],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    return placed.mapInArrow(make, FILE)


def write_tokens(rows: DataFrame, path: str) -> None:
    """ORC files with an index entry every ROW_GROUP rows and Bloom filters on the ids."""
    options = {"orc.create.index": "true", "orc.row.index.stride": str(ROW_GROUP), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of token files, in FILE's columns."""
    return spark.read.schema(FILE).orc(path)


def with_starts(rows: DataFrame) -> DataFrame:
    """``start`` in place of the part and the place in it: the ids of all documents before.

    Best given rows without their ids, as rows may be shuffled for the join with the
    parts' totals.
    """
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    # one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    joined = rows.join(bases, "part").withColumn("start", F.col("__base") + F.col("start_in_part"))
    return joined.select("doc_id", "start", *(c for c in rows.columns if c not in ("doc_id", "part", "start_in_part")))


def find(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """The rows of a few documents; the filter reaches the files' indexes."""
    return spark.read.schema(FILE).orc(path).where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def checksums(rows: DataFrame) -> DataFrame:
    """Token rows with ``ids_crc32`` of their ids as little-endian unsigned 32-bit integers, in place of the ids."""
    names = [c for c in rows.columns if c != "ids"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            view = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sums, pa.int64())], names=[*names, "ids_crc32"])

    kept = ", ".join(f"{n} {t}" for n, t in rows.drop("ids").dtypes)
    return rows.select(*names, "ids").mapInArrow(make, f"{kept}, ids_crc32 bigint")
