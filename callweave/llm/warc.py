"""WARC archives as chunked record tables.

A payload of any length becomes rows (record, chunk number, bytes so far, digest so far),
cut one after another from the column's own buffer, with one running SHA-1. Each chunk is a
complete WARC record: the first is the response, the others are its continuations with
segment numbers. An archive is thus written by Spark's text writer, one record a row, to
any file system that Spark reaches. It is read back by splitting at record starts, and the
chunks of a record, which lie one after another in one file, are digested again as they
stream by.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = "WARC/1.1\r\n"
END = "\r\n\r\n"
CHUNK_BYTES = 1 << 18
#: Bytes of chunks that are handed on together.
TOGETHER = 4 << 20
#: Parts in which pages of one digest meet their role.
ROLE_PARTS = 16

CHUNKS = "page_id bigint, url string, role string, refers_to bigint, payload_bytes bigint, payload_digest string, chunk_no int, chunk_bytes bigint, bytes_so_far bigint, digest_so_far string, last boolean, data string"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def sha1_base32(column: Column) -> Column:
    """The SHA-1 of a string or binary column as 32 upper-case base-32 digits, in the JVM."""
    hexed = F.sha1(column.cast("binary"))
    parts = [F.lpad(F.upper(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def cut(raw: memoryview, most: int = CHUNK_BYTES) -> Iterator[memoryview]:
    """Views of at most ``most`` bytes of UTF-8 that end between characters, none holding a record start.

    A payload may hold the text that starts a record; a cut within it keeps archives
    unambiguous, since continuations may be of any length. Nothing is copied.
    """
    starts = re.compile(re.escape(START.encode()))
    at, found = 0, starts.search(raw)
    while at < len(raw):
        end = len(raw) if found is None else found.start() + 4
        while at < end:
            to = min(end, at + most)
            while to < end and raw[to] & 0xC0 == 0x80:  # within a character
                to -= 1
            yield raw[at:to]
            at = to
        found = starts.search(raw, at)


def views(column: pa.StringArray) -> Iterator[memoryview]:
    """The bytes of each string, in the column's buffer; a null is empty."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield whole[a:b]


def chunk_rows(df: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of ``page_id, url, role, refers_to, payload_bytes, payload_digest, payload``.

    Responses give a row for each chunk, one at least; revisits give one row without data.
    ``digest_so_far`` is the SHA-1 of all bytes up to the chunk's end, so that a reader can
    check a prefix, and the last one equals the payload's. A very long payload is never
    copied whole: chunks are handed on by TOGETHER bytes. Empty payloads give one empty
    chunk; an empty table gives none.
    """
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, CHUNKS.split(", "), strict=True)])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        heads = [batch.column(n) for n in names[:6]]
        for i, payload in enumerate(views(batch.column("payload"))):
            head = [c[i].as_py() for c in heads]
            sha, total, k = hashlib.sha1(), 0, 0
            parts = cut(payload if head[2] == "response" else payload[:0], chunk_bytes)
            part = next(parts, payload[:0])
            while part is not None:
                after = next(parts, None)
                sha.update(part)
                total += len(part)
                yield (*head, k, len(part), total, _b32(sha.digest()), after is None, bytes(part))
                part, k = after, k + 1

    def packed(out: list[tuple]) -> pa.RecordBatch:
        *rest, data = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(rest, schema, strict=False)), pa.array(data, pa.binary()).cast(pa.string())], schema=schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row in rows(batch):
                out.append(row)
                held += len(row[-1])
                if held > TOGETHER:
                    yield packed(out)
                    out, held = [], 0
            if out:
                yield packed(out)

    return df.select("page_id", "url", "role", "refers_to", "payload_bytes", "payload_digest", "payload").mapInArrow(make, CHUNKS)


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Each page with its payload, digest, and role.

    Of pages whose payloads are equal and have ``least_bytes`` or more, the one with the
    largest id is the response and the others revisit it; shorter ones are all responses.
    Rows that repeat the largest id with that payload are responses too. Null ids never
    win against others; a null payload is an empty one; an empty table gives none, and other
    columns are left out. Partial maxima are made before the shuffle, and a digest that many
    pages share is joined back in parts.
    """
    base = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": sha1_base32(F.col("payload"))})
    # roles come from ids, lengths and digests alone; a digest that very many pages share meets its role in parts
    shared = (
        base.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("__kept"), F.count("*").alias("__n"))
        .where("__n > 1")
        .select("payload_digest", "payload_bytes", "__kept", F.explode(F.sequence(F.lit(0), F.lit(ROLE_PARTS - 1))).alias("__part"))
    )
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(ROLE_PARTS)).cast("int")
    joined = base.withColumn("__part", salt).join(shared, ["payload_digest", "payload_bytes", "__part"], "left").drop("__part")
    again = F.col("__kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__kept"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("role"),
        F.when(again, F.col("__kept")).alias("refers_to"),
    )


def record_text(chunks: DataFrame) -> DataFrame:
    """One WARC record a row, without the blank lines that end it."""
    one_line = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]+", " ")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    uri = F.concat(F.lit("<urn:page:"), page, F.lit(":"))
    own = F.concat(uri, F.col("chunk_no").cast("string"), F.lit(">"))
    first, many = F.col("chunk_no") == 0, ~((F.col("chunk_no") == 0) & F.col("last"))
    line = lambda name, value, when=None: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) if when is None else F.when(when, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    header = F.concat(
        F.lit(START),
        line("WARC-Type", F.when(first, F.col("role")).otherwise("continuation")),
        line("WARC-Record-ID", own),
        line("X-Page-ID", page),
        line("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"), many),
        line("WARC-Segment-Origin-ID", F.concat(uri, F.lit("0>")), ~first),
        line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"), many & F.col("last")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(":0>")), F.col("refers_to").isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("data")))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("X-Digest-So-Far", F.concat(F.lit("sha1:"), F.col("digest_so_far"))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.col("chunk_bytes").cast("string")),
        F.lit("\r\n"),
    )
    return chunks.select(F.concat(header, F.col("data")).alias("value"))


def write_archives(records: DataFrame, path: str) -> None:
    """Gzip-compressed archives, one for each partition."""
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table that the archives at ``path`` hold, in the order of each file, with ``intact``: length and digest agree.

    Files are split at record starts alone: no chunk holds one, and no end of one is the
    beginning of another, so a reader's buffer may end anywhere. The blank lines after a
    record come off by its length.
    """
    raw = spark.read.schema("value string").option("lineSep", START).text(path)
    cut_at = F.expr("locate('\\r\\n\\r\\n', value)")
    split = raw.where("value <> ''").select(F.substring("value", F.lit(1), cut_at - 1).alias("__h"), F.substring("value", cut_at + 4, F.length("value")).alias("__d"))
    # a record is written with the blank lines that end it, so it always has them
    parts = split.select("__h", F.endswith("__d", F.lit(END)).alias("__ended"), F.expr("left(__d, length(__d) - 4)").alias("data"))
    field = lambda name: F.nullif(F.regexp_extract("__h", f"(?:^|\n){name}: ([^\r]*)", 1), F.lit(""))
    digest = lambda name: F.substring_index(field(name), ":", -1)
    return parts.select(
        F.expr("try_cast(nullif(regexp_extract(__h, 'X-Page-ID: ([^\\r]*)', 1), 'null') as bigint)").alias("page_id"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Type").alias("record_type"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)).alias("segment"),
        field("WARC-Segment-Total-Length").cast("bigint").alias("segments_bytes"),
        F.nullif(F.regexp_extract("__h", "WARC-Refers-To: <urn:page:(-?[0-9]+):0>", 1), F.lit("")).cast("bigint").alias("refers_to"),
        digest("WARC-Payload-Digest").alias("payload_digest"),
        digest("X-Digest-So-Far").alias("digest_so_far"),
        field("X-Payload-Length").cast("bigint").alias("payload_bytes"),
        field("WARC-Target-URI").alias("url"),
        "data",
        (F.col("__ended") & (F.octet_length("data") == field("Content-Length").cast("bigint")) & (sha1_base32(F.col("data")) == digest("WARC-Block-Digest"))).alias("intact"),
    )


HEADS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, n_chunks int"


def record_heads(chunks: DataFrame) -> DataFrame:
    """One row per archived record, in HEADS, from its chunks as ``read_archives`` gives them.

    The chunks of a record follow each other, so they are digested again in passing, with no
    shuffle and no record held whole. A response's length and digest are those of its
    chunks; a revisit repeats what its header says. Fails if a chunk is damaged, missing or
    out of order, or a chain of digests is broken.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []  # the open record: page, type, refers_to, said digest, said length, sha, bytes, chunks, digest so far

        def wrong(page) -> ValueError:
            return ValueError(f"damaged record of page {page}")

        def close() -> tuple:
            page, kind, refers, said, length, sha, total, n, so_far = state
            if kind == "revisit":
                return page, length, said, kind, refers, n
            if total != length or so_far != said:
                raise wrong(page)
            return page, total, so_far, kind, refers, n

        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "record_type", "segment", "refers_to", "payload_digest", "payload_bytes", "digest_so_far", "intact")]
            for page, kind, segment, refers, said, length, so_far, ok, data in zip(*columns, views(batch.column("data")), strict=True):
                if segment == 1:
                    if state:
                        done.append(close())
                    state = [page, kind, refers, said, length, hashlib.sha1(), 0, 0, None]
                if not ok or not state or segment != state[7] + 1 or page != state[0]:
                    raise wrong(page)
                state[5].update(data)
                state[6] += len(data)
                state[7] += 1
                state[8] = _b32(state[5].digest())
                if state[8] != so_far:
                    raise wrong(page)
            yield packed(done)
        if state:
            yield packed([close()])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32())
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in HEADS.split(", ")])

    return chunks.select("page_id", "record_type", "segment", "refers_to", "payload_digest", "payload_bytes", "digest_so_far", "intact", "data").mapInArrow(make, HEADS)
