"""Artist documents: line tables, passages, facts, projects, application checklists."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.text import flattened


def line_table(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """A row a non-empty line with its place, whitespace collapsed and markdown heading marks off.

    All lines are kept; only where ``most`` is given are those beyond so many characters of a document left out.
    """
    clean = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\\r?\\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \\t\\f\\x0B]+", " "), "^ | $", ""))
    rows = df.select(F.col(key).alias("key"), F.posexplode(F.filter(clean, lambda x: x != "")).alias("pos", "raw"))
    if most is not None:
        so_far = F.sum(F.length("raw")).over(Window.partitionBy("key").orderBy("pos"))
        rows = rows.withColumn("__n", so_far).where(F.col("__n") <= most)
    return rows.select("key", "pos", F.col("raw").rlike("^#{1,6} ").alias("marked"), F.regexp_replace("raw", "^#{1,6} ", "").alias("line"))


def heading_like(line: Column, vocabulary: Sequence[str]) -> Column:
    """A short line without a full stop, in capitals or of the vocabulary."""
    bare = F.lower(F.regexp_replace(line, "[:\\s]+$", ""))
    words = F.size(F.split(line, " "))
    return (words <= 8) & ~line.rlike("[.,;]$") & (bare.isin(*vocabulary) | (line.rlike("\\p{L}{3}") & (F.upper(line) == line)))


def with_section(lines: DataFrame, heading: Column) -> DataFrame:
    """Each line with the heading above it, the line itself if it is one."""
    w = Window.partitionBy("key").orderBy("pos")
    return lines.withColumn("section", F.last(F.when(heading, F.col("line")), ignorenulls=True).over(w))


def pack_lines(lines: DataFrame, most: int = 800) -> DataFrame:
    """Passages of at most ``most`` characters that never cross a heading.

    ``key, pos, line, section`` in; a fold over each document's lines, one document a call.
    A line longer than ``most`` is cut at sentence ends, a sentence longer than it hard.
    """

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("pos").to_pylist(), table.column("line").to_pylist(), table.column("section").to_pylist(), strict=True))
        key, out, held, size, at = table.column("key")[0].as_py(), [], [], 0, None

        def flush():
            nonlocal held, size
            if held:
                out.append((at, " ".join(held)))
            held, size = [], 0

        for _, line, section in rows:
            if section != at:
                flush()
                at = section
            for piece in pieces(line, most):
                if size + len(piece) > most:
                    flush()
                held.append(piece)
                size += len(piece) + 1
        flush()
        return pa.table({"key": pa.array([key] * len(out), pa.int64()), "chunk_index": pa.array(range(len(out)), pa.int32()), "section": pa.array([s for s, _ in out], pa.string()), "chunk": pa.array([c for _, c in out], pa.string())})

    return lines.select(F.col("key").cast("bigint").alias("key"), "pos", "line", "section").groupBy("key").applyInArrow(pack, "key bigint, chunk_index int, section string, chunk string")


def pieces(line: str, most: int) -> list[str]:
    """A long line in sentences of at most ``most`` characters."""
    if len(line) <= most:
        return [line]
    out = []
    for sentence in line.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
        out += [sentence[i : i + most] for i in range(0, len(sentence), most)]
    return out


def facts(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """For each field the first line of a document that states it: ``key, field, value, quote, pos``.

    Each pattern's first group is the value. One pass over the lines; first hits are
    partial minima.
    """
    found = F.array(*(F.struct(F.lit(n).alias("field"), F.regexp_extract("line", p, 1).alias("value")) for n, p in patterns.items()))
    hits = lines.select("key", "pos", "line", F.explode(found).alias("f")).where("f.value <> ''")
    first = hits.groupBy("key", F.col("f.field").alias("field")).agg(F.min(F.struct("pos", F.col("f.value").alias("value"), F.col("line").alias("quote"))).alias("m"))
    return first.select("key", "field", "m.value", "m.quote", "m.pos")


def merge_suggestions(df: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """One suggestion a field: by the order of document kinds, then place."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    w = Window.partitionBy(key, "field").orderBy(F.when(rank == 0, len(kinds) + 1).otherwise(rank), "pos", "value")
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def evidence(df: DataFrame, passages: DataFrame) -> DataFrame:
    """Proposals with the reason that speaks against them, null if none: passage, quote, value."""
    squash = lambda c: F.lower(F.regexp_replace(c, "\\s+", " "))
    joined = df.join(passages.select("key", "chunk_index", "chunk"), ["key", "chunk_index"], "left")
    reason = F.when(F.col("chunk").isNull(), "no passage").when(~F.contains(squash(F.col("chunk")), squash(F.col("quote"))), "not quoted").when(F.coalesce(F.trim("value"), F.lit("")) == "", "no value")
    return joined.withColumn("reason", reason)


def merge_projects(df: DataFrame) -> DataFrame:
    """Projects of one artist and title: longest summary, range of years, all venues."""
    title = flattened(F.col("title"))
    return df.groupBy("artist_id", title.alias("title_key")).agg(
        F.max(F.struct(F.length("summary").alias("n"), "summary"))["summary"].alias("summary"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.concat_ws("; ", F.array_sort(F.collect_set("venue"))).alias("venues"),
    )


def checklist(df: DataFrame, key: str, questions: str, materials: str) -> DataFrame:
    """An item a question and material of a call; questions that repeat a material, and repeats, are left out."""
    m, q = F.transform(materials, flattened), F.transform(questions, flattened)
    items = F.concat(F.transform(F.array_distinct(m), lambda x: F.struct(F.lit("material").alias("kind"), x.alias("item"))), F.transform(F.array_except(q, m), lambda x: F.struct(F.lit("question").alias("kind"), x.alias("item"))))
    rows = df.select(F.col(key).alias("key"), F.posexplode(items).alias("pos", "i")).where("i.item <> ''")
    return rows.select("key", F.col("i.kind").alias("kind"), F.col("i.item").alias("item"), F.substring(F.sha2(F.concat_ws("/", F.col("key").cast("string"), "i.kind", "i.item"), 256), 1, 12).alias("item_id"))


def text_limit(text: Column) -> tuple[Column, Column]:
    """The number and unit (words or characters) of a stated limit, null without."""
    p = "(?i)(?:max(?:imum|\\.)?|up to|at most|no more than) ([0-9][0-9,.]*) (words|characters)"
    n = F.regexp_replace(F.regexp_extract(text, p, 1), "[,.]", "").try_cast("int")
    return n, F.nullif(F.lower(F.regexp_extract(text, p, 2)), F.lit(""))


def item_state(items: DataFrame, drafts: DataFrame) -> DataFrame:
    """Of each application how many items are done, started and missing."""
    joined = items.join(drafts.select("item_id", F.col("final").alias("__f")), "item_id", "left")
    return joined.groupBy("key").agg(F.count_if(F.col("__f")).alias("done"), F.count_if(~F.col("__f")).alias("started"), F.count_if(F.col("__f").isNull()).alias("missing"))
