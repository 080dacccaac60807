"""Phrases in text by a trie of words with longest match.

A text's words are runs of letters and digits in lower case. From each word on, the longest phrase of the
trie is taken; one that lies within a longer one does not count. ``#`` in a phrase stands for a number of
one or two digits, or a number word. Texts come in Arrow batches, each distinct one is read once a batch,
and a trie is built once a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Names that one pass over the texts holds in a worker; larger tables take more passes.
NAMES_A_PASS = 200_000
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
PHRASE_END = ""


def expand(template: str) -> list[str]:
    """All phrases of a template: "no (upper|lower|) age limit" has three."""
    parts = [p.split("|") for p in re.split(r"[()]", template)]
    return [" ".join("".join(x).split()) for x in product(*parts)]


def number(word: str) -> int | None:
    if word.isascii() and word.isdigit():
        return int(word) if len(word) <= 2 else None
    return NUMBER_WORDS.get(word)


class Trie:
    """Word tries: a node is a dictionary by word, its phrases' payloads under PHRASE_END."""

    def __init__(self, phrases: Iterable[tuple[str, int]]):
        self.root: dict = {}
        for phrase, payload in phrases:
            node = self.root
            words = [w if w == "#" else w.lower() for w in re.findall(r"#|[^\W_]+", phrase)]
            for w in words:
                node = node.setdefault(w, {})
            if words:
                node.setdefault(PHRASE_END, []).append(payload)

    def find(self, words: list[str]) -> Iterator[tuple[int, int, list[int], list[int]]]:
        """(first word, word after the last, payloads, numbers) of each phrase that no longer one holds."""
        numbers = [number(w) for w in words]
        reached = 0
        for at in range(len(words)):
            best = None
            todo = [(self.root, at, ())]
            while todo:
                node, k, taken = todo.pop()
                if PHRASE_END in node and (best is None or k > best[0]):
                    best = (k, node[PHRASE_END], taken)
                if k < len(words):
                    if (step := node.get(words[k])) is not None:
                        todo.append((step, k + 1, taken))
                    if numbers[k] is not None and (step := node.get("#")) is not None:
                        todo.append((step, k + 1, (*taken, numbers[k])))
            if best and best[0] > reached:
                reached = best[0]
                yield at, best[0], best[1], list(best[2])


def each_text(texts: pa.Array, read, kind: pa.DataType) -> pa.Array:
    """``read(text)`` of every text of a batch, each distinct one once; null for null."""
    coded = texts.combine_chunks().dictionary_encode() if isinstance(texts, pa.ChunkedArray) else texts.dictionary_encode()
    once = pa.array([read(t) for t in coded.dictionary.to_pylist()], kind)
    return once.take(coded.indices)


#: A phrase's words (first, after the last), characters (likewise), effect, topic, and numbers.
CUE = "struct<at:int,end:int,start:int,stop:int,effect:string,topic:string,n:array<int>>"
CUE_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("effect", pa.string()), ("topic", pa.string()), ("n", pa.list_(pa.int32()))]))


def reader(rows: list[tuple[str, str, str | None]]):
    """A column function that gives the cues of a text, for (template, effect, topic) rows."""
    tries: list[Trie] = []

    def read(text: str) -> list[dict]:
        if not tries:
            tries.append(Trie((p, i) for i, (template, _, _) in enumerate(rows) for p in expand(template)))
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        return [{"at": a, "end": b, "start": spans[a][0], "stop": spans[b - 1][1], "effect": rows[i][1], "topic": rows[i][2], "n": n} for a, b, found, n in tries[0].find(words) for i in found]

    def cues(texts: pa.Array) -> pa.Array:
        return each_text(texts, read, CUE_TYPE)

    cues.__annotations__ = {"texts": pa.Array, "return": pa.Array}

    def column(text: Column) -> Column:
        return F.arrow_udf(cues, f"array<{CUE}>")(text)

    return column


def has(cues: Column, *effects: str) -> Column:
    """Whether a cue of one of the effects occurs; false for null."""
    return F.coalesce(F.exists(cues, lambda c: c["effect"].isin(*effects)), F.lit(False))


def names_in(df: DataFrame, text: str, names: DataFrame, a_pass: int = NAMES_A_PASS) -> DataFrame:
    """``text, hits`` of the distinct texts in which a name occurs.

    ``names``: ``name`` of any number of words, and ``kind``, ``countries``. A hit has ``at, end, name, kind, countries`` and
    ``after``, the word that follows. Names go to the workers in passes of bounded size; a pass over the
    distinct texts reads one part of them. A name within a longer one does not count, in whichever part that is.
    """
    once = df.select(F.col(text).alias("text")).where(F.col(text).isNotNull()).distinct()
    n_passes = max(1, -(-names.count() // a_pass))
    dealt = names.select("name", "kind", "countries").withColumn("__pass", F.pmod(F.xxhash64("name"), F.lit(n_passes)))
    hit = "struct<at:int,end:int,name:string,kind:string,countries:array<string>,after:string>"
    kind = pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("countries", pa.list_(pa.string())), ("after", pa.string())]))
    parts = []
    for k in range(n_passes):
        rows = [(r.name, r.kind, r.countries) for r in dealt.where(F.col("__pass") == k).collect()]  # a_pass of them at most, but for ties of the hash
        sent = df.sparkSession.sparkContext.broadcast(rows)

        def make(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = sent.value
            trie = Trie((name, i) for i, (name, _, _) in enumerate(table))

            def read(t: str) -> list[dict]:
                words = [w.lower() for w in WORD.findall(t)]
                return [{"at": a, "end": b, "name": " ".join(words[a:b]), "kind": table[i][1], "countries": table[i][2], "after": words[b] if b < len(words) else None} for a, b, found, _ in trie.find(words) for i in found]

            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("text"), each_text(batch.column("text"), read, kind)], names=["text", "hits"])

        parts.append(once.mapInArrow(make, f"text string, hits array<{hit}>").where("size(hits) > 0"))
    found = parts[0]
    if n_passes > 1:
        for other in parts[1:]:
            found = found.union(other)
        merged = found.groupBy("text").agg(F.flatten(F.collect_list("hits")).alias("h"))
        found = merged.select("text", F.filter("h", lambda m: ~F.exists("h", lambda o: (o["at"] <= m["at"]) & (o["end"] >= m["end"]) & (o["end"] - o["at"] > m["end"] - m["at"]))).alias("hits"))
    return found.withColumnRenamed("text", text)
