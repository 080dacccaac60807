"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector
binds its letters' vectors, each rotated by its place, by multiplication; a text's vector
bundles its n-grams' by addition. A language's prototype bundles all training texts in it.
The language whose prototype has the largest cosine with a text is predicted. Prototypes are
a table, read in blocks, so that any number of languages can be learned.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import bpe
from callweave.plans.scratch import materialise

UNKNOWN = "und"
DIMENSIONS = 1024
GRAM = 3
SEED = 11
#: Characters counted together; bounds the table of one step.
TOGETHER = 1 << 20
#: Prototypes that are compared with a text together; more languages make more blocks.
LANGUAGES_IN_BLOCK = 1_000
#: Three standard deviations of the cosine of a random vector: below it a text speaks for no language.
LEAST_COSINE = 3 / DIMENSIONS**0.5


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(4096)
def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vector of a letter, or of the gap between words (0), from its code point alone."""
    return np.where(np.random.default_rng([SEED, code]).random(dimensions) < 0.5, np.int8(-1), np.int8(1))


def letters(text: str) -> np.ndarray:
    """Code points of a lower-cased text with each run of other characters as one gap, one gap at either end; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letter_table()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    kept = np.where(is_letter, codes, 0).astype(np.int64)
    kept = np.r_[0, kept, 0]
    return kept[(kept != 0) | (np.r_[1, kept[:-1]] != 0)]


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of rows of letters."""
    codes, place = np.unique(grams, return_inverse=True)
    place = place.reshape(grams.shape)
    table = np.stack([letter_vector(int(c), dimensions) for c in codes])
    out = table[place[:, -1]].astype(np.float32)
    for i in range(2, grams.shape[1] + 1):
        out *= np.roll(table, i - 1, axis=1)[place[:, -i]]
    return out


def bundles(texts: list[np.ndarray], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vector of each text (given as letters): counts of its n-grams times their vectors."""
    out = np.zeros((len(texts), dimensions), np.float32)
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= TOGETHER) and end - at < 256:
            held += len(texts[end])
            end += 1
        part = [t for t in texts[at:end]]
        codes, ids = np.unique(np.concatenate([*part, np.zeros(0, np.int64)]), return_inverse=True)
        starts = np.cumsum([0, *map(len, part)])
        base = len(codes) + 1
        windows = [ids[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)]
        keys = [w[:-2] * base * base + w[1:-1] * base + w[2:] if len(w) >= GRAM else np.zeros(0, np.int64) for w in windows]
        flat = np.concatenate([*keys, np.zeros(0, np.int64)])
        if base**3 <= 1 << 22:  # a table of all n-grams of these letters is smaller than sorting them
            seen = np.bincount(flat, minlength=1) > 0
            names, rank = np.flatnonzero(seen), np.cumsum(seen) - 1
            rows = [rank[k] for k in keys]
        else:
            names, inverse = np.unique(flat, return_inverse=True)
            rows = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
        grams = np.stack([codes[names // (base * base)], codes[names // base % base], codes[names % base]], axis=1) if len(names) else np.zeros((0, 3), np.int64)
        for lo in range(0, len(names), 4096):
            hi = min(len(names), lo + 4096)
            counts = np.stack([np.bincount(r, minlength=len(names))[lo:hi] if len(r) else np.zeros(hi - lo, np.int64) for r in rows]).astype(np.float32)
            out[at:end] += counts @ gram_vectors(grams[lo:hi], dimensions)
        at = end
    return out


@dataclass(frozen=True)
class Profiles:
    """Unit prototypes: a table of ``block, lang, v`` in ``blocks`` of bounded size; none without a language."""

    table: DataFrame
    blocks: int
    dimensions: int = DIMENSIONS

    def block(self, i: int) -> tuple[list[str], np.ndarray]:
        """Names in order, and a row a name."""
        found = sorted(self.table.where(F.col("block") == i).select("lang", "v").collect(), key=lambda r: r["lang"])
        table = np.array([r["v"] for r in found], np.float64).reshape(-1, self.dimensions)
        norms = np.linalg.norm(table, axis=1, keepdims=True)
        return [r["lang"] for r in found], (table / np.where(norms == 0, 1, norms)).astype(np.float32)


def in_training(id_col: str = "doc_id"):
    """Whether a document is not held out: crc32 of its id as text, modulo 4, is not 2. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes of all rows with a language and a text; other rows, and null texts, teach nothing.

    Each task sends partial vectors by language; they are summed by language and dimension
    in Spark, and written as a table.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in bpe.slices(whole, "text", 2 << 20):
                langs = np.array(batch.column("lang").to_pylist(), object)
                vectors = bundles([letters(t) for t in batch.column("text").to_pylist()], dimensions)
                for name in set(langs.tolist()):
                    sums[name] = sums.get(name, 0) + vectors[langs == name].sum(axis=0, dtype=np.float64)
                if len(sums) > LANGUAGES_IN_BLOCK:
                    yield packed(sums)
                    sums = {}
        if sums:
            yield packed(sums)

    def packed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = rows.mapInArrow(partial, "lang string, v array<bigint>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    each = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    table = materialise(each.withColumn("hash", F.xxhash64("lang")), "prototypes")
    blocks = -(-table.count() // LANGUAGES_IN_BLOCK)
    return Profiles(table.withColumn("block", F.pmod("hash", F.lit(max(1, blocks)))).drop("hash"), blocks, dimensions)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds the predicted language of each whole text and its cosine, from 0 to 1.

    ``und`` with score 0 for null and empty texts, texts without letters, and where no
    language was learned. Cosines are rounded to six digits; ties go to the language first
    in order. Columns named as a result are replaced, all others pass through; an empty
    table stays empty. With more than one block of prototypes, the best so far is written
    after each block, so that one block at a time is held.
    """
    out = docs.drop(lang_col, score_col).withColumns({lang_col: F.lit(UNKNOWN), score_col: F.lit(0.0)})
    for i in range(profiles.blocks):
        out = _compared(out, *profiles.block(i), text_col, lang_col, score_col)
        if profiles.blocks > 1:
            out = materialise(out, "predicted")
    return out


def _compared(docs: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str, lang_col: str, score_col: str) -> DataFrame:
    """Rows with the better of the language they have and the best of the block."""
    packed, dimensions = base64.b64encode(prototypes.tobytes()), prototypes.shape[1]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prototypes = np.frombuffer(base64.b64decode(packed), np.float32).reshape(-1, dimensions)
        for whole in batches:
            for batch in bpe.slices(whole, text_col, 2 << 20):
                seqs = [letters(t or "") for t in batch.column(text_col).to_pylist()]
                vectors = bundles(seqs, dimensions)
                norms = np.linalg.norm(vectors, axis=1)
                known = (np.fromiter(map(len, seqs), np.int64, len(seqs)) > 0) & (norms > 0)
                cosines = np.round((vectors @ prototypes.T / np.where(norms == 0, 1, norms)[:, None]).astype(np.float64), 6)
                best = cosines.argmax(axis=1)
                scores = np.clip(cosines[np.arange(len(seqs)), best], 0, 1)
                langs, had = batch.column(lang_col).to_pylist(), batch.column(score_col).to_pylist()
                for r in np.flatnonzero(known).tolist():
                    name, score = names[best[r]], float(scores[r])
                    if langs[r] == UNKNOWN or (-score, name) < (-had[r], langs[r]):
                        langs[r], had[r] = name, score
                yield bpe.plus(batch, {lang_col: pa.array(langs, pa.string()), score_col: pa.array(had, pa.float64())})

    return docs.mapInArrow(make, docs.schema)
