"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Only DataFrame functions. N-grams are the words themselves and pairs of neighbouring word
ends (last three characters), each hashed into a table of its own. The weight of a bucket
is the log of its share in the trusted text over its share in the corpus, both smoothed,
in whole micronats, so that a document's sum does not depend on any order. A document's
score is that sum over its number of n-grams; one threshold decides for every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and what counts as a symbol.
SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5
BUCKETS = 8192
TARGET_ROWS = 20_000
SMOOTHING = 1.0
THRESHOLD = -500_000


@dataclass(frozen=True)
class Ratio:
    """Weights in micronats: ``buckets`` for words, then ``buckets`` for pairs of word ends."""

    buckets: int
    weights: tuple[int, ...]

    def column(self) -> Column:
        """The weights as an array that the optimiser folds to one constant."""
        return F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<int>")


def words(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def _steps(count: Column, f) -> Column:
    """``f(i)`` for i from 0 to below ``count``, in an array."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), f)).otherwise(F.array().cast("array<bigint>"))


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``__w`` (words) and ``__h`` (their 64-bit hashes); a null text has none."""
    split = docs.withColumn("__w", words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return split.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))


def with_grams(hashed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``__g``: the buckets of a document's n-grams, words first, pairs offset by ``buckets``."""
    ends = hashed.withColumn("__e", F.transform("__w", lambda w: F.xxhash64(F.substring(w, -3, 3))))
    pair = lambda i: F.pmod(F.xxhash64(F.get("__e", i), F.get("__e", i + 1)), F.lit(buckets).cast("bigint")) + buckets
    pairs = _steps(F.size("__e") - 1, pair)
    ones = F.transform("__h", lambda h: F.pmod(h, F.lit(buckets).cast("bigint")))
    return ends.withColumn("__g", F.concat(ones, pairs)).drop("__e")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", most: int = TARGET_ROWS) -> DataFrame:
    """Ids labelled good: the ``most`` with the smallest hashes, which bounds what is broadcast."""
    good = labels.where(F.col(quality_col) == 1).select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> Ratio:
    """Count n-grams of the whole corpus and of its trusted documents.

    ``trusted``: at most TARGET_ROWS ids. Counts are summed in each task before they are
    shuffled, so ``2 * buckets`` rows a task leave it, and ``2 * buckets`` reach the driver.
    Without trusted documents, or without words, all weights are 0.
    """
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("__t"))), "doc_id", "left")
    # explode_outer: for explode the optimiser adds a filter that recomputes the array for each element
    grams = with_grams(with_words(marked), buckets).select("__t", F.explode_outer("__g").alias("__b"))
    counts = grams.groupBy("__b").agg(F.count("*").alias("raw"), F.count("__t").alias("good")).collect()
    raw, good = [0] * (2 * buckets), [0] * (2 * buckets)
    for b, r, g in counts:
        if b is not None:
            raw[b], good[b] = r, g
    return Ratio(buckets, tuple(w for k in (0, buckets) for w in _weights(good[k : k + buckets], raw[k : k + buckets])))


def _weights(good: list[int], raw: list[int]) -> list[int]:
    from math import log

    if not sum(good):
        return [0] * len(raw)
    g, r = sum(good) + SMOOTHING * len(good), sum(raw) + SMOOTHING * len(raw)
    return [round(1e6 * (log((x + SMOOTHING) / g) - log((y + SMOOTHING) / r))) for x, y in zip(good, raw, strict=True)]


def repeated_words(hashed: DataFrame) -> DataFrame:
    """Adds ``__repeats``: words within a 5-word window that the text has twice or more.

    Windows are compared by 64-bit hashes. They are sorted within the row only where a
    repeat exists, and the positions of repeats are laid over each other by their gaps.
    """
    at = lambda i, k: F.get("__h", i + k)
    windows = hashed.withColumn("__win", _steps(F.size("__h") - (WINDOW - 1), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))
    some = F.size(F.array_distinct("__win")) < F.size("__win")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = windows.withColumn("__s", F.when(some, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty)).drop("__win")
    same = lambda x, k: F.coalesce(F.get("__s", k)["h"] == x["h"], F.lit(False))
    found = ordered.withColumn("__p", F.filter("__s", lambda x, k: same(x, k - 1) | same(x, k + 1))).drop("__s")
    placed = found.withColumn("__p", F.sort_array(F.transform("__p", lambda x: x["i"])))
    steps = F.transform("__p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", k + 1) - p, F.lit(WINDOW))))
    return placed.withColumn("__repeats", F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)).drop("__p")


def passed(scored: DataFrame, kept: str = "kept") -> DataFrame:
    """The rows that are kept.

    The row number keeps the optimiser from moving the condition below the steps that make
    it, where it would recompute whole arrays for each of their elements.
    """
    held = scored.withColumn("__row", F.monotonically_increasing_id())
    return held.where((F.col("__row") >= 0) & F.col(kept)).drop("__row")


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def score(docs: DataFrame, ratio: Ratio, text_col: str = "text", threshold: int = THRESHOLD, prefix: str = "") -> DataFrame:
    """Every row of ``docs`` with the base counts, ``base_failed``, ``llr`` and ``kept``, their names after ``prefix``.

    ``llr``: mean micronats an n-gram, rounded down; null without words. ``kept``: false if
    ``base_failed``, else whether ``llr`` reaches the threshold. A null text counts as
    empty. Input columns with the name of a result are replaced; all others stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.drop(*(prefix + c for c in OUT if prefix + c != text_col))
    lines = docs.withColumn("__l", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    counted = lines.withColumns({
        "__symbols": F.length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("bigint"),
        "__dups": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint"),
    }).drop("__l")
    hashed = repeated_words(with_words(counted, text_col))
    sized = hashed.withColumns({
        "__n": F.size("__w").cast("bigint"),
        "__chars": F.aggregate("__w", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)),
    })
    table = ratio.column()
    total = F.aggregate("__g", F.lit(0).cast("bigint"), lambda a, g: a + F.get(table, g.cast("int")))
    summed = with_grams(sized, ratio.buckets).withColumn("__llr", F.when(F.size("__g") > 0, F.floor(total / F.size("__g")).cast("bigint")))
    failed = (F.col("__n") < 10) | (100 * F.col("__repeats") > 20 * F.col("__n"))
    judged = summed.withColumn("__failed", failed).withColumn("__kept", ~F.col("__failed") & F.coalesce(F.col("__llr") >= threshold, F.lit(False)))
    inner = ("__n", "__chars", "__symbols", "__dups", "__repeats", "__failed", "__llr", "__kept")
    return judged.select(*docs.columns, *(F.col(i).alias(prefix + o) for i, o in zip(inner, OUT, strict=True)))
