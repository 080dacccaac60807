"""Matching: filters, vectors, ranking, shared words, match score."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.text import word_count
from callweave.plans.scratch import materialise

ITEMS_IN_BLOCK = 8192
QUERIES_IN_BLOCK = 128


def text_hash(*fields: Column) -> Column:
    """16 hex digits over the non-empty fields, a line each."""
    lines = F.array_compact(F.array(*(F.when(c != "", c) for c in fields)))
    return F.substring(F.sha2(F.concat_ws("\n", lines), 256), 1, 16)


def stale(now: DataFrame, index: DataFrame) -> DataFrame:
    """Ids that the index lacks or holds with another hash."""
    old = index.select("id", F.col("text_hash").alias("__h"))
    return now.join(old, "id", "left").where(~F.col("text_hash").eqNullSafe(F.col("__h"))).select("id")


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def mean_vectors(df: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """Per key the weighted mean of unit vectors, made a unit vector again; summed by dimension in partials."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(F.col(key).alias("key"), w.alias("w"), F.posexplode(unit(F.col(vector).cast("array<double>"))).alias("i", "x"))
    dims = rows.groupBy("key", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    lists = dims.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return lists.select("key", unit(F.transform("s", lambda e: e["x"])).alias("v"))


def _cells(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Queries and items dealt into cells of a grid, about ``QUERIES_IN_BLOCK`` by ``ITEMS_IN_BLOCK``, in which every pair meets once.

    The numbers of blocks come from the counted rows. A query's ``mean`` and ``std`` come along.
    """
    parts = max(1, -(-queries.count() // QUERIES_IN_BLOCK))
    blocks = max(1, -(-items.count() // ITEMS_IN_BLOCK))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("bigint"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    vector = unit(F.col("v").cast("array<double>")).alias("v")
    spread = [F.col(c) if c in queries.columns else F.lit(None).cast("double").alias(c) for c in ("mean", "std")]
    i = items.select(dealt("item", blocks).alias("block"), each(parts).alias("part"), F.col("item").alias("id"), F.lit(False).alias("q"), vector)
    q = queries.select(each(blocks).alias("block"), dealt("key", parts).alias("part"), F.col("key").alias("id"), F.lit(True).alias("q"), vector, *spread)
    return i.unionByName(q, allowMissingColumns=True)


def _scored(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A cell's places of queries, ids, items' ids, and the matrix of cosines."""
    side, ids = table.column("q").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
    at, base = np.flatnonzero(side), np.flatnonzero(~side)
    x = np.array(table.column("v").combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)
    return at, ids[at], ids[base], np.round(x[at] @ x[base].T, 12)


def top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``key, item, sim``: each query's k nearest items by cosine, ties to the smaller item.

    A cell's task multiplies matrices and returns k items a query, so only these are shuffled.
    """

    def best(table: pa.Table) -> pa.Table:
        _, keys, base, s = _scored(table)
        order = [np.lexsort((base, -row))[:k] for row in s]
        cat = lambda xs, t: np.concatenate([*xs, np.zeros(0, t)]).astype(t)
        found, sims = cat([base[o] for o in order], np.int64), cat([row[o] for row, o in zip(s, order, strict=True)], np.float64)
        return pa.table({"key": pa.array(np.repeat(keys, [len(o) for o in order]), pa.int64()), "item": pa.array(found), "sim": pa.array(sims)})

    near = _cells(queries, items).groupBy("block", "part").applyInArrow(best, "key bigint, item bigint, sim double")
    w = Window.partitionBy("key").orderBy(F.desc("sim"), "item")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarities(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``key, item, sim, mean, std`` of every pair, cell by cell; the last two are the query's own, null without."""

    def all_pairs(table: pa.Table) -> pa.Table:
        at, keys, base, s = _scored(table)
        own = {c: np.repeat(table.column(c).to_numpy()[at], len(base)) for c in ("mean", "std")}
        return pa.table({"key": pa.array(np.repeat(keys, len(base)), pa.int64()), "item": pa.array(np.tile(base, len(keys)), pa.int64()), "sim": pa.array(s.ravel())} | {c: pa.array(x, pa.float64()) for c, x in own.items()})

    return _cells(queries, items).groupBy("block", "part").applyInArrow(all_pairs, "key bigint, item bigint, sim double, mean double, std double")


def with_spread(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Queries with mean and deviation of their similarity to all items, from partial sums; pairs aren't shuffled."""
    spread = similarities(queries, items).groupBy("key").agg(F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"))
    return queries.join(spread, "key")


def preference_filter(calls: DataFrame, as_of: str, kinds: list[str] | None = None, disciplines: list[str] | None = None, no_fee: bool = False, text: str = "", countries: list[str] | None = None, funded_only: bool = False) -> DataFrame:
    """Calls that a preference does not rule out; what a call does not state never does, but for funding, which needs evidence.

    Open ones alone, by the deadline and the years in the title. ``countries`` (array) holds
    "any" as its wildcard; ``funding`` (array of categories) counts beyond mentoring and fee waivers.
    """
    keep = F.coalesce(F.col("deadline_date") >= F.to_date(F.lit(as_of)), F.lit(True)) & ~title_says_past(F.col("title"), as_of)
    if countries:
        place = F.col("countries")
        keep &= (F.coalesce(F.size(place), F.lit(0)) <= 0) | F.array_contains(place, "any") | F.arrays_overlap(place, F.array(*map(F.lit, countries)))
    if funded_only:
        keep &= F.coalesce(F.exists("funding", lambda c: ~c.isin("mentoring", "fee waiver")), F.lit(False))
    if kinds:
        keep &= F.coalesce(F.col("kind").isin(*kinds), F.lit(True))
    if disciplines:
        keep &= F.coalesce(F.col("discipline").isin("all", *disciplines), F.lit(True))
    if no_fee:
        keep &= F.coalesce(~F.col("has_fee"), F.lit(True))
    if text:
        keep &= F.contains(F.lower("title"), F.lit(text.lower()))
    return calls.where(keep)


def grouped_ranking(df: DataFrame, order: Column) -> DataFrame:
    """Position within (profile, group) by an order, ties by the call's place."""
    w = Window.partitionBy("profile_id", "grp").orderBy(order, "opportunity_id")
    return df.withColumn("pos", F.row_number().over(w))


def topic_words(text: Column) -> Column:
    """Distinct lower-cased words of four letters and more, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zà-öø-ÿ]{4,})"), F.lit(1)))


def word_frequency(df: DataFrame, text: str) -> DataFrame:
    """In how many texts a word occurs; counted in each task first."""
    return df.select(F.explode(topic_words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def same_word_forms(words: DataFrame) -> DataFrame:
    """Pairs of a word with another that counts as its form, both ways.

    k = max(5, shorter - 2) leading letters must agree. A word gives the beginning that it
    needs as the shorter one, and those that it would have beside each shorter length, so
    that the join finds matches alone, however many words share five letters.
    """
    long = words.where("length(word) >= 5").select("word", F.length("word").alias("n"))
    start = lambda word, n: F.left(word, F.greatest(F.lit(5), F.col(n) - 2))
    shorter = long.select("word", "n", start("word", "n").alias("p"))
    longer = long.select(F.col("word").alias("form"), F.explode(F.sequence(F.lit(5), F.col("n"))).alias("n")).withColumn("p", start("form", "n"))
    pairs = shorter.join(longer, ["n", "p"]).where("word <> form").select("word", "form")
    return pairs.union(pairs.where("length(form) > length(word)").select("form", "word"))


def specific_words(df: DataFrame, text: str, share: float = 0.10) -> DataFrame:
    """Words that with all their forms occur in less than a share of the texts."""
    freq = materialise(word_frequency(df, text), "frequency")  # the texts are read once; what follows is of the vocabulary's size
    # a word's forms by beginning: those at least as long as it are summed by its length, shorter ones by their own
    long = freq.where("length(word) >= 5").withColumn("n", F.length("word"))
    start = lambda n: F.left("word", F.greatest(F.lit(5), F.col(n) - 2)).alias("p")
    each = long.select("word", "df", F.col("n").alias("own"), F.explode(F.sequence(F.lit(5), F.col("n"))).alias("n")).select("word", "df", "own", "n", start("n"))
    sums = each.groupBy("n", "p").agg(F.sum("df").alias("__longer"), F.coalesce(F.sum(F.when(F.col("own") == F.col("n"), F.col("df"))), F.lit(0)).alias("__same"))
    met = each.join(sums, ["n", "p"])
    added = met.groupBy("word").agg(F.sum(F.when(F.col("n") == F.col("own"), F.col("__longer") - F.col("df")).otherwise(F.col("__same"))).alias("__more"))
    total = df.select(F.count("*").alias("__n"))
    summed = freq.join(added, "word", "left").select("word", (F.col("df") + F.coalesce("__more", F.lit(0))).alias("n"))
    return summed.where(F.col("n") < share * F.lit(total.scalar())).select("word", "n")


def shared_words(left: DataFrame, right: DataFrame, specific: DataFrame, key: str, text: str, other_key: str, other_text: str) -> DataFrame:
    """How many specific words two texts share, by an inverted index over these alone.

    The left texts' specific words are written first: where their table is small, the right texts meet it where
    they lie, and only counts of pairs are shuffled.
    """
    a = materialise(left.select(F.col(key).alias("a"), F.explode(topic_words(F.col(text))).alias("word")).join(specific.select("word"), "word"), "wanted")
    b = right.select(F.col(other_key).alias("b"), F.explode(topic_words(F.col(other_text))).alias("word"))
    return a.join(b, "word").groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def same_word(a: Column, b: Column) -> Column:
    """Equal, or one a form of the other by the rule of ``same_word_forms``."""
    k = F.greatest(F.lit(5), F.least(F.length(a), F.length(b)) - 2)
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 5) & (F.left(a, k) == F.left(b, k)))


def shared_word_forms(left: DataFrame, right: DataFrame, specific: DataFrame, key: str, text: str, other_key: str, other_text: str) -> DataFrame:
    """How many specific words of the right text the left one holds in any form, each word in one form.

    Left words go through their forms to the specific words, which the inverted index then
    joins exactly. Of each pair the matched words are taken in text order, without those
    that are a form of one taken before.
    """
    word = materialise(specific.select("word"), "specific")
    mine = left.select(F.col(key).alias("a"), F.explode(topic_words(F.col(text))).alias("word"))
    forms = same_word_forms(mine.select("word").union(word).distinct()).join(word.withColumnRenamed("word", "form"), "form")
    a = materialise(mine.join(word, "word").select("a", "word").union(mine.join(forms, "word").select("a", "form")).distinct(), "wanted")
    b = right.select(F.col(other_key).alias("b"), F.posexplode(topic_words(F.col(other_text))).alias("pos", "word"))
    pairs = a.join(b, "word").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "word")))["word"].alias("ws"))
    taken = F.aggregate("ws", F.array().cast("array<string>"), lambda seen, w: F.when(F.exists(seen, lambda s: same_word(s, w)), seen).otherwise(F.array_append(seen, w)))
    return pairs.select("a", "b", F.size(taken).cast("bigint").alias("n_shared"))


def top_shared(pairs: DataFrame, k: int) -> DataFrame:
    """Each left text's ``k`` right texts with most shared words, ties to the smaller."""
    w = Window.partitionBy("a").orderBy(F.desc("n_shared"), "b")
    return pairs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def shared_of(pairs: DataFrame, left: DataFrame, right: DataFrame, specific: DataFrame) -> DataFrame:
    """``a, b, word`` of given pairs; ``left`` and ``right``: ``key, text``."""
    word = specific.select("word")
    a = pairs.select("a", "b").join(left.select(F.col("key").alias("a"), F.explode(topic_words(F.col("text"))).alias("word")), "a")
    b = right.join(pairs.select(F.col("b").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("b"), F.explode(topic_words(F.col("text"))).alias("word"))
    return a.join(word, "word").join(b, ["b", "word"]).select("a", "b", "word")


def best_sentence(shared: DataFrame, sentences: DataFrame, side: str, least_words: int) -> DataFrame:
    """For each pair its best sentence on one side: ``a, b, idx, sentence, words``.

    ``shared``: ``a, b, word``; ``sentences``: ``key, idx, chunk`` of the texts that ``side`` names; shorter
    ones than ``least_words`` explain nothing. The sentence whose distinct words meet most
    shared words in some form, the first on a tie; ``words`` are those words, in order. Words
    meet by four leading letters, so only texts of a pair do.
    """
    shared = materialise(shared, "shared")
    long = sentences.join(shared.select(F.col(side).alias("key")).distinct(), "key", "left_semi").where(word_count(F.col("chunk")) >= least_words)
    said = long.select(F.col("key").alias(side), "idx", "chunk", F.posexplode(topic_words(F.col("chunk"))).alias("pos", "said")).withColumn("__p", F.left("said", F.lit(4)))
    near = shared.withColumn("__p", F.left("word", F.lit(4))).join(said, [side, "__p"]).where(same_word(F.col("said"), F.col("word")))
    words = F.transform(F.array_sort(F.collect_set(F.struct("pos", "said"))), lambda x: x["said"]).alias("words")
    each = near.groupBy("a", "b", "idx", "chunk").agg(words)
    best = each.groupBy("a", "b").agg(F.max_by(F.struct("idx", "chunk", "words"), F.struct(F.size("words"), -F.col("idx"))).alias("m"))
    return best.select("a", "b", "m.idx", F.col("m.chunk").alias("sentence"), F.array_join("m.words", " ").alias("words"))


def check_vocabulary(values: Sequence[str], known: Sequence[str], what: str) -> None:
    """A filter with a value that the vocabulary lacks is refused."""
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"unknown {what}: {', '.join(unknown)}")


def title_says_past(title: Column, as_of: str) -> Column:
    """Whether the years of a title are all before this one."""
    years = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("\\b(20[0-9]{2})\\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(F.array_max(years) < F.year(F.to_date(F.lit(as_of))), F.lit(False))


def match_percent(df: DataFrame, weights: tuple[float, float, float], intercept: float) -> DataFrame:
    """Z of the similarity by its query's ``mean`` and ``std``, logistic probability, and whole percent rounded half-even."""
    z = (F.col("sim") - F.col("mean")) / F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    x = F.lit(intercept) + weights[0] * F.col("z") + weights[1] * F.least("n_shared", F.lit(5)) + weights[2] * F.col("mismatch").cast("int")
    return df.withColumn("z", z).withColumn("percent", F.bround(100 / (1 + F.exp(-x))).cast("int"))


def discipline_mismatch(mine: Column, theirs: Column) -> Column:
    """Both sides state disciplines, none is for all, and none is shared."""
    return F.coalesce((F.size(mine) > 0) & (F.size(theirs) > 0) & ~F.array_contains(theirs, "all") & ~F.arrays_overlap(mine, theirs), F.lit(False))


def suggested(df: DataFrame, key: Sequence[str], order: Column, tie: str, more: int = 3) -> DataFrame:
    """The closest item and the next ``more`` for each key."""
    w = Window.partitionBy(*key).orderBy(order, tie)
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= 1 + more)


def saved_stage(df: DataFrame, as_of: str) -> DataFrame:
    """The stage of a saved call: closed, completed, draft or saved."""
    closed = F.coalesce(F.col("deadline_date") < F.to_date(F.lit(as_of)), F.lit(False))
    stage = F.when(F.col("n_items").isNotNull() & (F.col("n_done") == F.col("n_items")), "completed").when(closed, "closed").when(F.col("n_items").isNotNull(), "draft").otherwise("saved")
    return df.withColumn("stage", stage)


def passages(chunks: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """Each question's k nearest passages of the same artist, ties in file order.

    The join stays within an artist; scores are sums over the vectors' dimensions.
    """
    both = questions.select("artist_id", "question_id", F.col("v").alias("qv")).join(chunks, "artist_id")
    score = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    w = Window.partitionBy("artist_id", "question_id").orderBy(F.desc(F.round("score", 9)), "chunk_index")
    return both.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("qv", "v")


def gathered(ranked: DataFrame) -> DataFrame:
    """Of each artist all passages found by any question, once, in file order."""
    once = ranked.select("artist_id", "chunk_index").distinct()
    return once.groupBy("artist_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("chunk_index")), lambda x: x.cast("string"))).alias("passages"))



def page_of(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """One page of each key's ranking; ``pos`` counts from 1."""
    return df.where((F.col("pos") > offset) & (F.col("pos") <= offset + limit))


def options(df: DataFrame, values: str, wildcard: str = "all") -> DataFrame:
    """The distinct values that a filter offers, without the wildcard."""
    return df.where(F.col(values).isNotNull() & (F.col(values) != wildcard)).select(F.col(values).alias("value")).distinct()
