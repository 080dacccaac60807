"""Corpus analysis: the aggregates behind a corpus card and its charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.operators.ordered import running_sum

UNSTATED, OTHER = "(not stated)", "(other)"


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column with its number of nulls; one pass over the table."""
    sums = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    return sums.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in columns))).alias("s")).select(
        F.col("s.name").alias("column_name"), (F.col("n") - F.col("s.filled")).alias("n_null")
    )


def corpus_card(df: DataFrame, source: str, day: str) -> DataFrame:
    """Rows, distinct sources, and the span of the deadline."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(source).alias("n_sources"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts by value, nulls named."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(UNSTATED)).alias("value")).agg(F.count("*").alias("n"))


def cumulative_share(df: DataFrame, column: str) -> DataFrame:
    """Sources by size with the share that the largest hold together."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), "value")  # one row a source
    return counts.select("value", "n", F.row_number().over(order).alias("pos"), F.sum("n").over(order).alias("__run"), F.sum("n").over(Window.partitionBy()).alias("__all")).select(
        "value", "n", "pos", F.round(F.col("__run") / F.col("__all"), 6).alias("share")
    )


def bucketed(df: DataFrame, column: str, top: int, name: str = "bucket") -> DataFrame:
    """The column with all but its ``top`` most frequent values as one."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).count()
    best = counts.orderBy(F.desc("count"), "__v").limit(top).select("__v", F.lit(1).alias("__top"))
    joined = df.join(F.broadcast(best), F.col(column) == F.col("__v"), "left")  # ``top`` rows
    return joined.withColumn(name, F.when(F.col(column).isNull(), UNSTATED).when(F.col("__top").isNull(), OTHER).otherwise(F.col(column))).drop("__v", "__top")


def share_by(df: DataFrame, group: str, condition: Column, top: int = 6) -> DataFrame:
    """The share of rows that meet a condition by bucketed group."""
    return bucketed(df, group, top).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg(condition.cast("double")), 6).alias("share"))


def component_profile(df: DataFrame, category: str, amount: str) -> DataFrame:
    """By category: rows, exact median, and the largest amount.

    Ranks come from range partitions, so no task holds all amounts of a category.
    """
    rows = df.select(F.col(category).alias("category"), F.col(amount).cast("double").alias("amount"), F.monotonically_increasing_id().alias("tie"))
    sums = rows.groupBy("category").agg(F.count("*").alias("n"), F.round(F.max("amount"), 4).alias("largest"))
    ranked = running_sum(rows.where("amount is not null"), F.lit(1), ["amount", "tie"], ["category"])
    middle = ranked.where(F.col("run").isin(F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)))
    median = middle.groupBy("category").agg(F.round(F.avg("amount"), 4).alias("median_amount"))
    return sums.join(median.withColumnRenamed("category", "__c"), F.col("category").eqNullSafe(F.col("__c")), "left").select("category", "n", "median_amount", "largest")


def log_histogram(df: DataFrame, amount: str) -> DataFrame:
    """Counts by power of ten of a positive amount."""
    return df.where(F.col(amount) > 0).groupBy(F.floor(F.log10(amount)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def keyword_hits(df: DataFrame, text: str, cues: dict[str, str]) -> DataFrame:
    """Texts that match each class of cues, and none of them."""
    flags = [F.col(text).rlike(p).cast("int").alias(n) for n, p in cues.items()]
    hit = df.select(*flags)
    none = F.when(sum((F.col(n) for n in cues), F.lit(0)) == 0, 1).otherwise(0)
    return hit.agg(*(F.sum(n).alias(n) for n in cues), F.sum(none).alias("none"))


def cross_tab(df: DataFrame, a: str, b: str, top: int = 8) -> DataFrame:
    """Two categoricals, each bucketed, with their counts in long form."""
    both = bucketed(bucketed(df, a, top, "a"), b, top, "b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def co_occurrence(df: DataFrame, key: str, item: str) -> DataFrame:
    """Keys in which two items occur together; pairs are made within a key's distinct items."""
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("s"))
    left = sets.select("s", F.posexplode("s").alias("i", "a"))
    return left.select("a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def word_quartiles(df: DataFrame, group: str, text: str) -> DataFrame:
    """Word counts by group: mean, quartiles and range."""
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t\\r\\n\\f\\x0B]+"), ""))
    counted = df.select(F.col(group).alias("grp"), words.alias("w"))
    quart = lambda p: F.expr(f"percentile(w, {p})")
    return counted.groupBy("grp").agg(
        F.round(F.avg("w"), 4).alias("mean_words"), quart(0.25).alias("q1"), quart(0.5).alias("q2"), quart(0.75).alias("q3"), F.min("w").alias("least"), F.max("w").alias("most")
    )
