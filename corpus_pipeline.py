"""From raw documents to a tokenised training mixture, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the one before
kept. All but the last return the columns of ``docs``; columns that a stage needs are named
apart from those, so that extra columns pass through whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import bpe, language, minhash, mixing, quality
from callweave.plans.scratch import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that speak for no learned language, and gives the others without ``lang`` the predicted one.

    Rejected: null and empty texts, texts without letters, and texts whose best cosine is
    below LEAST_COSINE, which a random vector passes once in 700 times. Prototypes are learned
    from the training rows with a language. Where there are none, nothing can be told apart
    and nothing is rejected. Rows are judged one by one, whatever their id; whole texts count.
    """
    profiles = language.fit(docs.where(language.in_training()))
    if not profiles.blocks:
        return docs
    predicted = language.predict(docs, profiles, lang_col="__lang_pred", score_col="__lang_score")
    known = predicted.where((F.col("__lang_pred") != language.UNKNOWN) & (F.col("__lang_score") >= language.LEAST_COSINE))
    return known.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules, as null and empty texts do, or fall short of the log-likelihood ratio."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratio = quality.fit(docs, quality.trusted_ids(labels))
    return quality.passed(quality.score(docs, ratio, prefix="__q_"), "__q_kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class; rows with a null id all stay."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), minhash.Params())
    gone = materialise(found.where("not kept").select("doc_id").distinct(), "dropped")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeats = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeats.isEmpty():
        return left
    # rows that share an id are one document: the one with the first text stays
    named = left.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), "text").alias("__row"))
    return named.select("__row.*").union(left.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws each source to its temperature weight, and writes the documents in the order of the mixture.

    Halfway from the corpus' entropy to that of equal weights, small sources up to twice, no
    document left out. Rows come range partitioned and sorted by their place in the
    mixture, so that every stretch of it holds the sources in their weights. Rows that share
    an id are drawn together. Rows with a null id can't be told apart and come once, last.
    """
    known = docs.where("doc_id is not null")
    lean = known.select("doc_id", "source", mixing.whitespace_tokens(F.col("text")).alias("tokens"))
    once = lean.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.*")
    drawn = mixing.mix(once, tokens=F.col("tokens")).select("doc_id", F.col("mix_pos").alias("__pos"), F.col("pass").alias("__pass"))
    placed = known.join(drawn, "doc_id").unionByName(docs.where("doc_id is null"), allowMissingColumns=True)
    order = [F.col("__pos").asc_nulls_last(), F.col("doc_id"), F.col("__pass")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the packed ids of each whole text and their number; null and empty texts have none."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_bpe),
]

#: Hashing, prototypes and merges are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
