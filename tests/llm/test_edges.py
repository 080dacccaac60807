"""SQL of the llm queries, and the edge cases that the other tests leave out."""

import collections
import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callweave.llm import bpe, mixing, quality, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = lambda df: sorted(tuple(None if pd.isna(x) else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    theirs = con.sql(queries.oracle_sql()[name]).df()
    mine = queries.queries()[name](spark, SF).toPandas()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def spark_hash(value: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest(value, seed=seed)
    return h - (1 << 64) if h >> 63 else h


def grams(text, buckets):
    """Buckets of words, then of pairs of neighbouring word ends, as plain Python."""
    words = [w.decode() for w in (text or "").encode().split()]
    ends = [spark_hash(w[-3:].encode()) for w in words]
    long = lambda x: int(x).to_bytes(8, "little", signed=True)
    pairs = [spark_hash(long(b), spark_hash(long(a)) & (1 << 64) - 1) for a, b in zip(ends, ends[1:])]
    return [spark_hash(w.encode()) % buckets for w in words] + [p % buckets + buckets for p in pairs]


def test_quality_verdicts_equal_brute_force(spark):
    words = [f"{a}{b}" for a in "klmnp" for b in ("ab", "eco", "idu", "of")]
    texts = [" ".join(words[(i * j) % 20] for j in range(12 + i)) for i in range(12)] + ["zz yy " * 20, None, "", " \n ", "long word " * 100_000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, texts[4], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, llr int")
    ratio = quality.fit(df, spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id bigint"), buckets=32)
    raw, good = collections.Counter(), collections.Counter()
    for i, t, _ in rows:
        raw.update(grams(t, 32))
        good.update(grams(t, 32) if i in (1, 2, 3) else [])
    weights = []
    for k in (0, 32):
        g, r = [good[b] for b in range(k, k + 32)], [raw[b] for b in range(k, k + 32)]
        weights += [round(1e6 * (math.log((x + 1) / (sum(g) + 32)) - math.log((y + 1) / (sum(r) + 32)))) for x, y in zip(g, r)]
    assert list(ratio.weights) == weights
    want = {}
    for i, t, _ in rows:
        own = grams(t, 32)
        want[t] = sum(weights[b] for b in own) // len(own) if own else None
    got = quality.score(df, ratio).collect()
    assert len(got) == len(rows) and all(r.llr == want[r.text] for r in got)
    # a tie with the threshold is kept
    edge = want[texts[1]]
    assert {r.kept for r in quality.score(df.where("doc_id = 1"), ratio, threshold=edge).collect()} == {True}
    assert {r.kept for r in quality.score(df.where("doc_id = 1"), ratio, threshold=edge + 1).collect()} == {False}
    assert quality.score(df.where("false"), ratio).count() == 0 and set(quality.fit(df.where("false"), spark.createDataFrame([], "doc_id bigint"), buckets=32).weights) == {0}


def test_codes_of_repeated_and_unnamed_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    df = spark.createDataFrame([(1, "One two."), (1, "One two."), (None, "ab"), (2, "word " * 200_000)], "doc_id bigint, text string")
    got = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(got) == 4 and all(np.frombuffer(r.ids, "<u4").tolist() == lib.encode(r.text, add_special_tokens=False).ids for r in got)


def test_shards_of_hard_rows(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000), (1, "x" * 3_000_000), (2, ""), (3, None)], "doc_id bigint, text string")
    got = sharding.assign_shards(df, sharding.even_tree(3)).collect()
    assert sorted(r.size for r in got) == [16, 16, 3_000_016, 3_000_016] and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sorted(r.slot for s in {r.shard for r in got} for r in got if r.shard == s) == sorted(i for s in {r.shard for r in got} for i in range(sum(r.shard == s for r in got)))
    assert sharding.assign_shards(df.where("false"), sharding.even_tree(3)).count() == 0


def test_mixing_of_one_very_long_document(spark):
    df = spark.createDataFrame([(1, "a", "w " * 500_000), (2, "b", "w"), (3, "b", None)], "doc_id bigint, source string, text string")
    got = mixing.mix(df, mixing.Policy(most_repeats=3.0, entropy_gain=None)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and sum(r.tokens for r in got if r.source == "a") == 500_000
    assert sum(r.tokens for r in got if r.source == "b") <= 4


def test_digests_do_not_depend_on_the_reader(spark):
    from callweave.llm import warc

    row = spark.createDataFrame([("é\r\n",)], "t string").select(warc.sha1_base32(F.col("t"))).first()[0]
    import base64

    assert row == base64.b32encode(hashlib.sha1("é\r\n".encode()).digest()).decode()
