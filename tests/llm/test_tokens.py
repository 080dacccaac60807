import random
import tracemalloc
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from callweave.llm import bpe, token_counts, token_orc

TEXTS = ["", "The cat sat on the mat.", "<|endoftext|>a<|startoftext|> B", "aaaaaaaaaaaaaaaa", "ΑΣΑΣ ΟΔΥΣΣΕΥΣ İstanbul ẞ", "é Å don't I'LL 'S", "  x\x85y\x1cz​", "\U0001f600 ok\n\n a", "1234 ١٢٣ ⅷ 中文", "x" * 5000, "a  \n b\t \tc"]
VOCABULARIES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_encode_and_decode_match_the_library(spark, name):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    for r in bpe.decode(bpe.encode(df, path), path).collect():
        ref = lib.encode(r.text or "", add_special_tokens=False)
        assert np.frombuffer(r.ids, "<u4").tolist() == ref.ids and r.n_tokens == len(ref.ids)
        assert r.decoded == lib.decode(ref.ids, skip_special_tokens=False)
    assert bpe.encode(df.where("false"), path).count() == 0


RANDOM = random.Random(3)
HARD = [*TEXTS[:8], *TEXTS[9:], unicodedata.normalize("NFD", "Málaga über naïve 한국어 x"), "thinontioneder 'rest''ll 'Tis we've", "B!!<|endoftext|>", " a \n\n  b   'tis  \n"]
HARD += ["".join(RANDOM.choice("ab 'stlvé\u0301ΣİǄ1!\n\t<|endoftext|>") for _ in range(50)) for _ in range(30)]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_every_prefix_count_matches_the_library(spark, name):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rows = [(i, t, 1) for i, t in enumerate([*HARD, None, "x" * 5000, HARD[1]])] + [(None, "ab", 1)]
    df = token_counts.with_prefix_table(spark.createDataFrame(rows, "doc_id bigint, text string, prefix_tokens int"), path)
    for r in df.collect():
        text = r.text or ""
        got = np.cumsum(np.frombuffer(r.prefix_tokens, "<i2")).tolist()
        assert r.n_tokens == count(text) and len(got) == len(text)
        if len(text) < 1000:
            assert got == [count(text[:k]) for k in range(1, len(text) + 1)]
    assert token_counts.with_prefix_table(df.where("false"), path).count() == 0


def test_budgets_are_answered_by_the_table(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    texts = ["Unbelievable artists may apply, until noon; don't wait! " * 2, "a <|endoftext|> b", "\U0001f600é x", "", None]
    df = token_counts.with_prefix_table(spark.createDataFrame([(t, 0) for t in texts], "text string, n int"), path)
    for budget in (0, 1, 2, 7, 20, 1000):
        for t, r in zip(texts, token_counts.truncate(df, budget).collect(), strict=True):
            want = max((k for k in range(len(t or "") + 1) if count(t[:k] if t else "") <= budget), default=0)
            assert r.text == (None if t is None else t[:want]) and len(r.prefix_tokens) == 2 * want
        assert [r.tokens_at for r in token_counts.tokens_at(df, budget).collect()] == [count((t or "")[:budget]) for t in texts]


def test_all_code_points_match_the_library():
    """Every code point between letters, at a word's end, and alone."""
    for name in VOCABULARIES:
        path = public_tokenizers.path(name)
        lib, v = Tokenizer.from_file(path), bpe.Vocabulary(path)
        codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not 0x3FFFF < c < 0xE0000 and not c >= 0xF0200]
        texts = ["\n".join(f"a{chr(c)}b c{chr(c)} {chr(c)}" for c in codes[i : i + 64]) for i in range(0, len(codes), 64)]
        for lo in range(0, len(texts), 200):
            part = texts[lo : lo + 200]
            for t, ids, ref in zip(part, v.encode(part), lib.encode_batch_fast(part, add_special_tokens=False), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == ref.ids, [hex(ord(c)) for c in t if len(lib.encode(f"a{c}b c{c} {c}", add_special_tokens=False).ids) * 4 != len(v.encode([f"a{c}b c{c} {c}"])[0])]


def test_token_files_round_trip(spark, tmp_path):
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    lib = Tokenizer.from_file(paths[0])
    rows = [(i * 7 % 11, t, 1) for i, t in enumerate([*TEXTS[:-1], None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part int")
    out = str(tmp_path / "t")
    token_orc.write_tokens(token_orc.encode_sorted(df, *paths, end_id=2), out)
    got = token_orc.with_starts(token_orc.checksums(token_orc.read_tokens(spark, out))).orderBy("doc_id").collect()
    at = 0
    for r, (doc_id, text, _) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r.doc_id for r in token_orc.find(spark, out, [3]).collect()] == [3]
    none = str(tmp_path / "none")
    token_orc.write_tokens(token_orc.encode_sorted(df.where("false"), *paths, end_id=2), none)
    assert token_orc.read_tokens(spark, none).count() == 0


def test_both_encoders_of_token_files_agree():
    """Texts around the length of white space from which the pair index takes over, and null and repeated ids."""
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    v, lib = bpe.vocabulary(paths[0]), Tokenizer.from_file(paths[0])
    encode = token_orc.encoder(*paths)
    for n in (1998, 1999, 2000, 2001, 50_000):
        for c in (" ", "\n", "\t ", "x", "xy"):
            text = f"start {c * n}end<|endoftext|> it's"
            ids = lib.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encode(text), "<u4").tolist() == ids == np.frombuffer(v.encode([text])[0], "<u4").tolist()


def test_searches_skip_stripes(spark, tmp_path):
    """A search by id reads fewer rows than the files hold, by their indexes and Bloom filters, and stripes are read in parallel."""
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    df = spark.range(0, 60_000, 3).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).union(spark.createDataFrame([(None, "n"), (3, "twice")], "doc_id bigint, text string"))
    out = str(tmp_path / "t")
    token_orc.write_tokens(token_orc.encode_sorted(df, *paths, end_id=2).coalesce(1), out)

    def read(ids):
        found = token_orc.find(spark, out, ids)
        rows = [r.doc_id for r in found.collect()]
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return rows, scan.metrics().apply("numOutputRows").value()

    rows, seen = read([3])
    assert rows == [3, 3] and 0 < seen <= 2 * token_orc.ROW_GROUP
    assert read([4]) == ([], 0)  # within the range of a row group; only the Bloom filter says no
    assert token_orc.read_tokens(spark, out).count() == 20_002


def test_prefix_counts_of_long_texts_without_blanks():
    """A megabyte of composed and of decomposed text each takes seconds, and sampled prefixes equal the library's."""
    import time
    import unicodedata

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, c, rnd = Tokenizer.from_file(path), token_counts.counter(path), random.Random(6)
    han = [chr(x) for x in range(0x4E00, 0x4F00)]
    kana = [unicodedata.normalize("NFD", chr(x)) for x in range(0x304B, 0x3070)]
    for letters in (han, [*han, "塚"], kana):
        text = "".join(rnd.choices(letters, k=340_000))
        assert len(text.encode()) > 1_000_000
        began = time.time()
        packed, n = c.prefix_table([text])[0]
        assert time.time() - began < 60
        counts = np.cumsum(np.frombuffer(packed, "<i2"), dtype=np.int64)
        assert len(counts) == len(text) and counts[-1] == n
        for k in [1, 2, 3, *rnd.sample(range(1, 30_000), 12), len(text)]:
            assert counts[k - 1] == len(lib.encode(text[:k], add_special_tokens=False).ids)


def test_prefix_counts_of_marks_that_move():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, c, rnd = Tokenizer.from_file(path), token_counts.counter(path), random.Random(7)
    pool = ["é", "Ệ", "o", "ᄀ", "ᅡ", "'s", "!", "́", "Å", "İ", "ͅ", "9", "Σ", "ệ", "̸", "̣", "=", "יִ", "ো", "Ᲊ", "が"]
    for _ in range(150):
        text = "".join(rnd.choices(pool, k=rnd.randrange(1, 60)))
        counts = np.cumsum(np.frombuffer(c.prefix_table([text])[0][0], "<i2")).tolist()
        assert counts == [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]


class Captured:
    """Stands for a DataFrame: gives the function that its rows would go through."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def mapInArrow(self, make, schema):  # noqa: N802
        return make


def test_encoding_a_large_batch_takes_bounded_memory():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=15)) for _ in range(2000)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    make = bpe.encode(Captured(), path)
    assert [len(b) for b in make(iter([batch.slice(0, 2)]))] == [2]
    bpe.vocabulary(path).known.clear()
    tracemalloc.start()
    rows = sum(b.num_rows for b in make(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bpe.vocabulary(path).known.clear()
    assert rows == 200 and peak < 200 << 20, peak >> 20
