"""The other operators against brute force and their edge cases, on small fixtures."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from callweave.llm import ann, components, language, minhash, mixing, quality, sharding, warc

RND = random.Random(5)
WORDS = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[RND.randrange(len(w))] = f"x{RND.random()}"
    return " ".join(w)


def corpus():
    base = [prose(80) for _ in range(6)]
    texts = [edited(b, RND.randrange(12)) for b in base for _ in range(12)] + base * 2 + [prose(60) for _ in range(20)]
    return [*texts, None, "", "one", "One", "two words", " TWO\twords "]


def crowd():
    """A group of near copies beyond 64 and 512 classes, a chain of them, and a long text twice."""
    base, long = prose(60), prose(40_000)
    chain = [" ".join(f"c{j}" for j in range(3 * i, 3 * i + 50)) for i in range(30)]
    return [edited(base, RND.randrange(1, 7)) for _ in range(600)] + chain + [long, edited(long, 300), edited(long, 20_000)] + [base, base]


@pytest.mark.parametrize("k,block,texts,shingles", [(2, 512, "corpus", 1 << 19), (2, 5, "corpus", 1 << 19), (5, 7, "corpus", 300), (2, 512, "crowd", 1 << 16)])
def test_near_duplicates_equal_brute_force(spark, k, block, texts, shingles):
    rows = [(3 * i % 2113, t, "extra", 0) for i, t in enumerate(globals()[texts]())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component string, node int")
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = minhash.near_duplicates(df, minhash.Params(words=k, block=block, block_shingles=shingles)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), root(i), root(i) == i) for i in ids}
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    hub = [(200, 1000 + i) for i in range(3000)] + [(1999, 5000), (5000, 150)]
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)] + hub, "u bigint, v bigint")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100} | {i: 150 for i in (150, 200, 5000, *range(1000, 4000))}


@pytest.fixture
def file_by_file(spark):
    """Every file is a partition of its own, as it is where tables are large."""
    sizes = {f"spark.sql.files.{k}": "256k" for k in ("maxPartitionBytes", "openCostInBytes")}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k in sizes:
        spark.conf.unset(k)


def test_components_equal_a_plain_walk(spark, file_by_file):
    rnd = random.Random(11)
    links = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(700)] + [(i + 1, i) for i in range(1000, 1200)]
    links += [(5000 - i, 5001) for i in range(500)] + [(3000, 5100 + i) for i in range(500)] + [(2**62, 4999), (-5, 17), (8, 8)]
    parent = {i: i for x in links if x[0] != x[1] for i in x}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in (x for x in links if x[0] != x[1]):
        x, y = sorted((root(u), root(v)))
        parent[y] = x
    for spread in (1, 40):  # in one partition, and dealt so that few links of a node meet
        edges = spark.createDataFrame([*links, *links[:300], (None, 4), (4, None)], "u bigint, v bigint").repartition(spread)
        got = [tuple(r) for r in components.components(edges).collect()]
        assert sorted(got) == sorted((i, root(i)) for i in parent)
    assert components.components(edges.where("false")).count() == 0


def test_components_take_few_shuffles(spark, file_by_file, monkeypatch):
    shuffles, plain = [], components.materialise

    def counted(df, name):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count(" Exchange "))
        return plain(df, name)

    monkeypatch.setattr(components, "materialise", counted)
    stars = spark.createDataFrame([(1000 * i + j, 1000 * i) for i in range(20) for j in range(1, 40)], "u bigint, v bigint")
    assert components.components(stars).count() == 800
    assert sum(shuffles) == 0, shuffles
    shuffles.clear()
    chains = spark.createDataFrame([(100 * i + j + 1, 100 * i + j) for i in range(50) for j in range(20)], "u bigint, v bigint").repartition(16)
    assert {r.component % 100 for r in components.components(chains).collect()} == {0}
    assert 0 < sum(shuffles) <= 40, shuffles


def test_archives_round_trip(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n" + "é" * 3000
    rows = [(1, "http://a", tricky, 1), (2, "u", "same", 1), (5, "u", "same", 1), (5, "u", "same", 1), (3, None, None, 1), (4, "u", "", 1), (None, "u", "z", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, role int")
    chunks = warc.chunk_rows(warc.with_roles(pages), chunk_bytes=1000)
    warc.write_archives(warc.record_text(chunks), str(tmp_path / "w"))
    back = warc.read_archives(spark, str(tmp_path / "w"))
    assert "".join(r.data for r in back.where("page_id = 1").orderBy("segment").collect()) == tricky
    got = sorted([tuple(r)[:5] for r in warc.record_heads(back).collect()], key=str)
    kept = {}
    for i, _, h, _ in rows:
        kept[h or ""] = max(kept.get(h or "", -1), -1 if i is None else i)
    b32 = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(i, len((h or "").encode()), b32(h or ""), *(("response", None) if i is None or kept[h or ""] == i else ("revisit", kept[h or ""]))) for i, _, h, _ in rows]
    assert got == sorted(want, key=str)


def test_no_record_is_lost_that_ends_like_a_record(spark, tmp_path):
    from pyspark.sql import functions as F

    ends = F.element_at(F.array(*map(F.lit, ("\r\n", "\r", "\r\n\r\n", "\r\n\r\nWARC/1.1\r", "WARC/1.1\r\n", "x"))), (F.col("id") % 6 + 1).cast("int"))
    pages = spark.range(150_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("id").cast("string"), ends).alias("html"))
    warc.write_archives(warc.record_text(warc.chunk_rows(warc.with_roles(pages))), str(tmp_path / "w"))
    heads = warc.record_heads(warc.read_archives(spark, str(tmp_path / "w")))
    same = heads.join(pages, "page_id").where((F.col("payload_digest") == warc.sha1_base32(F.col("html"))) & (F.col("payload_bytes") == F.octet_length("html")))
    assert heads.count() == 150_000 and same.count() == 150_000


def test_long_payloads_are_cut_without_copies():
    import tracemalloc

    raw = memoryview(b"0123456789abcdef" * (4 << 20))
    tracemalloc.start()
    assert sum(map(len, warc.cut(raw))) == len(raw) and tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    assert [bytes(x) for x in warc.cut(memoryview("ab\u00e9WARC/1.1\r\nc".encode()), 3)] == [b"ab", "\u00e9W".encode(), b"ARC", b"/1.", b"1\r\n", b"c"]


def test_damage_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u", "abc" * 500), (2, "v", "")], "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(warc.record_text(warc.chunk_rows(warc.with_roles(pages), 600)), str(tmp_path / "w"))
    back = warc.read_archives(spark, str(tmp_path / "w"))
    assert sorted((r.page_id, r.n_chunks) for r in warc.record_heads(back).collect()) == [(1, 3), (2, 1)]
    for bad in (back.where("segment <> 2"), back.where("segment <> 3"), back.withColumn("data", F.regexp_replace("data", "^a", "b"))):
        with pytest.raises(Exception, match="damaged record of page 1"):
            warc.record_heads(bad).collect()
    assert warc.chunk_rows(warc.with_roles(pages.where("false"))).count() == 0


def test_search_is_exact_on_what_it_finds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 24)) * rng.uniform(0.5, 2, (400, 1))
    x[7] = x[8]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [1.0] * 3, 1), (904, [None] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    from pyspark.sql import functions as F

    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12 and r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append(r.vec_id)
    hits = sum(len(set(got[q]) & set([i for i in np.lexsort((np.arange(400), -(x @ x[q]))) if i != q][:10])) for q in range(0, 400, 20))
    assert hits >= 0.9 * 200
    few = ann.nearest(df.where("vec_id < 5 or vec_id = 20"), F.col("vec_id") % 20 == 0, k=10).collect()
    assert len(few) == 10
    assert ann.nearest(df.where("vec_id > 899 and vec_id <> 903"), F.lit(True)).count() == 0


def test_recall_of_the_shipped_search(spark):
    from pyspark.sql import functions as F

    from callweave.llm import queries

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(np.float64)
    got = collections.defaultdict(list)
    for r in queries.op3_cross_polytope_search(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        order = [j for j in np.lexsort((ids, -(x * x[i]).sum(axis=1))) if j != i][:20]
        hits += len(set(ids[order]) & set(got[ids[i]]))
    assert hits >= 0.95 * 20 * (ids % 20 == 0).sum()
    # finer buckets, of two cross-polytopes, and repeated rows with equal scores
    twice = spark.createDataFrame([(int(i), v.tolist(), 7) for i, v in zip(ids[:300], x[:300])] + [(int(i) + 10_000, x[0].tolist(), 7) for i in range(200)] + [(40, x[40].tolist(), 7)], "vec_id bigint, embedding array<double>, score int")
    found = ann.nearest(twice, F.col("vec_id") == 0, k=30, extra=4).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(10_000, 10_030)) and {type(r.score) for r in found} == {float}


def test_hash_tree(spark):
    rows = [(i, f"t{i % 7}" if i % 5 else None, i) for i in range(3000)] + [(None, "x", 0), (5, "t5", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard bigint")
    got = sharding.assign_shards(df, sharding.even_tree(40), buckets=8).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(got) == len(rows)
    assert 40 < sum(r.grown_shard == 40 for r in got) < 120
    first = next(r for r in got if r.doc_id == 6)
    assert (first.size, first.text_crc32) == (18, zlib.crc32(b"t6"))

    def draw(key, options):
        u = lambda p: (int(hashlib.md5(f"{p}/{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return min(options, key=lambda o: (-math.log(u(o[0])) / o[1], o[2]))[2]

    for r in got[:200]:
        key = "" if r.doc_id is None else r.doc_id
        g = draw(key, [(f"g{g}", 8.0, g) for g in range(5)])
        k = draw(key, [(f"g{g}/r{k}", 4.0, k) for k in (2 * g, 2 * g + 1)])
        assert r.shard == draw(key, [(f"g{g}/r{k}/{s}", 1.0, s) for s in range(4 * k, 4 * k + 4)])
    with pytest.raises(ValueError):
        sharding.even_tree(0)


def test_languages_are_told_apart(spark):
    talk = {"xx": "bada gabo dabu gaba ", "yy": "tiki keti pike kiti ", "zz": "sølv øre æble å "}
    rows = [(i, talk[n] * (1 + i % 5), n, 1.0) for i, n in enumerate(["xx", "yy", "zz"] * 20)] + [(100, None, "xx", 1.0), (101, "12 !", "yy", 1.0), (102, "", None, 1.0), (103, "KITI pike", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    profiles = language.fit(df.where(language.in_training()))
    got = {r.doc_id: r for r in language.predict(df, profiles).collect()}
    assert all(got[i].lang_pred == n for i, _, n, _ in rows[:60]) and got[103].lang_pred == "yy"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (100, 101, 102)) and all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(df, language.fit(df.where("false"))).where("lang_pred <> 'und'").count() == 0
    assert language.predict(df.where("false"), profiles).count() == 0
    # brute force: bundles of all training texts, cosines with each
    train = [(language.letters(t or ""), n) for i, t, n, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2 and t and n]
    proto = {n: sum(language.bundles([x])[0].astype(np.float64) for x, m in train if m == n) for n in talk}
    for i, t, *_ in rows[:60] + rows[-1:]:
        v = language.bundles([language.letters(t)])[0].astype(np.float64)
        cos = {n: round(float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), 4) for n, p in proto.items()}
        assert abs(max(cos.values()) - got[i].score) < 2e-4 and cos[got[i].lang_pred] == max(cos.values())


def test_languages_without_a_limit_and_on_ties(spark):
    syllables = [a + b for a in "bcdfghklmnprstvwz" for b in "aeiou"]
    rows = [(i, " ".join(random.Random(i).choices(syllables, k=40)).replace(" ", ""), f"l{i:04}") for i in range(3000)]
    rows += [(4000, "xyx xyx", "tie-b"), (4001, "xyx xyx", "tie-a"), (None, "aaa", "l0001"), (4002, "long " * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = language.fit(df)
    assert profiles.blocks > 2
    got = {r.doc_id: r for r in language.predict(df.where("doc_id % 100 = 0 or doc_id > 3999 or doc_id is null"), profiles).collect()}
    assert all(got[i].lang_pred == f"l{i:04}" and got[i].score > 0.99 for i in range(0, 3000, 100))
    assert {got[4000].lang_pred, got[4001].lang_pred} == {"tie-a"} and len(got) == 34


def test_held_out_accuracy_of_languages(spark):
    from callweave.llm import queries

    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op9_hyperdimensional_language(spark, "/root/testdata/sf0.01").where("held_out").join(truth, "doc_id").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_profile_vectors_equal_a_plain_sum():
    text = language.letters("Abba, cab 1 abba")
    want = np.zeros(64)
    for a, b, c in zip(text, text[1:], text[2:]):
        want += np.roll(language.letter_vector(int(a), 64), 2) * np.roll(language.letter_vector(int(b), 64), 1).astype(int) * language.letter_vector(int(c), 64)
    assert np.array_equal(language.bundles([text], 64)[0], want)


def brute_quality(t):
    w, seen, pos = (t or "").encode().split(), collections.defaultdict(list), set()
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    for v in seen.values():
        if len(v) > 1:
            pos.update(j for i in v for j in range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(pos)


def test_quality_equals_brute_force(spark):
    texts = [prose(40), "a b c d e " * 4 + prose(30), "x\ny\nx\n \n\ny y", None, "", "é é #*|", prose(30) + " ***", "a b c d e f a b c d e", "w1 " * 12]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    trusted = spark.createDataFrame([(0,), (6,)], "doc_id bigint")
    ratio = quality.fit(df, trusted, buckets=64)

    def grams(t):
        w = (t or "").encode().split()
        h = lambda b: xxhash.xxh64_intdigest(b, seed=42)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return [signed(h(x)) % 64 for x in w], len(w)

    for r in quality.score(df, ratio).collect():
        n, chars, symbols, dups, repeats = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and (r.llr is None) == (n == 0)
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    ones = collections.Counter(b for t in texts for b in grams(t)[0])
    good = collections.Counter(b for i in (0, 6) for b in grams(texts[i])[0])
    assert list(ratio.weights[:64]) == quality._weights([good[b] for b in range(64)], [ones[b] for b in range(64)])
    assert quality.fit(df, trusted.where("false"), buckets=64).weights == (0,) * 128


def test_mixing_meets_its_limits(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 4}" if i % 9 else None, " ".join(["w"] * (1 + i % 13)), 1) for i in range(600)] + [(700, "none", "", 1), (701, "big", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, block int")
    share = collections.Counter()
    for _, s, t, _ in rows:
        share[s] += len((t or "").split())
    total, live = sum(share.values()), [v for v in share.values() if v]

    def entropy(e):
        p = np.array([(v / total) ** e for v in live])
        return -(p / p.sum() * np.log(p / p.sum())).sum() / math.log(len(live))

    def repeats(e):
        p = [(v / total) ** e / (v / total) for v in live]
        return max(p) / min(p)

    def bisect(after):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if after(mid) else (mid, hi)
        return hi

    by_entropy, by_repeats = bisect(lambda e: entropy(e) < (1 + entropy(1)) / 2), bisect(lambda e: repeats(e) <= 2)
    assert 0.1 < by_entropy < 0.9 and 0.1 < by_repeats < 0.9
    for policy, e in ((mixing.Policy(rows_per_block=20), max(by_entropy, by_repeats)), (mixing.Policy(rows_per_block=20, most_repeats=None), by_entropy), (mixing.Policy(rows_per_block=20, entropy_gain=None), by_repeats)):
        got = mixing.mix(df, policy).collect()
        weights = {r.source: r.weight for r in got}
        z = sum((v / total) ** e for v in live)
        assert all(abs(weights[s] - (v / total) ** e / z) < 1e-9 for s, v in share.items() if v)
        assert {r.doc_id for r in got} == {r[0] for r in rows}
    got = mixing.mix(df, mixing.Policy(rows_per_block=20)).collect()
    drawn = collections.Counter()
    for r in got:
        drawn[r.source] += r.tokens
        assert 0 <= r.mix_pos < 1
    assert all(drawn[s] <= 2 * v + 13 for s, v in share.items() if v) and drawn["big"] == share["big"]
    # brute force of the permutation: passes, blocks by hash, documents by hash, cut at the budget
    from pyspark.sql import functions as F

    key = lambda *c: F.xxhash64(F.lit(3), *c)
    hashes = {(r.doc_id, r.p): (r.a, r.b) for r in df.select("doc_id", mixing.whitespace_tokens(F.col("text")).alias("tokens"), F.explode(F.array(F.lit(0), F.lit(1))).alias("p")).select("doc_id", "p", key("doc_id", "p").alias("a"), key("p", "doc_id", "tokens").alias("b")).collect()}
    z, e = sum((v / total) ** max(by_entropy, by_repeats) for v in live), max(by_entropy, by_repeats)
    least = min((v / total) ** (e - 1) for v in live)
    turns = {(r.s, r.p, r.b): r.h for r in spark.createDataFrame([("null" if s is None else "=" + s, p, b) for s in share for p in (0, 1) for b in range(40)], "s string, p int, b bigint").select("s", "p", "b", key("s", "p", "b").alias("h")).collect()}
    want = set()
    for s in share:
        own = [(i, len((t or "").split())) for i, q, t, _ in rows if q == s]
        budget = max((share[s] / total) ** e / least * total if share[s] else 0, share[s])
        blocks, at = -(-len(own) // 20), 0
        for p in range(max(1, math.ceil(budget / share[s] - 1e-9)) if share[s] else 1):
            line = sorted((turns[("null" if s is None else "=" + s, p, hashes[i, p][0] % blocks)], hashes[i, p][0] % blocks, hashes[i, p][1], i, n) for i, n in own if n or p == 0)
            for _, block, _, i, n in line:
                if at < budget or (n == 0 and p == 0 and at <= budget):
                    want.add((i, p, block, at))
                at += n
    assert {(r.doc_id, r["pass"], r.block, r.start_token) for r in got} == want and len(got) == len(want)
    twice = mixing.mix(df.union(df.where("doc_id < 3")), mixing.Policy(rows_per_block=20)).where("doc_id < 3 and pass = 0").count()
    assert twice == 6
    part = mixing.mix(df, mixing.Policy(most_repeats=None, entropy_share=1.0, budget=500, rows_per_block=20)).collect()
    some = collections.Counter()
    for r in part:
        some[r.source] += r.tokens
    assert all(500 / len(live) <= some[s] < 500 / len(live) + 13 for s, v in share.items() if v)
    assert mixing.mix(df.where("false")).count() == 0


def test_pipeline_equals_brute_force_stage_by_stage(spark, tmp_path):
    from pyspark.sql import functions as F

    plain = [prose(40) for _ in range(30)]
    noise = " ".join("".join(RND.choices("qxzjvkwyþðœłđ", k=7)) for _ in range(40))
    texts = [*corpus(), *plain, noise, noise + " x", plain[0] + " w1 w2", prose(30_000), "a b c d e " * 30, "12 34 !", None]
    rows = [(i, t, "en" if i % 5 and t and "q" not in t else None, f"s{0 if i % 3 else i % 7}", 1, 2.0, True) for i, t in enumerate(texts)]
    rows += [(None, prose(50), None, None, 1, 2.0, False), (4, prose(50), "en", "s1", 1, 2.0, True), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, stages = [docs], dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        out = stages[name](spark, seen[-1], str(tmp_path))
        assert out.columns == docs.columns
        seen.append(out)
    tables = [d.collect() for d in seen]
    key = lambda rs: collections.Counter((r.doc_id, r.text) for r in rs)
    # language: the noise, texts without letters and nulls go, by the profiles' cosines; prose stays
    gone, profiles = key(tables[0]) - key(tables[1]), language.fit(docs.where(language.in_training()))
    scores = {(r.doc_id, r.text): r.score for r in language.predict(docs.drop("score"), profiles).collect()}
    assert set(gone) == {k for k, s in scores.items() if s < 3 / 32} and {noise, noise + " x", "12 34 !", None} <= {t for _, t in gone}
    assert not {t for _, t in gone} & {*plain, texts[-4]}
    assert all(r.lang is not None for r in tables[1])
    # quality: all that fail the base rules go
    for _, t in key(tables[2]):
        n, *_, repeats = brute_quality(t)
        assert n >= 10 and 100 * repeats <= 20 * n
    # near duplicates: the smallest id of each class of 5-word sets, by all pairs
    sets = {}
    for r in tables[2]:
        if r.doc_id is not None:
            w = r.text.lower().split()
            sets.setdefault(r.doc_id, []).append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)})
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and any(len(x & y) * 100 >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in tables[3] if r.doc_id is not None) == sorted({root(i) for i in sets})
    assert sum(r.doc_id is None for r in tables[3]) == sum(r.doc_id is None for r in tables[2])
    # mixing: as often, and in the order, that the operator says
    known = seen[3].where("doc_id is not null")
    drawn = sorted(mixing.mix(known).select("mix_pos", "doc_id", "pass").collect())
    assert [r.doc_id for r in tables[4] if r.doc_id is not None] == [r.doc_id for r in drawn]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert key(final) == key(tables[4]) and all(len(r.ids) == 4 * r.n_tokens for r in final)
    empty = docs.where("false")
    for stage in stages.values():
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert seen[1].where(F.col("lang").isNull()).count() == 0
