"""SimHash near-duplicates against brute force and on edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash

from callweave.llm import queries, simhash
from callweave.llm.components import components

RND = random.Random(3)


def plain_fingerprint(text):
    small = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", small)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, most=4):
    """Smallest name reachable, from pairs (name, fingerprint); a name may come again."""
    names, fps = [i for i, _ in items], np.array([f for _, f in items], np.uint64)
    parent = {i: i for i in names}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, name in enumerate(names):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= most).tolist():
            a, b = sorted((root(name), root(names[j])))
            parent[b] = a
    return {i: root(i) for i in names}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def flipped(x, n):
    for _ in range(n):
        x ^= 1 << RND.randrange(64)
    return x


@pytest.mark.parametrize("most,block", [(4, 4096), (4, 16), (3, 50), (6, 4096), (2, 64)])
def test_links_of_dense_and_scattered_fingerprints(spark, most, block):
    centre = RND.getrandbits(64)
    pool = {flipped(centre, RND.randrange(9)) for _ in range(500)} | {0, 1, 7, 31, 2**64 - 1}
    for _ in range(150):
        base = RND.getrandbits(64)
        pool |= {base, flipped(base, RND.randrange(1, 7))}
    items = list(enumerate(pool))
    classes = spark.createDataFrame([(signed(x), i) for i, x in items], "fp bigint, node bigint")
    p = simhash.Params(most_bits=most, block=block)
    assert block == 4096 or simhash.large_buckets(classes, p).count()
    got = {r.node: r.component for r in components(simhash.class_links(classes, p)).collect()}
    assert {i: got.get(i, i) for i, _ in items} == plain_components(items, most)


def test_edge_rows(spark):
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(RND.choices(words, k=120)) for _ in range(8)]
    texts = [*base, *base[:3], base[0].upper(), base[1].replace(" ", "\t\n"), base[2].replace("w1", "é1"), base[3] + " tail", None, "", " \n ", "one", "ONE", "a b c", "Zeichen ganz"]
    rows = [(100 - 3 * i, t, "x", 7) for i, t in enumerate(texts)] + [(100, base[5], "again", 7), (91, base[3], "x", 7), (91, base[3], "x", 7), (None, base[4], "x", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string, fp int")
    got = simhash.near_duplicates(df).collect()
    want = plain_components([(i, plain_fingerprint(t)) for i, t, *_ in rows if i is not None])
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.fingerprint) for r in got if r.doc_id is not None) == sorted((i, f"{plain_fingerprint(t):016x}") for i, t, *_ in rows if i is not None)
    assert all(r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_pieces_of_long_texts_make_no_difference(monkeypatch):
    text = "  ".join(RND.choices(["Alpha", "b", "gämma", "d" * 40, "\te"], k=3000))
    whole = simhash.fingerprint(text)
    assert whole == plain_fingerprint(text)
    for size in (1, 7, 100, 5000):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text) == whole
        assert simhash.fingerprint("one two") == plain_fingerprint("one two")


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = plain_components(list(fps.items()))
    got = queries.op11_deletion_variant_simhash(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", want[i]) for i, f in fps.items())
    assert len({r.component_id for r in got}) < len(got)
