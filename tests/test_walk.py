"""The quota sample's walk against a plain one."""

import hashlib
import random

import pytest

from callweave.operators import annotate


@pytest.mark.parametrize("seed,together", [(1, 10_000), (2, 7), (3, 40)])
def test_walk_equals_a_plain_walk(spark, seed, together):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(60), rnd.choice(["a", "a", "a", "b", "c", "other"]), rnd.choice([None, "same", f"t{rnd.randrange(80)}", f"u{i}"])) for i in range(500)]
    quotas = {"a": 12, "b": 30, "c": 500}
    left, calls, texts, want = dict(quotas), {}, set(), []
    for r in sorted(rows, key=lambda r: (hashlib.md5(f"{seed}/{r[0]}".encode()).hexdigest(), r[0])):
        text = r[3] or ""
        if left.get(r[2], 0) > 0 and calls.get(r[1], 0) < 2 and text not in texts:
            left[r[2]] -= 1
            calls[r[1]] = calls.get(r[1], 0) + 1
            texts.add(text)
            want.append(r[0])
    df = spark.createDataFrame([*rows, rows[5]], "chunk_id int, opportunity_id int, family string, text string")
    got = annotate.quota_walk(df, quotas, 20, seed=seed, together=together).collect()
    assert sorted(r.chunk_id for r in got) == sorted(want)
    assert sorted(r.chunk_id for r in got if r.split == "test") == sorted(want[:20])
    assert annotate.quota_walk(df.where("false"), quotas, 20).count() == 0
