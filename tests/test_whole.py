"""Whole jobs: nothing is cut from a long or large input."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.operators import annotate, documents, evaluate, ingest, matching


def test_long_documents_keep_their_last_lines(spark):
    text = "# One\n" + "a line of some words\n" * 12_000 + "LAST PART\nwrite to me@here.org"
    lines = documents.line_table(spark.createDataFrame([(1, text)], "k bigint, t string"), "k", "t")
    assert lines.count() == 12_003
    sections = documents.with_section(lines, documents.heading_like(F.col("line"), ["contact"]))
    assert sections.where("section = 'LAST PART'").count() == 2
    assert [r.value for r in documents.facts(lines, {"mail": "([a-z]+@[a-z.]+[a-z])"}).collect()] == ["me@here.org"]
    assert documents.line_table(spark.createDataFrame([(1, "ab\ncd")], "k bigint, t string"), "k", "t", most=3).count() == 1


def test_attached_texts_are_whole(spark):
    pages = spark.createDataFrame([(1, "page")], "key int, text string")
    attached = spark.createDataFrame([(1, 1, "t", "x" * 7000)], "key int, rank int, title string, text string")
    assert ingest.attach_texts(pages, attached).first().text == "page\n## t\n" + "x" * 7000
    assert ingest.attach_texts(pages, attached, most=5).first().text == "page\n## t\nxxxxx"


@pytest.fixture
def ranges(spark):
    """Small inputs too are dealt over several range partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def windows(df):
    """What the plan's windows are partitioned and ordered by."""
    return re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", df._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("n", [3, 5, 23, 100])
def test_calibration_ranks_by_ranges(spark, ranges, n):
    df = spark.range(n).selectExpr("id as k", "(id * 37 % 11) / 10 as p", "cast(id % 2 as int) as y")
    made = evaluate.calibration(df, "k", "p", "y")
    assert all("__run_p" in w for w in windows(made))
    ntile = df.select(F.ntile(5).over(Window.orderBy("p", "k")).alias("bin"), "p", "y").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("share_true"))
    assert sorted(made.collect()) == sorted(ntile.collect())


def test_distinct_scores_rank_by_ranges(spark, ranges):
    df = spark.range(50).selectExpr("(id * 37 % 41 + 1) / 50 as p", "cast(id % 3 = 0 as int) as y")
    made = evaluate.probability_scores(df, "p", "y")
    assert all("__run_p" in w for w in windows(made))
    rows = [(r.p, r.y) for r in df.collect()]
    wins = [(a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z]
    assert made.first().auc == round(sum(wins) / len(wins), 6)


@pytest.mark.parametrize("target,share", [(90, 0.2), (200, 0.1), (20, 0.5)])
def test_walk_over_sources_equals_a_plain_one(spark, ranges, target, share):
    df = spark.range(60).selectExpr("id as opportunity_id", "if(id < 50, 'a', if(id < 58, 'b', null)) as source", "id % 9 as n_chunks")
    made = annotate.capped_calls(df, target, share)
    assert all("__run_p" in w for w in windows(made))
    order = sorted(df.collect(), key=lambda r: hashlib.md5(f"1/{r.opportunity_id}".encode()).hexdigest())
    most, spent, want, deferred, total = max(1, round(target * share)), {}, set(), [], 0
    for r in order:
        if total >= target:
            break
        if not r.n_chunks:
            continue
        if spent.get(r.source, 0) + r.n_chunks > most:
            deferred.append(r)
            continue
        want.add((r.opportunity_id, False))
        spent[r.source] = spent.get(r.source, 0) + r.n_chunks
        total += r.n_chunks
    for r in deferred:
        if total >= target:
            break
        want.add((r.opportunity_id, True))
        total += r.n_chunks
    assert {(r.opportunity_id, r.relaxed) for r in made.collect()} == want


def test_blocks_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(matching, "ITEMS_IN_BLOCK", 10)
    monkeypatch.setattr(matching, "QUERIES_IN_BLOCK", 2)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 4)), rng.normal(size=(200, 4))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, v array<double>")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "item bigint, v array<double>")
    assert max(r["count"] for r in matching._cells(queries, items).groupBy("block", "part").count().collect()) < 40
    s = np.round((x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T, 9)
    near = {(r.key, r["rank"]): r.item for r in matching.top_k(queries, items, 3).collect()}
    assert near == {(i, j + 1): int(at) for i in range(5) for j, at in enumerate(np.argsort(-s[i])[:3])}
    spread = matching.with_spread(queries, items)
    assert not windows(spread)
    pairs = matching.similarities(spread, items).collect()
    assert len(pairs) == 1000 and all(abs(r.sim - s[r.key, r.item]) < 1e-8 and abs(r["mean"] - s[r.key].mean()) < 1e-8 and abs(r["std"] - s[r.key].std()) < 1e-8 for r in pairs)


def test_shared_words_meet_in_any_form(spark):
    artist = spark.createDataFrame([(1, "Paintings and translations, sound"), (2, "nothing here")], "k int, t string")
    calls = spark.createDataFrame([(7, "A painting, two paintings, translate it"), (8, "sounds")], "k int, t string")
    specific = spark.createDataFrame([("painting",), ("paintings",), ("translate",), ("sounds",)], "word string")
    rows = matching.shared_word_forms(artist, calls, specific, "k", "t", "k", "t").collect()
    assert sorted((r.a, r.b, r.n_shared) for r in rows) == [(1, 7, 2), (1, 8, 1)]
