"""What a job does once, not for each row or pair, and what bounds a task."""

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from callweave.operators import discover, evaluate, facts, ingest, many_models, matching, normalise, ordered, requirements
from callweave.plans import catalog, views
from callweave.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentences_of_texts_without_a_pair_are_left_out(spark):
    shared = spark.createDataFrame([(1, 10, "harbour")], "a long, b long, word string")
    sentences = spark.createDataFrame([(10, 0, "The harbour is a quiet place"), (11, 0, "Another harbour is far from here")], "key long, idx int, chunk string")
    best = matching.best_sentence(shared, sentences, "b", 5)
    assert [(r.a, r.b, r.idx, r.words) for r in best.collect()] == [(1, 10, 0, "harbour")]
    assert "LeftSemi" in plan(best)


def test_shared_words_meet_the_index_where_the_texts_lie(spark):
    left = spark.createDataFrame([(1, "painted harbours"), (2, "harbours"), (2, "harbours"), (3, None)], "k long, t string")
    right = spark.createDataFrame([(7, "harbours painted in spring"), (8, "nothing"), (9, None)], "k long, t string")
    specific = spark.createDataFrame([("harbours", 1), ("painted", 1)], "word string, n long")
    pairs = matching.shared_words(left, right, specific, "k", "t", "k", "t")
    assert sorted((r.a, r.b, r.n_shared) for r in pairs.collect()) == [(1, 7, 2), (2, 7, 2)]
    assert "BroadcastHashJoin" in plan(pairs) and "SortMergeJoin" not in plan(pairs)


def test_specific_words_count_all_forms_without_pairs(spark):
    words = ["painter", "painters", "painting", "paint", "painted", "river", "rivers", "sea"]
    df = spark.createDataFrame([(w,) for w in words for _ in range(len(w))], "t string")

    def form(a, b):
        k = max(5, min(len(a), len(b)) - 2)
        return a != b and min(len(a), len(b)) >= 5 and a[:k] == b[:k]

    known = [w for w in words if len(w) >= 4]
    want = {w: len(w) + sum(len(o) for o in known if form(w, o)) for w in known}
    specific = matching.specific_words(df, "t", 2.0)
    assert {r.word: r.n for r in specific.collect()} == want
    assert "frequency-" in "".join(specific.inputFiles())  # the texts are not read again


def test_a_distinct_line_is_read_once(spark):
    rows = [(k, p, line, s) for k in range(40) for p, (line, s) in enumerate([("Ada Field", None), ("ada.field@example.org", None), ("Born 12 March 1984", None), ("2012 | Tide | Hall", "Solo exhibitions"), ("MFA Painting, 2012", "Education")])]
    lines = spark.createDataFrame(rows, "key long, pos int, line string, section string")
    table = spark.createDataFrame([("norway", "country", ["NORWAY"])], "name string, kind string, countries array<string>")
    found = facts.profile_facts(lines, table, {"german": "de"}, {"painting": "\\bpainters?\\b"}, "2026-01-01")
    got = {(r.field, r.value, r.pos) for r in found.where("key = 7").collect()}
    assert got == {("name", "Ada Field", 0), ("birth_date", "1984-03-12", 2), ("active_since", "2012", 3), ("degree", "MFA", 4), ("graduation_year", "2012", 4)}
    assert found.count() == 40 * 5
    assert "ArrowEvalPython" not in plan(found)  # no cue is looked for in each line


def test_text_rules_run_once_a_distinct_text(spark):
    chunks = spark.createDataFrame([(1, 0, "Applicants must be under 30 years old.", False, None), (1, 1, None, False, None), (2, 0, "Who can apply?", True, None)], "opportunity_id long, chunk_index int, text string, is_heading boolean, heading string")
    predictions = spark.createDataFrame([(1, 0, ["AGE"], {"AGE": 0.9}), (1, 1, ["AGE"], {"AGE": 0.8})], "opportunity_id long, chunk_index int, labels array<string>, probabilities map<string,double>")
    rows = requirements.requirement_rows(chunks, predictions, chunks.select("opportunity_id").distinct())
    assert sorted((r.opportunity_id, r.chunk_index, r.label or "", r.polarity or "", r.has_value) for r in rows.collect()) == [(1, 0, "AGE", "REQUIRES", True), (1, 1, "AGE", "REQUIRES", False), (2, 0, "", "", False)]
    assert "ArrowEvalPython" not in plan(rows)


def test_sections_are_read_once(spark):
    lines = spark.createDataFrame([(1, 0, "Tide", None), (1, 1, "2015 - video", None), (1, 2, "About the shore.", None)], "key long, pos int, line string, section string")
    works = facts.work_pages(lines, "2020-01-01")
    assert [(r.title, r.years, r.medium, r.summary) for r in works.collect()] == [("Tide", "2015", "video", "About the shore.")]
    assert "ArrowEvalPython" not in plan(works)


def test_pages_are_handed_on_a_few_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["<p>Call</p>", None] * 300)], names=["key", "html"])
    out = list(ingest.read_pages(iter([batch]), 300))
    assert [b.num_rows for b in out] == [256, 256, 88]
    assert [k for b in out for k in b.column("key").to_pylist()] == list(range(600))


def test_a_views_window_is_dealt_by_its_rows(spark, tmp_path, monkeypatch):
    lines = spark.range(40).select((F.col("id") % 8).alias("l_orderkey"), F.col("id").cast("int").alias("l_linenumber"), F.lit(1).alias("l_partkey"), F.lit(1).alias("l_suppkey"), F.lit(1.0).alias("l_quantity"), F.lit(1.0).alias("l_extendedprice"), F.lit("1994-01-01").cast("date").alias("l_shipdate"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(8).select(F.col("id").alias("o_orderkey"), (F.col("id") % 2).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(views, "ROWS_A_TASK", 5)
    df = views.load(spark, str(tmp_path), "judgments")
    assert "hashpartitioning(l_orderkey" in plan(df) and ", 8), REPARTITION_BY_NUM" in plan(df)
    assert df.count() == 40 and df.select("item").distinct().count() == 40


def test_places_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    df = spark.range(40).select("id", (F.col("id") % 2).alias("k"))
    want = sorted((r.id, r.k, r.run, r.total) for r in ordered.running_sum(df, F.lit(1), ["id"], ["k"]).collect())
    monkeypatch.setattr(ordered, "ROWS_A_TASK", 5)
    placed = ordered.running_sum(df, F.lit(1), ["id"], ["k"])
    assert "hashpartitioning(__run_p" in plan(placed) and ", 8), REPARTITION_BY_NUM" in plan(placed)
    assert sorted((r.id, r.k, r.run, r.total) for r in placed.collect()) == want == [(i, i % 2, i // 2 + 1, 20) for i in range(40)]


def test_one_array_comes_to_the_driver(spark, tmp_path):
    spark.range(40).repartition(8).write.parquet(f"{tmp_path}/rows")
    df, size = spark.read.parquet(f"{tmp_path}/rows").repartition(8), 3 * many_models.SLICE // 2
    taken, collect = [], type(df).collect

    def counted(self):
        out = collect(self)
        taken.append(sum(len(r.s) for r in out))
        return out

    type(df).collect = counted
    try:
        total = many_models.summed(df, lambda batches: (np.arange(size) * float(b.num_rows) for b in batches), size)
    finally:
        type(df).collect = collect
    assert (total == np.arange(size) * 40.0).all() and taken == [8 * size]


def test_the_most_frequent_terms_are_placed_before_they_are_taken(spark):
    df = spark.createDataFrame([(f"{'red ' * (i % 2)}{'blue ' * (i % 3 > 0)}green", i % 2) for i in range(12)], "text string, fold int")
    terms = many_models.gram_table(df, 1, 1, 2)
    assert [(r.gram, r.n, r.df) for r in terms.collect()] == [("green", 1, {0: 6, 1: 6}), ("blue", 1, {0: 4, 1: 4})]
    assert "TakeOrdered" not in plan(terms)


def test_trigrams_are_looked_up_where_the_texts_lie(spark, monkeypatch):
    texts = ["Ein Haus am Meer", "a house by the sea", "", None, "字字字 𝔘𝔫 é", "x", "a house"]
    df = spark.createDataFrame([(min(i, 5), t, "de" if i in (0, 4) else "en" if i != 3 else None) for i, t in enumerate(texts)], "key long, text string, lang string")
    profiles = normalise.language_profiles(df, "lang", "text", 50)
    counts = {(r.lang, r.gram): r.n for r in normalise.trigram_counts(df, "lang", "text").collect()}
    each = df.where("lang is not null").select("lang", F.explode(normalise.letter_trigrams(F.col("text"))).alias("gram"))
    assert counts == {(r.lang, r.gram): r["count"] for r in each.groupBy("lang", "gram").count().collect()}
    found = normalise.language_scores(df, "key", "text", profiles)
    assert "Generate" not in plan(found) and "Generate" not in plan(profiles)
    told = lambda d: {r.key: (r.detected, round(r.confidence, 9)) for r in d.collect()}
    near = told(found)
    monkeypatch.setattr(normalise, "KNOWN_NUMBERS", 0)
    assert near == told(normalise.language_scores(df, "key", "text", profiles)) and near[0][0] == "de" and near[1][0] == "en"


def test_many_letters_are_counted_without_a_table():
    numbers = np.array([normalise.trigram_numbers([chr(0x4E00 + i) + "ab"])[0][0] for i in range(300)] * 2)
    kinds, found, n = normalise._counted(numbers, np.arange(600) % 2, 2)
    assert len(n) == 300 and n.sum() == 600 and set(found) == set(numbers) and set(kinds) == {0, 1}


def test_words_of_sentences_are_not_shuffled(spark):
    rows = [(1, 0, "Artists based in Oslo"), (1, 1, "artists BASED in Oslo, or near"), (1, 2, "..."), (1, 3, None), (2, 0, "Artists based in Oslo"), (None, 0, "x")]
    df = spark.createDataFrame(rows, "opportunity_id long, idx int, text string")
    pairs = evaluate.aligned_sentences(df, df)
    assert sorted((r.opportunity_id, r.a, r.b) for r in pairs.collect()) == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0)]
    assert "Generate" not in plan(pairs)


def test_a_processor_sees_buckets_of_keys(spark, tmp_path):
    spark.createDataFrame([], "key string, hash string, ts timestamp").write.parquet(f"{tmp_path}/in")
    changes = jobs.changed_pages(jobs.stream_of(spark, f"{tmp_path}/in"))
    assert "__bucket" in changes._jdf.queryExecution().analyzed().toString()


def test_a_missing_page_key_is_a_key_of_its_own(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(None, "x", at(0)), (None, "x", at(1)), ("", "x", at(2)), ("a", None, at(3)), ("a", None, at(4)), (None, "y", at(5))]
    spark.createDataFrame(rows, "key string, hash string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    got = jobs.drain(jobs.changed_pages(jobs.stream_of(spark, f"{tmp_path}/in")))
    assert sorted((str(r.key), str(r.hash), r.ts.hour) for r in got.collect()) == [("", "x", 2), ("None", "x", 0), ("None", "y", 5), ("a", "None", 3), ("a", "None", 4)]


def test_vectors_of_calls_are_not_written_again(spark, monkeypatch):
    written, write = [], discover.materialise
    monkeypatch.setattr(discover, "materialise", lambda df, name: written.append(name) or write(df, name))
    grouped = spark.createDataFrame([(1, 7, "fit", False), (1, 8, "fit", False), (2, 7, "fit", True)], "profile_id long, opportunity_id long, grp string, mismatch boolean")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "key long, v array<double>")
    items = spark.createDataFrame([(7, [3.0, 0.0]), (8, [0.0, 1.0])], "item long, v array<double>")
    texts = spark.createDataFrame([(1, "harbour"), (7, "harbour"), (8, None)], "key long, text string")
    specific = spark.createDataFrame([("harbour", 2)], "word string, n long")
    found = discover.matched(grouped, queries, items, texts, texts, specific, 3)
    assert sorted((r.profile_id, r.pos, r.opportunity_id, r.n_shared, r.sim) for r in found.collect()) == [(1, 1, 7, 1, 1.0), (1, 2, 8, 0, 0.0), (2, 1, 7, 0, 0.0)]
    assert written == ["kept"]


def test_only_kept_pairs_are_judged(spark, tmp_path, monkeypatch):
    pairs = spark.createDataFrame([(1, 7), (1, 8)], "profile_id long, opportunity_id long")
    monkeypatch.setattr(catalog.eligibility, "assess", lambda pairs, *_: pairs)
    blank = spark.createDataFrame([], "profile_id long, birth_date date, nationality string, residence_country string, applicant_type string, confidence double")
    judged, items = catalog._items(lambda _: blank, pairs.where("opportunity_id = 7"))
    assert [r.opportunity_id for r in items.collect()] == [r.opportunity_id for r in judged.collect()] == [7]
