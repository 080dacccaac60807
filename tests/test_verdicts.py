"""Literal cases of verdicts, sentence rules, samples, page texts and streams."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from callweave.operators import annotate, eligibility, facts, ingest, learning, matching, requirements
from callweave.plans import scratch
from callweave.streaming import jobs

ITEMS = "profile_id int, opportunity_id int, chunk_index int, label string, polarity string, outcome string, text string, reason string"


def status(spark, rows):
    items = spark.createDataFrame([(1, 1, i, label, polarity, outcome, f"s{i}", "why") for i, (label, polarity, outcome) in enumerate(rows)], ITEMS)
    pairs = spark.createDataFrame([(1, 1)], "profile_id int, opportunity_id int")
    return eligibility.verdicts(pairs, eligibility.or_groups(items)).first()


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("NATIONALITY", "REQUIRES", "FAIL"), ("RESIDENCE", "REQUIRES", "PASS")], "ELIGIBLE"),  # one family: either will do
        ([("NATIONALITY", "REQUIRES", "FAIL"), ("AGE", "REQUIRES", "PASS"), ("RESIDENCE", "REQUIRES", "PASS")], "LIKELY_NOT_ELIGIBLE"),  # not next to each other
        ([("AGE", "WAIVES", "NO_RESTRICTION")], "ELIGIBLE"),
        ([("OTHER", "REQUIRES", "INFO")], "CHECK"),
        ([], "CHECK"),
        ([("RESIDENCE", "EXCLUDES", "PASS"), ("RESIDENCE", "REQUIRES", "FAIL")], "CHECK"),  # not being excluded meets nothing
        ([("OTHER_ELIGIBILITY", "REQUIRES", "CHECK"), ("OTHER_ELIGIBILITY", "REQUIRES", "PASS")], "CHECK"),  # such rows form no group
    ],
)
def test_status(spark, rows, want):
    assert status(spark, rows).status == want


def test_runs_are_those_of_pairs_whatever_the_batches(spark):
    """Random rows, some with unknown polarity, outcome or position, against a plain walk over each pair and class; batches of three rows cut pairs."""
    r = random.Random(4)
    labels, polarities, outcomes = ["AGE", "NATIONALITY", "RESIDENCE", "DISCIPLINE", "OTHER", None], ["REQUIRES", "EXCLUDES", "UNCLEAR", None], ["PASS", "FAIL", "CHECK", "INFO", "NO_RESTRICTION", None]
    rows = [(p, o, r.choice([*range(6), None]), r.choice(labels), r.choice(polarities), r.choice(outcomes), f"{p},{o},{i}", "why") for p in (1, 2, None) for o in range(8) for i in range(r.randint(1, 9))]
    group = {"AGE": "AGE", "NATIONALITY": "GEO", "RESIDENCE": "GEO", "DISCIPLINE": "DISCIPLINE"}
    want, by = {}, {}
    for x in rows:
        want[x[6]] = x[5]
        if x[3] in group and x[5] not in (None, "INFO", "NO_RESTRICTION"):
            by.setdefault((x[0], x[1], group[x[3]]), []).append(x)
    for some in by.values():
        place = lambda x: (x[2] is not None, x[2] or 0, x[3])
        runs, number, before = {}, 0, None
        for _, same in itertools.groupby(sorted(some, key=place), place):  # what stands in one place with one label is of one run
            peers = list(same)
            for x in peers:
                number += None in (x[2], before) or x[2] != before + 1
                before = x[2]
            runs.setdefault(number, []).extend(peers)
        for run in (run for run in runs.values() if len(run) > 1):
            known = [x for x in run if x[4]]
            clean = any(x[4] != "EXCLUDES" for x in known) or any(x[5] == "PASS" for x in run)
            clean &= all(x[5] == "PASS" for x in known if x[4] == "EXCLUDES")
            asks = [x[5] == "PASS" for x in known if x[4] != "EXCLUDES"]
            met = any(asks) or (not asks and bool(known))
            for x in run:
                want[x[6]] = "FAIL" if all(y[5] == "FAIL" for y in run) else "PASS" if clean and met else "CHECK"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        found = eligibility.or_groups(spark.createDataFrame(rows, ITEMS))
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()  # one sort a pair instead of four
        assert {x.text: x.effective for x in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_summary_quotes_the_first_failing_row(spark):
    got = status(spark, [("AGE", "REQUIRES", "FAIL"), ("APPLICANT_TYPE", "REQUIRES", "FAIL")])
    assert got.summary == "Against: s0 - why (and 1 more)"


@pytest.mark.parametrize(
    "birth,deadline,least,most,want",
    [
        ("1990-06-02", "2020-12-01", None, 29, None),  # 29 today, 30 on the deadline
        ("1990-06-02", "2020-06-01", None, 29, True),
        ("1990-06-01", "2020-06-01", None, 29, False),  # the birthday counts
        ("2004-01-01", None, 18, None, None),  # old enough in time, perhaps
        ("2004-01-01", "2020-07-01", 18, None, False),
        ("1950-01-01", None, None, 40, False),
        ("1990-01-01", "2010-01-01", None, 21, True),  # only the deadline that is over
        (None, "2020-07-01", 18, None, None),
    ],
)
def test_age(spark, birth, deadline, least, most, want):
    day = lambda s: None if s is None else dt.date.fromisoformat(s)
    row = spark.createDataFrame([(day(birth), day(deadline), least, most)], "b date, d date, l int, m int")
    assert row.select(eligibility.age_membership(F.col("b"), F.col("d"), F.col("l"), F.col("m"), "2020-06-01")).first()[0] is want


def test_chunks_keep_lines_whole(spark):
    text = "Paris - London, by train. Then on!\n- 1st part\n• second • third\n2.1) numbered; a) not cut\n"
    got = spark.createDataFrame([(text,)], "t string").select(requirements.sentence_chunks(F.col("t"))).first()[0]
    assert got == ["Paris - London, by train.", "Then on!", "1st part", "second", "third", "numbered; a) not cut"]


def test_walk_passes_over_what_does_not_fit(spark):
    """Sizes 6, 6, 3, 1 with room for 10: 6, then 3 and 1; the second 6 is passed over and does not count."""
    calls = spark.createDataFrame([(i, "s", n, i) for i, n in enumerate((6, 6, 3, 1))], "opportunity_id int, source string, n_chunks int, __o int")
    assert sorted(r.opportunity_id for r in annotate.source_capped(calls, F.lit(10)).collect()) == [0, 2, 3]


def test_reviews_are_merged_or_refused(spark):
    kind = "text string, label string, decision string, scope string"
    reviews = spark.createDataFrame([("a", "AGE", "fix", "APPLICANT")], kind)
    answers = spark.createDataFrame([("a", "AGE", "drop", "APPLICANT"), ("b", "AGE", "fix", "APPLICANT"), ("c", "AGE", "fix", "APPLICANT"), ("d", "AGE", "scope", "APPLICANT")], kind)
    merged, wrong = annotate.merged_reviews(reviews, answers.where("text <> 'c'"), answers)
    assert sorted(r.text for r in merged.collect()) == ["a", "b"] and {r.text: r.error for r in wrong.collect()} == {"a": "already reviewed", "c": "not queued"}
    changed, lost = annotate.updated_reviews(reviews.withColumn("polarity", F.lit("REQUIRES")), answers.withColumn("polarity", F.lit("EXCLUDES")))
    assert changed.first().decision == "drop" and lost.count() == 3


def test_value_errors(spark):
    kind = "v struct<min_age:int,max_age:int,countries:array<string>,broad_regions:array<string>,types:array<string>>"
    rows = spark.createDataFrame([((20, 30, None, None, None),), ((None, None, ["XX"], None, None),), ((30, 20, None, None, None),), ((None, None, None, None, None),), ((None, None, ["BE"], None, ["group"]),)], kind)
    got = [r[0] for r in rows.select(annotate.value_errors(F.col("v"), ["BE"], ["Europe"], ["group"])).collect()]
    assert got == [None, "countries", "ages", "nothing to check", None]


PAGE = "<html><head><title>t</title><script>x()</script></head><body><header>Site</header><nav>Menu</nav>{}<main><header>Call</header><p>Rules &amp; <b>more</b>.</p><nav>side</nav></main><footer>End</footer></body></html>"


def test_content_text(spark):
    long = "word " * 80
    pages = [PAGE.format(""), PAGE.format("").replace("more", long), PAGE.format(f"<article><header>Title</header>{long}<br></article>"), PAGE.format("<article>short</article>"), None, "plain <i>text"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = {r.key: r.text for r in ingest.content_text(df, "page_id", "html").collect()}
    assert got[0] == "t Call Rules & more ." and got[1].startswith("Call Rules & word") and got[1].endswith("word .")
    assert got[2] == "Title " + long.strip() and got[3] == "t short Call Rules & more ." and got[4] == "" and got[5] == "plain text"
    assert ingest.content_text(df, "page_id", "html", most=4).where("key = 5").first().text == "plai"


def test_text_repair_and_kinds(spark):
    df = spark.createDataFrame([(1, "fÃ¼r " + "x" * 300), (2, "für " + "x" * 300), (3, None)], "id int, t string")
    assert {r.id: r.why for r in ingest.badly_read(df, "t").collect()} == {1: "mojibake", 3: "short"}


def test_filters(spark):
    kind = "id int, deadline_date date, title string, kind string, discipline string, has_fee boolean, countries array<string>, funding array<string>"
    rows = [(1, None, "Call 2015", None, None, None, ["BE"], None), (2, None, "Call 2015 to 2030", None, None, None, ["any"], ["grant"]), (3, None, "x", None, None, None, None, ["mentoring"]), (4, None, "x", None, None, None, ["DE"], ["stipend"])]
    calls = spark.createDataFrame(rows, kind)
    keep = lambda **how: [r.id for r in matching.preference_filter(calls, "2020-01-01", **how).orderBy("id").collect()]
    assert keep() == [2, 3, 4] and keep(countries=["BE"]) == [2, 3] and keep(funded_only=True) == [2, 4]
    with pytest.raises(ValueError, match="unknown types: y"):
        matching.check_vocabulary(["x", "y"], ["x"], "types")


def test_streams_go_on_where_they_ended(spark, tmp_path):
    folder, at = str(tmp_path / "in"), str(tmp_path / "job")
    kind = "key string, hash string, ts timestamp"
    write = lambda rows: spark.createDataFrame([(k, h, dt.datetime(2020, 1, 1, i)) for k, h, i in rows], kind).coalesce(1).write.mode("append").parquet(folder)
    write([("a", "1", 0), ("a", "1", 1), ("b", "1", 1)])
    seen = lambda: sorted((r.key, r.hash) for r in jobs.drain(jobs.changed_pages(jobs.stream_of(spark, folder)), at=at).collect())
    assert seen() == [("a", "1"), ("b", "1")]
    write([("a", "2", 2), ("b", "1", 3), ("a", "1", 4)])
    assert seen() == [("a", "1"), ("a", "1"), ("a", "2"), ("b", "1")]
    latest = lambda: {r.key: r.hash for r in jobs.upsert(jobs.stream_of(spark, folder), "key", "ts", at=f"{at}2").collect()}
    assert latest() == {"a": "1", "b": "1"}
    write([("b", "9", 9)])
    assert latest() == {"a": "1", "b": "9"} and latest() == {"a": "1", "b": "9"}


def test_models_learn(spark):
    words = {"x": "red green blue", "y": "one two three"}
    rows = [(f"{words[n]} {i % 3}", n, i % 2) for i, n in enumerate(["x", "x", "y", "y"] * 10)]
    found = learning.grid_search(spark.createDataFrame(rows, "text string, label string, fold int"), [("lr", 10.0, 1, 1.0), ("svm", 10.0, 2, 1.0)], 2)
    assert [r.macro_f1 for r in found.collect()] == [1.0, 1.0]
    vectors = spark.createDataFrame([(i, [float(i % 2), 1.0], [["a"], ["b"]][i % 2], i // 2 % 2) for i in range(40)], "key int, v array<double>, labels array<string>, fold int")
    assert all((r.p > 0.5) == ((r.key % 2 == 0) == (r.label == "a")) for r in learning.one_vs_rest(vectors, ["a", "b"], 2).collect())
    pairs = spark.createDataFrame([(p, i, 2 if i % 3 == 0 else 0, float(i % 3 == 0) + 0.1 * (i % 2)) for p in range(8) for i in range(12)], "persona int, item int, grade int, sim double")
    assert all((r.p > 0.5) == (r.y == 1) for r in learning.match_probabilities(pairs, ["sim"], 3).collect())


def test_names_need_their_address(spark):
    lines = spark.createDataFrame([(1, 0, "Tomás de Oro", None), (1, 1, "Solo Exhibitions", None), (1, 2, "tomas.oro@x.org", None), (2, 0, "Tomás de Oro", None), (3, 0, "Ana Lima", None), (3, 1, "info@x.org", None)], "key int, pos int, line string, section string")
    assert [(r.key, r.value) for r in facts.names(lines).collect()] == [(1, "Tomás de Oro")]


def test_scratch_tables_can_be_deleted(spark):
    scratch.clean(spark)
    kept = scratch.materialise(spark.range(3).toDF("id"), "mine")
    assert kept.count() == 3 and scratch.clean(spark) == 1 and scratch.clean(spark) == 0
