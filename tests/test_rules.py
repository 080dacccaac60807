"""Text rules and three-valued logic on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from callweave.operators import eligibility, ingest, normalise, requirements


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,expected", [
    ("Artists must be under 35 years old.", (None, 34)), ("Open to artists aged 18 to 30.", (18, 30)), ("At least 21 years.", (21, None)), ("Up to 40.", (None, 40)),
    ("Under 30 or under 35.", (None, None)), ("aged 50 to 20", (None, None)), ("No ages here.", (None, None)),
])
def test_age_bounds(spark, text, expected):
    lo, hi = requirements.age_bounds(F.col("t"))
    assert tuple(one(spark, F.struct(lo.alias("a"), hi.alias("b")), t=text)) == expected


@pytest.mark.parametrize("text,expected", [
    ("Students are not eligible.", "EXCLUDES"), ("There is no age limit.", "WAIVES"), ("Applicants must live here.", "REQUIRES"), ("Usually students are excluded.", "UNCLEAR"),
    ("Not limited to painters.", "REQUIRES"), ("Open to all, but you must be a painter.", "UNCLEAR"),
])
def test_polarity(spark, text, expected):
    assert one(spark, requirements.polarity(F.col("t")), t=text) == expected


def test_sentence_chunks(spark):
    text = "1. First one. Second one!\n- a bullet; Next\n\n   \n(2) last"
    assert one(spark, requirements.sentence_chunks(F.col("t")), t=text) == ["First one.", "Second one!", "a bullet;", "Next", "last"]
    assert one(spark, requirements.sentence_chunks(F.col("t")), t=None) == []


@pytest.mark.parametrize("text,expected", [
    ("1.3.2025 to 31.5.2025", datetime.date(2025, 5, 31)), ("31.2.2025", None), ("Deadline: 3rd May 2024", datetime.date(2024, 5, 3)), ("May 3, 2024", datetime.date(2024, 5, 3)),
    ("2024-05-03", datetime.date(2024, 5, 3)), ("2024", None), (None, None), ("1 May 1999", None),
])
def test_deadlines(spark, text, expected):
    assert one(spark, normalise.parse_deadline(F.col("t"), "2024-01-01"), t=text) == expected


@pytest.mark.parametrize("href,expected", [
    ("/calls/1#top", "https://a.org/calls/1"), ("next.html", "https://a.org/x/next.html"), ("mailto:me@a.org", None), ("https://www.facebook.com/a", None), ("//b.org/y", "https://b.org/y"), ("#x", None),
])
def test_links(spark, href, expected):
    assert one(spark, ingest.normalise_link(F.col("h"), F.lit("https://a.org/x/page?q=1")), h=href) == expected


def test_placeholders_and_verbatim(spark):
    df = spark.createDataFrame([("Grants for artists based in Rome are given.", "grants for artists", "n/a", "for sculptors living abroad")], "src string, a string, b string, c string")
    row = ingest.drop_placeholders(df, ["a", "b"]).withColumn("flags", ingest.verbatim_misses(df, "src", ["a", "b", "c"])).first()
    assert (row.a, row.b, row.flags) == ("grants for artists", None, ["c"])


def test_unknown_never_fails(spark):
    inside = F.lit(None).cast("boolean")
    for p in ("REQUIRES", "EXCLUDES"):
        assert one(spark, eligibility.outcome(inside, F.lit(p)), x=1) == "CHECK"
    assert one(spark, eligibility.outcome(F.lit(False), F.lit("REQUIRES")), x=1) == "FAIL"
    assert one(spark, eligibility.outcome(F.lit(False), F.lit("EXCLUDES")), x=1) == "PASS"
    assert one(spark, eligibility.age_membership(F.lit(None).cast("date"), F.lit(None).cast("date"), F.lit(None).cast("int"), F.lit(30), "2024-01-01"), x=1) is None


def test_manual_intake_keeps_the_last_row(spark):
    df = spark.createDataFrame([(1, " a ", "u"), (2, "b", "u"), (3, "", "v")], "pos int, title string, url string")
    rows = ingest.manual_intake(df, ["title", "url"], "url", "pos").collect()
    assert [(r.title, r.id[:7]) for r in rows] == [("b", "manual_")]
