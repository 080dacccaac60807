"""The phrase trie against brute force, and the vocabulary on wordings that it was not written from."""

import random

import pytest
from pyspark.sql import functions as F

from callweave.operators import phrases, requirements, vocabulary

POLARITY = [
    ("Candidates must have their home in Wales.", "RESIDENCE", "REQUIRES"),
    ("Musicians who are studying full time cannot take part.", "STUDENT_STATUS", "EXCLUDES"),
    ("Companies that were supported last year will not be considered.", "PRIOR_FUNDING", "EXCLUDES"),
    ("Sadly we cannot support choirs from abroad.", "RESIDENCE", "EXCLUDES"),
    ("The prize has no upper age limit.", "AGE", "WAIVES"),
    ("You do not need to be a citizen of the Republic.", "NATIONALITY", "WAIVES"),
    ("Dancers of any age can send a video.", "CAREER_STAGE", "REQUIRES"),
    ("Dancers of any age can send a video.", None, "WAIVES"),
    ("The prize goes to writers of all nationalities living in the canton.", "RESIDENCE", "REQUIRES"),
    ("Theatres with a yearly grant are normally not funded.", "PRIOR_FUNDING", "UNCLEAR"),
    ("Training is not required, but you must show three works.", "EDUCATION", "UNCLEAR"),
    ("Leaders must be adults and must not have debts.", "AGE", "UNCLEAR"),
    ("Residents of five towns (excluding the capital).", "RESIDENCE", "UNCLEAR"),
    ("Pupils may not enter, unless a teacher signs.", "STUDENT_STATUS", "UNCLEAR"),
    ("You are not studying at the moment.", "STUDENT_STATUS", "EXCLUDES"),
    ("Soloists should instead apply for the travel fund.", "APPLICANT_TYPE", "EXCLUDES"),
    ("Fields include but are not limited to weaving.", "DISCIPLINE", "REQUIRES"),
    ("The budget must not exceed 900 euros.", "OTHER_ELIGIBILITY", "REQUIRES"),
    ("Be ready to commute (we can't provide a flat).", "RESIDENCE", "REQUIRES"),
    ("Es gibt keine Altersgrenze.", "AGE", "WAIVES"),
    ("Les étudiants ne peuvent pas participer.", "STUDENT_STATUS", "EXCLUDES"),
]
SCOPE = [
    ("Successful candidates will give a talk in spring.", None, "OBLIGATION"), ("You must attend the opening week.", None, "OBLIGATION"),
    ("Your project has to start in May.", None, "PROJECT"), ("Projects by artists under 30 are funded.", None, "APPLICANT"), ("Choirs", "Partners can include:", "PROJECT"),
    ("Ideally you have worked with glass.", None, "PREFERENCE"), ("Only weavers, ideally with a loom.", None, "APPLICANT"), ("Duos are also welcome.", None, "WIDENING"),
    ("Newcomers are defined as people in their first three years.", None, "NOT_A_CONDITION"), ("Applicants live in the valley.", None, "APPLICANT"), (None, None, None),
]


def read(spark, rows, column, schema):
    return [r.x for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("x")).orderBy("i").collect()]


def test_polarity_of_held_out_wordings(spark):
    got = read(spark, [r[:2] for r in POLARITY], requirements.polarity(F.col("t"), F.col("l")), "t string, l string")
    assert [(r[0], g) for r, g in zip(POLARITY, got)] == [(r[0], r[2]) for r in POLARITY]
    above = read(spark, [("Pupils.", "Who may not enter?"), ("Pupils.", "Who can enter?")], requirements.polarity(F.col("t"), "STUDENT_STATUS", F.col("h")), "t string, h string")
    assert above == ["EXCLUDES", "REQUIRES"]


def test_scope_of_held_out_wordings(spark):
    got = read(spark, [r[:2] for r in SCOPE], requirements.scope(F.col("t"), F.col("h")), "t string, h string")
    assert [(r[0], g) for r, g in zip(SCOPE, got)] == [(r[0], r[2]) for r in SCOPE]


def test_values_of_held_out_wordings(spark):
    text = F.col("t")
    career = requirements.career_value(text)
    rows = [("Two years of practice or more, at least 2 years.",), ("Up to six years of professional work.",), ("Established and emerging potters.",), ("The company exists for at least 4 years.",), ("Mindestens 3 Jahre Berufserfahrung.",)]
    assert [(r and (r.any_stage, r.min_years, r.max_years)) for r in read(spark, rows, career, "t string")] == [(False, 2, None), (False, None, 6), (True, None, None), None, (False, 3, None)]
    types = read(spark, [("Duos and foundations.",), ("Ein Verein oder Gruppen.",), ("Anybody.",)], requirements.applicant_types(text), "t string")
    assert types == [["group", "organisation"], ["group"], []]
    within = read(spark, [("Within the last two years of graduation.",), ("Graduated in the past 5 years.",), ("Graduates.",)], requirements.student_status(text)[1], "t string")
    assert within == [2, 5, None]
    art = read(spark, [("A diploma from an art academy.",), ("A degree in fine arts management.",), ("A university education.",), ("A PhD or a degree.",)], requirements.education_value(text), "t string")
    assert [a and a.art for a in art] == [True, None, False, None]


def plain_hits(text, names):
    words = [w.lower() for w in phrases.WORD.findall(text)]
    every = [(i, i + len(n), n) for n in names for i in range(len(words) - len(n) + 1) if tuple(words[i : i + len(n)]) == n]
    return sorted({h for h in every if not any(o[0] <= h[0] and h[1] <= o[1] and o[1] - o[0] > h[1] - h[0] for o in every)})


@pytest.mark.parametrize("a_pass", [200_000, 1500])
def test_names_equal_brute_force(spark, a_pass):
    rnd = random.Random(1)
    words = [f"n{i}" for i in range(40)]
    names = {tuple(rnd.choices(words, k=rnd.randrange(1, 7))) for _ in range(10_000)}
    texts = [" ".join(rnd.choice([w.upper(), w, w + ","]) for w in rnd.choices(words, k=rnd.randrange(0, 30))) for _ in range(40)]
    by_length = {}
    for n in names:
        by_length.setdefault(len(n), set()).add(n)

    def fast(text):
        found = [w.lower() for w in phrases.WORD.findall(text)]
        every = [(i, i + k, tuple(found[i : i + k])) for k, own in by_length.items() for i in range(len(found) - k + 1) if tuple(found[i : i + k]) in own]
        return sorted({h for h in every if not any(o[0] <= h[0] and h[1] <= o[1] and o[1] - o[0] > h[1] - h[0] for o in every)})

    table = spark.createDataFrame([(" ".join(n), "k", [n[0]]) for n in names], "name string, kind string, countries array<string>")
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:3], None, ""]], "t string")
    got = {r.t: sorted((h.at, h.end, tuple(h.name.split())) for h in r.hits) for r in phrases.names_in(df, "t", table, a_pass).collect()}
    assert got == {t: fast(t) for t in texts if fast(t)}
    assert plain_hits("n1 n2", [("n1",), ("n1", "n2")]) == [(0, 2, ("n1", "n2"))]


def test_countries_with_nested_and_spoken_names(spark):
    rows = [("africa", "broad", []), ("south africa", "country", ["ZA"]), ("french", "country", ["FR"]), ("french guiana", "place", ["FR"]), ("the united states of america and canada", "region", ["US", "CA"])]
    names = spark.createDataFrame(rows, "name string, kind string, countries array<string>")
    texts = ["Artists from South Africa.", "All of Africa", "French speakers", "French painters", "In French Guiana", "People of the United States of America and Canada", "Anywhere outside South Africa"]
    got = {r.t: (r.countries, r.places, r.regions) for r in requirements.country_sets(spark.createDataFrame([(t,) for t in texts], "t string"), "t", names).collect()}
    assert got == {texts[0]: (["ZA"], [], []), texts[1]: ([], [], ["africa"]), texts[3]: (["FR"], [], []), texts[4]: (["FR"], ["french guiana"], []), texts[5]: (["CA", "US"], [], [])}


def test_templates_and_tables(spark):
    assert phrases.expand("no (upper|) age (limit|limits)") == ["no upper age limit", "no upper age limits", "no age limit", "no age limits"]
    assert vocabulary.table(spark, "force").where("phrase = 'no age limit'").collect()[0].effect == "WAIVES"
    trie = phrases.Trie([("at least # years", 1), ("at least", 2), ("# years", 3)])
    assert list(trie.find("at least three years".split())) == [(0, 4, [1], [3])]
    assert list(trie.find("at least 1999 years at least".split())) == [(0, 2, [2], []), (4, 6, [2], [])]
