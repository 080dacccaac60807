"""The engine as one job on literal calls, reviews and profiles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from callweave.operators import engine, requirements

ROW = "opportunity_id int, chunk_index int, text string, heading string, is_heading boolean, label string, suspected string, why string, polarity string"
CALLS = "opportunity_id int, deadline_date date, requirements_text string, rules_elsewhere boolean"
NAMES = [("norway", "country", ["NO"]), ("norwegian", "country", ["NO"]), ("sweden", "country", ["SE"]), ("japan", "country", ["JP"]), ("north", "region", ["NO", "SE"]), ("oslo", "city", ["NO"]), ("lapland", "place", ["SE"]), ("europe", "broad", ["NO", "SE", "FR"])]
ANA = {"profile_id": 1, "birth_date": dt.date(1995, 3, 1), "nationalities": ["NO"], "residence_country": "SE", "residence_city": "Kiruna", "applicant_type": "individual", "languages": ["en"], "disciplines": ["painting"], "career_stage": "emerging", "years": 4, "enrolled": False, "graduation_year": 2018, "has_degree": True, "degree_field": "painting", "schools": [{"institution": "Oslo Academy", "city": "Oslo", "country": "NO"}]}
TODAY = "2024-06-01"


def typed(**fields):
    return {n: fields.get(n) for n in engine.FIELDS}


def review(text, label, decision="confirm", polarity="REQUIRES", scope="APPLICANT", applies_to=None, alternatives=None, **fields):
    return (text, label, decision, polarity, scope, applies_to, alternatives or [{"label": label, "value": typed(**fields)}])


def run(spark, calls, reviews=(), profiles=(ANA,), deadline=dt.date(2024, 9, 1), heading=None):
    """``calls``: by call a list of (text, label) or (text, "NONE", suspected, why)."""
    rows, frame = [], []
    for o, sentences in calls.items():
        for i, (text, label, *more) in enumerate(sentences):
            rows.append((o, i, text, heading, False, label, *(more or (None, None))))
        frame.append((o, deadline, "some text" if sentences is not None else "", False))
    req = spark.createDataFrame(rows, ROW.rsplit(",", 1)[0]) if rows else spark.createDataFrame([], ROW.rsplit(",", 1)[0])
    shown = F.coalesce("suspected", "label")
    req = req.withColumn("polarity", F.when(shown != "NONE", requirements.polarity(F.col("text"), shown, F.col("heading"))))
    people = spark.createDataFrame([tuple(p.get(k) for k in ("profile_id", *engine.PROFILE)) for p in profiles], "profile_id int, " + ", ".join(f"{k} {t}" for k, t in engine.PROFILE.items()))
    pairs = people.select("profile_id").crossJoin(spark.createDataFrame([(o,) for o in calls], "opportunity_id int"))
    names = spark.createDataFrame(NAMES, "name string, kind string, countries array<string>")
    return engine.evaluate(pairs, people, spark.createDataFrame(frame, CALLS), req, spark.createDataFrame(list(reviews), engine.REVIEWS), names, {"english": "en", "german": "de"}, ["painting", "film"], TODAY)


CASES = [
    # a certain rejection needs a review
    ([("Applicants must be under 25 years old.", "AGE")], [], "CHECK"),
    ([("Applicants must be under 25 years old.", "AGE")], [review("Applicants must be under 25 years old.", "AGE", most=24)], "LIKELY_NOT_ELIGIBLE"),
    # what is clearly met passes without one
    ([("Applicants must be under 45 years old.", "AGE")], [], "ELIGIBLE"),
    ([("Applicants must live in Sweden.", "RESIDENCE")], [], "ELIGIBLE"),
    ([("Applicants must live in Oslo.", "RESIDENCE")], [], "CHECK"),
    # the city decides on a residence that is narrower than a country
    ([("Based in Oslo.", "RESIDENCE")], [review("Based in Oslo.", "RESIDENCE", countries=["SE"], narrower="Oslo")], "LIKELY_NOT_ELIGIBLE"),
    ([("Based in Lapland.", "RESIDENCE")], [review("Based in Lapland.", "RESIDENCE", countries=["SE"], narrower="Lapland")], "CHECK"),
    # a review under the other geographic label; either field will do
    ([("From or in Norway.", "RESIDENCE")], [review("From or in Norway.", "NATIONALITY", countries=["NO"], either_or=True)], "ELIGIBLE"),
    ([("From Japan.", "NATIONALITY")], [review("From Japan.", "NATIONALITY", countries=["JP"])], "LIKELY_NOT_ELIGIBLE"),
    # a broad region lets in and never keeps out
    ([("Living across Asia.", "RESIDENCE")], [review("Living across Asia.", "RESIDENCE", broad=["asia"], members=["JP"])], "CHECK"),
    ([("Artists must live in Europe.", "RESIDENCE")], [], "ELIGIBLE"),
    # exclusions, drops, unreadable reviews, scopes
    ([("Swedish residents may not apply.", "RESIDENCE")], [review("Swedish residents may not apply.", "RESIDENCE", polarity="EXCLUDES", countries=["SE"])], "LIKELY_NOT_ELIGIBLE"),
    ([("Minors may not apply.", "AGE")], [review("Minors may not apply.", "AGE", polarity="EXCLUDES", most=17)], "ELIGIBLE"),
    ([("Of good age.", "AGE")], [review("Of good age.", "AGE", decision="drop", alternatives=[])], "CHECK"),
    ([("Of good age.", "AGE")], [review("Of good age.", "AGE", polarity="UNCLEAR", most=20)], "CHECK"),
    ([("The winners must be 20.", "AGE"), ("Applicants must live in Sweden.", "RESIDENCE")], [review("The winners must be 20.", "AGE", scope="OBLIGATION", most=20)], "ELIGIBLE"),
    ([("Groups must be from Japan.", "NATIONALITY"), ("Applicants must live in Sweden.", "RESIDENCE")], [review("Groups must be from Japan.", "NATIONALITY", applies_to=["group"], countries=["JP"])], "ELIGIBLE"),
    # alternatives
    ([("Norwegian, or living in Japan.", "NATIONALITY")], [review("Norwegian, or living in Japan.", "NATIONALITY", alternatives=[{"label": "NATIONALITY", "value": typed(countries=["NO"])}, {"label": "RESIDENCE", "value": typed(countries=["JP"])}])], "ELIGIBLE"),
    ([("Under 20, or living in Japan.", "AGE")], [review("Under 20, or living in Japan.", "AGE", alternatives=[{"label": "AGE", "value": typed(most=19)}, {"label": "RESIDENCE", "value": typed(countries=["JP"])}])], "LIKELY_NOT_ELIGIBLE"),
    # neighbouring rows of one family are alternatives
    ([("From Japan.", "NATIONALITY"), ("Living in Sweden.", "RESIDENCE")], [review("From Japan.", "NATIONALITY", countries=["JP"]), review("Living in Sweden.", "RESIDENCE", countries=["SE"])], "ELIGIBLE"),
    # check-only classes
    ([("At least 3 years of professional practice.", "CAREER_STAGE")], [], "ELIGIBLE"),
    ([("At least 9 years of professional practice.", "CAREER_STAGE")], [], "CHECK"),
    ([("A degree in fine arts is required.", "EDUCATION")], [], "ELIGIBLE"),
    ([("Has not been funded before.", "PRIOR_FUNDING")], [], "CHECK"),
    # disciplines
    ([("Open to painting.", "DISCIPLINE")], [], "ELIGIBLE"), ([("Open to film.", "DISCIPLINE")], [], "CHECK"), ([("All disciplines except film.", "DISCIPLINE")], [], "ELIGIBLE"),
    # languages come from any sentence
    ([("Fluent English is required of applicants.", "OTHER_ELIGIBILITY")], [], "ELIGIBLE"), ([("Applicants must live in Sweden and speak German.", "RESIDENCE")], [], "CHECK"),
    # the safety net: nothing suspected says nothing, a suspicion is to be checked
    ([("We like colours.", "NONE", None, None)], [], "CHECK"), ([("Something on residents.", "NONE", "RESIDENCE", "topic word")], [], "CHECK"),
    ([("Artists from around here.", "NONE", "DISCIPLINE", "classifier unsure"), ("Applicants must live in Sweden.", "RESIDENCE")], [], "ELIGIBLE"),
    ([("There is no age limit.", "AGE")], [], "ELIGIBLE"),
]


def test_verdicts_of_literal_calls(spark):
    calls = {i: sentences for i, (sentences, _, _) in enumerate(CASES)}
    # reviews hold for a text wherever it stands, so cases that contradict each other run apart
    first = [i for i, (s, r, _) in enumerate(CASES) if r or i not in (0, 13)]
    got, seen = {}, set()
    for group in (first, [0], [13]):
        texts = {t for i in group for t, *_ in CASES[i][0]}
        reviews, known = [], set()
        for i in group:
            for r in CASES[i][1]:
                if (r[0], r[1]) not in known and i != 14:
                    reviews.append(r)
                    known.add((r[0], r[1]))
        found = run(spark, {i: calls[i] for i in group}, reviews if group != [0] else []).verdicts.collect()
        got |= {r.opportunity_id: r.status for r in found}
        seen |= texts
    got[14] = run(spark, {14: calls[14]}, CASES[14][1]).verdicts.first().status
    assert {i: (CASES[i][0], got[i]) for i in calls} == {i: (CASES[i][0], CASES[i][2]) for i in calls}


def test_an_empty_profile_is_never_rejected(spark):
    calls = {i: s for i, (s, _, _) in enumerate(CASES)}
    reviews = {(r[0], r[1]): r for _, rs, _ in CASES for r in rs}
    found = run(spark, calls, reviews.values(), profiles=[{"profile_id": 5}]).verdicts.collect()
    assert len(found) == len(calls) and "LIKELY_NOT_ELIGIBLE" not in {r.status for r in found}


def test_calls_without_rules_and_pairs_without_calls(spark):
    got = run(spark, {1: [("Applicants must live in Sweden.", "RESIDENCE")], 2: None or []}).verdicts.collect()
    assert {r.opportunity_id: r.status for r in got} == {1: "ELIGIBLE", 2: "CHECK"}
    assert {r.summary for r in got if r.opportunity_id == 2} == {"Not analysed yet"}


def test_each_combination_is_worked_out_once(spark):
    """400 pairs of 20 like-minded people and 20 calls with the same three sentences: combinations follow fields, not pairs."""
    people = [ANA | {"profile_id": i, "birth_date": dt.date(1980 + i % 4, 1, 1), "residence_country": ["SE", "NO"][i % 2]} for i in range(20)]
    sentences = [("Applicants must be under 45 years old.", "AGE"), ("Applicants must live in Sweden.", "RESIDENCE"), ("Has not been funded before.", "PRIOR_FUNDING")]
    found = run(spark, {i: sentences for i in range(20)}, profiles=people)
    assert found.items.count() == 20 * 20 * 3
    # four birth dates, two countries, and a rule that no field matters to
    assert found.combinations.count() == 4 + 2 + 1


def test_the_last_exchange_is_dealt_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(engine, "ROWS_A_TASK", 1)
    calls = {i: [("Applicants must live in Sweden.", "RESIDENCE"), ("Painters only.", "DISCIPLINE")] for i in (1, 2, 3)}
    found = run(spark, calls)
    assert ", 6), REPARTITION_BY_NUM" in found.items._jdf.queryExecution().executedPlan().toString()
    assert found.items.count() == 6


def test_combinations_follow_ages_instead_of_dates(spark):
    """60 birth dates of two ages, on calls without a deadline, with one that is over and with one ahead."""
    people = [ANA | {"profile_id": i, "birth_date": dt.date(1990 + i // 30 * 10, 1, 1 + i % 30)} for i in range(60)]
    for deadline, ages in ((None, 2), (dt.date(2023, 9, 1), 2), (dt.date(2024, 9, 1), 2), (dt.date(2025, 1, 15), 4)):
        found = run(spark, {1: [("Applicants must be under 30 years old.", "AGE")]}, [review("Applicants must be under 30 years old.", "AGE", most=29)], people, deadline)
        assert found.combinations.count() == ages, deadline
        by_age = {(r.profile_id >= 30, r.status) for r in found.verdicts.collect()}
        assert by_age == {(False, "LIKELY_NOT_ELIGIBLE"), (True, "ELIGIBLE")}


def test_reviews_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)
    reviews = spark.createDataFrame([review("Applicants must live in Sweden.", "RESIDENCE", countries=["SE"])], engine.REVIEWS)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    names = spark.createDataFrame(NAMES, "name string, kind string, countries array<string>")
    req = spark.createDataFrame([(1, 0, "Applicants must live in Sweden.", None, False, "RESIDENCE", None, None, "REQUIRES")], ROW)
    people = spark.createDataFrame([(1, "SE"), (2, "NO")], "profile_id int, residence_country string")
    calls = spark.createDataFrame([(1, None, "some text", False)], CALLS)
    found = engine.evaluate(people.selectExpr("profile_id", "1 as opportunity_id"), people, calls, req, reviews.mapInArrow(counted, reviews.schema), names, {}, [], TODAY)
    assert {r.profile_id: r.status for r in found.verdicts.collect()} == {1: "ELIGIBLE", 2: "LIKELY_NOT_ELIGIBLE"}
    assert read.value == 1
