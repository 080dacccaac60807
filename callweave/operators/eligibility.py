"""Eligibility of given (profile, call) pairs by three-valued rules over requirement rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def find_review(requirements: DataFrame, reviews: DataFrame) -> DataFrame:
    """The review of a row's exact text and label, or of the other geographic label."""
    other = F.when(F.col("label") == "NATIONALITY", "RESIDENCE").when(F.col("label") == "RESIDENCE", "NATIONALITY")
    own = reviews.select("text", "label", F.col("decision").alias("__d1"))
    twin = reviews.select("text", F.col("label").alias("__other"), F.col("decision").alias("__d2"))
    joined = requirements.withColumn("__other", other).join(own, ["text", "label"], "left").join(twin, ["text", "__other"], "left")
    return joined.withColumn("decision", F.coalesce("__d1", "__d2")).drop("__other", "__d1", "__d2")


def reviewed_scope(reviews: DataFrame) -> DataFrame:
    """Per text the first scope, by name, that is not about the applicant."""
    return reviews.groupBy("text").agg(F.min(F.when(F.col("scope") != "APPLICANT", F.col("scope"))).alias("scope"))


def age_on(birth: Column, day: Column) -> Column:
    """Whole years on a day: one less before the birthday."""
    before = (F.month(day) * 100 + F.dayofmonth(day)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(day) - F.year(birth) - before.cast("int")


def reference_dates(deadline: Column, as_of: str) -> Column:
    """The days on which a rule must hold: today and the deadline, the deadline alone once it is over, today alone where none is known."""
    today = F.to_date(F.lit(as_of))
    return F.when(deadline.isNull(), F.array(today)).when(deadline < today, F.array(deadline)).otherwise(F.array(today, deadline))


def age_membership(birth: Column, deadline: Column, least: Column, most: Column, as_of: str) -> Column:
    """Whether the age lies within bounds on all days that count; null where they differ or the birth date is unknown.

    Too young on a call without a deadline is unknown too: the minimum may be reached in time.
    """
    ages = F.transform(reference_dates(deadline, as_of), lambda d: age_on(birth, d))
    low, high = F.coalesce(least, F.lit(0)), F.coalesce(most, F.lit(999))
    all_in, none_in = F.forall(ages, lambda x: x.between(low, high)), F.forall(ages, lambda x: ~x.between(low, high))
    young = deadline.isNull() & F.forall(ages, lambda x: x < low)
    return F.when(birth.isNull(), F.lit(None)).when(all_in, True).when(none_in & ~young, False)


def day_class(deadline: Column, as_of: str) -> Column:
    """Which of the cases of ``reference_dates`` a deadline is: none, past or ahead."""
    return F.when(deadline.isNull(), "none").when(deadline < F.to_date(F.lit(as_of)), "past").otherwise("ahead")


def age_class(birth: Column, deadline: Column, as_of: str) -> Column:
    """All that ``age_membership`` can tell apart, whatever the bounds: the case of the deadline and the age on each day that counts; "-" where the birth date is unknown."""
    ages = F.transform(reference_dates(deadline, as_of), lambda d: age_on(birth, d).cast("string"))
    return F.when(birth.isNull(), "-").otherwise(F.concat_ws(",", day_class(deadline, as_of), ages))


def year_class(deadline: Column, as_of: str) -> Column:
    """All of a deadline that ``graduate_membership`` can tell apart: its case and the year of each day that counts."""
    return F.concat_ws(",", day_class(deadline, as_of), F.transform(reference_dates(deadline, as_of), lambda d: F.year(d).cast("string")))


def type_membership(own: Column, wanted: Column) -> Column:
    """Listed is true; a group between persons and organisations is unknown; else false."""
    near = ((own == "group") & F.array_contains(wanted, "individual") & F.array_contains(wanted, "organisation")) | ((own == "organisation") & F.array_contains(wanted, "group"))
    return F.when(own.isNotNull(), F.when(F.array_contains(wanted, own), True).when(near, F.lit(None)).otherwise(False))


def outcome(inside: Column, polarity: Column, narrower: Column | None = None, by_city: Column | None = None, in_city: Column | None = None) -> Column:
    """E13, last rung: PASS, FAIL or CHECK by membership and polarity; unknown is never FAIL.

    ``narrower``: the rule asks for more than the set; then being inside is to be checked,
    but for a residence that is required (``by_city``), which the city decides.
    """
    narrower = F.lit(False) if narrower is None else narrower
    city = F.lit("CHECK") if by_city is None else F.when(by_city, F.when(in_city, "PASS").when(~in_city, "FAIL").otherwise("CHECK")).otherwise("CHECK")
    return (
        F.when(polarity == "WAIVES", "NO_RESTRICTION").when(~polarity.isin("REQUIRES", "EXCLUDES") | inside.isNull(), "CHECK")
        .when(polarity == "REQUIRES", F.when(~inside, "FAIL").when(narrower, city).otherwise("PASS"))
        .otherwise(F.when(~inside, "PASS").when(narrower, "CHECK").otherwise("FAIL"))
    )


REJECTING = ("AGE", "NATIONALITY", "RESIDENCE", "APPLICANT_TYPE", "STUDENT_STATUS")
CHECKED_ONLY = ("CAREER_STAGE", "EDUCATION", "PRIOR_FUNDING", "OTHER_ELIGIBILITY")
GROUPED = (*REJECTING, "DISCIPLINE")


def ladder(rows: DataFrame) -> DataFrame:
    """``outcome, check_kind`` of each sentence and profile; null outcome: the sentence says nothing.

    One ordered chain over columns that the joins before it bring along, so no rung sees a
    row that an earlier one took:

    ``is_heading, label, suspected, why, names_discipline, polarity``  the sentence
    ``text_scope`` (E02), ``rule_scope`` (T07), ``any_stage``          what it is about
    ``review_label, review_decision, review_polarity, review_scope, review_value, applies_to``  its review, null without (E01)
    ``applicant_type, inside, missing, narrower, either_or, in_city``  membership in the review's value (E03-E08)
    ``favour, discipline, check_met, check_read, check_missing, language_met``  E12, E10, E09; a language that is not asked for is null
    """
    c = F.col
    step = lambda outcome, kind=None: F.struct(F.lit(outcome).cast("string").alias("o"), (kind if isinstance(kind, Column) else F.lit(kind).cast("string")).alias("k"))
    out_of_scope = lambda scope: F.when(scope == "WIDENING", step("NO_RESTRICTION")).otherwise(step("INFO"))
    known = lambda scope: scope.isNotNull() & (scope != "APPLICANT")
    yes = lambda x: F.coalesce(x, F.lit(False))
    said = F.coalesce("text_scope", "rule_scope")
    language = F.when(c("language_met"), step("PASS")).otherwise(step("CHECK", F.when(yes(c("language_missing")), "missing_profile_field").otherwise("uncertain_match")))
    none = (
        F.when(c("suspected").isNull(), step(None))
        .when((c("suspected") == "DISCIPLINE") & (c("why") == "classifier unsure") & ~c("names_discipline"), step(None))
        .when(known(said), out_of_scope(said))
        .when((c("suspected") == "OTHER_ELIGIBILITY") & c("language_met").isNotNull(), language)
        .when(yes(c("favour")), step("PASS")).otherwise(step("CHECK", "safety_net"))
    )
    widened = F.when((c("rule_scope") == "PREFERENCE") & (c("label") == "CAREER_STAGE") & yes(c("any_stage")), "WIDENING").otherwise(c("rule_scope"))
    unreviewed = c("review_decision").isNull() & c("text_scope").isNull()
    compared = c("label").isin("CAREER_STAGE", "EDUCATION") & (c("polarity") == "REQUIRES")
    checked = (
        F.when((c("label") == "OTHER_ELIGIBILITY") & c("language_met").isNotNull(), language)
        .when(compared & yes(c("check_met")), step("PASS"))
        .when(compared & yes(c("check_read")), step("CHECK", F.when(yes(c("check_missing")), "missing_profile_field").otherwise("uncertain_match")))
        .otherwise(step("CHECK", "check_only_class"))
    )
    discipline = F.when(c("discipline") == "PASS", step("PASS")).otherwise(step("CHECK", F.when(c("discipline") == "MISSING", "missing_profile_field").otherwise("discipline_mismatch")))
    excused = (F.size("applies_to") > 0) & c("applicant_type").isNotNull() & ~F.array_contains("applies_to", c("applicant_type"))
    narrower = c("narrower").isNotNull()
    by_city = (c("review_label") == "RESIDENCE") & ~yes(c("either_or"))
    last = outcome(c("inside"), c("review_polarity"), narrower, by_city, c("in_city"))
    kind = (
        F.when(last != "CHECK", F.lit(None)).when(c("inside").isNull(), F.when(yes(c("missing")), "missing_profile_field").otherwise("uncertain_match"))
        .when(by_city & (c("review_polarity") == "REQUIRES") & yes(c("city_missing")), "missing_profile_field").otherwise("narrower_set")
    )
    found = (
        F.when(c("is_heading") | c("label").isNull(), step(None))
        .when(c("label") == "NONE", none)
        .when(c("polarity") == "WAIVES", step("NO_RESTRICTION"))
        .when(known(c("text_scope")), out_of_scope(c("text_scope")))
        .when(unreviewed & known(widened), out_of_scope(widened))
        .when(c("label") == "DISCIPLINE", discipline)
        .when(c("label").isin(*CHECKED_ONLY), checked)
        .when(c("review_decision").isNull(), F.when(yes(c("favour")), step("PASS")).otherwise(step("CHECK", "not_reviewed")))
        .when(known(c("review_scope")), out_of_scope(c("review_scope")))
        .when(yes(excused), step("NO_RESTRICTION"))
        .when(c("review_decision") == "drop", step("CHECK", "dropped"))
        .when(~yes(c("review_polarity").isin("REQUIRES", "EXCLUDES")) | ~yes(c("review_value")), step("CHECK", "unreadable"))
        .otherwise(F.struct(last.alias("o"), kind.alias("k")))
    )
    return rows.withColumn("__f", found).withColumns({"outcome": F.col("__f.o"), "check_kind": F.col("__f.k")}).drop("__f")


def language_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Language items of sentences about the applicant that no item covers yet.

    ``rows``: one a pair and sentence and label, with ``is_heading, polarity, scope,
    language_met`` (null: no language is asked for); ``items``: what the ladder gave. A
    sentence with a language item, or with one that is no condition, is covered; a heading
    or a waiver adds nothing. One item a sentence.
    """
    key = ["profile_id", "opportunity_id", "chunk_index"]
    covered = items.where((F.col("label") == "LANGUAGE") | (F.col("outcome") == "INFO")).select(*key).distinct()
    asked = rows.where(~F.col("is_heading") & (F.coalesce("polarity", F.lit("REQUIRES")) != "WAIVES") & (F.col("scope") == "APPLICANT") & F.col("language_met").isNotNull())
    once = asked.groupBy(*key).agg(F.max("language_met").alias("m")).join(covered, key, "left_anti")
    return once.select(*key, F.lit("LANGUAGE").alias("label"), F.when(F.col("m"), "PASS").otherwise("CHECK").alias("outcome"))


def assess(pairs: DataFrame, profiles: DataFrame, calls: DataFrame, requirements: DataFrame, as_of: str) -> DataFrame:
    """An outcome, with its reason, for each requirement row of each pair.

    Shuffles follow the call, then the profile; requirement rows are multiplied only by the
    pairs of their call.
    """
    rows = pairs.join(calls.select("opportunity_id", "deadline_date"), "opportunity_id").join(requirements, "opportunity_id")
    full = rows.join(profiles.withColumnRenamed("applicant_type", "__type"), "profile_id")
    inside = (
        F.when(F.col("label") == "AGE", age_membership(F.col("birth_date"), F.col("deadline_date"), F.col("min_age"), F.col("max_age"), as_of))
        .when(F.col("label") == "RESIDENCE", F.col("residence_country") == F.col("country"))
        .when(F.col("label") == "NATIONALITY", country_membership(F.array("nationality"), F.array("country"), F.array().cast("array<string>"), F.array().cast("array<string>")))
        .when(F.col("label") == "APPLICANT_TYPE", type_membership(F.col("__type"), F.array("applicant_type")))
    )
    judged = F.when(F.col("label") == "OTHER", F.when(F.col("polarity") == "WAIVES", "NO_RESTRICTION").otherwise("CHECK")).otherwise(outcome(inside, F.col("polarity")))
    reason = F.concat(F.when(F.col("polarity") == "EXCLUDES", "excludes by ").otherwise("asks for "), F.lower(F.regexp_replace("label", "_", " ")))
    return full.select("profile_id", "opportunity_id", "chunk_index", "label", "polarity", judged.alias("outcome"), "text", reason.alias("reason"))


def family(label: Column) -> Column:
    """Nationality and residence are one class of rules."""
    return F.when(label.isin("NATIONALITY", "RESIDENCE"), "GEO").otherwise(label)


PAIR = ("profile_id", "opportunity_id")
#: What E14 reads of each row, where it is asked for.
SPOKEN = ("asked", "covers", "said_outcome", "said_kind")


def changes(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Whether each row differs from the one before it in some column; nulls are alike."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in names:
        column = rows[name].combine_chunks()
        a, b = column[1:], column[:-1]
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def whole_pairs(batches: Iterator[pa.RecordBatch], rule: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """``rule`` over tables with all rows of their pairs; a pair's rows follow each other in the batches."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        ends = np.flatnonzero(changes(rows, PAIR)[1:])
        if len(ends):
            last = int(ends[-1]) + 1
            yield from rule(pa.concat_tables([*held, rows[:last]])).to_batches()
            held = [rows[last:]]
        elif rows.num_rows:
            held.append(rows)
    if held:
        yield from rule(pa.concat_tables(held)).to_batches()


def _runs(rows: pa.Table) -> pa.Table:
    """E15, E16 over whole pairs in the order of ``chunk_index, label``: their ``effective`` outcome."""
    number = lambda name: pc.fill_null(rows[name], -1).to_numpy()
    family, chunk, unknown = number("__f"), number("chunk_index"), pc.is_null(rows["chunk_index"]).to_numpy()
    pair = np.cumsum(changes(rows, PAIR))
    live = np.flatnonzero(family >= 0)
    found = np.full(rows.num_rows, -1)
    if len(live):
        at = live[np.lexsort((family[live], pair[live]))]  # stable: within a class the order stays
        starts = np.ones(len(at), bool)
        starts[1:] = (pair[at][1:] != pair[at][:-1]) | (family[at][1:] != family[at][:-1]) | (chunk[at][1:] != chunk[at][:-1] + 1) | unknown[at][1:] | unknown[at][:-1]
        # rows of one place and label are peers: they are of the run that the last of them begins or goes on with
        label = pc.fill_null(rows["label"].combine_chunks().dictionary_encode().indices, -1).to_numpy()[at]
        last = np.ones(len(at), bool)
        last[:-1] = (pair[at][1:] != pair[at][:-1]) | (family[at][1:] != family[at][:-1]) | (chunk[at][1:] != chunk[at][:-1]) | (unknown[at][1:] != unknown[at][:-1]) | (label[1:] != label[:-1])
        peers = np.flatnonzero(last)
        run = np.repeat(np.cumsum(starts)[peers], np.diff(peers, prepend=-1))
        first = np.flatnonzero(np.diff(run, prepend=0))
        some = lambda x: np.logical_or.reduceat(x, first)
        outcome, polarity = number("__o")[at], number("__p")[at]
        passed, excludes, asks = outcome == 2, polarity == 1, polarity == 2
        clean = some(asks | passed) & ~some(excludes & ~passed)
        met = some(asks & passed) | (some(excludes) & ~some(asks))
        size = np.diff(np.append(first, len(at)))
        found[at] = np.repeat(np.select([size == 1, ~some(outcome != 1), clean & met], [-1, 1, 2], 0), size)
    names = pa.array(["CHECK", "FAIL", "PASS"]).take(pa.array(found, mask=found < 0))
    return rows.drop_columns(["__f", "__o", "__p"]).append_column("effective", pc.coalesce(names, rows["outcome"].combine_chunks()))


def _heard(rows: pa.Table) -> pa.Table:
    """E14 over whole pairs in the order of ``chunk_index, label``: rows without an outcome go, and one language item a sentence that asks and that nothing covers is added."""
    flag = lambda name: pc.fill_null(rows[name], False).to_numpy()
    sentence = np.cumsum(changes(rows, (*PAIR, "chunk_index"))) - 1
    covered = np.zeros(sentence[-1] + 1 if len(sentence) else 0, bool)
    covered[sentence[flag("covers")]] = True
    asked = np.flatnonzero(flag("asked") & ~covered[sentence])
    items = rows.filter(pc.is_valid(rows["outcome"]))
    if len(asked):
        added = rows.take(asked[np.unique(sentence[asked], return_index=True)[1]])
        said = {"label": "LANGUAGE", "polarity": "REQUIRES", "reason": "asks for language", "outcome": added["said_outcome"], "check_kind": added["said_kind"], "effective": added["said_outcome"]}
        for name, x in said.items():
            column = pa.chunked_array([pa.array([x] * added.num_rows, "string")]) if isinstance(x, str) else x
            added = added.set_column(added.schema.get_field_index(name), rows.schema.field(name), column.cast(rows.schema.field(name).type))
        items = pa.concat_tables([items, added])
    return items.drop_columns(list(SPOKEN))


def or_groups(items: DataFrame, dealt: bool = False) -> DataFrame:
    """All items with their ``effective`` outcome: that of the run of neighbouring rows of one class that they are in.

    Only rejecting classes and disciplines form runs, and only rows that restrict; a run of
    one is none. All FAIL is FAIL; exclusions that all pass, with some alternative passing
    where there is one, is PASS; else CHECK. Two rows of one sentence never join.

    ``dealt``: all rows of a pair are in one partition. Rows with the columns SPOKEN are those
    of E14: ``asked``: the sentence asks the applicant for a language, ``covers``: no further item
    is needed for that, and what such an item would say. One sort by pair, then runs are told
    in Arrow batches.
    """
    spoken = all(c in items.columns for c in SPOKEN)
    live = F.col("label").isin(*GROUPED) & ~F.col("outcome").isin("NO_RESTRICTION", "INFO")
    families = list(dict.fromkeys("GEO" if x in ("NATIONALITY", "RESIDENCE") else x for x in GROUPED))
    number = F.when(live, F.array_position(F.array(*map(F.lit, families)), family(F.col("label"))) - 1)
    marks = {
        "__f": F.coalesce(number, F.lit(-1)).cast("int"), "__o": F.when(F.col("outcome") == "FAIL", 1).when(F.col("outcome") == "PASS", 2).otherwise(0),
        "__p": F.when(F.col("polarity").isNull(), 0).when(F.col("polarity") == "EXCLUDES", 1).otherwise(2),
    }
    laid = (items if dealt else items.repartition(*PAIR)).withColumns(marks).sortWithinPartitions(*PAIR, "chunk_index", "label")
    schema = StructType([f for f in items.schema.fields if not (spoken and f.name in SPOKEN)]).add("effective", StringType())
    rule = (lambda rows: _heard(_runs(rows))) if spoken else _runs
    return laid.mapInArrow(lambda batches: whole_pairs(batches, rule), schema)


def verdicts(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """A status and a sentence for each pair.

    Any FAIL, then any CHECK; pairs without rows, or with nothing but notes (INFO), are to
    be checked; the rest, waivers alone included, is eligible. The first failing row is
    quoted.
    """
    first = F.min_by(F.struct("text", "reason"), F.when(F.col("effective") == "FAIL", F.struct("chunk_index", "label")))
    sums = grouped.groupBy("profile_id", "opportunity_id").agg(
        F.count_if(F.col("effective") == "FAIL").alias("n_fail"), F.count_if(F.col("effective") == "CHECK").alias("n_check"), F.count_if(F.col("effective") == "PASS").alias("n_pass"),
        F.count_if(F.col("outcome") != "INFO").alias("__rules"), first.alias("__first"),
    )
    joined = pairs.join(sums, ["profile_id", "opportunity_id"], "left").fillna(0, ["n_fail", "n_check", "n_pass", "__rules"])
    status = F.when(F.col("n_fail") > 0, "LIKELY_NOT_ELIGIBLE").when((F.col("n_check") > 0) | (F.col("__rules") == 0), "CHECK").otherwise("ELIGIBLE")
    more = F.when(F.col("n_fail") > 1, F.concat(F.lit(" (and "), (F.col("n_fail") - 1).cast("string"), F.lit(" more)"))).otherwise("")
    summary = (
        F.when(F.col("n_fail") > 0, F.concat(F.lit("Against: "), F.col("__first.text"), F.lit(" - "), F.col("__first.reason"), more))
        .when(F.col("n_check") > 0, F.concat(F.lit("To check: "), F.col("n_check").cast("string")))
        .when(F.col("__rules") == 0, "No rules found").otherwise("Nothing against")
    )
    return joined.select("profile_id", "opportunity_id", "n_fail", "n_check", "n_pass", status.alias("status"), summary.alias("summary"))


def without_rules(calls: DataFrame, requirements: DataFrame) -> DataFrame:
    """Calls whose verdict needs no profile: ``opportunity_id, status, summary``.

    A call without requirement text (its rules elsewhere, or not told), and one with text
    but no requirement rows, is to be checked.
    """
    bare = F.trim(F.coalesce("requirements_text", F.lit(""))) == ""
    analysed = requirements.select("opportunity_id").distinct().withColumn("__a", F.lit(True))
    why = F.when(bare & F.coalesce("rules_elsewhere", F.lit(False)), "Rules are in another document").when(bare, "Rules are not told").when(F.col("__a").isNull(), "Not analysed yet")
    return calls.join(analysed, "opportunity_id", "left").select("opportunity_id", F.lit("CHECK").alias("status"), why.alias("summary")).where("summary is not null")


def career_check(value: Column, stage: Column, years: Column) -> Column:
    """``met, missing`` of a career value (T13): any stage is met, else a listed stage, else years strictly within the limits."""
    listed = F.size(value["stages"]) > 0
    low, high = value["min_years"], value["max_years"]
    within = F.coalesce(years > low, F.lit(True)) & F.coalesce(years < high, F.lit(True))
    met = F.when(value["any_stage"], True).when(listed, F.array_contains(value["stages"], stage)).otherwise(within & years.isNotNull())
    missing = F.when(F.coalesce(value["any_stage"], F.lit(False)), False).when(listed, stage.isNull()).otherwise(years.isNull())
    return F.when(value.isNotNull(), F.struct(F.coalesce(met, F.lit(False)).alias("met"), missing.alias("missing")))


ART = "(?iu)kunst(?!geschichte|wissenschaft)|k\u00fcnste|\\bart(s|es|i|istic)?\\b(?! (history|management|education))|beaux-arts|painting|sculpture|photography|malerei|grafik"


def education_check(value: Column, has_degree: Column, field: Column, schools: Column) -> Column:
    """``met, missing`` of an education value (T13): a degree, in art where that is asked, by its field or a school's name."""
    art = F.coalesce(field.rlike(ART), F.lit(False)) | F.coalesce(F.exists(schools, lambda s: s["institution"].rlike(ART)), F.lit(False))
    met = F.coalesce(has_degree, F.lit(False)) & (~F.coalesce(value["art"], F.lit(False)) | art)
    return F.when(value.isNotNull(), F.struct(met.alias("met"), has_degree.isNull().alias("missing")))


def languages_check(value: Column, spoken: Column) -> Column:
    """``met, missing`` of a language value (T15): one of the languages, or all where all are asked."""
    met = F.when(value["every"], F.size(F.array_except(value["languages"], spoken)) == 0).otherwise(F.arrays_overlap(value["languages"], spoken))
    return F.when(value.isNotNull(), F.struct((F.coalesce(met, F.lit(False)) & (F.coalesce(F.size(spoken), F.lit(0)) > 0)).alias("met"), (F.coalesce(F.size(spoken), F.lit(0)) <= 0).alias("missing")))


def study_check(value: Column, schools: Column, towns: Column) -> Column:
    """Whether a school of the profile meets a study value: by its name, else its place, else its country.

    ``towns``: the places that the value's regions count, themselves included. Not met is
    never certain, as a profile can leave a school out.
    """
    where = lambda s: F.lower(F.concat_ws(" ", s["institution"], s["city"]))
    named = F.exists(schools, lambda s: F.exists(value["institutions"], lambda n: F.contains(where(s), F.lower(n))))
    words = lambda t: F.concat(F.lit(" "), F.regexp_replace(t, "[^\\p{L}\\p{N}]+", " "), F.lit(" "))
    placed = F.exists(schools, lambda s: F.exists(towns, lambda t: F.contains(words(where(s)), words(F.lower(t)))))
    country = F.exists(schools, lambda s: F.array_contains(value["study_countries"], s["country"]))
    has = lambda name: F.coalesce(F.size(value[name]), F.lit(0)) > 0
    met = F.when(has("institutions"), named).when(has("study_places"), placed).when(has("study_countries"), country).otherwise(False)
    return F.struct(F.coalesce(met, F.lit(False)).alias("met"), (F.coalesce(F.size(schools), F.lit(0)) <= 0).alias("missing"))


def country_membership(fields: Column, countries: Column, broad: Column, region_members: Column) -> Column:
    """A listed country or member of a broad region is true; all fields known and no broad region is false; else unknown."""
    known = F.filter(fields, lambda x: x.isNotNull())
    hit = F.coalesce(F.arrays_overlap(known, countries), F.lit(False)) | F.coalesce(F.arrays_overlap(known, region_members), F.lit(False))
    whole = (F.size(known) == F.size(fields)) & (F.coalesce(F.size(broad), F.lit(0)) <= 0)
    return F.when(hit, True).when(whole, False)


def any_of(parts: DataFrame, key: str, inside: str) -> DataFrame:
    """Three-valued "or" over alternatives: one true is true, all false is false, else unknown."""
    yes, unknown = F.max(F.coalesce(F.col(inside), F.lit(False))), F.max(F.col(inside).isNull())
    return parts.groupBy(key).agg(F.when(yes, True).when(~unknown, False).alias("inside"))


def coverage(calls: DataFrame, requirements: DataFrame) -> DataFrame:
    """Calls with no requirement row."""
    return calls.join(requirements.select("opportunity_id"), "opportunity_id", "left_anti").select("opportunity_id")


def no_rules(items: DataFrame) -> DataFrame:
    """Calls of which no row restricts the applicant."""
    return items.groupBy("opportunity_id").agg(F.max(~F.col("outcome").isin("INFO", "NO_RESTRICTION")).alias("__any")).where("not __any").select("opportunity_id")


def verdict_rows(grouped: DataFrame) -> DataFrame:
    """A row a pair and sentence: its outcome by rank FAIL, PASS, CHECK, and its labels."""
    rank = F.when(F.col("effective") == "FAIL", 0).when(F.col("effective") == "PASS", 1).otherwise(2)
    return grouped.groupBy("profile_id", "opportunity_id", "chunk_index").agg(F.min_by("effective", rank).alias("shown"), F.concat_ws("|", F.array_sort(F.collect_set("label"))).alias("labels"))


def city_membership(city: Column, also: Column) -> Column:
    """Whether one of the places of ``also`` ("A / B") names the profile's city; null where it is unknown."""
    named = F.transform(F.split(also, " / "), lambda p: F.concat(F.lit(" "), F.lower(F.regexp_replace(p, "[^\\p{L}]+", " ")), F.lit(" ")))
    return F.when(city.isNotNull(), F.exists(named, lambda p: F.contains(p, F.concat(F.lit(" "), F.lower(city), F.lit(" ")))))


def graduate_membership(graduation_year: Column, within: Column, dates: Column) -> Column:
    """Graduated less than ``within`` years before each date; the year itself, and a later graduation, are unknown."""
    one = lambda d: F.when((F.year(d) - graduation_year < 0) | (F.year(d) - graduation_year == within), F.lit(None)).otherwise(F.year(d) - graduation_year < within)
    each = F.array_distinct(F.transform(dates, one))
    return F.when(F.size(each) == 1, each[0])


def languages_met(spoken: Column, wanted: Column) -> Column:
    """All wanted languages are spoken; null where the profile states none."""
    return F.when(F.size(spoken) > 0, F.size(F.array_except(wanted, spoken)) == 0)


def discipline_outcome(mine: Column, named: Column, excluded: Column) -> Column:
    """PASS where a discipline is named, or some are left of "all except"; else CHECK; never FAIL."""
    left = F.size(F.array_except(mine, excluded)) > 0
    return F.when(F.coalesce(F.arrays_overlap(mine, named), F.lit(False)), "PASS").when((F.size(excluded) > 0) & left, "PASS").otherwise("CHECK")


def in_favour(hits: Column, label: Column, polarity: Column, inside: Column) -> Column:
    """An unreviewed sentence on one topic that requires, and is surely met, passes; else it is to be checked."""
    topics = F.filter(hits, lambda h: (h != "GENERIC") & (h != label))
    return F.when((F.size(topics) == 0) & (polarity == "REQUIRES") & F.coalesce(inside, F.lit(False)), "PASS").otherwise("CHECK")
