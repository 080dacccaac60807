"""Verdicts on (profile, call) pairs in one job, by factorised evaluation.

1. Each distinct requirement (text, heading, label, ...) is a *rule*: its values are read, its review and
   scopes are looked up, and the profile fields that can matter to it are named, once.
2. Profiles become codes, one for each group of fields (countries, type, ...); birth dates and graduations
   become, pair by pair, the ages and years that follow from them on the days that count.
3. A pair's requirement row only differs from another by its rule and the codes of the fields that matter to
   it. Membership, checks and the ladder are worked out once for each
   distinct combination of these, and joined back.
4. Language items, alternatives and the verdict follow from one exchange and one sort by pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators import eligibility as E
from callweave.operators import requirements as R
from callweave.plans.scratch import materialise

GEO = ("NATIONALITY", "RESIDENCE")
#: What makes a requirement row another rule.
KEY = ("text", "heading", "is_heading", "label", "suspected", "why", "polarity")
#: Requirement rows of pairs in one task of the last exchange.
ROWS_A_TASK = 150_000
#: Combinations that one task judges.
COMBINATIONS_A_TASK = 20_000
#: What a sentence may ask for; ``narrower``: what it asks for besides the set ("A / B": one of these).
FIELDS = {
    "least": "int", "most": "int", "countries": "array<string>", "broad": "array<string>", "members": "array<string>", "narrower": "string", "either_or": "boolean",
    "types": "array<string>", "enrolled": "boolean", "within": "int", "any_stage": "boolean", "stages": "array<string>", "min_years": "int", "max_years": "int",
    "art": "boolean", "institutions": "array<string>", "study_places": "array<string>", "study_countries": "array<string>",
}
VALUE = "struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">"
#: Reviews: ``alternatives`` holds one value, or several of which one is enough.
REVIEWS = f"text string, label string, decision string, polarity string, scope string, applies_to array<string>, alternatives array<struct<label:string,value:{VALUE}>>"
#: The profile fields that each kind of rule looks at.
LOOKS_AT = {
    "AGE": ["birth_date"], "GEO": ["nationalities", "residence_country", "residence_city"], "TYPE": ["applicant_type"], "STUDENT": ["enrolled", "graduation_year", "schools"],
    "CAREER": ["career_stage", "years"], "EDUCATION": ["has_degree", "degree_field", "schools"], "LANGUAGE": ["languages"], "DISCIPLINE": ["disciplines"],
}
SCHOOLS = "array<struct<institution:string,city:string,country:string>>"
PROFILE = {
    "birth_date": "date", "nationalities": "array<string>", "residence_country": "string", "residence_city": "string", "applicant_type": "string", "enrolled": "boolean", "graduation_year": "int",
    "schools": SCHOOLS, "career_stage": "string", "years": "int", "has_degree": "boolean", "degree_field": "string", "languages": "array<string>", "disciplines": "array<string>",
}
#: Kinds of fields as bits of a number.
BITS = {k: 1 << i for i, k in enumerate(LOOKS_AT)}
KINDS = {"AGE": "AGE", "NATIONALITY": "GEO", "RESIDENCE": "GEO", "APPLICANT_TYPE": "TYPE", "STUDENT_STATUS": "STUDENT", "CAREER_STAGE": "CAREER", "EDUCATION": "EDUCATION", "DISCIPLINE": "DISCIPLINE"}


def value(**fields: Column) -> Column:
    """A VALUE with these fields, all others null."""
    return F.struct(*((fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()))


def text_values(texts: DataFrame, names: DataFrame, languages: dict[str, str], disciplines: Sequence[str]) -> DataFrame:
    """What each distinct ``text`` asks for: ``text, parsed, hits, language, named, excluded``.

    ``parsed``: VALUE by label, without the labels for which nothing can be read safely.
    ``names``: as in ``country_sets``. Null texts give none.
    """
    once = materialise(texts.select("text").where("text is not null").distinct(), "texts")
    text = F.col("text")
    geo = R.country_sets(once, "text", names).withColumnRenamed("countries", "__countries")
    study = R.study_value(once, "text", names)
    read = once.join(geo, "text", "left").join(study, "text", "left")
    least, most = R.age_bounds(text)
    enrolled, within = R.student_status(text)
    career, education, types = R.career_value(text), R.education_value(text), R.applicant_types(text)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    place = value(countries=F.col("__countries"), broad=F.col("regions"), members=F.col("members"), narrower=F.when(some("places"), F.array_join("places", " / ")))
    firm = lambda c: R.gated(c, text)
    own = {
        "AGE": F.when(firm(least).isNotNull() | firm(most).isNotNull(), value(least=least, most=most)),
        "NATIONALITY": firm(F.when(some("__countries") | some("regions"), place)),
        "RESIDENCE": firm(F.when(some("__countries") | some("regions"), place)),
        "APPLICANT_TYPE": firm(F.when(some(types), value(types=types))),
        "STUDENT_STATUS": firm(F.when(enrolled | within.isNotNull(), value(enrolled=F.when(within.isNull(), enrolled), within=within))),
        "CAREER_STAGE": F.when(career.isNotNull(), value(any_stage=career["any_stage"], stages=career["stages"], min_years=career["min_years"], max_years=career["max_years"])),
        "EDUCATION": F.when(education.isNotNull(), value(art=education["art"])).when(
            some("institutions") | some("study_places") | some("study_countries"), value(institutions=F.col("institutions"), study_places=F.col("study_places"), study_countries=F.col("study_countries"))),
    }
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in own.items())), lambda e: e["value"].isNotNull())
    return read.select(
        "text", F.map_from_entries(entries).alias("parsed"), R.keyword_hits(text).alias("hits"), R.languages_value(text, languages).alias("language"),
        R.disciplines_named(text, disciplines).alias("named"), R.excluded_disciplines(text, disciplines).alias("excluded"),
    )


def typed(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """The requirement table with the ``value`` (VALUE) that each row's text states for its label; waived rows have none."""
    parsed = readings.select(F.col("text").alias("__text"), "parsed")
    value = F.when(F.col("polarity") != "WAIVES", F.try_element_at("parsed", F.col("label")))
    return rows.join(parsed, F.col("text") == F.col("__text"), "left").withColumn("value", value).drop("__text", "parsed")


def rules(requirements: DataFrame, reviews: DataFrame, readings: DataFrame, names: DataFrame) -> DataFrame:
    """The distinct rules of ``text, heading, is_heading, label, suspected, why, polarity``, with all that does not depend on a profile.

    E01: a review of the exact text and label counts, else one of the other geographic
    label. E02: a scope that is not about the applicant, in any review of the
    text, else the applicant where there is one. Written
    once, so that ``rule`` stays the name of one rule.
    """
    shown = F.when(F.col("label") == "NONE", F.col("suspected")).otherwise(F.col("label"))
    once = requirements.select(*KEY).distinct().withColumn("shown", shown)
    columns = ("decision", "polarity", "scope", "applies_to", "alternatives")
    kept = reviews.groupBy("text", "label").agg(F.max(F.struct(*columns)).alias("r"))
    twin = F.when(F.col("label") == "NATIONALITY", "RESIDENCE").when(F.col("label") == "RESIDENCE", "NATIONALITY")
    own = kept.select("text", "label", F.col("r").alias("__own"))
    other = kept.select("text", twin.alias("label"), F.col("label").alias("__twin"), F.col("r").alias("__other")).where("label is not null")
    scopes = E.reviewed_scope(reviews).select("text", F.coalesce("scope", F.lit("APPLICANT")).alias("text_scope"))
    said = once.join(readings, "text", "left").join(own, ["text", "label"], "left").join(other, ["text", "label"], "left").join(scopes, "text", "left")
    review = F.coalesce("__own", "__other")
    judged = (review.isNotNull()) & (review["decision"] != "drop")
    parsed = F.try_element_at("parsed", F.col("shown"))
    alternatives = F.when(judged, review["alternatives"]).when(review.isNull() & parsed.isNotNull(), F.array(F.struct(F.col("shown").alias("label"), parsed.alias("value"))))
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    looks = F.flatten(F.array(
        F.coalesce(F.transform("alternatives", lambda a: F.try_element_at(kind, a["label"])), F.array().cast("array<string>")),
        F.array(F.when(F.size("applies_to") > 0, "TYPE"), F.when(F.col("language").isNotNull(), "LANGUAGE"), F.when(F.col("shown") == "DISCIPLINE", "DISCIPLINE")),
    ))
    full = said.select(
        *KEY, "shown", "hits", "language", "named", "excluded", "text_scope", R.scope(F.col("text"), F.col("heading")).alias("rule_scope"),
        (F.coalesce(F.size("named"), F.lit(0)) + F.coalesce(F.size("excluded"), F.lit(0)) > 0).alias("names_discipline"),
        F.coalesce(F.try_element_at("parsed", F.lit("CAREER_STAGE"))["any_stage"], F.lit(False)).alias("any_stage"),
        review["decision"].alias("review_decision"), F.when(review.isNotNull(), F.coalesce(F.when(F.col("__own").isNotNull(), F.col("label")), F.col("__twin"))).alias("review_label"),
        review["polarity"].alias("review_polarity"), review["scope"].alias("review_scope"), review["applies_to"].alias("applies_to"),
        (judged & (F.coalesce(F.size(review["alternatives"]), F.lit(0)) > 0)).alias("review_value"), alternatives.alias("alternatives"),
        R.polarity(F.col("text"), F.col("shown"), F.col("heading")).alias("direction"),
    ).withColumn("looks", F.array_sort(F.array_distinct(F.array_compact(looks)))).withColumn("rule", F.monotonically_increasing_id())
    single = F.when(F.size("alternatives") == 1, F.get("alternatives", 0)["value"])
    named = materialise(full.withColumns({"narrower": single["narrower"], "either_or": F.coalesce(single["either_or"], F.lit(False))}), "rules")
    # the places that a narrower condition names
    parts = named.where("narrower is not null").select("rule", F.explode(F.split("narrower", " / ")).alias("part"))
    known = names.where(F.col("kind").isin("place", "city")).groupBy(F.lower("name").alias("__n")).agg(F.max(F.col("kind") == "city").alias("city"))
    placed = parts.join(known, F.lower("part") == F.col("__n"), "left").groupBy("rule").agg(F.min(F.col("__n").isNotNull()).alias("only_places"), F.min(F.coalesce("city", F.lit(False))).alias("only_cities"))
    return materialise(named.join(placed, "rule", "left"), "rules")


def field_codes(profiles: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """A row a profile: its number ``person``, ``profile_id``, the fields of PROFILE, and for each of ``kinds`` a ``code_KIND`` that equal fields share.

    ``profiles``: ``profile_id`` and any of PROFILE; missing columns are unknown. A list
    without members is an unknown one; lists are sorted, so equal sets have one code.
    Written once, so that ``person`` stays the number of one row.
    """
    def field(n: str, t: str) -> Column:
        if n not in profiles.columns:
            return F.lit(None).cast(t).alias(n)
        return (F.when(F.size(n) > 0, F.array_sort(F.array_distinct(F.array_compact(n)))).cast(t) if t.startswith("array") else F.col(n).cast(t)).alias(n)

    full = profiles.select("profile_id", *(field(n, t) for n, t in PROFILE.items()))
    codes = {f"code_{k}": F.unhex(F.md5(F.to_json(F.struct(*LOOKS_AT[k])))) for k in kinds}
    return materialise(full.withColumns(codes).withColumn("person", F.monotonically_increasing_id()), "people")


def looks_at(kinds: Column) -> Column:
    """A number with the bits of some kinds of fields."""
    return sum((F.when(F.array_contains(kinds, k), bit).otherwise(0) for k, bit in BITS.items()), F.lit(0))


def pair_codes(kinds: Sequence[str], as_of: str) -> dict[str, Column]:
    """What a rule can tell apart in a pair, by kind of fields: the code of these; of birth dates and graduations, all that follows from them and the deadline.

    16 bytes, or bytes that end with the only ";" or follow 16, so joined codes of given kinds stay apart.
    """
    codes = {k: F.col(f"code_{k}") for k in kinds if k != "AGE"}
    if "AGE" in kinds:
        codes["AGE"] = F.concat(E.age_class(F.col("birth_date"), F.col("deadline_date"), as_of), F.lit(";")).cast("binary")
    if "STUDENT" in kinds:
        codes["STUDENT"] = F.concat(codes["STUDENT"], F.concat(E.year_class(F.col("deadline_date"), as_of), F.lit(";")).cast("binary"))
    return codes


def combinations(rows: DataFrame, people: DataFrame) -> DataFrame:
    """The distinct ``rule, signature`` of the rows, each with the profile fields that matter to it and the deadline of one of its pairs."""
    # the profile and the deadline are those of one row, as a class of ages holds for both together
    once = materialise(rows.groupBy("rule", "signature").agg(F.max("looks").alias("looks"), F.min_by("day", "person").alias("day"), F.min("person").alias("person")), "combinations")
    dealt = once.join(people.select("person", *PROFILE), "person").repartition(max(1, -(-once.count() // COMBINATIONS_A_TASK)))
    seen = {n: sum(BITS[k] for k, own in LOOKS_AT.items() if n in own) for n in PROFILE}
    return dealt.select("rule", "signature", "day", *(F.when(F.col("looks").bitwiseAND(seen[n]) != 0, F.col(n)).alias(n) for n in PROFILE))


def _member(a: Column, as_of: str) -> Column:
    """E03-E09 for one alternative: ``inside, missing``; what goes beyond the set makes being inside uncertain only among several."""
    label, v = a["label"], a["value"]
    none = F.array().cast("array<string>")
    lives, from_ = F.array_compact(F.array("residence_country")), F.coalesce("nationalities", none)
    unknown = F.array(F.lit(None).cast("string"))
    fields = F.when(F.coalesce(v["either_or"], F.lit(False)), F.concat(F.when(F.size(lives) > 0, lives).otherwise(unknown), F.when(F.size(from_) > 0, from_).otherwise(unknown)))
    fields = fields.when(label == "NATIONALITY", F.when(F.size(from_) > 0, from_).otherwise(unknown)).otherwise(F.when(F.size(lives) > 0, lives).otherwise(unknown))
    dates = E.reference_dates(F.col("day"), as_of)
    study = E.study_check(v, F.col("schools"), v["study_places"])
    graduated = E.graduate_membership(F.col("graduation_year"), v["within"], dates)
    school = F.coalesce(F.size(v["institutions"]), F.lit(0)) > 0
    student = F.when(v["within"].isNotNull(), F.when(graduated & school, F.when(study["met"], True)).otherwise(graduated)).otherwise(F.col("enrolled"))
    placed = school | (F.coalesce(F.size(v["study_places"]), F.lit(0)) > 0) | (F.coalesce(F.size(v["study_countries"]), F.lit(0)) > 0)
    inside = (
        F.when(label == "AGE", E.age_membership(F.col("birth_date"), F.col("day"), v["least"], v["most"], as_of))
        .when(label.isin(*GEO), E.country_membership(fields, v["countries"], v["broad"], v["members"]))
        .when(label == "APPLICANT_TYPE", E.type_membership(F.col("applicant_type"), v["types"]))
        .when(label == "STUDENT_STATUS", student)
        .when((label == "EDUCATION") & placed, F.when(study["met"], True))
    )
    missing = (
        F.when(label == "AGE", F.col("birth_date").isNull()).when(label.isin(*GEO), F.exists(fields, lambda x: x.isNull())).when(label == "APPLICANT_TYPE", F.col("applicant_type").isNull())
        .when(label == "STUDENT_STATUS", F.when(v["within"].isNotNull(), F.col("graduation_year").isNull()).otherwise(F.col("enrolled").isNull()))
        .when((label == "EDUCATION") & placed, study["missing"]).otherwise(False)
    )
    return F.struct(inside.alias("inside"), missing.alias("missing"), v["narrower"].isNotNull().alias("more"))


def judged(combos: DataFrame, found: DataFrame, as_of: str) -> DataFrame:
    """``rule, signature`` with outcome, kind of check and language: the ladder (E13) once for each combination."""
    rows = combos.join(found, "rule")
    members = F.transform("alternatives", lambda a: _member(a, as_of))
    rows = rows.withColumn("__m", members)
    several = F.size("__m") > 1
    sure = lambda m: m["inside"] & ~(several & m["more"])
    inside = F.when(F.exists("__m", lambda m: F.coalesce(sure(m), F.lit(False))), True).when(F.forall("__m", lambda m: F.coalesce(~m["inside"], F.lit(False))), False)
    own = F.when(F.size("alternatives") == 1, F.get("alternatives", 0)["value"])
    career, education = E.career_check(own, F.col("career_stage"), F.col("years")), E.education_check(own, F.col("has_degree"), F.col("degree_field"), F.col("schools"))
    study = E.study_check(own, F.col("schools"), own["study_places"])
    check = F.when(own.isNull(), None).when(F.col("shown") == "CAREER_STAGE", career).when((F.col("shown") == "EDUCATION") & own["art"].isNotNull(), education).when(F.col("shown") == "EDUCATION", study)
    language = E.languages_check(F.col("language"), F.coalesce("languages", F.array().cast("array<string>")))
    mine = F.coalesce("disciplines", F.array().cast("array<string>"))
    named = F.coalesce("named", F.array().cast("array<string>"))
    open_ = F.size(F.array_except(mine, F.coalesce("excluded", F.array().cast("array<string>")))) > 0
    match = F.arrays_overlap(mine, named)
    # "all except" passes with a field that is left; else a field must be named by a sentence that requires it
    discipline = F.when(F.size(mine) == 0, "MISSING").when(F.col("excluded").isNotNull(), F.when(open_, "PASS").otherwise("CHECK")).when((F.col("polarity") == "REQUIRES") & F.coalesce(match, F.lit(False)), "PASS").otherwise("CHECK")
    met = F.when(F.col("shown") == "DISCIPLINE", match).when(F.col("shown").isin("CAREER_STAGE", "EDUCATION"), check["met"]).when(F.col("narrower").isNull() & F.col("shown").isin(*E.REJECTING), inside)
    favour = (F.size(F.array_except("hits", F.array(F.lit("GENERIC"), F.col("shown")))) == 0) & (F.col("direction") == "REQUIRES") & met
    town = F.transform(F.split("narrower", " / "), lambda p: F.concat(F.lit(" "), F.lower(F.regexp_replace(p, "[^\\p{L}\\p{N}]+", " ")), F.lit(" ")))
    city = F.concat(F.lit(" "), F.lower(F.regexp_replace("residence_city", "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))
    in_city = F.when(F.col("only_places") & F.col("residence_city").isNotNull(), F.when(F.exists(town, lambda p: F.contains(city, p)), True).when(F.col("only_cities"), False))
    read = rows.withColumns({
        "inside": inside, "missing": F.exists("__m", lambda m: m["missing"]), "in_city": in_city, "city_missing": F.col("only_places") & F.col("residence_city").isNull(),
        "favour": F.coalesce(favour, F.lit(False)), "discipline": discipline, "check_met": check["met"], "check_read": check.isNotNull(), "check_missing": check["missing"],
        "language_met": language["met"], "language_missing": language["missing"],
    })
    told = E.ladder(read)
    by_review = F.col("label").isin(*E.REJECTING) & F.col("review_decision").isNotNull()
    spoken = (F.col("shown") == "OTHER_ELIGIBILITY") & F.col("language_met").isNotNull() & F.col("outcome").isin("PASS", "CHECK")
    said = F.coalesce("text_scope", "rule_scope")
    return told.select(
        "rule", "signature", "outcome", "check_kind", "language_met", "language_missing", "text", "is_heading", said.alias("scope"), F.col("polarity").alias("said_polarity"),
        F.when(spoken, "LANGUAGE").when(by_review, F.col("review_label")).otherwise(F.col("shown")).alias("label"),
        F.when(by_review & (F.col("review_decision") != "drop") & F.col("review_polarity").isin("REQUIRES", "EXCLUDES"), F.col("review_polarity")).otherwise(F.col("polarity")).alias("polarity"),
    )


def _said(told: DataFrame) -> DataFrame:
    """Outcomes of combinations with the reason of their items, and what E14 asks of them: one language item a sentence about the applicant that no item covers."""
    asked = ~F.col("is_heading") & (F.coalesce("said_polarity", F.lit("REQUIRES")) != "WAIVES") & (F.col("scope") == "APPLICANT") & F.col("language_met").isNotNull()
    reason = F.concat(F.when(F.col("polarity") == "EXCLUDES", "excludes by ").otherwise("asks for "), F.lower(F.regexp_replace("label", "_", " ")))
    return told.select(
        "rule", "signature", "text", "label", "outcome", "check_kind", "polarity", reason.alias("reason"), F.coalesce(asked, F.lit(False)).alias("asked"),
        F.coalesce((F.col("label") == "LANGUAGE") | (F.col("outcome") == "INFO"), F.lit(False)).alias("covers"), F.when(F.col("language_met"), "PASS").otherwise("CHECK").alias("said_outcome"),
        F.when(~F.col("language_met"), F.when(F.col("language_missing"), "missing_profile_field").otherwise("uncertain_match")).alias("said_kind"),
    )


@dataclass(frozen=True)
class Evaluation:
    """``items``: an outcome for each requirement row of each pair, with its alternatives' (``effective``); ``verdicts``: a row a pair; ``combinations``: what was worked out."""

    items: DataFrame
    verdicts: DataFrame
    combinations: DataFrame


def evaluate(pairs: DataFrame, profiles: DataFrame, calls: DataFrame, requirements: DataFrame, reviews: DataFrame, names: DataFrame, languages: dict[str, str], disciplines: Sequence[str], as_of: str) -> Evaluation:
    """E01-E20 for ``profile_id, opportunity_id`` pairs.

    ``calls``: ``opportunity_id, deadline_date, requirements_text, rules_elsewhere``;
    ``requirements``: the table of T21 (its values are read again from the texts);
    ``reviews``: REVIEWS; ``profiles``: ``profile_id`` and any of PROFILE. Pairs of unknown
    profiles or calls give no verdict. Rows are multiplied by the pairs of their call alone.
    """
    # texts and reviews are read several times, rows of calls once more
    once = materialise(requirements.select(*KEY).distinct(), "distinct")
    found = rules(once, materialise(reviews, "reviews"), text_values(once, names, languages, disciplines), names)
    lean = found.select("rule", looks_at(F.col("looks")).alias("looks"), *(F.col(c).alias(f"__{c}") for c in KEY))
    bits = lean.agg(F.bit_or("looks")).first()[0] or 0
    kinds = [k for k, bit in BITS.items() if bits & bit]
    people = field_codes(profiles, [k for k in kinds if k != "AGE"])
    same = F.lit(True)
    for c in KEY:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    named = requirements.join(lean, same).select("opportunity_id", "chunk_index", "rule", "looks")
    codes = pair_codes(kinds, as_of)
    met = pairs.join(calls.select("opportunity_id", "deadline_date"), "opportunity_id").join(people.select("person", "profile_id", "birth_date", *(f"code_{k}" for k in kinds if k != "AGE")), "profile_id")
    known = materialise(met.select("profile_id", "opportunity_id", "deadline_date", "person", *(c.alias(f"code_{k}") for k, c in codes.items())), "pairs")
    seen = lambda *some: F.col("looks").bitwiseAND(sum(BITS[k] for k in some)) != 0
    signature = F.concat(F.lit("").cast("binary"), *(F.when(seen(k), F.col(f"code_{k}")).otherwise(F.lit("").cast("binary")) for k in kinds))
    # days matter to ages and to years since graduation
    day = F.when(seen("AGE", "STUDENT"), F.col("deadline_date"))
    rows = materialise(known.join(named, "opportunity_id").select("profile_id", "opportunity_id", "chunk_index", "rule", "looks", signature.alias("signature"), "person", day.alias("day")), "rows")
    told = materialise(_said(judged(combinations(rows, people), found, as_of)), "judged")
    joined = rows.select("profile_id", "opportunity_id", "chunk_index", F.col("rule").alias("__rule"), F.col("signature").alias("__sig")).join(told, (F.col("rule") == F.col("__rule")) & (F.col("signature") == F.col("__sig")))
    heard = joined.drop("__rule", "__sig", "signature", "rule").where("outcome is not null or asked or covers")
    # dealt by the number of rows, so that what a task sorts does not grow with the table
    each = heard.repartition(max(1, -(-rows.count() // ROWS_A_TASK)), *E.PAIR)
    grouped = E.or_groups(each, dealt=True)
    # Calls whose verdict needs no profile
    aside = E.without_rules(calls, requirements)
    with_rules = known.select(*E.PAIR).join(aside.select("opportunity_id"), "opportunity_id", "left_anti")
    ruled = E.verdicts(with_rules, grouped)
    bare = known.select(*E.PAIR).join(aside, "opportunity_id").select(*E.PAIR, *(F.lit(0).cast("bigint").alias(n) for n in ("n_fail", "n_check", "n_pass")), "status", "summary")
    return Evaluation(grouped, ruled.unionByName(bare), told)
