"""Queries of the engine as one job: requirement sentences, reviews and profiles from the tables, the oracle from the rule texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import eligibility, engine, requirements
from callweave.plans import catalog
from callweave.plans.registry import query
from callweave.plans.scratch import materialise
from callweave.plans.views import by_template

#: The reading of each wording (by_template), reviews of two thirds of the texts, membership, and the ladder.
ENGINE_ITEMS = f"""
  cs AS (SELECT list(n_name ORDER BY n_name) AS c FROM nation),
  w AS (SELECT *, CASE label WHEN 'OTHER' THEN 'OTHER_ELIGIBILITY' ELSE label END AS lab, {by_template(3)} AS pol, {by_template(4)} AS sc, {by_template(5)} AS min_age, coalesce({by_template(6)}, 999) AS max_age,
      {by_template(5)} IS NOT NULL OR {by_template(6)} IS NOT NULL AS ages, list_filter(string_split({by_template(7)}, ','), lambda x: x <> '') AS types, CASE WHEN contains(text, n_name) THEN n_nationkey ELSE tpl END AS k,
      CASE WHEN tpl IN (0, 1, 10, 14) THEN [n_name] WHEN tpl = 28 THEN list_concat(c[1:4], [n_name]) END AS countries FROM wordings, cs),
  r AS (SELECT *, lab IN ('AGE', 'NATIONALITY', 'RESIDENCE', 'APPLICANT_TYPE', 'STUDENT_STATUS') AS rejecting, k % 3 > 0 AS reviewed, k % 5 = 0 AS dropped,
      CASE lab WHEN 'AGE' THEN ages WHEN 'APPLICANT_TYPE' THEN len(types) > 0 WHEN 'STUDENT_STATUS' THEN true ELSE countries IS NOT NULL END AS readable FROM w),
  rows AS (SELECT o.o_custkey AS profile_id, r.*, p.birth_date, calls.deadline_date AS d, p.residence_country, p.nationality, p.applicant_type AS own
    FROM orders o JOIN calls ON o.o_orderkey = calls.opportunity_id JOIN r ON r.opportunity_id = o.o_orderkey JOIN profiles p ON p.profile_id = o.o_custkey),
  ins AS (SELECT *, CASE lab
      WHEN 'AGE' THEN CASE WHEN birth_date IS NULL THEN NULL
        WHEN d IS NULL THEN CASE WHEN {catalog.IN_SQL.format(day=catalog.TODAY_SQL)} THEN true WHEN {catalog.AGE_SQL.format(day=catalog.TODAY_SQL)} < coalesce(min_age, 0) THEN NULL ELSE false END
        WHEN d < {catalog.TODAY_SQL} THEN {catalog.IN_SQL.format(day='d')}
        WHEN {catalog.IN_SQL.format(day=catalog.TODAY_SQL)} = {catalog.IN_SQL.format(day='d')} THEN {catalog.IN_SQL.format(day='d')} END
      WHEN 'RESIDENCE' THEN list_contains(countries, residence_country) WHEN 'NATIONALITY' THEN list_contains(countries, nationality)
      WHEN 'APPLICANT_TYPE' THEN CASE WHEN own IS NULL THEN NULL WHEN list_contains(types, own) THEN true WHEN (own = 'organisation' AND list_contains(types, 'group')) OR (own = 'group' AND len(types) = 2 AND NOT list_contains(types, 'group')) THEN NULL ELSE false END END AS i FROM rows),
  items AS (SELECT profile_id, opportunity_id, chunk_index, lab AS label, pol AS polarity, text, CASE
      WHEN pol = 'WAIVES' THEN 'NO_RESTRICTION' WHEN sc = 'WIDENING' THEN 'NO_RESTRICTION' WHEN sc <> 'APPLICANT' THEN 'INFO' WHEN NOT rejecting THEN 'CHECK'
      WHEN NOT reviewed THEN CASE WHEN pol = 'REQUIRES' AND readable AND tpl <> 28 AND coalesce(i, false) THEN 'PASS' ELSE 'CHECK' END
      WHEN dropped OR pol = 'UNCLEAR' OR NOT readable OR i IS NULL THEN 'CHECK'
      WHEN tpl = 28 THEN CASE WHEN i THEN 'CHECK' ELSE 'FAIL' END
      WHEN (pol = 'REQUIRES') = i THEN 'PASS' ELSE 'FAIL' END AS outcome FROM ins)"""
ENGINE_GROUPS = catalog.GROUPS_SQL.replace(catalog.ITEMS_SQL, ENGINE_ITEMS).replace("label <> 'OTHER'", "label NOT IN ('OTHER_ELIGIBILITY', 'CAREER_STAGE')").replace("label = 'OTHER'", "label IN ('OTHER_ELIGIBILITY', 'CAREER_STAGE')")


def _requirements(w):
    """The sentences of calls with the class that a tagger gave them, as T21 keeps them."""
    none = F.lit(None).cast("string")
    return requirements.with_polarity(w.drop("tpl", "n_name", "n_nationkey").withColumns({"is_heading": F.lit(False), "suspected": none, "why": none}), F.col("label"))


def _reviews(t, w):
    """Two of three texts of a rejecting class are reviewed, one of five of these is dropped."""
    once = materialise(w.select("text", "label", "tpl", "n_name", "n_nationkey").distinct(), "wordings")  # else filters work the texts out again, row by row
    w = once.withColumns({"pol": F.expr(by_template(3)), "sc": F.expr(by_template(4)), "least": F.expr(by_template(5)), "most": F.expr(by_template(6)), "t": F.expr(by_template(7))})
    k = F.when(F.contains("text", "n_name"), F.col("n_nationkey")).otherwise(F.col("tpl"))
    all_names = t("nation").agg(F.array_sort(F.collect_list("n_name")).alias("c"))
    known = w.where(F.col("label").isin(*eligibility.REJECTING)).withColumn("k", k).where("k % 3 > 0").join(F.broadcast(all_names))  # one row
    countries = F.when(F.col("tpl").isin(0, 1, 10, 14), F.array("n_name")).when(F.col("tpl") == 28, F.concat(F.slice("c", 1, 4), F.array("n_name")))
    types = F.filter(F.split("t", ","), lambda x: x != "")
    read = {
        "AGE": F.when(F.col("least").isNotNull() | F.col("most").isNotNull(), engine.value(least=F.col("least"), most=F.col("most"))), "APPLICANT_TYPE": F.when(F.size(types) > 0, engine.value(types=types)),
        "STUDENT_STATUS": engine.value(enrolled=F.lit(True)), "RESIDENCE": F.when(countries.isNotNull(), engine.value(countries=countries)),
        "NATIONALITY": F.when(countries.isNotNull(), engine.value(countries=countries, narrower=F.when(F.col("tpl") == 28, "upper town"))),
    }
    value = F.coalesce(*(F.when(F.col("label") == n, v) for n, v in read.items()))
    alternatives = F.filter(F.array(F.struct("label", value.alias("value"))), lambda a: a["value"].isNotNull())
    decision = F.when(F.col("k") % 5 == 0, "drop").otherwise("confirm")
    return known.select("text", "label", decision.alias("decision"), F.col("pol").alias("polarity"), F.col("sc").alias("scope"), F.lit(None).cast("array<string>").alias("applies_to"), alternatives.alias("alternatives")).dropDuplicates(["text", "label"])


def _evaluation(t) -> engine.Evaluation:
    orders = t("orders")
    pairs = orders.select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("opportunity_id"))
    people = t("profiles").select("profile_id", "birth_date", F.array("nationality").alias("nationalities"), "residence_country", "applicant_type")
    calls = t("calls").select("opportunity_id", "deadline_date", F.when(F.col("kind") != "P", F.col("title")).alias("requirements_text"), F.col("has_fee").alias("rules_elsewhere"))
    label = F.when(F.col("label") == "OTHER", "OTHER_ELIGIBILITY").otherwise(F.col("label"))
    w = materialise(t("wordings").withColumn("label", label), "sentences")
    return engine.evaluate(pairs, people, calls, _requirements(w), _reviews(t, w), catalog._names(t), {"english": "en", "german": "de"}, ["painting", "film"], "1996-06-01")


@query(f"WITH {ENGINE_ITEMS} SELECT profile_id, opportunity_id, chunk_index, label, polarity, outcome FROM items")
def e01_e14_engine_items(t):
    """Only neighbours' outcomes are left aside: what the ladder gave each row of each pair."""
    return _evaluation(t).items.select("profile_id", "opportunity_id", "chunk_index", "label", "polarity", "outcome")


@query(f"""WITH {ENGINE_GROUPS}, sums AS (SELECT profile_id, opportunity_id, count(*) FILTER (WHERE effective = 'FAIL') AS f, count(*) FILTER (WHERE effective = 'CHECK') AS c, count(*) FILTER (WHERE effective = 'PASS') AS p,
    count(*) FILTER (WHERE outcome <> 'INFO') AS k, min_by(concat(text, ' - ', CASE polarity WHEN 'EXCLUDES' THEN 'excludes by ' ELSE 'asks for ' END, lower(replace(label, '_', ' '))), chunk_index) FILTER (WHERE effective = 'FAIL') AS q FROM grouped GROUP BY 1, 2),
  full_ AS (SELECT o_custkey AS profile_id, o_orderkey AS opportunity_id, calls.kind = 'P' AS bare, coalesce(calls.has_fee, false) AS elsewhere, f, c, p, k, q, w.opportunity_id IS NULL AS unread FROM orders
    JOIN calls ON o_orderkey = calls.opportunity_id JOIN profiles pr ON pr.profile_id = o_custkey LEFT JOIN sums s ON o_custkey = s.profile_id AND o_orderkey = s.opportunity_id LEFT JOIN (SELECT DISTINCT opportunity_id FROM wordings) w ON w.opportunity_id = o_orderkey)
  SELECT profile_id, opportunity_id, CASE WHEN bare OR unread THEN 0 ELSE coalesce(f, 0) END AS n_fail, CASE WHEN bare OR unread THEN 0 ELSE coalesce(c, 0) END AS n_check, CASE WHEN bare OR unread THEN 0 ELSE coalesce(p, 0) END AS n_pass,
    CASE WHEN bare OR unread THEN 'CHECK' WHEN f > 0 THEN 'LIKELY_NOT_ELIGIBLE' WHEN c > 0 OR coalesce(k, 0) = 0 THEN 'CHECK' ELSE 'ELIGIBLE' END AS status,
    CASE WHEN bare AND elsewhere THEN 'Rules are in another document' WHEN bare THEN 'Rules are not told' WHEN unread THEN 'Not analysed yet'
      WHEN f > 0 THEN concat('Against: ', q, CASE WHEN f > 1 THEN concat(' (and ', CAST(f - 1 AS VARCHAR), ' more)') ELSE '' END) WHEN c > 0 THEN concat('To check: ', CAST(c AS VARCHAR)) WHEN coalesce(k, 0) = 0 THEN 'No rules found' ELSE 'Nothing against' END AS summary
  FROM full_""")
def e17_e18_engine_verdicts(t):
    return _evaluation(t).verdicts


# the typed value of each row of the requirement table: ages, types and countries by the wording, none of waived rows
_COUNTRIES = "CASE WHEN tpl IN (0, 4, 5, 10, 13, 15) THEN n_name WHEN tpl = 28 THEN array_to_string(list_sort(list_distinct(list_concat(c[1:4], [n_name]))), ',') END"
_KEPT = f"""{catalog.TABLE_SQL}, g AS (SELECT *, label IN ('NATIONALITY', 'RESIDENCE') AND NOT ((tpl IN (3, 13) AND label = 'NATIONALITY') OR (tpl = 29 AND label = 'RESIDENCE') OR (tpl = 29 AND label = 'NATIONALITY')) AS geo FROM r),
  kept AS (SELECT * FROM g QUALIFY NOT coalesce(geo, false) OR row_number() OVER (PARTITION BY opportunity_id, chunk_index, coalesce(geo, false) ORDER BY confidence DESC, label) = 1),
  named AS (SELECT k.*, ws.n_name, c FROM kept k JOIN wordings ws USING (opportunity_id, chunk_index, tpl), (SELECT list(n_name ORDER BY n_name) AS c FROM nation) cs),
  typed AS (SELECT opportunity_id, chunk_index, tpl, label, CASE label
    WHEN 'AGE' THEN CASE WHEN tpl <> 27 THEN CAST({by_template(5)} AS VARCHAR) END WHEN 'APPLICANT_TYPE' THEN NULL ELSE NULL END AS least,
    CASE WHEN label = 'AGE' AND tpl <> 27 THEN CAST({by_template(6)} AS VARCHAR) END AS most,
    CASE WHEN label = 'APPLICANT_TYPE' AND tpl NOT IN (7) THEN nullif({by_template(7)}, '') END AS types,
    CASE WHEN label IN ('NATIONALITY', 'RESIDENCE') AND NOT (tpl = 13 AND label = 'NATIONALITY') THEN {_COUNTRIES} END AS countries FROM named)"""


def _typed(t):
    rows = materialise(catalog._table(t), "requirements")
    return engine.typed(rows, engine.text_values(rows, catalog._names(t), {"english": "en", "german": "de"}, ["painting", "film"]))


@query(f"WITH {_KEPT} SELECT opportunity_id, chunk_index, label, least, most, types, countries FROM typed WHERE coalesce(least, most, types, countries) IS NOT NULL")
def t21_typed_values(t):
    """The values that requirement rows of ages, types and countries state, in text form."""
    rows = _typed(t).where("value is not null and label in ('AGE', 'APPLICANT_TYPE', 'NATIONALITY', 'RESIDENCE')")
    text = lambda c: F.nullif(F.concat_ws(",", c), F.lit(""))
    return rows.select("opportunity_id", "chunk_index", "label", F.col("value.least").cast("string").alias("least"), F.col("value.most").cast("string").alias("most"), text("value.types").alias("types"), text("value.countries").alias("countries"))


@query(f"""WITH {_KEPT} SELECT label, count(*) AS n, count(*) FILTER (WHERE coalesce(least, most, types, countries) IS NOT NULL) AS n_read FROM typed
  WHERE label IN ('AGE', 'APPLICANT_TYPE') AND NOT (label = 'AGE' AND tpl IN (2, 29)) AND NOT (label = 'APPLICANT_TYPE' AND tpl = 29) GROUP BY 1""")
def t22_value_rates(t):
    """By class, rows that could have a value (waived ones have none) and those with one."""
    rows = _typed(t).withColumn("has_value", F.col("value").isNotNull())
    return requirements.value_rates(rows.where("suspected is null"), ["AGE", "APPLICANT_TYPE"])
