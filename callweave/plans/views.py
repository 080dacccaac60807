"""Fixture views over the given tables: one SQL text for Spark and for the oracle.

``{name}`` stands for a table or another view. Only syntax that both engines share.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Sentences of a call (@ stands for a country), the heading above, their class, and what a reader takes from them:
#: polarity, what they are about, least and largest age, applicant types.
WORDINGS = [
    ("Applicants must be resident in @.", None, "RESIDENCE", "REQUIRES", "APPLICANT", None, None, ""),
    ("Citizens of @ may not apply.", None, "NATIONALITY", "EXCLUDES", "APPLICANT", None, None, ""),
    ("There is no upper age limit.", None, "AGE", "WAIVES", "APPLICANT", None, None, ""),
    ("Artists of any nationality are welcome to apply.", None, "NATIONALITY", "WAIVES", "WIDENING", None, None, ""),
    ("Selected artists will give two workshops in @.", None, "OTHER", "REQUIRES", "OBLIGATION", None, None, ""),
    ("Projects must take place in @.", None, "OTHER", "REQUIRES", "PROJECT", None, None, ""),
    ("Preference will be given to painters from @.", None, "RESIDENCE", "REQUIRES", "PREFERENCE", None, None, ""),
    ("Collectives may also apply.", None, "APPLICANT_TYPE", "REQUIRES", "WIDENING", None, None, "group"),
    ("An emerging artist is understood as somebody in the first years of a career.", None, "CAREER_STAGE", "REQUIRES", "NOT_A_CONDITION", None, None, ""),
    ("Students cannot apply.", None, "STUDENT_STATUS", "EXCLUDES", "APPLICANT", None, None, ""),
    ("Painters must normally live in @.", None, "RESIDENCE", "UNCLEAR", "APPLICANT", None, None, ""),
    ("Students of any subject", "Who cannot apply?", "STUDENT_STATUS", "EXCLUDES", "APPLICANT", None, None, ""),
    ("Registered organisations only.", None, "APPLICANT_TYPE", "REQUIRES", "APPLICANT", None, None, "organisation"),
    ("Applicants do not need to be citizens of @.", None, "NATIONALITY", "WAIVES", "APPLICANT", None, None, ""),
    ("Residents of @ are not eligible, except sculptors.", None, "RESIDENCE", "UNCLEAR", "APPLICANT", None, None, ""),
    ("Theatres from @", "Partners can include:", "OTHER", "REQUIRES", "PROJECT", None, None, ""),
    ("You must be at least 18 and cannot have won before.", None, "AGE", "UNCLEAR", "APPLICANT", 18, None, ""),
    ("We cannot offer accommodation.", None, "OTHER", "REQUIRES", "APPLICANT", None, None, ""),
    ("Open to painters aged between 20 and 30.", None, "AGE", "REQUIRES", "APPLICANT", 20, 30, ""),
    ("For applicants under the age of 35.", None, "AGE", "REQUIRES", "APPLICANT", None, 34, ""),
    ("Applicants up to 40 years old.", None, "AGE", "REQUIRES", "APPLICANT", None, 40, ""),
    ("Everybody over 25.", None, "AGE", "REQUIRES", "APPLICANT", 25, None, ""),
    ("Applicants must be of legal age.", None, "AGE", "REQUIRES", "APPLICANT", 18, None, ""),
    ("Your child must be under 12.", None, "AGE", "REQUIRES", "APPLICANT", None, None, ""),
    ("Applicants over 18 or over 21.", None, "AGE", "REQUIRES", "APPLICANT", None, None, ""),
    ("Artists based outside @.", None, "RESIDENCE", "REQUIRES", "APPLICANT", None, None, ""),
    ("Individuals, duos and organisations can apply.", None, "APPLICANT_TYPE", "REQUIRES", "APPLICANT", None, None, "group,individual,organisation"),
    ("Ideally applicants are under 30.", None, "AGE", "REQUIRES", "PREFERENCE", None, None, ""),
    ("Citizens of Northland or @, and people from Upper Town.", None, "NATIONALITY", "REQUIRES", "APPLICANT", None, None, ""),
    ("@ language skills are no requirement.", None, "OTHER", "WAIVES", "WIDENING", None, None, ""),
]


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def by_template(column: int) -> str:
    """The value of each wording by its number, in SQL."""
    return "CASE tpl " + " ".join(f"WHEN {i} THEN {_literal(w[column])}" for i, w in enumerate(WORDINGS)) + " END"


def _said(text: str) -> str:
    return "concat(" + ", n_name, ".join(_literal(x) for x in text.split("@")) + ")" if "@" in text else _literal(text)


VIEWS = {
    "cv_lines": """
        SELECT c_custkey AS key, i AS pos, section, CASE i
          WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'ADA FIELD' ELSE 'Ada van Field' END WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'Painter and sculptor' ELSE 'We are a small collective of dancers' END
          WHEN 2 THEN CASE WHEN c_custkey % 5 = 0 THEN 'write to me' ELSE 'ada.field@example.org' END
          WHEN 3 THEN CASE c_custkey % 4 WHEN 0 THEN 'Born 12 March 1984 in a village' WHEN 1 THEN '(b. 1979, by the sea)' WHEN 2 THEN 'Date of birth: 03.11.1990' ELSE 'The festival was born on 3 May 2019' END
          WHEN 4 THEN CASE WHEN c_custkey % 2 = 0 THEN concat('Nationality: ', n_name) ELSE concat(n_name, ' citizen, living in Exile') END
          WHEN 5 THEN CASE WHEN c_custkey % 3 = 0 THEN concat('Lives and works in Harbour, ', n_name) ELSE concat('A performance about ', n_name) END
          WHEN 6 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Languages: German (native), English (fluent), French (basic)' ELSE 'Speaks with hands' END
          WHEN 7 THEN CASE WHEN c_custkey % 4 < 2 THEN 'MFA Painting, Kassel, 2012' ELSE 'BA Sculpture, Ghent' END WHEN 8 THEN CASE WHEN c_custkey % 4 < 2 THEN 'MA Film, 2022 - present' ELSE '2009' END
          WHEN 9 THEN '2015 Tide (video), North Gallery, Oslo' WHEN 10 THEN concat(CAST(2005 + c_custkey % 7 AS VARCHAR(9)), ' | First Light | Old Mill') WHEN 11 THEN '2031 South Hall, “After the Rain”, Bern'
          WHEN 12 THEN '2018 Many hands, Hall' WHEN 13 THEN 'Low Water, 2024 – 2026' WHEN 14 THEN 'A film about the shore.' WHEN 15 THEN 'I am working on a choir of bells.' ELSE 'My next project is a map.' END AS line
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey CROSS JOIN (VALUES (0, NULL), (1, NULL), (2, NULL), (3, NULL), (4, NULL), (5, NULL), (6, NULL), (7, 'Education'), (8, 'Education'),
          (9, 'Solo exhibitions'), (10, 'Solo exhibitions'), (11, 'Solo exhibitions'), (12, 'Group exhibitions'), (13, 'Portfolio'), (14, 'Portfolio'), (15, 'Statement'), (16, 'Statement')) AS v(i, section)""",
    "portfolio_lines": """
        SELECT l_orderkey AS key, CAST(8 * item + i AS INTEGER) AS pos, CASE WHEN l_linestatus = 'O' THEN 'Selected works' END AS section, CASE i
          WHEN 0 THEN concat(CASE l_returnflag WHEN 'A' THEN 'Night Study ' WHEN 'N' THEN 'Harbour Song ' ELSE 'Glass Field ' END, CAST(l_partkey AS VARCHAR(9)))
          WHEN 1 THEN '(for two voices)' WHEN 2 THEN CASE WHEN l_tax < 0.03 THEN concat(CAST(y AS VARCHAR(9)), ' - video and sound') WHEN l_tax < 0.06 THEN concat('Oil on paper. ', CAST(y AS VARCHAR(9))) ELSE concat(CAST(y AS VARCHAR(9)), ' - ', CAST(y + 1 AS VARCHAR(9))) END
          WHEN 3 THEN 'A work about the shore.' WHEN 4 THEN CASE WHEN l_discount < 0.05 THEN 'It was shown at night.' ELSE '17' END ELSE 'The last line, in smaller type.' END AS line
        FROM (SELECT *, year(l_shipdate) + 20 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS item FROM {lineitem}) w
          CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(i) WHERE i <> 1 OR l_quantity > 25""",
    "wordings": f"""
        SELECT l_orderkey AS opportunity_id, chunk_index, n_name, n_nationkey, tpl, CASE tpl {" ".join(f"WHEN {i} THEN {_said(w[0])}" for i, w in enumerate(WORDINGS))} END AS text, {by_template(1)} AS heading, {by_template(2)} AS label
        FROM (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS chunk_index,
          n_name, n_nationkey, (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % {len(WORDINGS)} AS tpl FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey) w""",
    "calls": """
        SELECT o_orderkey AS opportunity_id, o_orderpriority AS source, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS deadline_date,
          concat('Call ', CAST(o_custkey AS VARCHAR(20))) AS title, o_orderstatus AS kind, o_totalprice AS price,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'painting' WHEN o_orderkey % 3 = 1 THEN 'sculpture' ELSE 'all' END AS discipline,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS has_fee
        FROM {orders}""",
    "profiles": """
        SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1950 + c_custkey * 37 % 55 END AS birth_year,
          CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE DATE '1950-01-01' + CAST(c_custkey * 373 % 20000 AS INTEGER) END AS birth_date,
          CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE n_name END AS nationality,
          n_name AS residence_country, c_mktsegment AS discipline,
          CASE WHEN c_custkey % 7 = 3 THEN NULL WHEN c_custkey % 3 = 0 THEN 'individual' WHEN c_custkey % 3 = 1 THEN 'group' ELSE 'organisation' END AS applicant_type
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "requirements": """
        SELECT l_orderkey AS opportunity_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS chunk_index,
          CASE l_partkey % 5 WHEN 0 THEN 'AGE' WHEN 1 THEN 'RESIDENCE' WHEN 2 THEN 'APPLICANT_TYPE' WHEN 3 THEN 'NATIONALITY' ELSE 'OTHER' END AS label,
          concat('Rule ', CAST(l_partkey % 97 AS VARCHAR(9))) AS text, CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_quantity AS INTEGER) % 30 + 5 END AS min_age,
          CASE l_suppkey % 4 WHEN 0 THEN 'REQUIRES' WHEN 1 THEN 'EXCLUDES' WHEN 2 THEN 'WAIVES' ELSE 'UNCLEAR' END AS polarity,
          CAST(l_quantity AS INTEGER) + 20 AS max_age, n_name AS country,
          CASE l_returnflag WHEN 'A' THEN 'individual' WHEN 'N' THEN 'group' ELSE 'organisation' END AS applicant_type,
          l_discount AS confidence
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    "sentences": """
        SELECT l_orderkey AS opportunity_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS idx, CASE l_partkey % 8
          WHEN 0 THEN concat('Applicants must be under ', CAST(CAST(l_quantity AS INTEGER) + 15 AS VARCHAR(9)), ' years old.')
          WHEN 1 THEN concat('Applicants must be at least ', CAST(CAST(l_quantity AS INTEGER) + 5 AS VARCHAR(9)), ' years old.')
          WHEN 2 THEN 'Students are not eligible.' WHEN 3 THEN concat('Artists based in ', n_name, '.')
          WHEN 4 THEN 'There is no age limit.' WHEN 5 THEN 'Who can apply?' WHEN 6 THEN 'Preferably applicants have a degree.'
          ELSE concat('Open to artists aged ', CAST(CAST(l_quantity AS INTEGER) + 10 AS VARCHAR(9)), ' to ', CAST(CAST(l_quantity AS INTEGER) + 20 AS VARCHAR(9)), ', and only collectives.') END AS text
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    "ladder": """
        SELECT l_orderkey AS opportunity_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS chunk_index,
          l_partkey % 23 = 0 AS is_heading,
          CASE l_partkey % 9 WHEN 1 THEN 'AGE' WHEN 2 THEN 'RESIDENCE' WHEN 3 THEN 'NATIONALITY' WHEN 4 THEN 'DISCIPLINE' WHEN 5 THEN 'EDUCATION' WHEN 6 THEN 'OTHER_ELIGIBILITY' WHEN 7 THEN 'NONE' WHEN 8 THEN 'CAREER_STAGE' END AS label,
          CASE l_suppkey % 5 WHEN 1 THEN 'DISCIPLINE' WHEN 2 THEN 'OTHER_ELIGIBILITY' WHEN 3 THEN 'AGE' WHEN 4 THEN 'EDUCATION' END AS suspected,
          CASE WHEN l_linenumber % 2 = 0 THEN 'classifier unsure' ELSE 'topic word' END AS why, l_orderkey % 3 = 0 AS names_discipline,
          CASE CAST(l_quantity AS INTEGER) % 5 WHEN 0 THEN 'WAIVES' WHEN 1 THEN 'EXCLUDES' WHEN 2 THEN 'UNCLEAR' ELSE 'REQUIRES' END AS polarity,
          CASE (l_partkey + l_suppkey) % 11 WHEN 0 THEN 'WIDENING' WHEN 1 THEN 'PROJECT' WHEN 2 THEN 'APPLICANT' END AS text_scope,
          CASE (l_partkey * 3 + l_orderkey) % 7 WHEN 0 THEN 'PREFERENCE' WHEN 1 THEN 'WIDENING' WHEN 2 THEN 'OBLIGATION' ELSE 'APPLICANT' END AS rule_scope,
          l_suppkey % 2 = 0 AS any_stage,
          CASE WHEN (l_partkey + l_linenumber) % 4 > 0 THEN CASE (l_partkey + l_orderkey) % 6 WHEN 0 THEN 'drop' WHEN 1 THEN 'correct' ELSE 'confirm' END END AS review_decision,
          CASE WHEN l_orderkey % 2 = 0 THEN 'RESIDENCE' ELSE 'NATIONALITY' END AS review_label,
          CASE (l_suppkey + l_linenumber) % 5 WHEN 0 THEN 'UNCLEAR' WHEN 1 THEN 'EXCLUDES' ELSE 'REQUIRES' END AS review_polarity,
          CASE (l_orderkey + l_suppkey) % 9 WHEN 0 THEN 'OBLIGATION' WHEN 1 THEN 'WIDENING' ELSE 'APPLICANT' END AS review_scope, (l_partkey + l_suppkey) % 8 > 0 AS review_value,
          (l_orderkey + l_linenumber) % 6 = 0 AS limited, CASE l_orderkey % 4 WHEN 0 THEN 'group' WHEN 1 THEN 'individual' END AS applicant_type,
          CASE (l_partkey + l_quantity) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS inside, l_quantity % 2 = 0 AS missing,
          CASE WHEN (l_suppkey * 3 + l_linenumber) % 4 = 0 THEN 'Berlin' END AS narrower, l_suppkey % 3 = 0 AS either_or,
          CASE (l_orderkey + l_partkey) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS in_city, l_partkey % 2 = 0 AS city_missing, l_orderkey % 5 = 0 AS favour,
          CASE l_linenumber % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'MISSING' ELSE 'CHECK' END AS discipline, l_suppkey % 4 = 0 AS check_met, l_suppkey % 3 > 0 AS check_read, l_linenumber % 2 = 0 AS check_missing,
          CASE l_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS language_met, l_orderkey % 2 = 0 AS language_missing
        FROM {lineitem}""",
    "deadlines": """
        SELECT o_orderkey AS id, CASE o_orderkey % 5
          WHEN 0 THEN concat(CAST(day(o_orderdate) AS VARCHAR(9)), '.', CAST(month(o_orderdate) AS VARCHAR(9)), '.', CAST(year(o_orderdate) + 25 AS VARCHAR(9)))
          WHEN 1 THEN concat('Apply by ', CAST(year(o_orderdate) + 25 AS VARCHAR(9)), '-', lpad(CAST(month(o_orderdate) AS VARCHAR(9)), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS VARCHAR(9)), 2, '0'))
          WHEN 2 THEN concat('from 1.1.', CAST(year(o_orderdate) + 25 AS VARCHAR(9)), ' to 31.', CAST(month(o_orderdate) AS VARCHAR(9)), '.', CAST(year(o_orderdate) + 25 AS VARCHAR(9)))
          WHEN 3 THEN concat('in ', CAST(year(o_orderdate) + 25 AS VARCHAR(9))) END AS text
        FROM {orders}""",
    "funding": """
        SELECT l_orderkey AS opportunity_id, l_linenumber AS pos, l_extendedprice AS amount,
          CASE l_linenumber % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'eur?' END AS currency,
          CASE l_returnflag WHEN 'A' THEN 'month' WHEN 'N' THEN 'total' ELSE 'sometime' END AS period, l_linestatus AS category
        FROM {lineitem}""",
    "crawl": "SELECT event_id, CAST(user_id AS VARCHAR(20)) AS id, ts, event_type, value FROM {events}",
    "annotations": """
        SELECT d.doc_id AS chunk_id, d.source AS grp, concat('q', CAST(l.quality AS VARCHAR(9)), 't', CAST(l.toxic AS VARCHAR(9))) AS label,
          CASE WHEN d.doc_id % 9 = 0 THEN 'q1t0' ELSE concat('q', CAST(l.quality AS VARCHAR(9)), 't', CAST(l.toxic AS VARCHAR(9))) END AS rated,
          (d.doc_id * 37 % 101) / 100.0 AS confidence
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "judgments": """
        SELECT o_custkey AS persona, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS item, (l_partkey * 7 + l_suppkey * 13) % 97 AS sim,
          CASE WHEN l_partkey % 5 = 0 THEN 2 WHEN l_partkey % 5 < 3 THEN 1 ELSE 0 END AS grade, l_suppkey % 5 > 0 AS judged
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "verdicts": """
        SELECT o_custkey AS persona, o_orderkey AS opportunity_id,
          CASE o_orderkey % 3 WHEN 0 THEN 'ELIGIBLE' WHEN 1 THEN 'CHECK' ELSE 'NOT_ELIGIBLE' END AS expected,
          CASE (o_orderkey / 8 + o_custkey) % 4 WHEN 0 THEN 'ELIGIBLE' WHEN 1 THEN 'CHECK' WHEN 2 THEN 'NOT_ELIGIBLE' ELSE 'CHECK' END AS status,
          o_orderpriority AS rule_class
        FROM {orders}""",
}
VIEWS["verdicts"] = VIEWS["verdicts"].replace("(o_orderkey / 8 + o_custkey)", "(o_orderkey * 3 + o_custkey)")


#: Rows of a table in one task of a view's window.
ROWS_A_TASK = 250_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over given tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    parts = {t: load(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))}
    if "OVER (PARTITION BY l_orderkey" in text:
        # dealt for the view's window by the number of rows, so that what a task sorts does not grow with the table
        lines = parts["lineitem"]
        parts["lineitem"] = lines.repartition(max(1, -(-lines.count() // ROWS_A_TASK)), "l_orderkey")
    return spark.sql(text, **parts)


def with_views(sql: str) -> str:
    """The oracle's SQL, the views that it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    body = ",\n".join(f"{v} AS ({VIEWS[v].replace('{', '').replace('}', '')})" for v in used)
    if not used:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {body}, {sql.lstrip()[15:]}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {body}, {sql.lstrip()[5:]}"
    return f"WITH {body}\n{sql}"
