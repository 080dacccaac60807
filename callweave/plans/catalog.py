"""Registered queries: each operator over the given tables, with the oracle's SQL beside it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.operators import annotate, documents, eligibility, evaluate, explore, facts, ingest, learning, matching, normalise, requirements
from callweave.plans.registry import ORACLE, QUERIES, query
from callweave.plans.scratch import materialise, new_path
from callweave.plans.views import by_template, load, with_views
from callweave.sources import stages
from callweave.streaming import jobs

# --- corpus analysis


@query("""SELECT 'discipline' AS column_name, count(*) - count(discipline) AS n_null FROM calls
  UNION ALL SELECT 'has_fee', count(*) - count(has_fee) FROM calls UNION ALL SELECT 'title', count(*) - count(title) FROM calls""")
def x01_null_profile(t):
    return explore.null_profile(t("calls"), ["discipline", "has_fee", "title"])


@query("SELECT count(*) AS n_rows, count(DISTINCT source) AS n_sources, CAST(min(deadline_date) AS VARCHAR) AS first_day, CAST(max(deadline_date) AS VARCHAR) AS last_day FROM calls")
def x01_corpus_card(t):
    card = explore.corpus_card(t("calls"), "source", "deadline_date")
    return card.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("SELECT coalesce(discipline, '(not stated)') AS value, count(*) AS n FROM calls GROUP BY 1")
def x02_value_counts(t):
    return explore.value_counts(t("calls"), "discipline")


@query("""WITH c AS (SELECT source AS value, count(*) AS n FROM documents GROUP BY 1)
  SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS pos, round(sum(n) OVER (ORDER BY n DESC, value) / sum(n) OVER (), 6) AS share FROM c""")
def x03_cumulative_share(t):
    return explore.cumulative_share(t("documents"), "source")


@query("""WITH top AS (SELECT source, count(*) AS c FROM calls GROUP BY 1 ORDER BY c DESC, source LIMIT 3),
  b AS (SELECT CASE WHEN source IN (SELECT source FROM top) THEN source ELSE '(other)' END AS bucket, has_fee FROM calls)
  SELECT bucket, count(*) AS n, round(avg(CAST(has_fee AS DOUBLE)), 6) AS share FROM b GROUP BY 1""")
def x04_share_by_bucket(t):
    return explore.share_by(t("calls"), "source", F.col("has_fee"), top=3)


@query("""SELECT category, count(*) AS n, round(quantile_cont(amount, 0.5), 4) AS median_amount, round(max(amount), 4) AS largest FROM funding GROUP BY 1""")
def x05_component_profile(t):
    return explore.component_profile(t("funding"), "category", "amount")


@query("SELECT CAST(floor(log10(amount)) AS INTEGER) AS bin, count(*) AS n FROM funding WHERE amount > 0 GROUP BY 1")
def x05_log_histogram(t):
    return explore.log_histogram(t("funding"), "amount")


CUES = {"license": "licensed under", "mail": "@", "digits": "[0-9]{3}"}


@query("""SELECT sum(CAST(regexp_matches(text, 'licensed under') AS BIGINT))::BIGINT AS license, sum(CAST(regexp_matches(text, '@') AS BIGINT))::BIGINT AS mail,
  sum(CAST(regexp_matches(text, '[0-9]{3}') AS BIGINT))::BIGINT AS digits,
  sum(CASE WHEN regexp_matches(text, 'licensed under|@|[0-9]{3}') THEN 0 ELSE 1 END)::BIGINT AS none FROM documents""")
def x06_keyword_hits(t):
    return explore.keyword_hits(t("documents"), "text", CUES)


@query("SELECT source AS a, coalesce(discipline, '(not stated)') AS b, count(*) AS n FROM calls GROUP BY 1, 2")
def x07_cross_tab(t):
    return explore.cross_tab(t("calls"), "source", "discipline")


@query("""WITH s AS (SELECT DISTINCT opportunity_id, label FROM requirements)
  SELECT x.label AS a, y.label AS b, count(*) AS n FROM s x JOIN s y ON x.opportunity_id = y.opportunity_id AND x.label < y.label GROUP BY 1, 2""")
def x08_co_occurrence(t):
    return explore.co_occurrence(t("requirements"), "opportunity_id", "label")


@query("""WITH w AS (SELECT lang AS grp, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n\\f\\x0B]+'), lambda x: x <> '')) AS w FROM documents)
  SELECT grp, round(avg(w), 4) AS mean_words, quantile_cont(w, 0.25) AS q1, quantile_cont(w, 0.5) AS q2, quantile_cont(w, 0.75) AS q3,
    CAST(min(w) AS INTEGER) AS least, CAST(max(w) AS INTEGER) AS most FROM w GROUP BY 1""")
def x09_word_quartiles(t):
    return explore.word_quartiles(t("documents"), "lang", "text")


# --- evaluation


@query("SELECT label AS truth, rated AS guess, count(*) AS n FROM annotations GROUP BY 1, 2")
def v04_confusion(t):
    return evaluate.confusion(t("annotations"), "label", "rated")


@query("""WITH l AS (SELECT label FROM annotations UNION SELECT rated FROM annotations),
  s AS (SELECT l.label, (SELECT count(*) FROM annotations a WHERE a.label = l.label) AS support, (SELECT count(*) FROM annotations a WHERE a.rated = l.label) AS given,
    (SELECT count(*) FROM annotations a WHERE a.rated = l.label AND a.label = l.label) AS tp FROM l),
  p AS (SELECT label, support, CASE WHEN given = 0 THEN 0.0 ELSE tp / given END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r FROM s)
  SELECT label, support, round(p, 6) AS prec, round(r, 6) AS rec, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p""")
def v04_class_report(t):
    return evaluate.class_report(t("annotations"), "label", "rated")


@query("""WITH n AS (SELECT count(*) AS n, sum(CASE WHEN label = rated THEN 1 ELSE 0 END) AS same FROM annotations),
  x AS (SELECT label AS l, count(*) AS x FROM annotations GROUP BY 1), y AS (SELECT rated AS l, count(*) AS y FROM annotations GROUP BY 1),
  c AS (SELECT sum(x * y) AS c FROM x JOIN y ON x.l = y.l)
  SELECT n, round(same / n, 6) AS raw_agreement, round((same / n - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM n, c""")
def a10_kappa(t):
    return evaluate.kappa(t("annotations"), "label", "rated")


@query("""SELECT threshold, count(*) FILTER (WHERE confidence >= threshold) AS accepted, round(count(*) FILTER (WHERE confidence >= threshold) / count(*), 6) AS share,
  round(coalesce(count(*) FILTER (WHERE confidence >= threshold AND label = rated) / nullif(count(*) FILTER (WHERE confidence >= threshold), 0), 0.0), 6) AS accuracy
  FROM annotations, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold) GROUP BY 1""")
def v07_threshold_sweep(t):
    return evaluate.threshold_sweep(t("annotations"), "label", "rated", "confidence", [0.1, 0.3, 0.5, 0.7, 0.9])


@query("""SELECT truth, guess, pos, chunk_id FROM (SELECT label AS truth, rated AS guess, chunk_id,
  row_number() OVER (PARTITION BY label, rated ORDER BY confidence DESC, chunk_id) AS pos FROM annotations WHERE label <> rated) WHERE pos <= 3""")
def v10_confident_errors(t):
    return evaluate.confident_errors(t("annotations"), "chunk_id", "label", "rated", "confidence")


@query("""WITH k AS (SELECT DISTINCT opportunity_id, label, polarity FROM requirements),
  g AS (SELECT opportunity_id, list(DISTINCT label) FILTER (WHERE polarity <> 'WAIVES') AS a, list(DISTINCT label) FILTER (WHERE polarity <> 'UNCLEAR') AS b FROM k GROUP BY 1),
  s AS (SELECT coalesce(len(a), 0) AS t, coalesce(len(b), 0) AS g, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS tp FROM g)
  SELECT round(sum(tp) / sum(g), 6) AS micro_p, round(sum(tp) / sum(t), 6) AS micro_r, round(2 * sum(tp) / (sum(t) + sum(g)), 6) AS micro_f1,
    round(avg(CASE WHEN tp = t AND tp = g THEN 1.0 ELSE 0.0 END), 6) AS exact_share, round(avg(CASE WHEN t > 0 AND g = 0 THEN 1.0 ELSE 0.0 END), 6) AS missed_share FROM s""")
def v05_multilabel_scores(t):
    sets = t("requirements").groupBy("opportunity_id").agg(
        F.collect_set(F.when(F.col("polarity") != "WAIVES", F.col("label"))).alias("a"), F.collect_set(F.when(F.col("polarity") != "UNCLEAR", F.col("label"))).alias("b")
    )
    return evaluate.multilabel_scores(sets, "opportunity_id", "a", "b")


SETS_SQL = """k AS (SELECT DISTINCT opportunity_id, label, polarity FROM requirements),
  g AS (SELECT opportunity_id, coalesce(list(DISTINCT label) FILTER (WHERE polarity <> 'WAIVES'), []) AS a, coalesce(list(DISTINCT label) FILTER (WHERE polarity <> 'UNCLEAR'), []) AS b FROM k GROUP BY 1),
  c AS (SELECT l.label, list_contains(a, l.label) AS t, list_contains(b, l.label) AS p, len(a) AS size FROM g, (SELECT DISTINCT label FROM requirements) l),
  m AS (SELECT label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM c GROUP BY 1)"""


def _sets(t):
    kept = lambda other: F.collect_set(F.when(F.col("polarity") != other, F.col("label")))
    return t("requirements").groupBy("opportunity_id").agg(kept("WAIVES").alias("a"), kept("UNCLEAR").alias("b"))


@query(f"""WITH {SETS_SQL} SELECT label, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
  FROM m WHERE tp + fp + fn > 0""")
def v05_label_counts(t):
    return evaluate.label_counts(_sets(t), "a", "b")


@query(f"""WITH {SETS_SQL}, f AS (SELECT avg(round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)) AS macro FROM m)
  SELECT round(any_value(macro), 5) AS macro_f1, round(avg(CASE WHEN t <> p THEN 1.0 ELSE 0.0 END), 6) AS hamming, round(count(*) FILTER (t AND p AND size >= 2) / count(*) FILTER (t AND size >= 2), 6) AS compound_recall FROM c, f""")
def v05_macro_hamming_compound(t):
    return evaluate.multilabel_more(_sets(t), "a", "b", 5)


VERDICT_SQL = """count(*) FILTER (WHERE status = 'NOT_ELIGIBLE' AND expected <> 'NOT_ELIGIBLE') AS wrong_no, count(*) FILTER (WHERE expected <> 'NOT_ELIGIBLE') AS of_not_no,
  count(*) FILTER (WHERE status = 'ELIGIBLE' AND expected = 'NOT_ELIGIBLE') AS wrong_yes, count(*) FILTER (WHERE expected = 'NOT_ELIGIBLE') AS of_no,
  count(*) FILTER (WHERE status = 'ELIGIBLE' AND expected = 'ELIGIBLE') AS found_yes, count(*) FILTER (WHERE expected = 'ELIGIBLE') AS of_yes,
  count(*) FILTER (WHERE status = 'NOT_ELIGIBLE' AND expected = 'NOT_ELIGIBLE') AS found_no, round(avg(CASE WHEN status <> 'CHECK' THEN 1.0 ELSE 0.0 END), 6) AS conclusive FROM verdicts"""


@query(f"SELECT {VERDICT_SQL}")
def v15_gold_verdicts(t):
    return evaluate.verdict_counts(t("verdicts"))


@query(f"SELECT rule_class AS grp, {VERDICT_SQL} GROUP BY 1")
def v15_gold_verdicts_by_class(t):
    return evaluate.verdict_counts(t("verdicts"), "rule_class")


@query("""SELECT persona, count(*) AS n, round(avg(CASE WHEN status = 'ELIGIBLE' THEN 1.0 ELSE 0.0 END), 6) AS eligible, round(avg(CASE WHEN status = 'CHECK' THEN 1.0 ELSE 0.0 END), 6) AS "check",
  round(avg(CASE WHEN status = 'NOT_ELIGIBLE' THEN 1.0 ELSE 0.0 END), 6) AS not_eligible FROM verdicts GROUP BY ROLLUP (persona)""")
def v16_verdict_mix(t):
    return evaluate.verdict_mix(t("verdicts"))


@query("SELECT expected AS a, status AS b, count(*) AS n FROM verdicts GROUP BY CUBE (expected, status)")
def v13_crosstab_with_margins(t):
    return evaluate.crosstab_with_margins(t("verdicts"), "expected", "status")


@query("""WITH g AS (SELECT *, CASE WHEN judged THEN grade ELSE 0 END AS g FROM judgments),
  r AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY sim DESC, item) AS pos, row_number() OVER (PARTITION BY persona ORDER BY g DESC, item) AS best FROM g)
  SELECT persona, round(count(*) FILTER (WHERE pos <= 10 AND g >= 1) / 10, 6) AS p_at_k, round(count(*) FILTER (WHERE pos <= 10 AND g = 2) / 10, 6) AS strict_p,
    round(coalesce(sum(CASE WHEN pos <= 10 THEN g / log2(pos + 1) ELSE 0.0 END) / nullif(sum(CASE WHEN best <= 10 THEN g / log2(best + 1) ELSE 0.0 END), 0), 0.0), 6) AS ndcg,
    count(*) FILTER (WHERE pos <= 10 AND NOT judged) AS unjudged FROM r GROUP BY 1""")
def v20_ranking_metrics(t):
    return evaluate.ranking_metrics(t("judgments"))


@query("""WITH b AS (SELECT CAST(confidence AS DOUBLE) AS p, CASE WHEN label = rated THEN 1 ELSE 0 END AS y FROM annotations),
  k AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM b)
  SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc,
    round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM k""")
def v23_probability_scores(t):
    right = F.when(F.col("label") == F.col("rated"), 1).otherwise(0)
    return evaluate.probability_scores(t("annotations").select(F.col("confidence").cast("double").alias("p"), right.alias("y")), "p", "y")


@query("""WITH b AS (SELECT ntile(5) OVER (ORDER BY confidence, chunk_id) AS bin, CAST(confidence AS DOUBLE) AS p, CASE WHEN label = rated THEN 1 ELSE 0 END AS y FROM annotations)
  SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS share_true FROM b GROUP BY 1""")
def v23_calibration(t):
    right = F.when(F.col("label") == F.col("rated"), 1).otherwise(0)
    return evaluate.calibration(t("annotations").select("chunk_id", F.col("confidence").cast("double").alias("p"), right.alias("y")), "chunk_id", "p", "y")


# --- discovery and merge


@query("SELECT concat('p_', substr(sha256(url), 1, 12)) AS id, page_id FROM pages")
def c01_make_id(t):
    return t("pages").select(ingest.make_id(F.col("url"), "p").alias("id"), "page_id")


LINKS_SQL = """
  anchors AS (SELECT page_id AS key, url AS base, unnest(a) AS a, unnest(range(len(a))) AS pos FROM (
    SELECT page_id, url, regexp_extract_all(CASE WHEN regexp_extract(html, '(?s)<main[^>]*>(.*?)</main>', 1) <> '' THEN regexp_extract(html, '(?s)<main[^>]*>(.*?)</main>', 1) ELSE html END, '(?s)<a [^>]*>.*?</a>') AS a FROM pages)),
  parts AS (SELECT key, base, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href,
    regexp_replace(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g') AS title FROM anchors),
  cut AS (SELECT *, regexp_replace(regexp_replace(href, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '#.*$', '') AS link FROM parts),
  whole AS (SELECT *, CASE WHEN regexp_matches(link, '^[a-z]+://') THEN link WHEN starts_with(link, '//') THEN concat('https:', link)
    WHEN starts_with(link, '/') THEN concat(regexp_extract(base, '^([a-z]+://[^/?#]+)', 1), link) ELSE concat(regexp_extract(regexp_replace(base, '[?#].*$', ''), '^(.*/)', 1), link) END AS url FROM cut),
  links AS (SELECT key, pos, url, title FROM (SELECT *, row_number() OVER (PARTITION BY key, url ORDER BY pos) AS r FROM whole
    WHERE NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)') AND link <> '' AND title <> ''
      AND regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#:]+)', 1) NOT IN ('facebook.com', 'instagram.com', 'twitter.com', 'x.com', 'linkedin.com', 'youtube.com')) WHERE r = 1)"""


def _links(t):
    return ingest.harvest_links(t("pages"), "page_id", "url", "html")


@query(f"WITH {LINKS_SQL} SELECT key, CAST(pos AS INTEGER) AS pos, url, title FROM links")
def c02_c03_harvest_links(t):
    return _links(t)


@query(f"WITH {LINKS_SQL} SELECT key, sha256(string_agg(concat(url, '|', title), chr(10) ORDER BY concat(url, '|', title))) AS hash FROM links GROUP BY key")
def c04_fingerprint(t):
    return ingest.fingerprint(_links(t))


@query(f"WITH {LINKS_SQL}, h AS (SELECT key, string_agg(concat(url, '|', title), chr(10) ORDER BY concat(url, '|', title)) AS h FROM links GROUP BY key) SELECT key FROM h WHERE key % 3 < 2")
def c05_changed_pages(t):
    now = ingest.fingerprint(_links(t))
    # the crawl before lacks a third of the pages, and another third had other links
    before = now.where("key % 3 > 0").withColumn("hash", F.when(F.col("key") % 3 == 1, F.sha2(F.concat("hash", F.lit("old")), 256)).otherwise(F.col("hash")))
    return ingest.changed(now, before)


@query("""WITH k AS (SELECT page_id, url FROM pages), u AS (SELECT concat('p_', substr(sha256(url || '/call'), 1, 12)) AS id, url || '/call' AS url FROM k UNION SELECT concat('p_', substr(sha256(url), 1, 12)), url FROM k)
  SELECT DISTINCT id, url FROM u WHERE id NOT IN (SELECT concat('p_', substr(sha256(url), 1, 12)) FROM k WHERE page_id % 3 = 0)""")
def c07_known_calls(t):
    pages = t("pages")
    known = pages.select(F.explode(F.array(F.col("url"), F.concat("url", F.lit("/call")))).alias("url")).distinct()
    return ingest.unseen(known.select(ingest.make_id(F.col("url"), "p").alias("id"), "url"), ingest.seen_ids(pages.where("page_id % 3 = 0").select(ingest.make_id(F.col("url"), "p").alias("id"))))


@query("SELECT opportunity_id, CASE WHEN opportunity_id % 4 = 0 THEN NULL ELSE title END AS title, discipline FROM calls")
def c13_placeholders(t):
    calls = t("calls").withColumn("title", F.when(F.col("opportunity_id") % 4 == 0, " Not stated. ").otherwise(F.col("title"))).withColumn("discipline", F.coalesce("discipline", F.lit("n/a")))
    return ingest.drop_placeholders(calls, ["title", "discipline"]).select("opportunity_id", "title", "discipline")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'title' ELSE '' END AS missed FROM documents")
def c14_verbatim(t):
    docs = t("documents").withColumns({"title": F.when(F.col("doc_id") % 2 == 0, "words that nobody wrote here").otherwise("two words"), "own": F.substring_index("text", ".", 2)})
    return docs.select("doc_id", F.concat_ws(",", ingest.verbatim_misses(docs, "text", ["title", "own"])).alias("missed"))


@query("""WITH c AS (SELECT concat(id, '/', CAST(CAST(ts AS DATE) AS VARCHAR)) AS id, event_type FROM crawl)
  SELECT DISTINCT id FROM c WHERE id NOT IN (SELECT id FROM c WHERE event_type = 'error' UNION SELECT id FROM c WHERE event_type = 'signup')""")
def s04_c06_unseen_ids(t):
    crawl = t("crawl").withColumn("id", F.concat("id", F.lit("/"), F.col("ts").cast("date").cast("string")))
    seen = ingest.seen_ids(crawl.where("event_type = 'error'"), crawl.where("event_type = 'signup'"))
    return ingest.unseen(crawl.select("id").distinct(), seen)


@query("""SELECT opportunity_id AS id, title, price FROM calls WHERE opportunity_id % 3 > 0
  UNION ALL SELECT opportunity_id, concat(title, ' again'), price + 2 FROM calls WHERE opportunity_id % 3 = 0""")
def c08_merge_by_id(t):
    calls = t("calls").select(F.col("opportunity_id").alias("id"), "title", "price")
    some = calls.where("id % 3 = 0")
    twice = some.select("id", F.concat("title", F.lit(" again")).alias("title"), F.explode(F.array(F.col("price") + 1, F.col("price") + 2)).alias("price"))
    return ingest.merge_by_id(calls, twice, position="price")


@query("SELECT user_id AS url, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def s05_last_per_key(t):
    return ingest.last_per_key(t("events").select(F.col("user_id").alias("url"), "event_id"), "url", "event_id")


@query(f"""WITH {LINKS_SQL}, s AS (SELECT key, pos, url, CASE WHEN regexp_matches(lower(translate(concat(url, ' ', title), 'áàâäãéèêëíìîïóòôöõúùûüñç', 'aaaaaeeeeiiiiooooouuuunc')), 'th|en') THEN 3 ELSE 0 END + CASE WHEN pos % 2 = 0 THEN 2 ELSE 0 END + 1 AS score,
    lower(concat(url, ' ', title)) AS f FROM links)
  SELECT key, rank, url, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, pos) AS INTEGER) AS rank FROM s WHERE score >= 2 AND NOT regexp_matches(f, 'login')) WHERE rank <= 3""")
def c09_rank_documents(t):
    links = _links(t).withColumns({"in_content": F.col("pos") % 2 == 0, "same_host": F.lit(True)})
    return ingest.rank_documents(links, "th|en", "login")


@query(f"WITH {LINKS_SQL} SELECT key, url, title FROM links")
def c03_tree_links(t):
    return ingest.main_links(ingest.page_links(t("pages"), "page_id", "url", "html")).drop("pos")


# a page without a long <article> is all content, else the anchors within it are; hosts are read from the URLs
@query(f"""WITH {LINKS_SQL}, art AS (SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)^(.*?)<article', 1), '(?s)<a [^>]*>.*?</a>')) AS n0, len(regexp_extract_all(body, '(?s)<a [^>]*>.*?</a>')) AS n1,
      length(regexp_replace(regexp_replace(replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g')) AS size
    FROM (SELECT *, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS body FROM pages)),
  s AS (SELECT l.key, l.pos, l.url, CASE WHEN regexp_matches(lower(translate(concat(l.url, ' ', l.title), 'áàâäãéèêëíìîïóòôöõúùûüñç', 'aaaaaeeeeiiiiooooouuuunc')), 'th|en') THEN 3 ELSE 0 END
      + CASE WHEN art.size < 300 OR l.pos BETWEEN n0 AND n0 + n1 - 1 THEN 2 ELSE 0 END + CASE WHEN lower(regexp_extract(l.url, '^[a-zA-Z]+://([^/?#]+)', 1)) = lower(regexp_extract(p.url, '^[a-zA-Z]+://([^/?#]+)', 1)) THEN 1 ELSE 0 END AS score,
    lower(concat(l.url, ' ', l.title)) AS f FROM links l JOIN pages p ON p.page_id = l.key JOIN art ON art.page_id = l.key)
  SELECT key, rank, url, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, pos) AS INTEGER) AS rank FROM s WHERE score >= 2 AND NOT regexp_matches(f, 'login')) WHERE rank <= 3""")
def c09_tree_documents(t):
    """The place and host of each link come from its page."""
    links = ingest.page_links(t("pages"), "page_id", "url", "html")
    once = links.where("title <> ''").groupBy("key", "url").agg(F.min(F.struct("pos", "title", "in_content", "same_host")).alias("m")).select("key", "url", "m.*")
    return ingest.rank_documents(once, "th|en", "login")


@query(f"WITH {LINKS_SQL} SELECT url, count(DISTINCT key) AS n_pages FROM links GROUP BY url HAVING count(DISTINCT key) >= 2")
def c10_site_wide(t):
    return ingest.site_wide(_links(t), least=2)


@query("""SELECT opportunity_id, CASE WHEN discipline IS NULL THEN 'no discipline' WHEN has_fee THEN 'fee' WHEN price > 200000 THEN 'too large' END AS reason FROM calls""")
def c16_gate(t):
    rules = [("no discipline", F.col("discipline").isNull()), ("fee", F.col("has_fee")), ("too large", F.col("price") > 200000)]
    return ingest.gate(t("calls"), rules).select("opportunity_id", "reason")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'published' WHEN o_orderkey % 5 = 0 THEN 'raw' WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'not added' END AS stage FROM orders""")
def c20_furthest_stage(t):
    ids = t("orders").select(F.col("o_orderkey").alias("id"))
    return ingest.furthest_stage(ids, [("published", ids.where("id % 7 = 0")), ("raw", ids.where("id % 5 = 0")), ("rejected", ids.where("id % 3 = 0"))])


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'de' AND doc_id % 4 = 0)")
def c21_never_extracted(t):
    docs = t("documents")
    return ingest.never_extracted(docs, docs.where("lang = 'de' AND doc_id % 4 = 0"))


# --- normalisation


@query("""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS lang FROM documents WHERE doc_id % 7 > 0)
  SELECT r.doc_id AS id, r.lang FROM documents r LEFT JOIN d ON r.doc_id = d.id WHERE d.id IS NULL OR r.lang IS DISTINCT FROM d.lang""")
def n02_needs_processing(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), "lang")
    return normalise.needs_processing(docs, docs.where("id % 7 > 0").withColumn("lang", F.when(F.col("id") % 5 == 0, "en").otherwise(F.col("lang"))))


@query("""WITH n AS (SELECT id, list_max(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]{1,2}\\.[0-9]{1,2}\\.20[0-9]{2}'), lambda x: CAST(try_strptime(x, '%d.%m.%Y') AS DATE)), lambda d: d IS NOT NULL)) AS a,
    CAST(try_strptime(regexp_extract(coalesce(text, ''), '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '%Y-%m-%d') AS DATE) AS b FROM deadlines),
  d AS (SELECT id, coalesce(a, CASE WHEN abs(year(b) - 2020) <= 10 THEN b END) AS deadline FROM n)
  SELECT id, CAST(deadline AS VARCHAR) AS deadline, coalesce(deadline < DATE '2020-06-01', false) AS closed FROM d""")
def n03_n04_deadlines(t):
    read = t("deadlines").select("id", normalise.parse_deadline(F.col("text"), "2020-06-01").alias("deadline"))
    return read.select("id", F.col("deadline").cast("string").alias("deadline"), normalise.is_closed(F.col("deadline"), "2020-06-01").alias("closed"))


DATES = ["Frist: @. März 2021", "le @ février 2022", "hasta el @ de mayo de 2022", "May @th (edition 2021)", "Deadline: @ June, or @ July 2021", "in 2021", "@ October 1990", None]


@query("""SELECT o_orderkey AS id, CAST(CASE o_orderkey % 8 WHEN 0 THEN make_date(2021, 3, d) WHEN 1 THEN make_date(2022, 2, d) WHEN 2 THEN make_date(2022, 5, d) WHEN 3 THEN make_date(2021, 5, d) WHEN 4 THEN make_date(2021, 7, d) END AS VARCHAR) AS deadline
  FROM (SELECT o_orderkey, o_custkey % 28 + 1 AS d FROM orders)""")
def n03_named_months(t):
    day = (F.col("o_custkey") % 28 + 1).cast("string")
    text = F.coalesce(*(F.when(F.col("o_orderkey") % 8 == i, F.replace(F.lit(x), F.lit("@"), day)) for i, x in enumerate(DATES) if x))
    return t("orders").select(F.col("o_orderkey").alias("id"), normalise.parse_deadline(text, "2020-06-01", languages=("en", "de", "fr", "es")).cast("string").alias("deadline"))


@query("SELECT opportunity_id, CASE WHEN count(*) % 2 = 0 THEN string_agg(period || '/' || upper(category), ',' ORDER BY pos, amount, category, period) END AS items FROM funding GROUP BY 1")
def n14_accepted_translations(t):
    lists = t("funding").groupBy("opportunity_id").agg(F.array_sort(F.collect_list(F.struct("pos", "amount", "category", "period"))).alias("l"))
    original = F.transform("l", lambda x: F.struct(x["period"].alias("kind"), x["category"].alias("item")))
    translated = F.transform("l", lambda x: F.upper(x["category"]))
    some = F.when(F.size("l") % 2 == 0, translated).otherwise(F.slice(translated, 1, F.size("l") - 1))
    accepted = normalise.accepted_translation(original, some)
    return lists.select("opportunity_id", F.when(accepted.isNotNull(), F.array_join(F.transform(accepted, lambda x: F.concat_ws("/", x["kind"], x["item"])), ",")).alias("items"))


@query("SELECT source AS value, max(CASE WHEN lang = 'en' THEN true ELSE false END) AS english FROM documents GROUP BY 1")
def n05_distinct_values(t):
    return normalise.distinct_values(t("documents"), "source", "lang")


@query("SELECT opportunity_id, CASE discipline WHEN 'painting' THEN 'visual' WHEN 'sculpture' THEN 'spatial,visual' WHEN 'all' THEN '' END AS canonical FROM calls")
def n06_n07_value_map(t):
    calls = t("calls")
    labels = F.when(F.col("value") == "painting", F.array(F.lit("visual"), F.lit("odd"))).when(F.col("value") == "sculpture", F.array(F.lit("spatial"), F.lit("visual")))
    mapping = normalise.distinct_values(calls.withColumn("lang", F.lit("en")), "discipline", "lang").select("value", labels.alias("labels")).where("labels is not null")
    mapped = normalise.apply_value_map(calls, "discipline", mapping, ["spatial", "visual"])
    return mapped.select("opportunity_id", F.when(F.col("canonical").isNotNull(), F.concat_ws(",", "canonical")).alias("canonical"))


@query("""SELECT opportunity_id, pos, CASE WHEN currency = 'eur?' THEN NULL ELSE amount END AS amount, CASE WHEN currency = 'eur?' THEN NULL ELSE currency END AS currency,
  CASE WHEN period = 'sometime' THEN NULL ELSE period END AS period FROM funding WHERE category = 'O'""")
def n10_valid_component(t):
    return normalise.valid_component(t("funding"), ["month", "total"], ["O"]).select("opportunity_id", "pos", "amount", "currency", "period")


@query("""SELECT opportunity_id, pos FROM funding WHERE pos % 2 = 0""")
def n11_ungrounded(t):
    told = F.when(F.col("pos") % 2 == 0, F.lit("no sum")).otherwise(F.concat(F.lit("a sum of "), F.format_number(F.col("amount").cast("bigint"), 0), F.lit(" each")))
    return normalise.ungrounded(t("funding").withColumn("told", told), "amount", "told").select("opportunity_id", "pos")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 15 AS batch, (row_number() OVER (ORDER BY doc_id) - 1) % 15 AS pos FROM documents WHERE lang <> 'en'")
def n12_n13_work_batches(t):
    return normalise.work_batches(t("documents").where("lang <> 'en'"), "doc_id", 15)


@query("""WITH g AS (SELECT doc_id, source, lower(trim(split_part(text, '.', 1))) AS k, length(text) AS n FROM documents),
  r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY source, k ORDER BY n DESC, doc_id DESC) AS kept FROM g)
  SELECT doc_id AS dropped, kept FROM r WHERE doc_id <> kept""")
def n15_content_duplicates(t):
    docs = t("documents").withColumn("title", F.trim(F.substring_index("text", ".", 1)))
    return normalise.drop_duplicates(docs, "source", "title", F.length("text"), "doc_id")


@query("""WITH g AS (SELECT opportunity_id, currency, period, min(amount) AS lo, max(amount) AS hi FROM funding GROUP BY ALL)
  SELECT opportunity_id, string_agg(m, '; ' ORDER BY m) AS label FROM (SELECT opportunity_id, concat(CASE WHEN lo < hi THEN 'up to ' ELSE '' END, CAST(CAST(round(hi) AS BIGINT) AS VARCHAR), ' ', currency, ' per ', period) AS m FROM g) GROUP BY 1""")
def n16_funding_labels(t):
    return normalise.funding_labels(t("funding"))


@query("""SELECT opportunity_id, round(max(amount * CASE currency WHEN 'EUR' THEN 1.0 WHEN 'USD' THEN 2.0 END), 2) AS eur FROM funding GROUP BY 1
  HAVING count(*) = 1 AND max(amount * CASE currency WHEN 'EUR' THEN 1.0 WHEN 'USD' THEN 2.0 END) BETWEEN 100 AND 50000""")
def n17_headline_funding(t):
    return normalise.headline_funding(t("funding"), {"EUR": 1.0, "USD": 2.0}, 100, 50000)


# --- requirement sentences


#: Fixed values, as in ``requirements``: glyphs that part blocks, list marks that come off, sentence ends.
CHUNK_SQL = r"""
  blocks AS (SELECT doc_id, unnest(b) AS b, unnest(range(len(b))) AS bi FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '(^|\s)[•▪◦*](\s)', '\1' || chr(10) || '\2', 'g'), '[\r\n]+') AS b FROM documents)),
  cuts AS (SELECT doc_id, bi, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '^\s+|\s+$', '', 'g'), '^[-–—•▪◦*]+\s*|^\(?[0-9]{1,2}(?:\.[0-9]{1,2})*[.)]\s+|^[a-zA-Z][.)]\s+', ''), '^\s+|\s+$', '', 'g'),
    '([.;!?])\s+([A-Z0-9("''])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS c FROM blocks),
  pieces AS (SELECT doc_id, bi, ci, regexp_replace(c, '^\s+|\s+$', '', 'g') AS c FROM (SELECT doc_id, bi, unnest(c) AS c, unnest(range(len(c))) AS ci FROM cuts)),
  chunks AS (SELECT doc_id AS key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY bi, ci) - 1 AS INTEGER) AS idx, c AS chunk FROM pieces WHERE c <> '')"""


@query(f"WITH {CHUNK_SQL} SELECT key, idx, chunk FROM chunks")
def t01_sentence_chunks(t):
    return requirements.split_sentences(t("documents"), "doc_id", "text")


HEADING_SQL = """SELECT opportunity_id, idx, text, CASE WHEN (regexp_matches(text, '[?:!]$') OR NOT regexp_matches(text, '[.;]$')) AND regexp_matches(text, 'apply') AND NOT regexp_matches(text, 'years') THEN text END AS h FROM sentences"""


@query(f"""SELECT opportunity_id, idx, last_value(h IGNORE NULLS) OVER (PARTITION BY opportunity_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM ({HEADING_SQL})""")
def t02_t03_headings(t):
    heading = requirements.is_heading(F.col("text"), "apply", "years")
    return requirements.with_heading(t("sentences"), "opportunity_id", "idx", "text", heading).select("opportunity_id", "idx", "heading")


RULES_SQL = """
  once AS (SELECT DISTINCT text, lower(text) AS low FROM sentences),
  read AS (SELECT text, concat_ws(',', CASE WHEN regexp_matches(low, '\\b(years old|aged|age limit|under [0-9]+|over [0-9]+)\\b') THEN 'AGE' END, CASE WHEN regexp_matches(low, '\\bbased in\\b') THEN 'RESIDENCE' END,
      CASE WHEN regexp_matches(low, '\\bcollectives?\\b') THEN 'APPLICANT_TYPE' END, CASE WHEN regexp_matches(low, '\\bstudents?\\b') THEN 'STUDENT_STATUS' END, CASE WHEN regexp_matches(low, '\\bdegree\\b') THEN 'EDUCATION' END,
      CASE WHEN regexp_matches(low, '\\b(must|only|eligible|can apply|open to)\\b') THEN 'GENERIC' END) AS hits,
    CASE WHEN low LIKE '%no age limit%' THEN 'WAIVES' WHEN low LIKE '%not eligible%' THEN 'EXCLUDES' ELSE 'REQUIRES' END AS polarity,
    CASE WHEN low LIKE '%preferably%' THEN 'PREFERENCE' ELSE 'APPLICANT' END AS scope,
    CASE WHEN low LIKE '%aged%' THEN CAST(regexp_extract(low, '([0-9]+) to', 1) AS INTEGER) WHEN low LIKE '%at least%' THEN CAST(regexp_extract(low, 'at least ([0-9]+)', 1) AS INTEGER) END AS least_age,
    CASE WHEN low LIKE '%aged%' THEN CAST(regexp_extract(low, 'to ([0-9]+)', 1) AS INTEGER) WHEN low LIKE '%under%' THEN CAST(regexp_extract(low, 'under ([0-9]+)', 1) AS INTEGER) - 1 END AS most_age,
    CASE WHEN low LIKE '%collectives%' THEN 'group' ELSE '' END AS types FROM once)"""


@query(f"WITH {RULES_SQL} SELECT s.opportunity_id, s.idx, r.hits, r.polarity, r.scope, r.least_age, r.most_age, r.types FROM sentences s JOIN read r ON s.text = r.text")
def t04_t06_t07_t08_t10_rules(t):
    def rules(once):
        text = F.col("text")
        least, most = requirements.age_bounds(text)
        return once.select(
            "text", F.concat_ws(",", requirements.keyword_hits(text)).alias("hits"), requirements.polarity(text).alias("polarity"), requirements.scope(text).alias("scope"),
            requirements.gated(least, text).alias("least_age"), requirements.gated(most, text).alias("most_age"), F.concat_ws(",", requirements.applicant_types(text)).alias("types"),
        )

    return requirements.over_distinct(t("sentences"), "text", rules).drop("text")


@query("""SELECT s.opportunity_id, s.idx, n.n_name AS country_named FROM sentences s LEFT JOIN nation n ON upper(regexp_extract(s.text, 'based in ([A-Za-z ]+)', 1)) = n.n_name""")
def t09_country_named(t):
    named = requirements.over_distinct(t("sentences"), "text", lambda once: requirements.country_named(once, "text", t("nation"), "n_name"))
    return named.select("opportunity_id", "idx", "country_named")


# confident means 0.7 or more; discounts go to 0.1, so they are taken tenfold
@query("""SELECT label, count(*) AS n, round(avg(10 * confidence), 6) AS mean_confidence, round(avg(CASE WHEN 10 * confidence >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS confident,
  round(count(*) / sum(count(*)) OVER (), 6) AS share FROM requirements GROUP BY label""")
def t22_requirement_report(t):
    return requirements.requirement_report(t("requirements").withColumn("confidence", 10 * F.col("confidence")))


@query(f"SELECT opportunity_id, chunk_index, {by_template(3)} AS polarity, {by_template(4)} AS scope FROM wordings")
def t06_t07_polarity_and_scope(t):
    rows = t("wordings").select("opportunity_id", "chunk_index", "heading", "label", "text")
    return rows.select("opportunity_id", "chunk_index", requirements.polarity(F.col("text"), F.col("label"), F.col("heading")).alias("polarity"), requirements.scope(F.col("text"), F.col("heading")).alias("scope"))


@query(f"SELECT DISTINCT text, {by_template(5)} AS least, {by_template(6)} AS most, {by_template(7)} AS types FROM wordings")
def t08_t10_t12_values(t):
    text = F.col("text")
    least, most = requirements.age_bounds(text)
    return t("wordings").select("text").distinct().select("text", requirements.gated(least, text).alias("least"), requirements.gated(most, text).alias("most"), F.concat_ws(",", requirements.applicant_types(text)).alias("types"))


def _names(t):
    nation = t("nation").select(F.lower("n_name").alias("name"), F.lit("country").alias("kind"), F.array("n_name").alias("countries"))
    more = nation.groupBy().agg(F.array_sort(F.flatten(F.collect_list("countries"))).alias("c"))
    region = more.select(F.lit("northland").alias("name"), F.lit("region").alias("kind"), F.slice("c", 1, 3).alias("countries"))
    place = more.select(F.lit("upper town").alias("name"), F.lit("place").alias("kind"), F.slice("c", 4, 1).alias("countries"))
    return nation.union(region).union(place).union(more.select(F.lit("town").alias("name"), F.lit("country").alias("kind"), F.slice("c", 5, 1).alias("countries")))


# of 28: the region's three countries, the country itself, and the place's; of 29 none, as it names a language; of 25 none, as it says outside
@query("""WITH n AS (SELECT list(n_name ORDER BY n_name) AS c FROM nation)
  SELECT DISTINCT text, array_to_string(CASE tpl WHEN 28 THEN list_sort(list_distinct(list_concat(c[1:4], [n_name]))) ELSE [n_name] END, ',') AS countries, CASE tpl WHEN 28 THEN 'upper town' ELSE '' END AS places
  FROM wordings, n WHERE contains(text, n_name) AND tpl NOT IN (14, 25, 29)""")
def t09_country_sets(t):
    found = requirements.country_sets(t("wordings"), "text", _names(t)).where("size(countries) > 0")
    return found.select("text", F.concat_ws(",", "countries").alias("countries"), F.concat_ws(",", "places").alias("places"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 1 THEN n_name WHEN n_regionkey = 1 THEN 'the west' ELSE concat('the west, ', n_name) END AS said FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def t18_described_countries(t):
    nation = t("nation")
    west = sorted(r.n_name for r in nation.where("n_regionkey = 1").select("n_name").collect())
    rows = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    mine = F.when(F.col("c_custkey") % 2 == 0, F.array_union(F.array(*map(F.lit, west)), F.array("n_name"))).otherwise(F.array("n_name"))
    return rows.select(F.col("c_custkey").alias("id"), requirements.describe_countries(mine, [("the west", west)]).alias("said"))


STUDY = ["Graduated from Kassel Academy.", "Having studied at a school in @.", "Alumni of Villa Arson within the last three years.", "Graduated within the last three years.", "At least 3 years of professional practice.",
         "Between 2 to 5 years of practice.", "The organisation has existed for at least 3 years.", "For emerging artists.", "Emerging and established artists.", "A degree in fine arts is needed.", "A diploma, or an equivalent.", "A degree.",
         "A good command of English or German.", "Fluent in both English and German.", "Works written in English may be submitted.", "Knowledge of French is welcome."]
STUDY_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 16 " + " ".join(f"WHEN {i} THEN {'concat(' + repr(x.split('@')[0]) + ', n_name, ' + repr(x.split('@')[1]) + ')' if '@' in x else repr(x)}" for i, x in enumerate(STUDY)) + " END AS text, o_orderkey % 16 AS k, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _study(t):
    n = F.col("k")
    text = F.coalesce(*(F.when(n == i, F.concat(F.lit(x.split("@")[0]), F.col("n_name"), F.lit(x.split("@")[1])) if "@" in x else F.lit(x)) for i, x in enumerate(STUDY)))
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 16).alias("k"), "n_name").withColumn("text", text)


@query(f"""WITH w AS ({STUDY_SQL}) SELECT DISTINCT text, CASE k WHEN 0 THEN 'Kassel Academy' WHEN 2 THEN 'Villa Arson' ELSE '' END AS institutions, CASE k WHEN 1 THEN n_name ELSE '' END AS countries FROM w WHERE k < 4""")
def t14_study_values(t):
    found = requirements.study_value(_study(t), "text", _names(t))
    return found.select("text", F.concat_ws(",", "institutions").alias("institutions"), F.concat_ws(",", "study_countries").alias("countries"))


@query(f"""WITH w AS ({STUDY_SQL}) SELECT DISTINCT text, CASE WHEN k IN (2, 3) THEN CASE k WHEN 3 THEN 3 END END AS within, CASE k WHEN 4 THEN '3-' WHEN 5 THEN '2-5' WHEN 7 THEN 'emerging' WHEN 8 THEN 'any' END AS career,
  CASE k WHEN 9 THEN true WHEN 11 THEN false END AS art, CASE k WHEN 12 THEN 'de,en or' WHEN 13 THEN 'de,en and' END AS languages FROM w""")
def t11_t13_t15_values(t):
    text = F.col("text")
    career, education, language = requirements.career_value(text), requirements.education_value(text), requirements.languages_value(text, {"english": "en", "german": "de", "french": "fr"})
    years = F.concat_ws("-", F.coalesce(career["min_years"].cast("string"), F.lit("")), F.coalesce(career["max_years"].cast("string"), F.lit("")))
    said = F.when(career["any_stage"], "any").when(F.size(career["stages"]) > 0, F.array_join(career["stages"], ",")).when(career.isNotNull(), years)
    spoken = F.when(language.isNotNull(), F.concat(F.array_join(language["languages"], ","), F.when(language["every"], " and").otherwise(" or")))
    return _study(t).select("text").distinct().select("text", requirements.student_status(text)[1].alias("within"), said.alias("career"), education["art"].alias("art"), spoken.alias("languages"))


# probabilities and labels by place; a heading has none; nationality and residence together leave the likelier one
TABLE_SQL = f"""
  w AS (SELECT *, chunk_index % 4 AS m, tpl = 11 AS is_heading FROM wordings WHERE opportunity_id % 3 > 0),
  l AS (SELECT *, unnest(CASE WHEN is_heading THEN [NULL] WHEN m = 0 THEN ['NONE'] WHEN m = 1 THEN ['AGE'] WHEN m = 2 THEN ['RESIDENCE', 'NATIONALITY'] ELSE ['APPLICANT_TYPE', 'AGE'] END) AS lab FROM w),
  r AS (SELECT opportunity_id, chunk_index, tpl, is_heading, lab AS label, CASE WHEN is_heading THEN NULL WHEN lab = 'NONE' THEN 0.75 WHEN lab = 'NATIONALITY' THEN 0.6 WHEN lab = 'RESIDENCE' THEN 0.5 ELSE 0.8 END AS confidence FROM l)"""


def _table(t):
    w = t("wordings").withColumn("is_heading", F.col("tpl") == 11)
    m = F.when(F.col("is_heading"), F.lit(None)).otherwise(F.col("chunk_index") % 4)
    lists = F.when(m == 1, F.array(F.lit("AGE"))).when(m == 2, F.array(F.lit("RESIDENCE"), F.lit("NATIONALITY"))).when(m == 3, F.array(F.lit("APPLICANT_TYPE"), F.lit("AGE")))
    p = lambda *kv: F.create_map(*(F.lit(x) for x in kv))
    chances = F.when(m == 0, p("AGE", 0.25, "RESIDENCE", 0.1)).when(m == 2, p("NATIONALITY", 0.6, "RESIDENCE", 0.5)).when(m.isNotNull(), p("AGE", 0.8, "APPLICANT_TYPE", 0.8))
    predictions = w.select("opportunity_id", "chunk_index", lists.alias("labels"), chances.alias("probabilities"))
    published = t("orders").select(F.col("o_orderkey").alias("opportunity_id")).where("opportunity_id % 3 > 0")
    return requirements.requirement_rows(w.select("opportunity_id", "chunk_index", "text", "is_heading", "heading"), predictions, published)


@query(f"""WITH {TABLE_SQL}, g AS (SELECT *, label IN ('NATIONALITY', 'RESIDENCE') AND NOT ((tpl IN (3, 13) AND label = 'NATIONALITY') OR tpl IN (13, 29) AND label = 'RESIDENCE') AS geo FROM r)
  SELECT label, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM (SELECT * FROM g QUALIFY NOT coalesce(geo, false) OR row_number() OVER (PARTITION BY opportunity_id, chunk_index, coalesce(geo, false) ORDER BY confidence DESC, label) = 1) GROUP BY 1""")
def t21_requirement_table(t):
    return _table(t).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"""WITH {TABLE_SQL}, s AS (SELECT opportunity_id, chunk_index, bool_or(label <> 'NONE') AS has_one FROM r WHERE label IS NOT NULL GROUP BY 1, 2),
  c AS (SELECT opportunity_id, count(*) AS n, bool_or(has_one) AS has_one FROM s GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS n_sentences, count(*) AS n_calls, count(*) FILTER (WHERE NOT has_one) AS n_without FROM c""")
def t22_table_summary(t):
    return requirements.table_summary(_table(t)).select("n_sentences", "n_calls", "n_without")


@query("""WITH e AS (SELECT vec_id, embedding, 4 * embedding[1] - 2 * embedding[2] + 0.1 AS za, 3 * embedding[3] - 0.2 AS zb FROM embeddings),
  p AS (SELECT vec_id, 1 / (1 + exp(-za)) AS pa, 1 / (1 + exp(-zb)) AS pb FROM e)
  SELECT vec_id AS key, 'first' AS label, round(pa, 4) AS p FROM p WHERE pa >= 0.5 UNION ALL SELECT vec_id, 'second', round(pb, 4) FROM p WHERE pb >= 0.5
  UNION ALL SELECT vec_id, 'NONE', round(greatest(pa, pb), 4) FROM p WHERE pa < 0.5 AND pb < 0.5""")
def t19_linear_scores(t):
    table = t("embeddings")
    width = 64
    weights = np.zeros((2, width))
    weights[0, :2], weights[1, 2] = (4, -2), 3
    scored = requirements.linear_scores(table, "vec_id", "embedding", ["first", "second"], weights, np.array([0.1, -0.2]))
    return scored.select("key", "label", F.round("p", 4).alias("p"))


# --- eligibility


AGE_SQL = "(year({day}) - year(birth_date) - CAST(month({day}) * 100 + day({day}) < month(birth_date) * 100 + day(birth_date) AS INTEGER))"
IN_SQL = f"({AGE_SQL} BETWEEN coalesce(min_age, 0) AND max_age)"
TODAY_SQL = "DATE '1996-06-01'"

# ages count birthdays; a rule holds on today and the deadline or it is unknown; too young without a deadline is unknown
ITEMS_SQL = f"""
  rows AS (SELECT o.o_custkey AS profile_id, r.opportunity_id, r.chunk_index, r.label, r.polarity, r.text, p.birth_date, c.deadline_date AS d, r.min_age, r.max_age, p.residence_country, p.nationality, r.country, p.applicant_type AS own, r.applicant_type AS want
    FROM orders o JOIN calls c ON o.o_orderkey = c.opportunity_id JOIN requirements r ON r.opportunity_id = c.opportunity_id JOIN profiles p ON p.profile_id = o.o_custkey),
  ins AS (SELECT *, CASE label
      WHEN 'AGE' THEN CASE WHEN birth_date IS NULL THEN NULL
        WHEN d IS NULL THEN CASE WHEN {IN_SQL.format(day=TODAY_SQL)} THEN true WHEN {AGE_SQL.format(day=TODAY_SQL)} < coalesce(min_age, 0) THEN NULL ELSE false END
        WHEN d < {TODAY_SQL} THEN {IN_SQL.format(day='d')}
        WHEN {IN_SQL.format(day=TODAY_SQL)} = {IN_SQL.format(day='d')} THEN {IN_SQL.format(day='d')} END
      WHEN 'RESIDENCE' THEN residence_country = country
      WHEN 'NATIONALITY' THEN nationality = country
      WHEN 'APPLICANT_TYPE' THEN CASE WHEN own IS NULL THEN NULL WHEN own = want THEN true WHEN own = 'organisation' AND want = 'group' THEN NULL ELSE false END END AS i FROM rows),
  items AS (SELECT profile_id, opportunity_id, chunk_index, label, polarity, text, CASE WHEN polarity = 'WAIVES' THEN 'NO_RESTRICTION' WHEN label = 'OTHER' OR polarity = 'UNCLEAR' OR i IS NULL THEN 'CHECK'
    WHEN (polarity = 'REQUIRES') = i THEN 'PASS' ELSE 'FAIL' END AS outcome FROM ins)"""

# nationality and residence are one family; other labels, waivers and notes are in no group
GROUPS_SQL = f"""{ITEMS_SQL},
  fam AS (SELECT *, CASE WHEN label IN ('NATIONALITY', 'RESIDENCE') THEN 'GEO' ELSE label END AS fm FROM items WHERE outcome NOT IN ('NO_RESTRICTION', 'INFO') AND label <> 'OTHER'),
  st AS (SELECT *, CASE WHEN chunk_index = lag(chunk_index) OVER w + 1 THEN 0 ELSE 1 END AS s FROM fam WINDOW w AS (PARTITION BY profile_id, opportunity_id, fm ORDER BY chunk_index)),
  rn AS (SELECT *, sum(s) OVER (PARTITION BY profile_id, opportunity_id, fm ORDER BY chunk_index) AS run FROM st),
  gs AS (SELECT profile_id, opportunity_id, fm, run, count(*) AS n, bool_and(outcome = 'FAIL') AS af, bool_and(polarity <> 'EXCLUDES' OR outcome = 'PASS') AS cl,
    bool_or(polarity <> 'EXCLUDES' AND outcome = 'PASS') OR NOT bool_or(polarity <> 'EXCLUDES') AS sm FROM rn GROUP BY ALL),
  grouped AS (SELECT r.profile_id, r.opportunity_id, r.chunk_index, r.label, r.polarity, r.text, r.outcome, CASE WHEN n = 1 THEN outcome WHEN af THEN 'FAIL' WHEN cl AND sm THEN 'PASS' ELSE 'CHECK' END AS effective
    FROM rn r JOIN gs g ON r.profile_id = g.profile_id AND r.opportunity_id = g.opportunity_id AND r.fm = g.fm AND r.run = g.run
    UNION ALL SELECT profile_id, opportunity_id, chunk_index, label, polarity, text, outcome, outcome FROM items WHERE outcome IN ('NO_RESTRICTION', 'INFO') OR label = 'OTHER')"""


def _pairs(t):
    return t("orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("opportunity_id"))


def _items(t, pairs=None):
    pairs = _pairs(t) if pairs is None else pairs
    return pairs, eligibility.assess(pairs, t("profiles").select("profile_id", "birth_date", "nationality", "residence_country", "applicant_type"), t("calls"), t("requirements").drop("confidence"), "1996-06-01")


@query(f"WITH {ITEMS_SQL} SELECT profile_id, opportunity_id, chunk_index, label, polarity, outcome FROM items")
def e03_e06_e13_outcomes(t):
    return _items(t)[1].drop("text", "reason")


@query(f"WITH {GROUPS_SQL} SELECT profile_id, opportunity_id, chunk_index, label, effective FROM grouped")
def e15_e16_or_groups(t):
    return eligibility.or_groups(_items(t)[1]).select("profile_id", "opportunity_id", "chunk_index", "label", "effective")


@query(f"""WITH {GROUPS_SQL}, sums AS (SELECT profile_id, opportunity_id, count(*) FILTER (WHERE effective = 'FAIL') AS f, count(*) FILTER (WHERE effective = 'CHECK') AS c, count(*) FILTER (WHERE effective = 'PASS') AS p,
    count(*) FILTER (WHERE outcome <> 'INFO') AS k, min_by(concat(text, ' - ', CASE polarity WHEN 'EXCLUDES' THEN 'excludes by ' ELSE 'asks for ' END, lower(replace(label, '_', ' '))), chunk_index) FILTER (WHERE effective = 'FAIL') AS q FROM grouped GROUP BY 1, 2)
  SELECT o_custkey AS profile_id, o_orderkey AS opportunity_id, coalesce(f, 0) AS n_fail, coalesce(c, 0) AS n_check, coalesce(p, 0) AS n_pass,
    CASE WHEN f > 0 THEN 'LIKELY_NOT_ELIGIBLE' WHEN c > 0 OR coalesce(k, 0) = 0 THEN 'CHECK' ELSE 'ELIGIBLE' END AS status,
    CASE WHEN f > 0 THEN concat('Against: ', q, CASE WHEN f > 1 THEN concat(' (and ', CAST(f - 1 AS VARCHAR), ' more)') ELSE '' END) WHEN c > 0 THEN concat('To check: ', CAST(c AS VARCHAR)) WHEN coalesce(k, 0) = 0 THEN 'No rules found' ELSE 'Nothing against' END AS summary
  FROM orders LEFT JOIN sums ON o_custkey = profile_id AND o_orderkey = opportunity_id""")
def e17_verdicts(t):
    pairs, items = _items(t)
    return eligibility.verdicts(pairs, eligibility.or_groups(items))


@query("""WITH r AS (SELECT text, min(CASE WHEN idx % 3 = 0 THEN 'PROJECT' WHEN idx % 3 = 1 THEN 'APPLICANT' ELSE 'OBLIGATION' END) FILTER (WHERE idx % 3 <> 1) AS scope FROM sentences GROUP BY text) SELECT text, scope FROM r""")
def e02_reviewed_scope(t):
    scope = F.when(F.col("idx") % 3 == 0, "PROJECT").when(F.col("idx") % 3 == 1, "APPLICANT").otherwise("OBLIGATION")
    return eligibility.reviewed_scope(t("sentences").select("text", scope.alias("scope")))


# --- matching


@query("SELECT opportunity_id AS id, substr(sha256(concat_ws(chr(10), title, discipline)), 1, 16) AS text_hash FROM calls")
def m01_text_hash(t):
    return t("calls").select(F.col("opportunity_id").alias("id"), matching.text_hash(F.col("title"), F.col("discipline")).alias("text_hash"))


CENTRES_SQL = """
  u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
  dims AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM u) GROUP BY 1, 2),
  m AS (SELECT label AS key, list(x ORDER BY i) AS m FROM dims GROUP BY 1),
  centres AS (SELECT key, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS v FROM m)"""


def _centres(t):
    return matching.mean_vectors(t("embeddings"), "label", "embedding").select(F.col("key").cast("bigint").alias("key"), "v")


@query(f"WITH {CENTRES_SQL} SELECT CAST(key AS BIGINT) AS key, i, round(x, 6) AS x FROM (SELECT key, unnest(v) AS x, unnest(range(len(v))) AS i FROM centres)")
def m02_m06_mean_vectors(t):
    return _centres(t).select("key", F.posexplode("v").alias("i", "x")).select("key", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


TOPK_SQL = f"""{CENTRES_SQL}, sims AS (SELECT CAST(c.key AS BIGINT) AS key, u.vec_id AS item, round(list_dot_product(c.v, u.v), 12) AS sim FROM centres c, u)"""


@query(f"WITH {TOPK_SQL} SELECT key, item, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, item) AS rank FROM sims) WHERE rank <= 10")
def m07_top_k(t):
    items = t("embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    return matching.top_k(materialise(_centres(t), "centres"), items, 10).select("key", "item", F.round("sim", 6).alias("sim"), "rank")


@query("""SELECT opportunity_id FROM calls WHERE coalesce(deadline_date >= DATE '1996-01-01', true) AND coalesce(kind IN ('O', 'P'), true) AND coalesce(discipline IN ('all', 'painting'), true) AND coalesce(NOT has_fee, true)""")
def m03_preference_filter(t):
    return matching.preference_filter(t("calls"), "1996-01-01", ["O", "P"], ["painting"], no_fee=True).select("opportunity_id")


@query("""SELECT o_custkey AS profile_id, o_orderkey AS opportunity_id, o_orderstatus AS grp, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders""")
def m09_grouped_ranking(t):
    rows = t("orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("opportunity_id"), F.col("o_orderstatus").alias("grp"), "o_totalprice")
    return matching.grouped_ranking(rows, F.desc("o_totalprice")).drop("o_totalprice")


WORDS_SQL = """
  words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]{4,}'))) AS word FROM documents),
  freq AS (SELECT word, count(*) AS df FROM words GROUP BY 1),
  forms AS (SELECT a.word, b.word AS form FROM freq a JOIN freq b ON substr(a.word, 1, 5) = substr(b.word, 1, 5) AND a.word <> b.word AND length(a.word) >= 5 AND length(b.word) >= 5
    AND left(a.word, greatest(5, least(length(a.word), length(b.word)) - 2)) = left(b.word, greatest(5, least(length(a.word), length(b.word)) - 2))),
  more AS (SELECT f.word, sum(q.df) AS m FROM forms f JOIN freq q ON f.form = q.word GROUP BY 1),
  specific AS (SELECT freq.word, df + coalesce(m, 0) AS n FROM freq LEFT JOIN more ON freq.word = more.word WHERE df + coalesce(m, 0) < 0.10 * (SELECT count(*) FROM documents))"""


@query(f"WITH {WORDS_SQL} SELECT word, df FROM freq")
def m11_m12_word_frequency(t):
    return matching.word_frequency(t("documents"), "text")


@query(f"WITH {WORDS_SQL} SELECT word, CAST(n AS BIGINT) AS n FROM specific")
def m12_m13_specific_words(t):
    return matching.specific_words(t("documents"), "text")


@query(f"""WITH {WORDS_SQL}, b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]{{4,}}'))) AS word FROM benchmark)
  SELECT b.item_id AS a, w.doc_id AS b, count(*) AS n_shared FROM b JOIN specific s ON b.word = s.word JOIN words w ON w.word = b.word GROUP BY 1, 2""")
def m14_shared_words(t):
    return matching.shared_words(t("benchmark"), t("documents"), matching.specific_words(t("documents"), "text"), "item_id", "text", "doc_id", "text")


SAME_SQL = """({a} = {b} OR (least(length({a}), length({b})) >= 5 AND left({a}, greatest(5, least(length({a}), length({b})) - 2)) = left({b}, greatest(5, least(length({a}), length({b})) - 2))))"""


@query(f"""WITH {WORDS_SQL}, b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]{{4,}}'))) AS word FROM benchmark),
  ordered AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]{{4,}}') AS ws FROM documents)),
  firsts AS (SELECT doc_id, word, min(pos) AS pos FROM ordered GROUP BY 1, 2),
  pairs AS (SELECT v.word AS mine, s.word AS theirs FROM (SELECT DISTINCT word FROM b) v JOIN specific s ON left(v.word, 4) = left(s.word, 4) AND {SAME_SQL.format(a='v.word', b='s.word')}),
  wanted AS (SELECT DISTINCT item_id, theirs FROM b JOIN pairs ON b.word = pairs.mine),
  met AS (SELECT item_id AS a, doc_id AS b, list([word] ORDER BY pos) AS ws FROM wanted JOIN firsts ON theirs = word GROUP BY 1, 2)
  SELECT a, b, len(list_reduce(ws, lambda s, x: CASE WHEN len(list_filter(s, lambda y: {SAME_SQL.format(a='y', b='x[1]')})) > 0 THEN s ELSE list_concat(s, x) END)) AS n_shared FROM met""")
def m14_shared_word_forms(t):
    return matching.shared_word_forms(t("benchmark"), t("documents"), matching.specific_words(t("documents"), "text"), "item_id", "text", "doc_id", "text")


@query(f"""WITH {WORDS_SQL}, {CHUNK_SQL.strip()}, bw AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]{{4,}}'))) AS word FROM benchmark),
  pr AS (SELECT bw.item_id AS a, w.doc_id AS b, count(*) AS n FROM bw JOIN specific s ON bw.word = s.word JOIN words w ON w.word = bw.word GROUP BY 1, 2), tp AS (SELECT a, b FROM pr QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) <= 2),
  sh AS (SELECT tp.a, tp.b, bw.word FROM tp JOIN bw ON bw.item_id = tp.a JOIN specific s ON s.word = bw.word JOIN words w ON w.doc_id = tp.b AND w.word = bw.word),
  sw AS (SELECT key, idx, chunk, unnest(ws) AS said, unnest(range(len(ws))) AS pos FROM (SELECT key, idx, chunk, list_distinct(regexp_extract_all(lower(chunk), '[a-zà-öø-ÿ]{{4,}}')) AS ws FROM chunks WHERE len(list_filter(regexp_split_to_array(chunk, '\\s+'), lambda x: x <> '')) >= 5)),
  hit AS (SELECT a, b, idx, count(DISTINCT said) AS n FROM sh JOIN sw ON sw.key = sh.b AND {SAME_SQL.format(a='said', b='word')} GROUP BY 1, 2, 3)
  SELECT a, b, idx, n FROM hit QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n DESC, idx) = 1""")
def m15_best_sentences(t):
    left, right = t("benchmark").select(F.col("item_id").alias("key"), "text"), t("documents").select(F.col("doc_id").alias("key"), "text")
    specific = materialise(matching.specific_words(right, "text"), "specific")
    pairs = materialise(matching.top_shared(matching.shared_words(left, right, specific, "key", "text", "key", "text"), 2), "pairs")
    told = materialise(right.join(pairs.select(F.col("b").alias("key")).distinct(), "key", "left_semi"), "told")  # texts of a pair alone are split
    shared = matching.shared_of(pairs, left, told, specific)
    best = matching.best_sentence(shared, requirements.split_sentences(told, "key", "text"), "b", 5)
    return best.select("a", "b", "idx", F.size(F.split("words", " ")).cast("bigint").alias("n"))


@query(f"""WITH {TOPK_SQL}, z AS (SELECT key, item, (sim - avg(sim) OVER (PARTITION BY key)) / stddev_pop(sim) OVER (PARTITION BY key) AS z FROM sims)
  SELECT key, item, CAST(round_even(100 / (1 + exp(-(-1 + z + 0.3 * least(item % 7, 5) - 0.5 * (item % 2)))), 0) AS INTEGER) AS percent FROM z""")
def m16_match_percent(t):
    items = t("embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    centres = matching.with_spread(materialise(_centres(t), "centres"), items)
    near = matching.similarities(materialise(centres, "spread"), items)
    return matching.match_percent(near.withColumns({"n_shared": F.col("item") % 7, "mismatch": F.col("item") % 2 == 1}), (1.0, 0.3, -0.5), -1.0).select("key", "item", "percent")


# --- annotation


@query("""WITH n AS (SELECT *, lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text FROM sentences WINDOW w AS (PARTITION BY opportunity_id ORDER BY idx)),
  q AS (SELECT text, CASE WHEN idx < 4 THEN 'early' ELSE 'late' END AS label, opportunity_id, idx, previous_text, next_text FROM n),
  g AS (SELECT text, label, count(*) OVER (PARTITION BY text, label) AS occurrences, opportunity_id AS example_key, previous_text, next_text, row_number() OVER (PARTITION BY text, label ORDER BY opportunity_id, idx) AS r FROM q)
  SELECT text, label, occurrences, example_key, previous_text, next_text FROM g WHERE r = 1 AND NOT (label = 'early' AND text LIKE 'Artists%')""")
def a04_review_queue(t):
    rows = t("sentences").withColumn("label", F.when(F.col("idx") < 4, "early").otherwise("late"))
    reviews = rows.where("label = 'early' and text like 'Artists%'")
    return annotate.review_queue(rows, reviews, "opportunity_id", "idx", "text", "label")


@query("SELECT doc_id, source, pos FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('1/', CAST(doc_id AS VARCHAR))), doc_id) AS pos FROM documents) WHERE pos <= 5")
def a13_a14_capped_sample(t):
    return annotate.capped_sample(t("documents").select("doc_id", "source"), "doc_id", "source", 5)


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def a02_a15_extended_pool(t):
    return annotate.unused(t("documents").select("doc_id"), t("labels"), "doc_id")


FAMILY_SQL = """
  c AS (SELECT opportunity_id * 100 + idx AS chunk_id, opportunity_id, text, CASE idx % 3 WHEN 0 THEN 'dropped' WHEN 1 THEN 'check_only' ELSE 'safety_net' END AS family FROM sentences),
  o AS (SELECT *, md5(concat('1/', CAST(chunk_id AS VARCHAR))) AS o FROM c)"""


def _families(t):
    chunks = t("sentences").select((F.col("opportunity_id") * 100 + F.col("idx")).alias("chunk_id"), "opportunity_id", "text", F.when(F.col("idx") % 3 == 0, "dropped").when(F.col("idx") % 3 == 1, "check_only").otherwise("safety_net").alias("family"))
    return chunks


@query(f"""WITH {FAMILY_SQL}, f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY text ORDER BY o, chunk_id) = 1), p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY o, chunk_id) <= 2),
  q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY family ORDER BY o, chunk_id) <= CASE family WHEN 'dropped' THEN 20 WHEN 'check_only' THEN 15 ELSE 30 END)
  SELECT chunk_id, opportunity_id, text, family, CASE WHEN row_number() OVER (ORDER BY o, chunk_id) <= 25 THEN 'test' ELSE 'dev' END AS split FROM q""")
def a13_quota_sample(t):
    return annotate.quota_sample(_families(t), {"dropped": 20, "check_only": 15, "safety_net": 30}, 25)


@query()
def a13_quota_walk(t):
    """One walk under all three limits; the tests hold a plain walk."""
    return annotate.quota_walk(_families(t), {"dropped": 20, "check_only": 15, "safety_net": 30}, 25).select("chunk_id", "opportunity_id", "text", "family", "split")


@query("""WITH c AS (SELECT opportunity_id, source, opportunity_id % 3 = 0 AS r, md5(concat('1/', CAST(opportunity_id AS VARCHAR))) AS o FROM calls WHERE opportunity_id NOT IN (SELECT opportunity_id FROM requirements WHERE max_age > 60)),
  a AS (SELECT * FROM (SELECT * FROM c WHERE r QUALIFY row_number() OVER (PARTITION BY source ORDER BY o, opportunity_id) <= 3) ORDER BY o, opportunity_id LIMIT 10),
  b AS (SELECT c.* FROM c LEFT JOIN (SELECT source, count(*) AS s FROM a GROUP BY 1) s ON c.source = s.source WHERE NOT r QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY o, opportunity_id) <= 3 - coalesce(s, 0))
  SELECT opportunity_id, source, r AS rejectable FROM a UNION ALL SELECT opportunity_id, source, r FROM (SELECT * FROM b ORDER BY o, opportunity_id LIMIT 10)""")
def a14_halved_sample(t):
    calls = t("calls").select("opportunity_id", "source", (F.col("opportunity_id") % 3 == 0).alias("rejectable"))
    return annotate.halved_sample(calls, t("requirements").where("max_age > 60"), 20)


@query(f"""WITH {FAMILY_SQL}, a AS (SELECT * FROM (SELECT * FROM o WHERE lower(text) LIKE '%degree%' QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY o, chunk_id) <= 2) ORDER BY o, chunk_id LIMIT 40),
  b AS (SELECT o.* FROM o LEFT JOIN (SELECT opportunity_id, count(*) AS s FROM a GROUP BY 1) s ON o.opportunity_id = s.opportunity_id WHERE lower(text) LIKE '%based in%' AND chunk_id NOT IN (SELECT chunk_id FROM a)
    QUALIFY row_number() OVER (PARTITION BY o.opportunity_id ORDER BY o, chunk_id) <= 2 - coalesce(s, 0))
  SELECT chunk_id, 'EDUCATION' AS keyword_class FROM a UNION ALL SELECT chunk_id, 'RESIDENCE' FROM (SELECT * FROM b ORDER BY o, chunk_id LIMIT 40)""")
def a02_targeted(t):
    return annotate.targeted(_families(t).select("opportunity_id", "chunk_id", "text"), {"EDUCATION": "degree", "RESIDENCE": "based in"}, 40).select("chunk_id", "keyword_class")


@query("""WITH r AS (SELECT persona, item, row_number() OVER (PARTITION BY persona ORDER BY sim DESC, item) AS a, row_number() OVER (PARTITION BY persona ORDER BY sim, item) AS b FROM judgments),
  p AS (SELECT DISTINCT persona, item FROM r WHERE (a <= 5 OR b <= 5) AND (persona, item) NOT IN (SELECT (persona, item) FROM judgments WHERE judged))
  SELECT persona, item, row_number() OVER (PARTITION BY persona ORDER BY md5(concat('1/', CAST(persona AS VARCHAR), '/', CAST(item AS VARCHAR))), item) AS pos FROM p""")
def a15_judging_pool(t):
    j = t("judgments")
    top = lambda order: j.withColumn("r", F.row_number().over(Window.partitionBy("persona").orderBy(order, "item"))).where("r <= 5").select("persona", "item")
    return annotate.judging_pool(top(F.desc("sim")).union(top(F.asc("sim"))), j.where("judged"))


@query("""SELECT chunk_id, CASE WHEN confidence > 0.9 THEN 'q1t1' WHEN confidence < 0.1 THEN 'SKIP' WHEN confidence < 0.3 THEN rated ELSE label END AS final_label,
  CASE WHEN confidence > 0.9 THEN CASE WHEN label = 'q1t1' THEN 'confirmed' ELSE 'changed' END WHEN confidence < 0.1 THEN 'moved' WHEN confidence < 0.3 THEN CASE WHEN label = rated THEN 'confirmed' ELSE 'changed' END ELSE 'kept' END AS state FROM annotations""")
def a09_apply_review(t):
    a = t("annotations")
    human = a.where("confidence < 0.3").select("chunk_id", F.when(F.col("confidence") < 0.1, "SKIP").otherwise(F.col("rated")).alias("label"))
    return annotate.apply_review(a, human, a.where("confidence > 0.9").select("chunk_id", F.lit("q1t1").alias("label")))


@query("SELECT grp, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM annotations GROUP BY grp")
def a03_dominance(t):
    return annotate.dominance(t("annotations"), "grp")


@query("""SELECT opportunity_id AS base, coalesce(string_agg(DISTINCT label, '|' ORDER BY label) FILTER (WHERE label <> 'NONE'), 'NONE') AS labels FROM (SELECT opportunity_id, CASE label WHEN 'OTHER' THEN 'NONE' ELSE label END AS label FROM requirements) GROUP BY 1""")
def a12_multilabel_union(t):
    rows = t("requirements").withColumn("label", F.when(F.col("label") == "OTHER", "NONE").otherwise(F.col("label")))
    return annotate.multilabel_union(rows, "opportunity_id", "label")


@query("SELECT grp, CAST((row_number() OVER (ORDER BY md5(concat('1/', grp))) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT grp FROM annotations)")
def v01_group_folds(t):
    return annotate.group_folds(t("annotations"), "grp", 5)


@query("""WITH c AS (SELECT grp, label, count(*) AS n FROM annotations GROUP BY 1, 2), m AS (SELECT grp, max_by(label, lpad(CAST(n AS VARCHAR), 9, '0') || label) AS main FROM c GROUP BY 1)
  SELECT grp, CAST((row_number() OVER (PARTITION BY main ORDER BY md5(concat('1/', grp)), grp) - 1) % 4 AS INTEGER) AS fold FROM m""")
def v01_stratified_folds(t):
    return learning.dealt_folds(t("annotations"), "grp", "label", 4)


@query("""WITH f AS (SELECT DISTINCT label, chunk_id % 40 AS fold FROM annotations) SELECT fold, label FROM (SELECT DISTINCT fold FROM f), (SELECT DISTINCT label FROM f) EXCEPT SELECT fold, label FROM f""")
def v01_labels_missing(t):
    return learning.labels_missing(t("annotations").withColumn("fold", F.col("chunk_id") % 40), "label", "fold")


def _labelled(t):
    return t("documents").select("doc_id", "text").join(t("labels"), "doc_id")


@query()
def v02_grid_search(t):
    rows = _labelled(t).join(t("documents").select("doc_id", "source"), "doc_id").withColumn("label", F.col("quality").cast("string"))
    folds = materialise(learning.stratified_folds(rows, "source", "label", 2), "folds")
    placed = rows.join(folds, rows["source"].eqNullSafe(folds["grp"])).select("text", "label", "fold")
    return learning.grid_search(placed, [("lr", 10.0, 1, 2.0), ("svm", 10.0, 2, 3.0)], 2)


@query()
def v03_one_vs_rest(t):
    e = t("embeddings")
    labels = [str(r.label) for r in e.groupBy("label").count().orderBy(F.desc("count"), "label").limit(3).collect()]
    rows = e.select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"), F.array(F.col("label").cast("string")).alias("labels"), (F.col("vec_id") % 2).cast("int").alias("fold"))
    return learning.one_vs_rest(rows, labels, 2)


@query("""WITH s AS (SELECT source AS model, doc_id % 5 AS seed, avg(n_chars) AS f1 FROM documents GROUP BY 1, 2) SELECT model, count(*) AS n, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std FROM s GROUP BY 1""")
def v06_over_seeds(t):
    runs = t("documents").groupBy(F.col("source").alias("model"), (F.col("doc_id") % 5).alias("seed")).agg(F.avg("n_chars").alias("f1"))
    return learning.over_seeds(runs, "model", ["f1"])


@query()
def v22_match_probabilities(t):
    rows = t("judgments").where("judged").select("persona", "item", "grade", "sim", (F.col("item") % 7).alias("n_shared"))
    return learning.match_probabilities(rows, ["sim", "n_shared"], 4)


# --- streams: the oracle is the batch result


def stream(sql: str) -> Callable:
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_views(sql)
        return f

    return add


@stream("SELECT DISTINCT concat('d_', substr(sha256(CAST(user_id AS VARCHAR)), 1, 12)) AS id, CAST(user_id AS VARCHAR) AS url FROM events WHERE user_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def w01_discovered(spark, sf_dir):
    seen = load(spark, sf_dir, "documents").where("lang = 'de'").select(jobs.make_id(F.col("doc_id").cast("string"), "d").alias("id"))
    events = jobs.stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("url"), "ts")
    return jobs.drain(jobs.discovered(events, seen, "5000 days")).select("id", "url")


@stream("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def w02_upsert(spark, sf_dir):
    return jobs.upsert(jobs.stream_of(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@stream("""WITH b AS (SELECT CAST(user_id AS VARCHAR) AS id, unnest(range(3)) AS k, time_bucket(INTERVAL '1 day', ts) AS day FROM events WHERE event_type = 'error'),
  w AS (SELECT id, day - to_days(CAST(k AS INTEGER)) AS start FROM b) SELECT id, start, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2""")
def w04_blocked(spark, sf_dir):
    events = jobs.stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("id"), "ts", "event_type")
    return jobs.drain_complete(jobs.blocked(events, "error", 2, "3 days", "1 day"))


@stream("SELECT date_trunc('hour', ts) AS start, CASE WHEN event_type = 'error' THEN 'error' WHEN value IS NULL THEN 'no value' END AS reason, count(*) AS n FROM events GROUP BY 1, 2")
def w05_routed(spark, sf_dir):
    events = jobs.stream_of(spark, f"{sf_dir}/events.parquet")
    return jobs.drain_complete(jobs.routed(events, [("error", F.col("event_type") == "error"), ("no value", F.col("value").isNull())]))


@stream("SELECT CAST(user_id AS VARCHAR) AS key, event_type AS hash, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM (SELECT user_id, event_type, ts, min(event_id) AS event_id FROM events GROUP BY ALL)) WHERE event_type IS DISTINCT FROM before")
def w03_changed_pages(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    once = events.groupBy("user_id", "event_type", "ts").agg(F.min("event_id").alias("event_id")).select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("hash"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    rows = jobs.stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("hash"), "ts")
    return jobs.drain(jobs.changed_pages(rows)).join(once, ["key", "hash", "ts"]).select("key", "hash", "event_id")


@stream("""WITH e AS (SELECT user_id, ts, event_type, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS ok FROM events WHERE event_type IN ('error', 'purchase')),
  f AS (SELECT * FROM e WHERE event_type = 'error')
  SELECT CAST(a.user_id AS VARCHAR) AS id, a.ts FROM f a JOIN f b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL '20 days' AND b.ok IS NOT DISTINCT FROM a.ok GROUP BY 1, 2 HAVING count(*) >= 2""")
def w04_throttled(spark, sf_dir):
    rows = jobs.stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("id"), "ts", "event_type")
    return jobs.drain(jobs.throttled(rows, "error", "purchase", 2, 20 * 86_400)).select("id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@stream("""WITH w AS (SELECT date_trunc('hour', ts) AS start, CASE WHEN event_type = 'error' THEN 'error' WHEN value IS NULL THEN 'no value' END AS reason FROM events), m AS (SELECT max(ts) - INTERVAL '1 hour' AS mark FROM events)
  SELECT start, reason, count(*) AS n FROM w, m WHERE start + INTERVAL '1 hour' <= mark GROUP BY 1, 2""")
def w05_closed_hours(spark, sf_dir):
    events = jobs.stream_of(spark, f"{sf_dir}/events.parquet")
    return jobs.drain(jobs.routed(events, [("error", F.col("event_type") == "error"), ("no value", F.col("value").isNull())]))


# --- documents


LINES_SQL = r"""
  l AS (SELECT doc_id AS key, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_replace(regexp_replace(x, '[ \t\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') AS ls FROM documents),
  lines AS (SELECT key, CAST(pos AS INTEGER) AS pos, line FROM (SELECT key, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM l))"""


@query(f"WITH {LINES_SQL} SELECT key, pos, regexp_replace(line, '^#{{1,6}} ', '') AS line FROM lines")
def s11_whole_lines(t):
    return documents.line_table(t("documents"), "doc_id", "text").drop("marked")


@query(f"WITH {LINES_SQL}, h AS (SELECT *, CASE WHEN len(string_split(line, ' ')) <= 8 AND NOT regexp_matches(line, '[.,;]$') AND regexp_matches(line, '\\p{{L}}{{3}}') AND upper(line) = line THEN line END AS h FROM lines) SELECT key, pos, last_value(h IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos) AS section FROM h")
def d01_d05_sections(t):
    lines = documents.line_table(t("documents"), "doc_id", "text")
    return documents.with_section(lines, documents.heading_like(F.col("line"), ["contact"])).select("key", "pos", "section")


@query(f"""WITH {LINES_SQL}, f AS (SELECT key, pos, line, 'mail' AS field, regexp_extract(line, '([a-z0-9.]+@[a-z0-9.]+[a-z])', 1) AS value FROM lines UNION ALL SELECT key, pos, line, 'number', regexp_extract(line, '([0-9]{{3,}})', 1) FROM lines)
  SELECT key, field, value, line AS quote, pos FROM (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY pos) AS r FROM f WHERE value <> '') WHERE r = 1""")
def d06_d11_facts(t):
    lines = documents.line_table(t("documents"), "doc_id", "text")
    return documents.facts(lines, {"mail": "([a-z0-9.]+@[a-z0-9.]+[a-z])", "number": "([0-9]{3,})"})


@query(f"""WITH {LINES_SQL}, s AS (SELECT key, sum(length(regexp_replace(line, '^#{{1,6}} ', '')) - length(replace(regexp_replace(line, '^#{{1,6}} ', ''), ' ', ''))) AS blanks, sum(length(replace(regexp_replace(line, '^#{{1,6}} ', ''), ' ', ''))) AS letters FROM lines GROUP BY 1)
  SELECT key, CAST(letters AS BIGINT) AS letters, true AS fits FROM s""")
def d02_packed_passages(t):
    # passages hold all letters of their lines, and none is longer than the limit
    lines = documents.line_table(t("documents"), "doc_id", "text")
    packed = documents.pack_lines(documents.with_section(lines, documents.heading_like(F.col("line"), ["contact"])).select("key", "pos", "line", "section"))
    return packed.groupBy("key").agg(F.sum(F.length(F.replace("chunk", F.lit(" "), F.lit("")))).alias("letters"), (F.max(F.length("chunk")) <= 800).alias("fits"))


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 4 = 0 THEN 'no passage' WHEN doc_id % 4 = 1 THEN 'not quoted' WHEN doc_id % 4 = 2 THEN 'no value' END AS reason FROM documents""")
def d13_evidence(t):
    docs, k = t("documents"), F.col("doc_id") % 4
    passages = docs.select(F.col("doc_id").alias("key"), F.lit(0).alias("chunk_index"), F.concat(F.lit("Born  in\nOslo. "), "text").alias("chunk"))
    quote, value = F.when(k == 1, "lives in no town at all").otherwise("born in oslo"), F.when(k != 2, "Oslo").otherwise(" ")
    proposed = docs.select(F.col("doc_id").alias("key"), F.when(k == 0, 7).otherwise(0).alias("chunk_index"), quote.alias("quote"), value.alias("value"))
    return documents.evidence(proposed, passages).select("key", "reason")


@query("""WITH s AS (SELECT o_custkey AS artist_id, o_orderstatus AS field, o_clerk_kind AS kind, o_orderkey AS pos FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'cv' WHEN 1 THEN 'statement' ELSE 'other' END AS o_clerk_kind FROM orders))
  SELECT artist_id, field, kind, pos FROM (SELECT *, row_number() OVER (PARTITION BY artist_id, field ORDER BY CASE kind WHEN 'cv' THEN 1 WHEN 'statement' THEN 2 ELSE 3 END, pos) AS r FROM s) WHERE r = 1""")
def d12_merge_suggestions(t):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "cv").when(F.col("o_orderkey") % 3 == 1, "statement").otherwise("other")
    rows = t("orders").select(F.col("o_custkey").alias("artist_id"), F.col("o_orderstatus").alias("field"), kind.alias("kind"), F.col("o_orderkey").alias("pos"), F.lit("v").alias("value"))
    return documents.merge_suggestions(rows, "artist_id", ["cv", "statement"]).drop("value")


@query("""SELECT o_custkey AS artist_id, lower(o_orderpriority_text) AS title_key, max(summary) AS summary, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, string_agg(DISTINCT o_orderstatus, '; ' ORDER BY o_orderstatus) AS venues
  FROM (SELECT *, trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', ' ', 'g')) AS o_orderpriority_text, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS summary FROM orders) GROUP BY 1, 2""")
def d16_merge_projects(t):
    rows = t("orders").select(F.col("o_custkey").alias("artist_id"), F.col("o_orderpriority").alias("title"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("summary"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("venue"))
    return documents.merge_projects(rows)


@query("""WITH i AS (SELECT opportunity_id AS key, pos, pos % 4 AS item, period FROM funding), d AS (SELECT DISTINCT key, pos, period FROM i)
  SELECT key, count(*) FILTER (WHERE period = 'month') AS done, count(*) FILTER (WHERE period = 'total') AS started, count(*) FILTER (WHERE period = 'sometime') AS missing FROM d GROUP BY 1""")
def d19_item_state(t):
    items = t("funding").select(F.col("opportunity_id").alias("key"), F.concat_ws("/", F.col("opportunity_id").cast("string"), F.col("pos").cast("string"), "period").alias("item_id"), "period").distinct()
    drafts = items.where("period <> 'sometime'").select("item_id", (F.col("period") == "month").alias("final"))
    return documents.item_state(items, drafts)


@query()
def c11_content_text(t):
    return ingest.content_text(t("pages"), "page_id", "html")


# what a reader takes from each document: no name without its e-mail address, no date from a festival, no country from a title
FACTS_SQL = """
  k AS (SELECT c_custkey AS key, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
  f AS (SELECT key, unnest([
    {'f': 'name', 'v': CASE WHEN key % 5 = 0 THEN NULL WHEN key % 2 = 0 THEN 'Ada Field' ELSE 'Ada van Field' END, 'p': 0},
    {'f': 'disciplines', 'v': CASE WHEN key % 3 = 0 THEN 'painting,sculpture' ELSE 'dance' END, 'p': 1}, {'f': 'applicant_type', 'v': CASE WHEN key % 3 = 0 THEN NULL ELSE 'group' END, 'p': 1},
    {'f': 'birth_date', 'v': CASE key % 4 WHEN 0 THEN '1984-03-12' WHEN 2 THEN '1990-11-03' END, 'p': 3}, {'f': 'birth_year', 'v': CASE key % 4 WHEN 1 THEN '1979' END, 'p': 3},
    {'f': 'nationalities', 'v': n_name, 'p': 4}, {'f': 'residence_country', 'v': CASE WHEN key % 3 = 0 THEN n_name END, 'p': 5}, {'f': 'residence_city', 'v': CASE WHEN key % 3 = 0 THEN 'Harbour' END, 'p': 5},
    {'f': 'languages', 'v': CASE WHEN key % 2 = 0 THEN 'de,en' END, 'p': 6}, {'f': 'degree', 'v': CASE WHEN key % 4 < 2 THEN 'MFA' ELSE 'BA' END, 'p': 7}, {'f': 'graduation_year', 'v': CASE WHEN key % 4 < 2 THEN '2012' ELSE '2009' END, 'p': 7},
    {'f': 'enrolled', 'v': CASE WHEN key % 4 < 2 THEN 'true' END, 'p': 8}, {'f': 'active_since', 'v': CAST(2005 + key % 7 AS VARCHAR), 'p': 10}]) AS x FROM k)"""


@query(f"WITH {FACTS_SQL} SELECT key, x.f AS field, x.v AS value, x.p AS pos FROM f WHERE x.v IS NOT NULL")
def d06_d11_profile_facts(t):
    table = t("nation").select(F.lower("n_name").alias("name"), F.lit("country").alias("kind"), F.array("n_name").alias("countries"))
    terms = {"dance": "\\bdancers?\\b", "painting": "\\bpainters?\\b", "sculpture": "\\bsculptors?\\b"}
    return facts.profile_facts(t("cv_lines"), table, {"german": "de", "english": "en", "french": "fr"}, terms, "2026-01-01").drop("quote")


@query("""WITH k AS (SELECT c_custkey AS key FROM customer), p AS (SELECT key, unnest([
    {'pos': 9, 'title': 'Tide', 'years': '2015', 'status': 'past', 'venue': 'North Gallery, Oslo', 'medium': 'video', 'summary': NULL}, {'pos': 10, 'title': 'First Light', 'years': CAST(2005 + key % 7 AS VARCHAR), 'status': 'past', 'venue': 'Old Mill', 'medium': NULL, 'summary': NULL},
    {'pos': 11, 'title': 'After the Rain', 'years': '2031', 'status': 'planned', 'venue': 'South Hall, Bern', 'medium': NULL, 'summary': NULL}, {'pos': 13, 'title': 'Low Water', 'years': '2024 – 2026', 'status': 'current', 'venue': NULL, 'medium': NULL, 'summary': 'A film about the shore.'},
    {'pos': 15, 'title': NULL, 'years': NULL, 'status': 'current', 'venue': NULL, 'medium': NULL, 'summary': 'I am working on a choir of bells.'}, {'pos': 16, 'title': NULL, 'years': NULL, 'status': 'planned', 'venue': NULL, 'medium': NULL, 'summary': 'My next project is a map.'}]) AS x FROM k)
  SELECT key, x.pos, x.title, x.years, x.status, x.venue, x.medium, x.summary FROM p""")
def d15_projects(t):
    return facts.projects(t("cv_lines"), "2026-01-01").drop("category")


@query("""SELECT profile_id, 'applicant_type' AS field, applicant_type AS value FROM profiles WHERE applicant_type = 'organisation' UNION ALL SELECT profile_id, 'nationality', nationality FROM profiles WHERE nationality NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 4)
  UNION ALL SELECT profile_id, 'birth_date', CAST(birth_date AS VARCHAR) FROM profiles WHERE birth_date > DATE '2000-01-01'""")
def d14_profile_errors(t):
    names = [r.n_name for r in t("nation").where("n_regionkey < 4").select("n_name").collect()]
    return facts.profile_errors(t("profiles").select("profile_id", "applicant_type", "nationality", "birth_date"), {"applicant_type": ["individual", "group"], "nationality": names}, "2000-01-01")


@query("SELECT profile_id, CASE WHEN birth_year <= 1990 THEN 1990 - birth_year END AS years FROM profiles")
def d14_years_of_practice(t):
    return t("profiles").select("profile_id", facts.years_of_practice(F.col("birth_year"), "1990-06-01").alias("years"))


# --- more of the requirement, eligibility and evaluation operators


@query("""WITH s AS (SELECT opportunity_id, idx, text, lower(text) AS low, 0.1 * (idx % 5) AS pa, 0.1 * (idx % 4) AS pr FROM sentences),
  h AS (SELECT *, low LIKE '%years old%' OR low LIKE '%aged%' OR regexp_matches(low, 'under [0-9]') OR low LIKE '%age limit%' AS age, low LIKE '%based in%' AS res, low LIKE '%collectives%' AS typ, low LIKE '%students%' AS stu, low LIKE '%degree%' AS edu,
    regexp_matches(low, '\\b(must|only|eligible|can apply|open to)\\b') AS gen FROM s)
  SELECT opportunity_id, idx, CASE WHEN age AND pa > 0 THEN 'AGE' WHEN age AND typ THEN 'AGE' WHEN age THEN 'AGE' WHEN res THEN 'RESIDENCE' WHEN typ THEN 'APPLICANT_TYPE' WHEN stu THEN 'STUDENT_STATUS' WHEN edu THEN 'EDUCATION'
      WHEN gen OR greatest(pa, pr) >= 0.3 THEN CASE WHEN pa > pr THEN 'AGE' ELSE 'RESIDENCE' END END AS suspected,
    CASE WHEN age OR res OR typ OR stu OR edu THEN 'topic word' WHEN gen THEN 'general word' WHEN greatest(pa, pr) >= 0.3 THEN 'classifier unsure' END AS why FROM h""")
def t05_safety_net(t):
    p = F.create_map(F.lit("AGE"), F.lit(0.1) * (F.col("idx") % 5), F.lit("RESIDENCE"), F.lit(0.1) * (F.col("idx") % 4))
    rows = t("sentences").withColumns({"p": p, "hits": requirements.keyword_hits(F.col("text"))})
    return requirements.safety_net(rows, "hits", "p").select("opportunity_id", "idx", "suspected", "why")


@query("""SELECT DISTINCT text, regexp_matches(lower(text), 'students?') AS enrolled, CASE WHEN lower(text) LIKE '%emerging%' THEN 'emerging' END AS stage, CASE WHEN text LIKE '%rtists%' THEN 'artist' ELSE '' END AS named FROM sentences""")
def t11_t13_t17_values(t):
    once = t("sentences").select("text").distinct()
    enrolled, _ = requirements.student_status(F.col("text"))
    return once.select("text", F.coalesce(enrolled, F.lit(False)).alias("enrolled"), requirements.career_stage(F.col("text")).alias("stage"), F.concat_ws(",", requirements.disciplines_named(F.col("text"), ["artist", "painter"])).alias("named"))


@query("""WITH r AS (SELECT opportunity_id, chunk_index // 2 AS sentence, CASE label WHEN 'AGE' THEN 'NATIONALITY' ELSE label END AS label, polarity, confidence AS p, chunk_index, max_age AS value FROM requirements),
  k AS (SELECT *, label IN ('NATIONALITY', 'RESIDENCE') AND polarity <> 'WAIVES' AS geo FROM r),
  n AS (SELECT *, row_number() OVER (PARTITION BY opportunity_id, sentence, geo ORDER BY p DESC, label) AS rn FROM k)
  SELECT opportunity_id, sentence, count(*) AS n_rows, count(CASE WHEN polarity <> 'WAIVES' THEN value END) AS n_values FROM n WHERE NOT geo OR rn = 1 GROUP BY 1, 2""")
def t20_readings(t):
    rows = t("requirements").withColumns({"sentence": F.floor(F.col("chunk_index") / 2), "label": F.when(F.col("label") == "AGE", "NATIONALITY").otherwise(F.col("label")), "p": F.col("confidence"), "value": F.col("max_age")})
    keyed = rows.withColumn("key", F.struct("opportunity_id", "sentence"))
    return requirements.readings(keyed, "key").groupBy("opportunity_id", "sentence").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_values"))


@query("""WITH r AS (SELECT DISTINCT text, CASE WHEN idx % 2 = 0 THEN 'NATIONALITY' ELSE 'AGE' END AS label FROM sentences WHERE text LIKE 'Artists%'),
  s AS (SELECT opportunity_id, idx, text, CASE WHEN idx % 3 = 0 THEN 'RESIDENCE' ELSE 'NATIONALITY' END AS label FROM sentences)
  SELECT opportunity_id, idx, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.text = s.text AND r.label = 'NATIONALITY') THEN 'confirm' END AS decision FROM s""")
def e01_find_review(t):
    rows = t("sentences").withColumn("label", F.when(F.col("idx") % 3 == 0, "RESIDENCE").otherwise("NATIONALITY"))
    label = F.when(F.col("idx") % 2 == 0, "NATIONALITY").otherwise("AGE").alias("label")
    reviews = t("sentences").where("text like 'Artists%'").select("text", label, F.lit("confirm").alias("decision")).distinct()
    return eligibility.find_review(rows, reviews).select("opportunity_id", "idx", "decision")


@query("""WITH m AS (SELECT p.profile_id, n.n_name AS wanted, p.residence_country AS own, n.n_nationkey % 3 = 0 AS b, CASE WHEN n.n_nationkey % 3 = 0 THEN (SELECT list(x.n_name) FROM nation x WHERE x.n_regionkey = n.n_regionkey) END AS members
    FROM profiles p JOIN nation n ON p.profile_id % 25 = n.n_nationkey)
  SELECT profile_id, CASE WHEN own = wanted OR list_contains(members, own) THEN 'true' WHEN NOT b THEN 'false' ELSE 'unknown' END AS inside FROM m""")
def e04_country_membership(t):
    nation = t("nation")
    region = nation.groupBy(F.col("n_regionkey").alias("r")).agg(F.collect_list("n_name").alias("m"))
    table = nation.join(region, F.col("n_regionkey") == F.col("r")).select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 3 == 0, F.col("m")).alias("m"))
    rows = t("profiles").join(table, F.col("profile_id") % 25 == F.col("n_nationkey"))
    broad = F.when(F.col("m").isNotNull(), F.array(F.lit("region")))
    inside = eligibility.country_membership(F.array("residence_country"), F.array("n_name"), broad, F.col("m"))
    return rows.select("profile_id", F.coalesce(inside.cast("string"), F.lit("unknown")).alias("inside"))


@query("""WITH p AS (SELECT opportunity_id AS key, CASE polarity WHEN 'REQUIRES' THEN true WHEN 'UNCLEAR' THEN NULL ELSE false END AS i FROM requirements)
  SELECT key, CASE WHEN bool_or(coalesce(i, false)) THEN 'true' WHEN NOT bool_or(i IS NULL) THEN 'false' ELSE 'unknown' END AS inside FROM p GROUP BY key""")
def e08_any_of(t):
    inside = F.when(F.col("polarity") == "REQUIRES", True).when(F.col("polarity") != "UNCLEAR", False)
    joined = eligibility.any_of(t("requirements").select(F.col("opportunity_id").alias("key"), inside.alias("i")), "key", "i")
    return joined.select("key", F.coalesce(F.col("inside").cast("string"), F.lit("unknown")).alias("inside"))


@query("SELECT opportunity_id FROM calls WHERE opportunity_id NOT IN (SELECT opportunity_id FROM requirements)")
def e18_e19_coverage(t):
    return eligibility.coverage(t("calls"), t("requirements"))


@query(f"WITH {ITEMS_SQL} SELECT opportunity_id FROM items GROUP BY 1 HAVING bool_and(outcome IN ('INFO', 'NO_RESTRICTION'))")
def e21_no_rules(t):
    return eligibility.no_rules(_items(t)[1])


@query(f"""WITH {GROUPS_SQL} SELECT profile_id, opportunity_id, chunk_index, CASE min(CASE effective WHEN 'FAIL' THEN 0 WHEN 'PASS' THEN 1 ELSE 2 END) WHEN 0 THEN 'FAIL' WHEN 1 THEN 'PASS' ELSE 'CHECK' END AS shown,
  string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM grouped WHERE effective NOT IN ('NO_RESTRICTION', 'INFO') GROUP BY 1, 2, 3""")
def e20_verdict_rows(t):
    return eligibility.verdict_rows(eligibility.or_groups(_items(t)[1]).where("effective not in ('NO_RESTRICTION', 'INFO')"))


SCOPED_SQL = "CASE WHEN {s} = 'WIDENING' THEN 'NO_RESTRICTION' ELSE 'INFO' END"
LADDER_SQL = f"""
  l AS (SELECT *, coalesce(text_scope, rule_scope) AS said, CASE WHEN rule_scope = 'PREFERENCE' AND label = 'CAREER_STAGE' AND any_stage THEN 'WIDENING' ELSE rule_scope END AS wide,
    label IN ('CAREER_STAGE', 'EDUCATION') AND polarity = 'REQUIRES' AS cmp, review_label = 'RESIDENCE' AND NOT either_or AS city, CASE WHEN language_missing THEN 'missing_profile_field' ELSE 'uncertain_match' END AS lk FROM ladder),
  o AS (SELECT *, CASE WHEN is_heading OR label IS NULL THEN NULL
    WHEN label = 'NONE' THEN CASE WHEN suspected IS NULL OR (suspected = 'DISCIPLINE' AND why = 'classifier unsure' AND NOT names_discipline) THEN NULL WHEN said <> 'APPLICANT' THEN {SCOPED_SQL.format(s='said')}
      WHEN suspected = 'OTHER_ELIGIBILITY' AND language_met IS NOT NULL THEN CASE WHEN language_met THEN 'PASS' ELSE 'CHECK/' || lk END WHEN favour THEN 'PASS' ELSE 'CHECK/safety_net' END
    WHEN polarity = 'WAIVES' THEN 'NO_RESTRICTION' WHEN text_scope <> 'APPLICANT' THEN {SCOPED_SQL.format(s='text_scope')} WHEN review_decision IS NULL AND text_scope IS NULL AND wide <> 'APPLICANT' THEN {SCOPED_SQL.format(s='wide')}
    WHEN label = 'DISCIPLINE' THEN CASE discipline WHEN 'PASS' THEN 'PASS' WHEN 'MISSING' THEN 'CHECK/missing_profile_field' ELSE 'CHECK/discipline_mismatch' END
    WHEN label IN ('CAREER_STAGE', 'EDUCATION', 'OTHER_ELIGIBILITY') THEN CASE WHEN label = 'OTHER_ELIGIBILITY' AND language_met IS NOT NULL THEN CASE WHEN language_met THEN 'PASS' ELSE 'CHECK/' || lk END
      WHEN cmp AND check_met THEN 'PASS' WHEN cmp AND check_read THEN CASE WHEN check_missing THEN 'CHECK/missing_profile_field' ELSE 'CHECK/uncertain_match' END ELSE 'CHECK/check_only_class' END
    WHEN review_decision IS NULL THEN CASE WHEN favour THEN 'PASS' ELSE 'CHECK/not_reviewed' END
    WHEN review_scope <> 'APPLICANT' THEN {SCOPED_SQL.format(s='review_scope')} WHEN limited AND applicant_type = 'group' THEN 'NO_RESTRICTION' WHEN review_decision = 'drop' THEN 'CHECK/dropped' WHEN review_polarity = 'UNCLEAR' OR NOT review_value THEN 'CHECK/unreadable'
    WHEN inside IS NULL THEN CASE WHEN missing THEN 'CHECK/missing_profile_field' ELSE 'CHECK/uncertain_match' END
    WHEN NOT inside THEN CASE review_polarity WHEN 'REQUIRES' THEN 'FAIL' ELSE 'PASS' END WHEN narrower IS NULL THEN CASE review_polarity WHEN 'REQUIRES' THEN 'PASS' ELSE 'FAIL' END
    WHEN review_polarity = 'EXCLUDES' OR NOT city THEN 'CHECK/narrower_set' WHEN in_city THEN 'PASS' WHEN NOT in_city THEN 'FAIL' WHEN city_missing THEN 'CHECK/missing_profile_field' ELSE 'CHECK/narrower_set' END AS r FROM l),
  judged AS (SELECT opportunity_id, chunk_index, label, is_heading, polarity, said, language_met, split_part(r, '/', 1) AS outcome, nullif(split_part(r, '/', 2), '') AS check_kind FROM o)"""


def _ladder(t):
    rows = t("ladder").withColumn("applies_to", F.when(F.col("limited"), F.array(F.lit("individual"), F.lit("organisation"))).otherwise(F.array().cast("array<string>")))
    return eligibility.ladder(rows)


@query(f"WITH {LADDER_SQL} SELECT opportunity_id, chunk_index, outcome, check_kind FROM judged")
def e11_e12_e13_ladder(t):
    return _ladder(t).select("opportunity_id", "chunk_index", "outcome", "check_kind")


@query(f"""WITH {LADDER_SQL} SELECT opportunity_id, chunk_index, CASE WHEN language_met THEN 'PASS' ELSE 'CHECK' END AS outcome FROM judged
  WHERE NOT is_heading AND polarity <> 'WAIVES' AND said = 'APPLICANT' AND language_met IS NOT NULL AND coalesce(outcome, '') <> 'INFO'""")
def e14_language_items(t):
    judged = _ladder(t).withColumns({"profile_id": F.lit(1), "scope": F.coalesce("text_scope", "rule_scope")})
    return eligibility.language_items(judged, judged.where("outcome is not null")).select("opportunity_id", "chunk_index", "outcome")


@query("""WITH c AS (SELECT opportunity_id, CASE WHEN opportunity_id % 3 > 0 THEN 'x' END AS txt, opportunity_id % 2 = 0 AS ext FROM calls)
  SELECT opportunity_id, 'CHECK' AS status, CASE WHEN txt IS NULL AND ext THEN 'Rules are in another document' WHEN txt IS NULL THEN 'Rules are not told' ELSE 'Not analysed yet' END AS summary
  FROM c WHERE txt IS NULL OR opportunity_id NOT IN (SELECT opportunity_id FROM requirements WHERE max_age > 40)""")
def e18_without_rules(t):
    calls = t("calls").select("opportunity_id", F.when(F.col("opportunity_id") % 3 > 0, "x").alias("requirements_text"), (F.col("opportunity_id") % 2 == 0).alias("rules_elsewhere"))
    return eligibility.without_rules(calls, t("requirements").where("max_age > 40"))


@query("""WITH p AS (SELECT profile_id, birth_year, profile_id % 12 AS years, CASE profile_id % 4 WHEN 0 THEN 'emerging' WHEN 1 THEN 'mid' WHEN 2 THEN 'established' END AS stage, CASE profile_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS degree,
    CASE WHEN profile_id % 3 = 0 THEN 'Kunsthochschule Kassel' ELSE 'Law School' END AS school FROM profiles)
  SELECT profile_id, CASE profile_id % 3 WHEN 0 THEN true WHEN 1 THEN coalesce(stage IN ('mid', 'established'), false) ELSE years > 3 AND years < 9 END AS career, CASE profile_id % 3 WHEN 1 THEN stage IS NULL ELSE false END AS career_missing,
    coalesce(degree, false) AND (profile_id % 2 = 0 OR profile_id % 3 = 0) AS education, degree IS NULL AS education_missing,
    CASE WHEN profile_id % 2 = 0 THEN profile_id % 6 = 1 ELSE profile_id % 6 IN (1, 3) END AS languages, profile_id % 3 = 0 AS school_in_hesse FROM p""")
def e09_checks(t):
    c, none = F.col("profile_id"), F.array().cast("array<string>")
    stage = F.when(c % 4 == 0, "emerging").when(c % 4 == 1, "mid").when(c % 4 == 2, "established")
    value = F.struct((c % 3 == 0).alias("any_stage"), F.when(c % 3 == 1, F.array(F.lit("mid"), F.lit("established"))).otherwise(none).alias("stages"), F.lit(3).alias("min_years"), F.lit(9).alias("max_years"))
    schools = F.array(F.struct(F.when(c % 3 == 0, "Kunsthochschule Kassel").otherwise("Law School").alias("institution"), F.lit(None).cast("string").alias("city"), F.lit("DE").alias("country")))
    degree = F.when(c % 5 == 1, False).when(c % 5 > 1, True)
    spoken = F.when(c % 6 == 1, F.array(F.lit("de"), F.lit("en"))).when(c % 6 == 3, F.array(F.lit("en")))
    wanted = F.struct(F.array(F.lit("en"), F.lit("de")).alias("languages"), (c % 2 == 0).alias("every"))
    study = F.struct(none.alias("institutions"), F.array(F.lit("Hesse")).alias("study_places"), F.array(F.lit("DE")).alias("study_countries"))
    career, education = eligibility.career_check(value, stage, (c % 12).cast("int")), eligibility.education_check(F.struct((c % 2 > 0).alias("art")), degree, F.lit(None).cast("string"), schools)
    return t("profiles").select("profile_id", career["met"].alias("career"), career["missing"].alias("career_missing"), education["met"].alias("education"), education["missing"].alias("education_missing"),
        eligibility.languages_check(wanted, spoken)["met"].alias("languages"), eligibility.study_check(study, schools, F.array(F.lit("Hesse"), F.lit("Kassel")))["met"].alias("school_in_hesse"))


@query("""WITH b AS (SELECT label, confidence::DOUBLE AS p, label = rated AS y FROM annotations),
  s AS (SELECT label, t AS threshold, count(*) FILTER (WHERE p >= t AND y) AS tp, count(*) FILTER (WHERE p >= t) AS g, count(*) FILTER (WHERE y) AS r FROM b, (SELECT unnest([0.1, 0.3, 0.5, 0.7])::DOUBLE AS t) GROUP BY 1, 2),
  f AS (SELECT *, CASE WHEN g + r = 0 THEN 0.0 ELSE 2 * tp / (g + r) END AS f1 FROM s)
  SELECT label, threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold) AS rn FROM f) WHERE rn = 1""")
def v08_best_thresholds(t):
    rows = t("annotations").select("label", F.col("confidence").cast("double").alias("p"), (F.col("label") == F.col("rated")).alias("y"))
    return evaluate.best_thresholds(rows, "label", "p", "y", [0.1, 0.3, 0.5, 0.7])


@query("""WITH t AS (SELECT doc_id AS doc, 'quality' AS field, CASE WHEN quality = 1 THEN 'good' END AS value FROM labels), f AS (SELECT doc_id AS doc, 'quality' AS field, CASE WHEN lang = 'en' THEN 'good' WHEN lang = 'de' THEN 'bad' END AS value FROM documents)
  SELECT coalesce(t.field, f.field) AS field, CASE WHEN t.value IS NULL AND f.value IS NULL THEN 'ok_null' WHEN t.value IS NULL THEN 'extra' WHEN f.value IS NULL THEN 'missed' WHEN t.value = f.value THEN 'right' ELSE 'wrong' END AS kind, count(*) AS n
  FROM t FULL JOIN f ON t.doc = f.doc AND t.field = f.field GROUP BY 1, 2""")
def v24_field_scores(t):
    truth = t("labels").select(F.col("doc_id").alias("doc"), F.lit("quality").alias("field"), F.when(F.col("quality") == 1, "good").alias("value"))
    found = t("documents").select(F.col("doc_id").alias("doc"), F.lit("quality").alias("field"), F.when(F.col("lang") == "en", "good").when(F.col("lang") == "de", "bad").alias("value"))
    return evaluate.field_scores(truth, found)


@query("""WITH r AS (SELECT persona AS key, item, row_number() OVER (PARTITION BY persona ORDER BY sim DESC, item) AS rank FROM judgments), w AS (SELECT persona AS key, item FROM judgments WHERE grade = 2),
  b AS (SELECT w.key, min(rank) AS r FROM w JOIN r ON w.key = r.key AND w.item = r.item GROUP BY 1)
  SELECT count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3 FROM b""")
def v25_hit_rates(t):
    j = t("judgments").withColumnRenamed("persona", "key")
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sim"), "item"))
    return evaluate.hit_rates(j.withColumn("rank", order), j.where("grade = 2").select("key", "item"))


@query("""WITH m AS (SELECT persona, status, count(*) AS n FROM verdicts WHERE expected = 'NOT_ELIGIBLE' AND status <> 'NOT_ELIGIBLE' GROUP BY 1, 2)
  SELECT persona, arg_max(status, lpad(CAST(n AS VARCHAR), 9, '0') || status) AS cause, count(*) = 1 AS only, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1""")
def v17_missed_causes(t):
    return evaluate.missed_causes(t("verdicts"))


@query("""WITH w AS (SELECT opportunity_id, idx, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM sentences)
  SELECT a.opportunity_id, a.idx AS a, b.idx AS b FROM w a JOIN w b ON a.opportunity_id = b.opportunity_id WHERE len(list_intersect(a.w, b.w)) >= 0.8 * least(len(a.w), len(b.w)) AND len(list_intersect(a.w, b.w)) > 0""")
def v18_aligned_sentences(t):
    return evaluate.aligned_sentences(t("sentences"), t("sentences"))


@query("""WITH u AS (SELECT ('0x' || substr(md5(concat('curve/', grp)), 1, 8))::BIGINT / 4294967296.0 AS u, CASE WHEN label = rated THEN 1.0 ELSE 0.0 END AS ok FROM annotations)
  SELECT share, count(*) AS n, round(avg(ok), 6) AS accuracy FROM u, (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS share) WHERE u < share GROUP BY 1""")
def v09_learning_curve(t):
    return evaluate.learning_curve(t("annotations"), "grp", F.col("label") == F.col("rated"), [0.25, 0.5, 0.75, 1.0])


@query("""WITH r AS (SELECT CASE WHEN idx % 3 = 0 THEN NULL WHEN idx % 3 = 1 THEN 'topic word' ELSE 'general word' END AS why, CASE WHEN opportunity_id % 2 = 0 THEN 'AGE' ELSE 'RESIDENCE' END AS suspected, CASE WHEN opportunity_id % 3 = 0 THEN 'NONE' ELSE 'AGE' END AS truth FROM sentences)
  SELECT why, count(*) FILTER (WHERE suspected = truth) AS caught, count(*) FILTER (WHERE truth = 'NONE') AS false_alarms, count(*) AS raised FROM r WHERE why IS NOT NULL GROUP BY 1""")
def v11_safety_net_report(t):
    i, o = F.col("idx") % 3, F.col("opportunity_id")
    rows = t("sentences").select(F.when(i == 1, "topic word").when(i == 2, "general word").alias("why"), F.when(o % 2 == 0, "AGE").otherwise("RESIDENCE").alias("suspected"), F.when(o % 3 == 0, "NONE").otherwise("AGE").alias("truth"))
    return evaluate.safety_net_report(rows)


# --- stage tables as files: what is read back is what was written


@query("SELECT opportunity_id AS id, source, title, CASE WHEN discipline IS NULL THEN '' ELSE discipline END AS disciplines FROM calls")
def s01_s03_stage_files(t):
    calls = t("calls").select(F.col("opportunity_id").alias("id"), "source", "title", F.array_compact(F.array("discipline")).alias("disciplines"))
    path = new_path(calls.sparkSession, "stage")
    stages.write_stage(calls, path, by_source=True)
    missing = stages.read_stage(calls.sparkSession, f"{path}-missing", calls.schema)
    return stages.read_stage(calls.sparkSession, path, calls.schema).unionByName(missing).withColumn("disciplines", F.concat_ws(",", "disciplines"))


@query("SELECT opportunity_id AS id, CASE WHEN opportunity_id % 3 = 0 THEN concat('a, \"b\"', chr(10), title) ELSE '' END AS title, discipline AS note, concat('x,', coalesce(discipline, '')) AS parts FROM calls")
def s06_s07_flat_table(t):
    title = F.when(F.col("opportunity_id") % 3 == 0, F.concat(F.lit('a, "b"\n'), "title")).otherwise("")
    rows = t("calls").select(F.col("opportunity_id").alias("id"), title.alias("title"), F.col("discipline").alias("note"), F.array(F.lit("x"), F.coalesce("discipline", F.lit(""))).alias("parts"), "price")
    path = new_path(rows.sparkSession, "flat")
    stages.export_csv(rows, path, drop=("price",))
    return stages.import_csv(rows.sparkSession, path, rows.drop("price").schema, keep_empty=("title",)).withColumn("parts", F.array_join("parts", ","))


@query("""WITH r AS (SELECT text, idx, opportunity_id, row_number() OVER (PARTITION BY text ORDER BY opportunity_id DESC, idx DESC) AS r FROM sentences)
  SELECT text, 'AGE' AS label, CAST(idx + 17 AS INTEGER) AS min_age, CASE WHEN idx % 2 = 0 THEN 'PROJECT' ELSE 'APPLICANT' END AS scope FROM r WHERE r = 1""")
def s08_typed_reviews(t):
    rows = t("sentences").select("text", F.lit("AGE").alias("label"), F.lit("fix").alias("decision"), F.lit("REQUIRES").alias("polarity"), F.to_json(F.struct((F.col("idx") + 17).alias("min_age"))).alias("value"), F.when(F.col("idx") % 2 == 0, "PROJECT").alias("scope"), (F.col("opportunity_id") * 100 + F.col("idx")).alias("at"))
    return stages.typed_reviews(rows, "at").select("text", "label", "value.min_age", "scope")


@query("SELECT opportunity_id, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) AS places FROM requirements GROUP BY 1")
def s09_call_order(t):
    # rows are kept in order without another sort
    placed = stages.in_call_order(t("requirements")).withColumn("at", F.monotonically_increasing_id())
    lists = materialise(placed.select("opportunity_id", "chunk_index", "at"), "placed").groupBy("opportunity_id").agg(F.array_sort(F.collect_list(F.struct("at", "chunk_index"))).alias("l"))
    return lists.select("opportunity_id", F.array_join(F.transform("l", lambda x: x["chunk_index"].cast("string")), ",").alias("places"))


@query("SELECT vec_id AS id, substr(sha256(CAST(vec_id AS VARCHAR)), 1, 16) AS text_hash, len(embedding) AS width FROM embeddings")
def s10_vector_index(t):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), matching.text_hash(F.col("vec_id").cast("string")).alias("text_hash"), F.col("embedding").alias("vector"))
    path = new_path(rows.sparkSession, "index")
    stages.save_index(rows, path, "m1")
    return stages.load_index(rows.sparkSession, path, "m1").select("id", "text_hash", F.size("vector").cast("bigint").alias("width"))


# --- the rest of ingest, normalisation, matching, documents and annotation


@query("""WITH c AS (SELECT conv_id AS key, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS m FROM conversations GROUP BY 1)
  SELECT doc_id AS key, d.lang || CASE WHEN m IS NULL THEN '' ELSE chr(10) || m END AS text FROM documents d LEFT JOIN c ON d.doc_id = c.key""")
def c12_whole_texts(t):
    pages = t("documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("text"))
    attached = t("conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("rank"), F.col("role").alias("title"), "text")
    return ingest.attach_texts(pages, attached)


@query("""WITH p AS (SELECT id, text, CASE WHEN id % 5 = 1 THEN CAST(try_strptime(regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '%Y-%m-%d') AS DATE) END AS d, list_max(regexp_extract_all(text, '20[0-9]{2}')) AS y FROM deadlines)
  SELECT id, CASE WHEN text IS NULL OR y IS NULL THEN false WHEN CAST(y AS INTEGER) < 2020 THEN true ELSE coalesce(d <= DATE '2020-06-01', false) END AS passed FROM p""")
def c15_deadline_passed(t):
    rows = t("deadlines").withColumn("d", F.when(F.col("id") % 5 == 1, normalise.parse_deadline(F.col("text"), "2020-06-01")))
    return rows.select("id", ingest.deadline_passed(F.col("text"), F.lit("Call 2001 to 2002"), F.col("d"), "2020-06-01").alias("passed"))


SECOND_SQL = """
  o AS (SELECT doc_id AS id, text, CASE WHEN lang = 'de' THEN 'rejected' ELSE 'accepted' END AS status FROM documents),
  n AS (SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN concat(text, 'x') ELSE text END AS text, CASE WHEN doc_id % 4 = 0 THEN 'rejected' ELSE 'accepted' END AS status,
    CASE WHEN doc_id % 4 = 0 THEN CASE doc_id % 5 WHEN 0 THEN 'deadline passed (2020)' WHEN 1 THEN 'fetch/extract error: 404' WHEN 2 THEN 'not open to individuals' ELSE 'a list of calls' END END AS reason FROM documents)"""


def _second(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), "lang", "text")
    old = docs.select("id", F.when(F.col("lang") == "de", "rejected").otherwise("accepted").alias("status"), F.col("text").alias("requirements_text"))
    no = F.col("id") % 4 == 0
    why = F.when(F.col("id") % 5 == 0, "deadline passed (2020)").when(F.col("id") % 5 == 1, "fetch/extract error: 404").when(F.col("id") % 5 == 2, "not open to individuals").otherwise("a list of calls")
    new = docs.select("id", F.when(no, "rejected").otherwise("accepted").alias("status"), F.when(F.col("lang") == "fr", F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("requirements_text"), F.when(no, why).alias("reason"))
    return old, new


@query(f"""WITH {SECOND_SQL} SELECT CASE WHEN n.reason LIKE 'fetch%' THEN 'error' WHEN o.status = 'accepted' AND n.status = 'accepted' THEN CASE WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END ELSE concat(o.status, ' to ', n.status) END AS outcome,
  count(*) AS n, round(avg(length(o.text)), 4) AS mean_before, round(avg(length(n.text)), 4) AS mean_after FROM o JOIN n ON o.id = n.id GROUP BY 1""")
def c17_extraction_diff(t):
    return ingest.extraction_diff(*_second(t))


@query(f"WITH {SECOND_SQL} SELECT CASE WHEN reason LIKE 'fetch%' THEN 'fetch/extract error' WHEN reason LIKE 'deadline%' THEN 'deadline passed' WHEN reason LIKE 'not open%' THEN 'not open to individuals' ELSE 'other' END AS kind, count(*) AS n FROM n WHERE status = 'rejected' GROUP BY 1")
def c17_rejection_kinds(t):
    return ingest.rejection_kinds(_second(t)[1])


@query("""SELECT 'discipline' AS field, round(avg(CASE WHEN discipline IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share FROM calls UNION ALL SELECT 'has_fee', round(avg(CASE WHEN has_fee IS NULL THEN 0.0 ELSE 1.0 END), 6) FROM calls
  UNION ALL SELECT 'title', round(avg(CASE WHEN trim(title) = '' THEN 0.0 ELSE 1.0 END), 6) FROM calls""")
def c17_filled_shares(t):
    return ingest.filled_shares(t("calls"), ["discipline", "has_fee", "title"])


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'materials' ELSE 'title' END AS field, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'deadline', count(*) FROM documents")
def c17_flags_per_field(t):
    flags = F.array(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("materials["), F.col("doc_id").cast("string"), F.lit("]"))).otherwise("title"), F.lit("deadline"))
    return ingest.flags_per_field(t("documents").withColumn("flags", flags), "flags")


@query("SELECT doc_id, CASE WHEN length(text) < 300 THEN 'short' ELSE 'mojibake' END AS why FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, 'fÃ¼r') ELSE text END AS text FROM documents) WHERE length(text) < 300 OR doc_id % 3 = 0")
def c19_badly_read(t):
    docs = t("documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("f\u00c3\u00bcr"))).otherwise(F.col("text")))
    return ingest.badly_read(docs, "text").select("doc_id", "why")


APPLIED_SQL = """
  p AS (SELECT opportunity_id AS id, CASE WHEN opportunity_id % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS status, title AS body, deadline_date FROM calls),
  x AS (SELECT id, status, body, CASE WHEN id % 5 = 4 THEN NULL WHEN id % 5 = 3 THEN 'error' WHEN id % 5 IN (0, 1) THEN 'accepted' ELSE 'rejected' END AS s, CASE WHEN id % 10 = 0 THEN body ELSE concat(body, '!') END AS nb, deadline_date < DATE '1995-01-01' AS over FROM p),
  m AS (SELECT *, CASE WHEN s = 'accepted' THEN 'accepted' WHEN s = 'rejected' THEN 'rejected' WHEN status = 'accepted' AND coalesce(over, false) THEN 'expired' WHEN status = 'accepted' THEN 'kept' ELSE 'unread' END AS outcome FROM x)"""


def _applied(t):
    c = F.col
    pages = t("calls").select(c("opportunity_id").alias("id"), F.when(c("opportunity_id") % 2 == 0, "accepted").otherwise("rejected").alias("status"), c("title").alias("body"), "deadline_date")
    results = pages.where("id % 5 <> 4").select("id", F.when(c("id") % 5 <= 1, "accepted").otherwise("rejected").alias("status"), F.when(c("id") % 10 == 0, c("body")).otherwise(F.concat("body", F.lit("!"))).alias("body"),
        F.when(c("id") % 5 == 3, "fetch/extract error: 500").when(c("id") % 5 == 2, "a list").alias("reason"))
    raw, rejected = pages.where("status = 'accepted'"), pages.where("status = 'rejected'").select("id", F.lit("old").alias("reason"))
    return ingest.applied(raw, rejected, raw.select("id"), pages, results, c("deadline_date") < F.lit("1995-01-01").cast("date"))


@query(f"WITH {APPLIED_SQL} SELECT id, CASE WHEN outcome = 'accepted' THEN nb ELSE body END AS body FROM m WHERE outcome IN ('accepted', 'kept')")
def c18_accepted_after(t):
    return _applied(t)[0]


@query(f"WITH {APPLIED_SQL} SELECT id, CASE outcome WHEN 'expired' THEN 'deadline passed' WHEN 'rejected' THEN 'a list' ELSE 'old' END AS reason FROM m WHERE outcome IN ('expired', 'rejected', 'unread')")
def c18_rejected_after(t):
    return _applied(t)[1]


@query(f"WITH {APPLIED_SQL} SELECT id FROM m WHERE status = 'accepted' AND NOT (outcome IN ('rejected', 'expired') OR (outcome = 'accepted' AND nb <> body))")
def c18_processed_after(t):
    return _applied(t)[2]


@query("""SELECT opportunity_id, CASE WHEN has_fee IS NULL THEN 'Not stated' WHEN NOT has_fee THEN 'None' WHEN opportunity_id % 3 = 0 THEN 'Yes, amount not stated' ELSE concat('EUR ', CAST(opportunity_id % 900 AS VARCHAR)) END AS fee,
  CASE opportunity_id % 3 WHEN 0 THEN 'International' WHEN 1 THEN 'BE,DE' ELSE '' END AS countries, CASE WHEN opportunity_id % 2 = 0 THEN 'music' ELSE '' END AS disciplines FROM calls""")
def n18_card_labels(t):
    c, any_ = F.col("opportunity_id"), F.lit("any")
    places = F.when(c % 3 == 0, F.array(any_)).when(c % 3 == 1, F.array(F.lit("BE"), any_, F.lit("DE"))).otherwise(F.array().cast("array<string>"))
    fee = normalise.fee_label(F.col("has_fee"), F.when(c % 3 > 0, c % 900), F.lit("EUR"))
    return t("calls").select("opportunity_id", fee.alias("fee"), F.concat_ws(",", normalise.shown_countries(places, "any")).alias("countries"), F.concat_ws(",", normalise.shown_disciplines(F.array(F.when(c % 2 == 0, "music").otherwise("other"), F.lit("other")), "other")).alias("disciplines"))


@query("""WITH f AS (SELECT opportunity_id, lower(category) AS c, CASE WHEN pos % 2 = 0 THEN amount END AS amount, currency, period FROM funding), g AS (SELECT opportunity_id, currency, period, min(amount) AS lo, max(amount) AS hi FROM f WHERE amount IS NOT NULL GROUP BY ALL),
  m AS (SELECT opportunity_id, concat(CASE WHEN lo < hi THEN 'up to ' ELSE '' END, currency, ' ', format('{:,}', CAST(round_even(hi, 0) AS BIGINT)), ' ', period) AS s FROM g),
  l AS (SELECT opportunity_id, string_agg(s, ' + ' ORDER BY s) AS a FROM m GROUP BY 1), k AS (SELECT opportunity_id, string_agg(c, ' + ' ORDER BY c = 'f', c) AS b FROM (SELECT DISTINCT opportunity_id, c FROM f WHERE amount IS NULL) GROUP BY 1),
  j AS (SELECT opportunity_id, concat_ws(' + ', a, b) AS x FROM (SELECT DISTINCT opportunity_id FROM f) LEFT JOIN l USING (opportunity_id) LEFT JOIN k USING (opportunity_id))
  SELECT opportunity_id, concat(upper(substr(x, 1, 1)), substr(x, 2)) AS label FROM j""")
def n16_n18_card_funding(t):
    rows = t("funding").select("opportunity_id", "category", F.when(F.col("pos") % 2 == 0, F.col("amount")).alias("amount"), "currency", "period", F.lit("as told").alias("funding"))
    return normalise.card_funding(rows, light=["f"])


@query("""WITH s AS (SELECT source, min(lang) AS tag FROM documents GROUP BY 1)
  SELECT d.doc_id, CASE WHEN s.tag <> 'en' THEN s.tag WHEN d.n_chars >= 1000 THEN d.lang ELSE 'en' END AS row_language FROM documents d LEFT JOIN s ON d.source = s.source""")
def n01_row_language(t):
    docs = t("documents")
    tags = docs.groupBy("source").agg(F.min("lang").alias("lang"))
    return normalise.trusted_language(docs, tags, "lang", "n_chars", 1000).select("doc_id", "row_language")


GRAMS_SQL = """t AS (SELECT doc_id, lang, source, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents),
  g AS (SELECT doc_id, lang, unnest(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substr(t, i, 3))) AS gram FROM t)"""


@query(f"""WITH {GRAMS_SQL}, c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 100),
  p AS (SELECT lang, gram, ln(n / sum(n) OVER (PARTITION BY lang)) AS logp FROM k), f AS (SELECT lang, min(logp) AS least FROM p GROUP BY 1),
  e AS (SELECT a.gram, f.lang, coalesce(p.logp, f.least) AS logp FROM (SELECT DISTINCT gram FROM p) a CROSS JOIN f LEFT JOIN p ON p.lang = f.lang AND p.gram = a.gram),
  d AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2), s AS (SELECT doc_id, e.lang, sum(n * logp) AS s FROM d JOIN e ON d.gram = e.gram GROUP BY 1, 2),
  x AS (SELECT doc_id, lang, exp(s - max(s) OVER (PARTITION BY doc_id)) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS r FROM s), y AS (SELECT *, x / sum(x) OVER (PARTITION BY doc_id) AS c FROM x), tag AS (SELECT source, min(lang) AS tag FROM documents GROUP BY 1)
  SELECT t.doc_id, CASE WHEN tag.tag <> 'en' THEN tag.tag WHEN y.c >= 0.9 THEN y.lang ELSE 'en' END AS row_language FROM t LEFT JOIN y ON y.doc_id = t.doc_id AND y.r = 1 LEFT JOIN tag ON tag.source = t.source""")
def n01_detected_language(t):
    docs = t("documents")
    found = normalise.language_scores(docs, "doc_id", "text", materialise(normalise.language_profiles(docs, "lang", "text", 100), "profiles"))
    tags = docs.groupBy("source").agg(F.min("lang").alias("lang"))
    rows = docs.select("doc_id", "source").join(found.withColumnRenamed("key", "doc_id"), "doc_id", "left")
    return normalise.trusted_language(rows, tags, "detected", "confidence", 0.9).select("doc_id", "row_language")


@query("""WITH t AS (SELECT lang, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents),
  g AS (SELECT lang, unnest(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substr(t, i, 3))) AS gram FROM t), c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM c), k AS (SELECT * FROM r WHERE r <= 100)
  SELECT lang, gram, round(ln(n / sum(n) OVER (PARTITION BY lang)), 6) AS logp FROM k""")
def n01_language_profiles(t):
    return normalise.language_profiles(t("documents"), "lang", "text", 100).select("lang", "gram", F.round("logp", 6).alias("logp"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'REVIEWED' WHEN c_nationkey % 2 = 0 THEN n_name ELSE c_mktsegment END AS place_country,
  CASE WHEN c_custkey % 10 = 0 THEN true WHEN c_nationkey % 2 = 0 THEN n_name <> c_mktsegment ELSE false END AS changed FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def n08_correct_places(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("city"), F.col("c_mktsegment").alias("country"))
    cities = t("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("city"), F.col("n_name").alias("country"))
    reviewed = rows.where("id % 10 = 0").select("id", F.lit("REVIEWED").alias("country"))
    return normalise.correct_places(rows, "city", "country", cities, reviewed).select("id", "place_country", "changed")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'tion') THEN 'painting' END, CASE WHEN lang = 'de' OR contains(lower(text), 'eau') THEN 'sculpture' END) AS disciplines FROM documents""")
def n09_quoted_disciplines(t):
    found = normalise.quoted_disciplines(F.array(F.lit("sculpture"), F.lit("painting"), F.lit("odd")), F.array(F.lit("EAU"), F.lit("tion"), F.lit("a")), F.col("text"), F.when(F.col("lang") == "de", F.array(F.lit("sculpture"))), ["painting", "sculpture"])
    return t("documents").select("doc_id", F.concat_ws(",", found).alias("disciplines"))


@query("""SELECT p.profile_id, o.o_orderkey AS opportunity_id, coalesce(c.discipline <> 'all' AND c.discipline <> CASE WHEN p.discipline = 'BUILDING' THEN 'painting' ELSE 'sculpture' END, false) AS mismatch
  FROM orders o JOIN profiles p ON o.o_custkey = p.profile_id JOIN calls c ON c.opportunity_id = o.o_orderkey""")
def m08_discipline_mismatch(t):
    pairs = t("orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("opportunity_id"))
    mine = F.when(F.col("p") == "BUILDING", "painting").otherwise("sculpture")
    rows = pairs.join(t("profiles").select("profile_id", F.col("discipline").alias("p")), "profile_id").join(t("calls").select("opportunity_id", "discipline"), "opportunity_id")
    theirs = F.when(F.col("discipline").isNotNull(), F.array("discipline"))
    return rows.select("profile_id", "opportunity_id", matching.discipline_mismatch(F.array(mine), theirs).alias("mismatch"))


@query("SELECT persona, item, pos FROM (SELECT persona, item, row_number() OVER (PARTITION BY persona ORDER BY sim DESC, item) AS pos FROM judgments) WHERE pos <= 4")
def m18_suggested(t):
    return matching.suggested(t("judgments"), ["persona"], F.desc("sim"), "item").select("persona", "item", "pos")


@query("""WITH i AS (SELECT opportunity_id, count(*) AS n_items, count(*) FILTER (WHERE period = 'month') AS n_done FROM funding GROUP BY 1)
  SELECT CASE WHEN n_items IS NOT NULL AND n_done = n_items THEN 'completed' WHEN deadline_date < DATE '1995-01-01' THEN 'closed' WHEN n_items IS NOT NULL THEN 'draft' ELSE 'saved' END AS stage, count(*) AS n
  FROM calls LEFT JOIN i ON calls.opportunity_id = i.opportunity_id GROUP BY 1""")
def m19_saved_stage(t):
    items = t("funding").groupBy("opportunity_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("period") == "month").alias("n_done"))
    return matching.saved_stage(t("calls").join(items, "opportunity_id", "left"), "1995-01-01").groupBy("stage").agg(F.count("*").alias("n"))


PASSAGE_SQL = """
  q AS (SELECT label, vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
  s AS (SELECT q.label AS artist_id, q.qid AS question_id, e.vec_id AS chunk_index, round(list_dot_product(q.qv::DOUBLE[], e.embedding::DOUBLE[]), 9) AS s FROM q JOIN embeddings e ON q.label = e.label),
  ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artist_id, question_id ORDER BY s DESC, chunk_index) AS rank FROM s) WHERE rank <= 3)"""


def _passages(t):
    e = t("embeddings").select(F.col("label").alias("artist_id"), F.col("vec_id").alias("chunk_index"), F.col("embedding").cast("array<double>").alias("v"))
    first = e.groupBy("artist_id").agg(F.min("chunk_index").alias("chunk_index"))
    return matching.passages(e, e.join(first, ["artist_id", "chunk_index"]).withColumnRenamed("chunk_index", "question_id"))


@query(f"WITH {PASSAGE_SQL} SELECT artist_id, question_id, chunk_index, rank FROM ranked")
def d03_passages(t):
    return _passages(t).select("artist_id", "question_id", "chunk_index", "rank")


@query(f"WITH {PASSAGE_SQL} SELECT artist_id, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) AS passages FROM (SELECT DISTINCT artist_id, chunk_index FROM ranked) GROUP BY 1")
def d04_gathered(t):
    return matching.gathered(_passages(t))


@query("""WITH i AS (SELECT opportunity_id AS key, 'q ' || lower(category) AS q, 'm ' || period AS m, pos FROM funding)
  SELECT key, 'material' AS kind, m AS item FROM (SELECT DISTINCT key, m FROM i) UNION ALL SELECT key, 'question', q FROM (SELECT DISTINCT key, q FROM i)""")
def d17_checklist(t):
    lists = t("funding").groupBy(F.col("opportunity_id").alias("key")).agg(F.collect_list(F.concat(F.lit("Q: "), "category")).alias("q"), F.collect_list(F.concat(F.lit("M - "), "period")).alias("m"))
    return documents.checklist(lists, "key", "q", "m").drop("item_id")


@query("""WITH t AS (SELECT opportunity_id, idx, CASE idx % 3 WHEN 0 THEN 'Max. 1,500 characters' WHEN 1 THEN 'no more than 300 words' END AS s FROM sentences)
  SELECT opportunity_id, idx, CASE idx % 3 WHEN 0 THEN 1500 WHEN 1 THEN 300 END AS n, CASE idx % 3 WHEN 0 THEN 'characters' WHEN 1 THEN 'words' END AS unit FROM t""")
def d18_text_limit(t):
    n, unit = documents.text_limit(F.when(F.col("idx") % 3 == 0, "Max. 1,500 characters").when(F.col("idx") % 3 == 1, "no more than 300 words"))
    return t("sentences").select("opportunity_id", "idx", n.alias("n"), unit.alias("unit"))


# a walk in seeded order: a call that would go beyond its source's cap is passed over and does not count; what is short is filled up from these
WALK_SQL = """
  c AS (SELECT opportunity_id, CASE WHEN opportunity_id % 3 = 0 THEN 0 ELSE opportunity_id % 7 END AS source, count(*) AS n FROM requirements GROUP BY 1, 2),
  o AS (SELECT *, md5(concat('1/', CAST(opportunity_id AS VARCHAR))) AS o FROM c),
  w AS (SELECT source, list_reduce(list({{'id': opportunity_id, 'n': n}} ORDER BY o, opportunity_id), lambda acc, x: CASE WHEN acc.n + x.n > {cap} THEN acc ELSE {{'n': acc.n + x.n, 'ids': list_append(acc.ids, x.id)}} END, {{'n': 0::BIGINT, 'ids': []::BIGINT[]}}) AS r FROM o GROUP BY 1),
  t AS (SELECT unnest(r.ids) AS opportunity_id FROM w),
  s AS (SELECT o.*, sum(n) OVER (ORDER BY o, opportunity_id) AS run FROM o JOIN t USING (opportunity_id)),
  d AS (SELECT o.*, sum(n) OVER (ORDER BY o, opportunity_id) + (SELECT max(run) FROM s) AS run FROM o WHERE opportunity_id NOT IN (SELECT opportunity_id FROM t))"""


def _sized_calls(t):
    source = F.when(F.col("opportunity_id") % 3 == 0, 0).otherwise(F.col("opportunity_id") % 7)
    return t("requirements").groupBy("opportunity_id", source.alias("source")).agg(F.count("*").alias("n_chunks"))


@query(f"WITH {WALK_SQL.format(cap=125)} SELECT opportunity_id, false AS relaxed FROM s WHERE run - n < 500")
def a01_capped_calls(t):
    return annotate.capped_calls(_sized_calls(t), 500, 0.25).select("opportunity_id", "relaxed")


@query(f"WITH {WALK_SQL.format(cap=20)} SELECT opportunity_id, false AS relaxed FROM s WHERE run - n < 400 UNION ALL SELECT opportunity_id, true FROM d WHERE run - n < 400")
def a01_relaxed_cap(t):
    return annotate.capped_calls(_sized_calls(t), 400, 0.05).select("opportunity_id", "relaxed")


@query("""WITH s AS (SELECT text, opportunity_id, idx FROM sentences WHERE idx % 5 = 0) SELECT text, opportunity_id, idx, CAST((row_number() OVER (ORDER BY text, opportunity_id, idx) - 1) // 60 + 1 AS BIGINT) AS batch FROM s""")
def a06_batches(t):
    return annotate.batches(t("sentences").where("idx % 5 = 0"), ["text", "opportunity_id", "idx"])


QUEUE_SQL = """
  l AS (SELECT opportunity_id, idx, text, CASE idx % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'EDUCATION' WHEN 2 THEN 'AGE' ELSE 'CAREER_STAGE' END AS label, CASE WHEN opportunity_id % 3 = 0 THEN 'AGE' END AS suspected, CASE WHEN opportunity_id % 7 = 0 THEN 'WAIVES' ELSE 'REQUIRES' END AS polarity,
    lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text FROM sentences WINDOW w AS (PARTITION BY opportunity_id ORDER BY idx)),
  k AS (SELECT *, CASE label WHEN 'NONE' THEN suspected ELSE label END AS shown FROM l WHERE polarity <> 'WAIVES' AND text NOT LIKE 'Preferably%' AND text NOT LIKE '%based in%')"""


def _queue_rows(t):
    c = F.col
    label = F.when(c("idx") % 4 == 0, "NONE").when(c("idx") % 4 == 1, "EDUCATION").when(c("idx") % 4 == 2, "AGE").otherwise("CAREER_STAGE")
    return t("sentences").select("opportunity_id", c("idx").alias("chunk_index"), "text", F.lit(False).alias("is_heading"), F.lit(None).cast("string").alias("heading"), label.alias("label"),
        F.when(c("opportunity_id") % 3 == 0, "AGE").alias("suspected"), F.when(c("opportunity_id") % 7 == 0, "WAIVES").otherwise("REQUIRES").alias("polarity"))


@query(f"""WITH {QUEUE_SQL}, g AS (SELECT *, count(*) OVER (PARTITION BY text) AS occurrences, row_number() OVER (PARTITION BY text ORDER BY opportunity_id, idx) AS r FROM k WHERE shown IN ('EDUCATION', 'CAREER_STAGE') OR (label = 'NONE' AND shown IS NOT NULL))
  SELECT text, shown AS label, occurrences, opportunity_id AS example_call, previous_text, next_text FROM g WHERE r = 1""")
def a05_scope_queue(t):
    reviewed = t("sentences").where("text like '%based in%'")
    scope = requirements.scope(F.col("text"))
    return annotate.scope_queue(_queue_rows(t), reviewed, reviewed.where("false"), scope, ["EDUCATION", "CAREER_STAGE"]).drop("heading")


@query("""WITH r AS (SELECT DISTINCT text, 'AGE' AS label, 'fix' AS decision, 'APPLICANT' AS scope FROM sentences WHERE text LIKE '%under%'), a AS (SELECT DISTINCT text, CASE WHEN text LIKE '%under%' THEN 'OTHER' ELSE 'AGE' END AS label, CASE WHEN text LIKE '%based%' THEN 'scope' ELSE 'fix' END AS decision, 'APPLICANT' AS scope FROM sentences)
  SELECT * FROM r UNION ALL SELECT * FROM a WHERE decision = 'fix'""")
def a08_merged_reviews(t):
    texts = t("sentences").select("text").distinct()
    reviews = texts.where("text like '%under%'").select("text", F.lit("AGE").alias("label"), F.lit("fix").alias("decision"), F.lit("APPLICANT").alias("scope"))
    answers = texts.select("text", F.when(F.col("text").like("%under%"), "OTHER").otherwise("AGE").alias("label"), F.when(F.col("text").like("%based%"), "scope").otherwise("fix").alias("decision"), F.lit("APPLICANT").alias("scope"))
    return annotate.merged_reviews(reviews, answers, answers)[0]


@query("""SELECT opportunity_id, chunk_index, CASE WHEN label NOT IN ('AGE', 'RESIDENCE') THEN 'scope' WHEN applicant_type NOT IN ('individual', 'group') THEN 'decision' WHEN polarity NOT IN ('REQUIRES', 'EXCLUDES', 'WAIVES') THEN 'polarity' END AS error
  FROM requirements WHERE label NOT IN ('AGE', 'RESIDENCE') OR applicant_type NOT IN ('individual', 'group') OR polarity NOT IN ('REQUIRES', 'EXCLUDES', 'WAIVES')""")
def a07_invalid_rows(t):
    rows = t("requirements").select("opportunity_id", "chunk_index", F.col("label").alias("scope"), F.col("applicant_type").alias("decision"), "polarity")
    return annotate.invalid_rows(rows, ["AGE", "RESIDENCE"], ["individual", "group"], ["REQUIRES", "EXCLUDES", "WAIVES"]).select("opportunity_id", "chunk_index", "error")


@query("""SELECT chunk_id, CASE WHEN confidence > 0.5 AND chunk_id % 2 > 0 THEN 'q0t0' ELSE label END AS label, CASE WHEN chunk_id % 2 = 0 THEN 'old [r3]' WHEN confidence > 0.5 THEN '[r3]' END AS notes FROM annotations""")
def a11_relabel(t):
    a = t("annotations").withColumn("notes", F.when(F.col("chunk_id") % 2 == 0, "old [r3]"))
    return annotate.relabel(a, a.where("confidence > 0.5").select("chunk_id", F.lit("q0t0").alias("new_label")), "[r3]").select("chunk_id", "label", "notes")


@query("""SELECT profile_id, CASE WHEN birth_year IS NULL OR d = within OR d < 0 THEN 'unknown' WHEN d < within THEN 'true' ELSE 'false' END AS inside
  FROM (SELECT profile_id, birth_year, 1990 - birth_year AS d, 10 + profile_id % 20 AS within FROM profiles)""")
def e07_graduate_membership(t):
    inside = eligibility.graduate_membership(F.col("birth_year"), 10 + F.col("profile_id") % 20, F.array(F.lit("1990-05-01").cast("date"), F.lit("1990-09-01").cast("date")))
    return t("profiles").select("profile_id", F.coalesce(inside.cast("string"), F.lit("unknown")).alias("inside"))


@query("""SELECT profile_id, coalesce(CAST(CASE WHEN birth_year IS NOT NULL THEN residence_country IN ('FRANCE', 'GERMANY') END AS VARCHAR), 'unknown') AS city,
  CASE WHEN discipline = 'BUILDING' THEN 'PASS' WHEN discipline <> 'MACHINERY' THEN 'PASS' ELSE 'CHECK' END AS discipline FROM profiles""")
def e05_e10_city_and_discipline(t):
    city = eligibility.city_membership(F.when(F.col("birth_year").isNotNull(), F.col("residence_country")), F.lit("in France / Germany"))
    named = eligibility.discipline_outcome(F.array("discipline"), F.array(F.lit("BUILDING")), F.array(F.lit("MACHINERY")))
    return t("profiles").select("profile_id", F.coalesce(city.cast("string"), F.lit("unknown")).alias("city"), named.alias("discipline"))


@query("""SELECT round(count(*) FILTER (WHERE expected = 'NOT_ELIGIBLE' AND status = 'NOT_ELIGIBLE') / count(*) FILTER (WHERE status = 'NOT_ELIGIBLE'), 6) AS prec,
  round(count(*) FILTER (WHERE expected = 'NOT_ELIGIBLE' AND status = 'NOT_ELIGIBLE') / count(*) FILTER (WHERE expected = 'NOT_ELIGIBLE'), 6) AS rec,
  round(count(*) FILTER (WHERE status = 'CHECK') / count(*), 6) AS unclear_share, count(*) FILTER (WHERE expected = 'NOT_ELIGIBLE' AND status = 'ELIGIBLE') AS dangerous FROM verdicts""")
def v12_v14_share_report(t):
    return evaluate.share_report(t("verdicts"), "expected", "status", "NOT_ELIGIBLE", "CHECK")


@query("""WITH r AS (SELECT persona, grade, row_number() OVER (PARTITION BY persona ORDER BY sim DESC, item) AS a, row_number() OVER (PARTITION BY persona ORDER BY sim, item) AS b FROM judgments),
  p AS (SELECT 'near' AS variant, persona, count(*) FILTER (WHERE a <= 10 AND grade >= 1) / 10 AS p FROM r GROUP BY 2 UNION ALL SELECT 'far', persona, count(*) FILTER (WHERE b <= 10 AND grade >= 1) / 10 FROM r GROUP BY 2)
  SELECT variant, round(avg(p), 6) AS mean_p, count(*) AS n_personas FROM p GROUP BY 1""")
def v21_ranking_variants(t):
    return evaluate.ranking_variants(t("judgments"), {"near": F.desc("sim"), "far": F.asc("sim")})


@query("""WITH s AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY opportunity_id ORDER BY chunk_index) = label THEN 1 ELSE 2 END AS s FROM requirements)
  SELECT opportunity_id, chunk_index AS pos, CAST(sum(s) OVER (PARTITION BY opportunity_id ORDER BY chunk_index) AS BIGINT) AS chunk_index FROM s""")
def v19_spaced_indexes(t):
    rows = t("requirements").select("opportunity_id", F.col("chunk_index").alias("pos"), "label")
    return evaluate.spaced_indexes(rows, "opportunity_id", "pos", "label").select("opportunity_id", "pos", F.col("chunk_index").cast("bigint").alias("chunk_index"))


@query("SELECT DISTINCT discipline AS value FROM calls WHERE discipline IS NOT NULL AND discipline <> 'all'")
def m17_options(t):
    return matching.options(t("calls"), "discipline")


@query("""SELECT persona, item, pos FROM (SELECT persona, item, row_number() OVER (PARTITION BY persona ORDER BY sim DESC, item) AS pos FROM judgments) WHERE pos > 5 AND pos <= 10""")
def m17_page(t):
    order = F.row_number().over(Window.partitionBy("persona").orderBy(F.desc("sim"), "item"))
    return matching.page_of(t("judgments").withColumn("pos", order), "persona", 5, 5).select("persona", "item", "pos")


# a page number ends a description
@query("""SELECT key, CAST(p.pos AS BIGINT) AS pos, p.line AS title, regexp_extract(d.line, '([0-9]{4}(?: - [0-9]{4})?)', 1) AS years, CASE WHEN contains(d.line, 'video') THEN 'video and sound' WHEN starts_with(d.line, 'Oil') THEN 'Oil on paper' END AS medium,
    b.line || CASE WHEN c.line = '17' THEN '' ELSE ' ' || c.line || ' ' || e.line END AS summary
  FROM portfolio_lines p JOIN portfolio_lines d USING (key) JOIN portfolio_lines b USING (key) JOIN portfolio_lines c USING (key) JOIN portfolio_lines e USING (key)
  WHERE p.pos % 8 = 0 AND d.pos = p.pos + 2 AND b.pos = p.pos + 3 AND c.pos = p.pos + 4 AND e.pos = p.pos + 5""")
def d15_work_pages(t):
    return facts.work_pages(t("portfolio_lines"), "2020-01-01").select("key", "pos", "title", "years", "medium", "summary")


# the other modules register their own queries
from callweave.plans import discover_queries, learning_queries, verdict_queries  # noqa: E402, F401

__all__ = ["ORACLE", "QUERIES"]
