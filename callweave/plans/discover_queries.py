"""The search "matched to you" over verdicts, vectors and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import discover, eligibility, matching
from callweave.plans import catalog
from callweave.plans.registry import query
from callweave.plans.scratch import materialise

#: Customers of these segments paint, the others sculpt; a profile's or call's vector and text are those of its number.
PAINTERS = ("BUILDING", "FURNITURE")


@query(f"""WITH {catalog.GROUPS_SQL}, {catalog.WORDS_SQL.strip()},
  vs AS (SELECT o_custkey AS profile_id, o_orderkey AS opportunity_id, coalesce(bool_or(effective = 'FAIL'), false) AS failed FROM orders LEFT JOIN grouped ON o_custkey = profile_id AND o_orderkey = opportunity_id GROUP BY 1, 2),
  u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))) AS l FROM embeddings),
  nv AS (SELECT count(*) AS n FROM embeddings), mult AS (SELECT o_orderkey % n AS i, count(*) AS m FROM orders, nv GROUP BY 1),
  sims AS (SELECT a.vec_id AS q, b.vec_id AS i, list_dot_product(a.v, b.v) / a.l / b.l AS sim FROM u a, u b),
  spr AS (SELECT q, sum(m * sim) / sum(m) AS mean, sqrt(sum(m * sim * sim) / sum(m) - (sum(m * sim) / sum(m)) ** 2) AS std FROM sims JOIN mult USING (i) GROUP BY q),
  p AS (SELECT vs.profile_id, vs.opportunity_id, round(sim, 12) AS sim, mean, std, coalesce(c.discipline <> 'all' AND c.discipline <> CASE WHEN pr.discipline IN ('BUILDING', 'FURNITURE') THEN 'painting' ELSE 'sculpture' END, false) AS mismatch, failed
    FROM vs JOIN calls c USING (opportunity_id) JOIN profiles pr USING (profile_id), nv, sims, spr WHERE sims.q = profile_id % n AND sims.i = opportunity_id % n AND spr.q = profile_id % n
      AND (c.deadline_date IS NULL OR c.deadline_date >= DATE '1995-06-01') AND c.has_fee IS NOT TRUE),
  g AS (SELECT *, CASE WHEN failed THEN 'not_eligible' WHEN mismatch THEN 'other_discipline' ELSE 'fit' END AS grp FROM p),
  kk AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY profile_id, grp ORDER BY sim DESC, opportunity_id) <= 3),
  sh AS (SELECT kk.profile_id, kk.opportunity_id, count(*) AS n_shared FROM kk JOIN words a ON a.doc_id = kk.profile_id JOIN words b ON b.doc_id = kk.opportunity_id AND b.word = a.word JOIN specific s ON s.word = a.word GROUP BY 1, 2),
  rk AS (SELECT kk.*, coalesce(n_shared, 0) AS shared, CAST(round_even(100 / (1 + exp(-(-1 + (sim - mean) / CASE WHEN std = 0 THEN 1 ELSE std END + 0.3 * least(coalesce(n_shared, 0), 5) - 0.5 * CAST(mismatch AS INTEGER)))), 0) AS INTEGER) AS percent FROM kk LEFT JOIN sh USING (profile_id, opportunity_id))
  SELECT profile_id, grp, CAST(row_number() OVER (PARTITION BY profile_id, grp ORDER BY percent DESC, sim DESC, opportunity_id) AS INTEGER) AS pos, opportunity_id, percent, CAST(shared AS BIGINT) AS n_shared FROM rk""")
def m03_m16_matched(t):
    calls = materialise(matching.preference_filter(t("calls"), "1995-06-01", no_fee=True), "calls")
    pairs = catalog._pairs(t)
    open_ = pairs.join(calls.select("opportunity_id"), "opportunity_id")
    # only pairs that the preferences keep are judged; a pair's verdict depends on no other pair
    judged, items = catalog._items(t, pairs.join(calls.select("opportunity_id"), "opportunity_id", "left_semi").select(*pairs.columns))
    verdicts = materialise(eligibility.verdicts(judged, eligibility.or_groups(items)), "verdicts")
    mine = t("profiles").select("profile_id", F.array(F.when(F.col("discipline").isin(*PAINTERS), "painting").otherwise("sculpture")).alias("disciplines"))
    theirs = calls.select("opportunity_id", F.when(F.col("discipline").isNotNull(), F.array("discipline")).alias("disciplines"))
    vectors = t("embeddings").select("vec_id", F.col("embedding").alias("v"))
    n = vectors.count()
    queries = mine.select(F.col("profile_id").alias("key"), (F.col("profile_id") % n).alias("vec_id")).join(vectors, "vec_id").select("key", "v")
    called = t("calls").select(F.col("opportunity_id").alias("item"), (F.col("opportunity_id") % n).alias("vec_id")).join(vectors, "vec_id").select("item", "v")
    texts = t("documents").select(F.col("doc_id").alias("key"), "text")
    specific = materialise(matching.specific_words(texts, "text"), "specific")
    found = discover.matched(discover.groups(open_, verdicts, mine, theirs), materialise(queries, "queries"), materialise(called, "items"), texts, texts, specific, 3)
    return found.drop("sim")
