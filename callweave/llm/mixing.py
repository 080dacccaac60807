"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent between 0 and 1, over the
sum of these. The exponent is found by bisection: the largest that reaches a target entropy,
or the smallest that keeps every source within a repetition limit, the larger of the two
where both are set. A source's budget
is its weight times all tokens to draw; it is filled by whole passes over the source and
one part of a pass. A pass goes through the source's documents in hashed blocks, and in
hashed order within each; the last pass ends where the budget is met, found by running
totals of blocks over range partitions, so that no task sees all of a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.operators.ordered import running_sum
from callweave.plans.scratch import materialise

STEPS = 50
#: Parts that a source's rows are dealt into where they meet the table of sources.
PARTS = 16


@dataclass(frozen=True)
class Policy:
    """What the exponent must meet, and how much is drawn.

    ``entropy_gain``: how far the entropy goes from the corpus' own (0) to that of equal
    weights (1); ``entropy_share``: the entropy to reach, over that of equal weights, in its
    place; ``most_repeats``: how often a source's tokens may be drawn, at most, and before
    the entropy. None leaves a condition out. ``budget``: tokens
    to draw; None draws so much that the least repeated source is drawn whole once, and so
    leaves no document out. ``rows_per_block`` sets the blocks of a source.
    """

    most_repeats: float | None = 2.0
    entropy_share: float | None = None
    entropy_gain: float | None = 0.5
    budget: int | None = None
    rows_per_block: int = 5_000
    seed: int = 3


def whitespace_tokens(text: Column) -> Column:
    """Words parted by ASCII white space; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("bigint")


def _at(sources: DataFrame, exponents: list[float]) -> list[dict]:
    """For each exponent: the largest repetition, and the entropy over that of equal weights.

    One aggregate over the table of sources for all exponents; sources never reach the driver.
    """
    each = sources.where("share > 0").select("share", F.explode(F.array(*map(F.lit, exponents))).alias("e")).withColumn("p", F.pow("share", F.col("e")))
    # weights are p / sum p; repetition over the least one is share^(e-1) against its own smallest
    sums = each.groupBy("e").agg(
        F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("s"), F.count("*").alias("n"),
        F.max(F.col("p") / F.col("share")).alias("most"), F.min(F.col("p") / F.col("share")).alias("least"),
    )
    return sorted((r.asDict() for r in sums.collect()), key=lambda r: r["e"])


def _repeats(r: dict, budget_over_total: float | None) -> float:
    """The largest number of times that a source is drawn."""
    return r["most"] / r["least"] if budget_over_total is None else budget_over_total * r["most"] / r["z"]


def _entropy_share(r: dict) -> float:
    from math import log

    if r["n"] < 2:
        return 1.0
    return (log(r["z"]) - r["s"] / r["z"]) / log(r["n"])


def exponent(sources: DataFrame, policy: Policy, total: int) -> float:
    """The bisected exponent. 1 keeps the shares, 0 makes all sources equal; 1 without sources or conditions."""
    over = None if policy.budget is None else policy.budget / max(1, total)
    found = [0.0] if policy.most_repeats is not None or policy.entropy_share is not None or policy.entropy_gain is not None else [1.0]
    target = policy.entropy_share
    if target is None and policy.entropy_gain is not None:
        own = _at(sources, [1.0])
        target = 1 - (1 - policy.entropy_gain) * (1 - _entropy_share(own[0])) if own else None
    if target is not None:
        found.append(_bisected(sources, lambda r: _entropy_share(r) < target, upper=False))
    if policy.most_repeats is not None:
        found.append(_bisected(sources, lambda r: _repeats(r, over) <= policy.most_repeats, upper=True))
    return max(found)


def _bisected(sources: DataFrame, after, upper: bool) -> float:
    """The exponent where ``after`` begins to hold: the upper or lower end of the last interval.

    Each pass evaluates 31 exponents within the interval at once and keeps the one step
    that holds the answer, until it is narrower than 2^-STEPS.
    """
    lo, hi = 0.0, 1.0
    while hi - lo > 2.0**-STEPS:
        grid = [lo + (hi - lo) * i / 32 for i in range(1, 32)]
        ok = [after(r) for r in _at(sources, grid)]
        if not ok:
            return 1.0
        points, passed = [lo, *grid, hi], ok.index(True) if True in ok else 31
        lo, hi = points[passed], points[passed + 1]
    return hi if upper else lo


def _hash(policy: Policy, *cols) -> Column:
    return F.xxhash64(F.lit(policy.seed), *cols)


def mix(docs: DataFrame, policy: Policy = Policy(), id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """One row per drawn copy: ``doc_id, source, tokens, weight, pass, block, start_token, mix_pos``.

    ``start_token``: tokens of the source's permutation before the copy; the budget is met
    by the copy that starts below it, so a source's draw exceeds its budget by less than
    one document. ``mix_pos``, from 0 to below 1, is that start over the budget: sorted by
    it, every stretch of the result holds the sources in their weights. Documents without
    tokens are drawn in the first pass alone, at the place their hash gives them. A null
    source is a source of its own; rows that share id and source are drawn apart, in any
    order; null and empty texts have no tokens, and a very long text is one document, never
    cut; empty tables give none. Other columns are left out.
    """
    tokens = whitespace_tokens(F.col("text")) if tokens is None else tokens
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens.alias("tokens"))
    lean = materialise(lean.withColumn("__s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))), "lean")
    per = lean.groupBy("__s").agg(F.sum("tokens").alias("__t"), F.count("*").alias("__rows"))
    total = per.agg(F.sum("__t")).first()[0] or 0
    sources = materialise(per.withColumn("share", F.col("__t") / F.lit(float(max(1, total)))), "sources")
    e = exponent(sources, policy, total)
    facts = _at(sources, [e])
    z, least = (facts[0]["z"], facts[0]["least"]) if facts else (1.0, 1.0)
    drawn = float(policy.budget) if policy.budget is not None else total * z / least  # then the least repeated source is drawn once
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(e)) / F.lit(z)).otherwise(0.0)
    plan = sources.select(
        "__s", "__t", weight.alias("weight"), (weight * drawn).alias("__budget"),
        F.ceil(F.col("__rows") / policy.rows_per_block).alias("__blocks"),
    )
    if policy.budget is None:  # rounding must not cut the whole pass of the least repeated source
        plan = plan.withColumn("__budget", F.greatest("__budget", F.col("__t").cast("double")))
    plan = materialise(plan, "weights")
    # dealt by (source, part), so that a hot source is no single task's, whatever way the table's size allows to join
    parts = plan.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    passes = F.when(F.col("__t") > 0, F.ceil(F.col("__budget") / F.greatest(F.col("__t"), F.lit(1)) - 1e-9)).otherwise(1).cast("int")
    dealt = lean.withColumn("__part", F.pmod(_hash(policy, "doc_id"), F.lit(PARTS)).cast("int"))
    copies = dealt.join(parts, ["__s", "__part"]).drop("__part").select("*", F.explode(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1)).alias("pass"))
    copies = copies.where((F.col("tokens") > 0) | (F.col("pass") == 0))
    copies = copies.withColumn("block", F.pmod(_hash(policy, "doc_id", "pass"), F.col("__blocks"))).withColumn("__o", _hash(policy, "pass", "doc_id", "tokens"))
    blocks = copies.groupBy("__s", "pass", "block").agg(F.sum("tokens").alias("__n")).withColumn("__turn", _hash(policy, "__s", "pass", "block"))
    starts = running_sum(blocks.withColumnRenamed("__s", "key"), F.col("__n"), ["pass", "__turn", "block"], ["key"]).select(F.col("key").alias("__s"), "pass", "block", (F.col("run") - F.col("__n")).alias("__b"))
    inside = Window.partitionBy("__s", "pass", "block").orderBy("__o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.join(starts, ["__s", "pass", "block"]).withColumn("start_token", F.col("__b") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    within = (F.col("start_token") < F.col("__budget")) | ((F.col("tokens") == 0) & (F.col("pass") == 0) & (F.col("start_token") <= F.col("__budget")))
    position = F.when(F.col("__budget") > 0, F.least(F.col("start_token") / F.col("__budget"), F.lit(1 - 2.0**-53))).otherwise(0.0)
    return placed.where(within).select("doc_id", "source", "tokens", "weight", "pass", "block", "start_token", position.alias("mix_pos"))
