"""Evaluation: reports, sweeps, agreement, verdict and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.operators.ordered import running_sum


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts of true and predicted label."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of each label, from one pass over the rows."""
    cells = confusion(df, truth, guess)
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("given"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("given"), F.lit(0).cast("bigint").alias("tp")),
    )).alias("x")).select("x.*")
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("given").alias("given"), F.sum("tp").alias("tp"))
    p, r = _ratio(F.col("tp"), F.col("given")), _ratio(F.col("tp"), F.col("support"))
    scored = sums.select("label", "support", p.alias("p"), r.alias("r"))
    return scored.select("label", "support", F.round("p", 6).alias("prec"), F.round("r", 6).alias("rec"), F.round(_ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("f1"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """A10: raw agreement and Cohen's kappa of two raters, from the marginals."""
    cells = confusion(df, a, b)
    rows = cells.groupBy(F.col("truth").alias("l")).agg(F.sum("n").alias("x"))
    cols = cells.groupBy(F.col("guess").alias("l")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, "l").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("c"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    one = total.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k")  # one row each
    return one.select("n", F.round(po, 6).alias("raw_agreement"), F.round(_ratio(po - pe, 1 - pe), 6).alias("kappa"))


def threshold_sweep(df: DataFrame, truth: str, guess: str, confidence: str, steps: Sequence[float]) -> DataFrame:
    """For each threshold the accepted share and its accuracy; partial sums, no row copies leave a task."""
    right = (F.col(truth) == F.col(guess)).cast("bigint")
    grid = F.explode(F.array(*map(F.lit, steps))).alias("threshold")
    each = df.select(right.alias("ok"), F.col(confidence).alias("c"), grid)
    got = each.groupBy("threshold").agg(F.count("*").alias("n"), F.sum((F.col("c") >= F.col("threshold")).cast("bigint")).alias("accepted"), F.sum(F.when(F.col("c") >= F.col("threshold"), F.col("ok")).otherwise(0)).alias("good"))
    return got.select("threshold", "accepted", F.round(F.col("accepted") / F.col("n"), 6).alias("share"), F.round(_ratio(F.col("good"), F.col("accepted")), 6).alias("accuracy"))


def confident_errors(df: DataFrame, key: str, truth: str, guess: str, confidence: str, most: int = 3) -> DataFrame:
    """The most confident errors of each confusion pair."""
    w = Window.partitionBy(truth, guess).orderBy(F.desc(confidence), key)
    wrong = df.where(F.col(truth) != F.col(guess)).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)
    return wrong.select(F.col(truth).alias("truth"), F.col(guess).alias("guess"), "pos", F.col(key).alias("chunk_id"))


def multilabel_scores(df: DataFrame, key: str, truth: str, guess: str) -> DataFrame:
    """Micro precision, recall and F1, exact-set share and missed share of label arrays."""
    both = F.size(F.array_intersect(truth, guess))
    sized = df.select(both.alias("tp"), F.size(truth).alias("t"), F.size(guess).alias("g"))
    exact = ((F.col("tp") == F.col("t")) & (F.col("tp") == F.col("g"))).cast("bigint")
    missed = ((F.col("t") > 0) & (F.col("g") == 0)).cast("bigint")
    s = sized.agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum(exact).alias("e"), F.sum(missed).alias("m"), F.count("*").alias("n"))
    return s.select(
        F.round(_ratio(F.col("tp"), F.col("g")), 6).alias("micro_p"), F.round(_ratio(F.col("tp"), F.col("t")), 6).alias("micro_r"),
        F.round(_ratio(2 * F.col("tp"), F.col("t") + F.col("g")), 6).alias("micro_f1"), F.round(F.col("e") / F.col("n"), 6).alias("exact_share"), F.round(F.col("m") / F.col("n"), 6).alias("missed_share"),
    )


def label_counts(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``label, tp, fp, fn, tn, precision, recall, f1`` of label arrays, a row for each label that either side holds.

    Both sides are exploded with their share in each cell, so that tasks add up before
    the shuffle; null arrays hold nothing.
    """
    none = F.array().cast("array<string>")
    t, g = F.array_distinct(F.coalesce(truth, none)), F.array_distinct(F.coalesce(guess, none))
    cells = F.concat(
        F.transform(F.array_intersect(t, g), lambda x: F.struct(x.alias("label"), F.lit("tp").alias("k"))),
        F.transform(F.array_except(g, t), lambda x: F.struct(x.alias("label"), F.lit("fp").alias("k"))),
        F.transform(F.array_except(t, g), lambda x: F.struct(x.alias("label"), F.lit("fn").alias("k"))),
    )
    each = df.select(F.explode(cells).alias("c")).select("c.*")
    n = df.count()
    per = each.groupBy("label").agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("tp", "fp", "fn"))).withColumn("tn", F.lit(n) - F.col("tp") - F.col("fp") - F.col("fn"))
    rate = lambda a, b: F.round(F.coalesce(_ratio(a, b), F.lit(0.0)), 6)
    return per.select("label", "tp", "fp", "fn", "tn", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def multilabel_more(df: DataFrame, truth: str, guess: str, labels: int) -> DataFrame:
    """Macro F1 over ``labels`` classes (0 for those that never occur), the share of wrong cells (Hamming loss), and the recall of rows with two labels or more."""
    none = F.array().cast("array<string>")
    t, g = F.array_distinct(F.coalesce(truth, none)), F.array_distinct(F.coalesce(guess, none))
    both = F.size(F.array_intersect(t, g))
    sized = df.select(both.alias("tp"), F.size(t).alias("t"), F.size(g).alias("g"))
    many = F.col("t") >= 2
    s = sized.agg(F.sum(F.col("t") + F.col("g") - 2 * F.col("tp")).alias("wrong"), F.count("*").alias("n"), F.sum(F.when(many, F.col("tp"))).alias("ctp"), F.sum(F.when(many, F.col("t"))).alias("ct"))
    f1 = label_counts(df, truth, guess).agg((F.sum("f1") / labels).alias("macro"))
    return s.join(F.broadcast(f1)).select(F.round("macro", 5).alias("macro_f1"), F.round(F.col("wrong") / (F.col("n") * labels), 6).alias("hamming"), F.round(_ratio(F.col("ctp"), F.col("ct")), 6).alias("compound_recall"))  # a row each


def verdict_counts(df: DataFrame, by: str | None = None) -> DataFrame:
    """Wrong and found verdicts of each kind against gold, overall or by a column."""
    yes, no = "ELIGIBLE", "NOT_ELIGIBLE"
    s, e = F.col("status"), F.col("expected")
    n = lambda c: F.count_if(c)
    keys = [F.col(by).alias("grp")] if by else []
    return df.groupBy(*keys).agg(
        n((s == no) & (e != no)).alias("wrong_no"), n(e != no).alias("of_not_no"), n((s == yes) & (e == no)).alias("wrong_yes"), n(e == no).alias("of_no"),
        n((s == yes) & (e == yes)).alias("found_yes"), n(e == yes).alias("of_yes"), n((s == no) & (e == no)).alias("found_no"), F.round(F.avg((s != "CHECK").cast("double")), 6).alias("conclusive"),
    )


def verdict_mix(df: DataFrame) -> DataFrame:
    """Shares of verdicts by persona, and over all rows in the row without a persona."""
    shares = [F.round(F.avg((F.col("status") == v).cast("double")), 6).alias(v.lower()) for v in ("ELIGIBLE", "CHECK", "NOT_ELIGIBLE")]
    return df.rollup("persona").agg(F.count("*").alias("n"), *shares)


def crosstab_with_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by both columns with margins; a margin's column is null."""
    return df.cube(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def ranking_metrics(df: DataFrame, k: int = 10) -> DataFrame:
    """P@k, strict P@k, NDCG@k and unjudged by persona.

    ``persona, item, sim, grade, judged``. Unjudged counts as 0; P@k divides by k even with
    fewer rows; the ideal is made of the persona's judged pool, and its absence gives 0.
    """
    graded = df.withColumn("g", F.when(F.col("judged"), F.col("grade")).otherwise(0))
    ranked = graded.withColumn("pos", F.row_number().over(Window.partitionBy("persona").orderBy(F.desc("sim"), "item")))
    ideal = F.row_number().over(Window.partitionBy("persona").orderBy(F.desc("g"), "item"))
    placed = ranked.withColumn("best", ideal)
    gain = lambda at: F.sum(F.when(F.col(at) <= k, F.col("g") / F.log2(F.col(at) + 1)).otherwise(0.0))
    top = F.col("pos") <= k
    return placed.groupBy("persona").agg(
        F.round(F.sum(F.when(top & (F.col("g") >= 1), 1).otherwise(0)) / k, 6).alias("p_at_k"), F.round(F.sum(F.when(top & (F.col("g") == 2), 1).otherwise(0)) / k, 6).alias("strict_p"),
        F.round(_ratio(gain("pos"), gain("best")), 6).alias("ndcg"), F.sum(F.when(top & ~F.col("judged"), 1).otherwise(0)).alias("unjudged"),
    )


def probability_scores(df: DataFrame, p: str, y: str) -> DataFrame:
    """ROC AUC by rank sums over distinct scores, Brier score and log loss."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    per = df.groupBy(F.col(p).alias("p")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("sq"), F.sum(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("ll"))
    ranked = running_sum(per, F.col("n"), ["p"]).withColumn("before", F.col("run") - F.col("n"))
    s = ranked.agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("m"), F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum("ll").alias("ll"))
    m, n = F.col("m"), F.col("n")
    return s.select(F.round(_ratio(F.col("r") - m * (m + 1) / 2, m * (n - m)), 6).alias("auc"), F.round(F.col("sq") / n, 6).alias("brier"), F.round(F.col("ll") / n, 6).alias("log_loss"))


def calibration(df: DataFrame, key: str, p: str, y: str, bins: int = 5) -> DataFrame:
    """Equal-count bins of a probability with its mean and the share that came true."""
    rows = df.select(F.col(key).alias("key"), F.col(p).alias("p"), F.col(y).alias("y"))
    least, longer = F.floor(F.col("total") / bins), F.col("total") % bins  # so many bins have one row more
    at = F.col("run") - 1
    bin_ = F.when(at < longer * (least + 1), F.floor(at / (least + 1))).otherwise(longer + F.floor((at - longer * (least + 1)) / F.greatest(least, F.lit(1)))) + 1
    ranked = running_sum(rows, F.lit(1), ["p", "key"]).withColumn("bin", bin_.cast("int"))
    return ranked.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("share_true"))


def best_thresholds(df: DataFrame, label: str, p: str, y: str, steps: Sequence[float]) -> DataFrame:
    """For each label the threshold of best F1, the lowest on a tie."""
    each = df.select(F.col(label).alias("label"), F.col(p).alias("p"), F.col(y).alias("y"), F.explode(F.array(*map(F.lit, steps))).alias("threshold"))
    said = F.col("p") >= F.col("threshold")
    sums = each.groupBy("label", "threshold").agg(F.count_if(said & F.col("y")).alias("tp"), F.count_if(said).alias("given"), F.count_if(F.col("y")).alias("real"))
    f1 = sums.withColumn("f1", _ratio(2 * F.col("tp"), F.col("given") + F.col("real")))
    return f1.groupBy("label").agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("m")).select("label", (-F.col("m.t")).alias("threshold"), F.round("m.f1", 6).alias("f1"))


def field_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Right, wrong, missed, extra and rightly empty by field, over a full join on (doc, field)."""
    both = truth.select("doc", "field", F.col("value").alias("t")).join(found.select("doc", "field", F.col("value").alias("f")), ["doc", "field"], "full")
    kind = F.when(F.col("t").isNull() & F.col("f").isNull(), "ok_null").when(F.col("t").isNull(), "extra").when(F.col("f").isNull(), "missed").when(F.col("t") == F.col("f"), "right").otherwise("wrong")
    return both.groupBy("field", kind.alias("kind")).agg(F.count("*").alias("n"))


def hit_rates(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Share of questions whose wanted item ranks first, and among the first three."""
    best = wanted.join(ranked.select("key", "item", "rank"), ["key", "item"], "left").groupBy("key").agg(F.min("rank").alias("r"))
    at = lambda k: F.round(F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double")), 6)
    return best.agg(F.count("*").alias("n"), at(1).alias("top1"), at(3).alias("top3"))


def missed_causes(df: DataFrame) -> DataFrame:
    """By persona the status that rejections were most often missed with, and whether it was the only one."""
    missed = df.where("expected = 'NOT_ELIGIBLE' AND status <> 'NOT_ELIGIBLE'")
    per = missed.groupBy("persona", "status").agg(F.count("*").alias("n"))
    return per.groupBy("persona").agg(F.max_by("status", F.struct("n", "status")).alias("cause"), (F.count("*") == 1).alias("only"), F.sum("n").alias("n"))


def aligned_sentences(left: DataFrame, right: DataFrame, share: float = 0.8) -> DataFrame:
    """Pairs of one call's sentences whose common words make up a share of the smaller set; sentences meet within the call, so that their words aren't shuffled."""
    words = lambda d, n: d.select("opportunity_id", F.col("idx").alias(n), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias(f"{n}_w"))
    common = F.size(F.array_intersect("a_w", "b_w"))
    both = words(left, "a").join(words(right, "b"), "opportunity_id").withColumn("n", common)
    return both.where((F.col("n") > 0) & (F.col("n") >= share * F.least(F.size("a_w"), F.size("b_w")))).select("opportunity_id", "a", "b")


def learning_curve(df: DataFrame, group: str, right: Column, shares: Sequence[float]) -> DataFrame:
    """Accuracy over nested shares of groups, taken in seeded order."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit("curve/"), F.col(group))), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))
    each = df.select(digits.alias("u"), right.cast("double").alias("ok"), F.explode(F.array(*map(F.lit, shares))).alias("share"))
    return each.where(F.col("u") < F.col("share")).groupBy("share").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


def share_report(df: DataFrame, truth: str, guess: str, positive: str, unclear: str) -> DataFrame:
    """Recall and precision of one class, share of the unclear one, and confident errors in favour of the rest."""
    t, g = F.col(truth), F.col(guess)
    s = df.agg(F.count_if((t == positive) & (g == positive)).alias("tp"), F.count_if(t == positive).alias("real"), F.count_if(g == positive).alias("given"), F.count_if(g == unclear).alias("u"), F.count_if((t == positive) & (g != positive) & (g != unclear)).alias("dangerous"), F.count("*").alias("n"))
    return s.select(F.round(_ratio(F.col("tp"), F.col("given")), 6).alias("prec"), F.round(_ratio(F.col("tp"), F.col("real")), 6).alias("rec"), F.round(F.col("u") / F.col("n"), 6).alias("unclear_share"), "dangerous")


def ranking_variants(df: DataFrame, variants: dict[str, Column], k: int = 10) -> DataFrame:
    """P@k of several orders of the same candidates, stacked; one window an order, all on one partitioning."""
    out = df
    for name, order in variants.items():
        out = out.withColumn(f"__{name}", F.row_number().over(Window.partitionBy("persona").orderBy(order, "item")))
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.col(f"__{n}").alias("pos")) for n in variants))).alias("v")
    ranked = out.select("persona", "grade", at).where(F.col("v.pos") <= k)
    per = ranked.groupBy("v.variant", "persona").agg((F.sum((F.col("grade") >= 1).cast("int")) / k).alias("p"))
    return per.groupBy("variant").agg(F.round(F.avg("p"), 6).alias("mean_p"), F.count("*").alias("n_personas"))


def spaced_indexes(df: DataFrame, key: str, pos: str, group: str) -> DataFrame:
    """Indexes that step by one within an alternative group and by two elsewhere, so that groups form runs."""
    w = Window.partitionBy(key).orderBy(pos)
    step = F.when(F.lag(group).over(w) == F.col(group), 1).otherwise(2)
    return df.withColumn("__s", step).withColumn("chunk_index", F.sum("__s").over(w)).drop("__s")


def safety_net_report(df: DataFrame) -> DataFrame:
    """Per rule the misses it caught and its false alarms. ``why, suspected, truth``."""
    raised = df.where("why is not null")
    return raised.groupBy("why").agg(F.count_if(F.col("suspected") == F.col("truth")).alias("caught"), F.count_if(F.col("truth") == "NONE").alias("false_alarms"), F.count("*").alias("raised"))
