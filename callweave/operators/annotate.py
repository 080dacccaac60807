"""Annotation and review data sets: queues, samples, label merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.operators.ordered import running_sum
from callweave.plans.scratch import materialise


def seeded(*keys: Column, seed: int = 1) -> Column:
    """An order that looks random and repeats: MD5 over the seed and the keys."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def review_queue(df: DataFrame, reviews: DataFrame, key: str, idx: str, text: str, label: str) -> DataFrame:
    """Unreviewed (text, label) with occurrences, first example, and its neighbouring sentences."""
    w = Window.partitionBy(key).orderBy(idx)
    near = df.withColumns({"previous_text": F.lag(text).over(w), "next_text": F.lead(text).over(w)})
    example = F.struct(F.col(key).alias("key"), F.col(idx).alias("idx"), "previous_text", "next_text")
    once = near.groupBy(F.col(text).alias("text"), F.col(label).alias("label")).agg(F.count("*").alias("occurrences"), F.min(example).alias("e"))
    return once.join(reviews.select("text", "label"), ["text", "label"], "left_anti").select("text", "label", "occurrences", F.col("e.key").alias("example_key"), F.col("e.previous_text").alias("previous_text"), F.col("e.next_text").alias("next_text"))


def capped_sample(df: DataFrame, key: str, group: str, most: int, seed: int = 1) -> DataFrame:
    """At most ``most`` rows a group, in seeded order."""
    w = Window.partitionBy(group).orderBy(seeded(F.col(key), seed=seed), key)
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def quota_sample(df: DataFrame, quotas: dict[str, int], test_size: int, per_call: int = 2, seed: int = 1) -> DataFrame:
    """``chunk_id, opportunity_id, family, text`` sampled: each text once, ``per_call`` rows a call, a quota a family, all in seeded order; the first ``test_size`` are the test split.

    The quotas bound the result, so its last ranks are of a small table.
    """
    placed = df.withColumn("__o", seeded(F.col("chunk_id"), seed=seed))
    first = placed.groupBy("text").agg(F.min_by(F.struct(*placed.columns), F.struct("__o", "chunk_id")).alias("r")).select("r.*")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("__o", "chunk_id"))
    few = first.withColumn("__r", rank("opportunity_id")).where(F.col("__r") <= per_call).withColumn("__r", rank("family"))
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("family")]
    taken = few.where(F.col("__r") <= quota)
    return taken.withColumn("split", F.when(F.row_number().over(Window.orderBy("__o", "chunk_id")) <= test_size, "test").otherwise("dev")).drop("__o", "__r")


#: Rows that the walk of a quota sample takes to the driver at a time.
WALKED_TOGETHER = 10_000


def quota_walk(df: DataFrame, quotas: dict[str, int], test_size: int, per_call: int = 2, seed: int = 1, together: int = WALKED_TOGETHER) -> DataFrame:
    """A13, one walk: rows of ``chunk_id, opportunity_id, family, text`` in seeded order, each taken unless its family's quota, its call or its text is used up.

    The next ``together`` rows that nothing taken so far rules out are walked at a time; what
    they use up is then kept from the following ones before these are put in order. The
    first row left is always taken, so there are no more rounds than the quotas together,
    and usually few. Only ids, digests and what was taken (bounded by the quotas) are held.
    The first ``test_size`` are the test split. Families without a quota give none; ties in
    the order go by ``chunk_id``; a chunk that comes again is one row.
    """
    lean = df.where(F.col("family").isin(*quotas)).select("chunk_id", "opportunity_id", "family", F.sha2(F.coalesce("text", F.lit("")), 256).alias("d"), seeded(F.col("chunk_id"), seed=seed).alias("o"))
    rows = materialise(lean.dropDuplicates(["chunk_id"]), "walk")
    spark, left, calls, texts, taken = df.sparkSession, dict(quotas), {}, set(), []
    at: tuple[str, object] | None = None  # the last row walked
    while any(n > 0 for n in left.values()):
        open_ = rows.where(F.col("family").isin(*(f for f, n in left.items() if n > 0)))
        if at is not None:
            open_ = open_.where((F.col("o") > at[0]) | ((F.col("o") == at[0]) & (F.col("chunk_id") > at[1])))
            used = [c for c, n in calls.items() if n >= per_call]
            open_ = open_.join(F.broadcast(spark.createDataFrame([(d,) for d in texts], "d string")), "d", "left_anti")  # a row a taken one at most
            if used:
                open_ = open_.where(~F.coalesce(F.col("opportunity_id").isin(*used), F.lit(False)))
        found = open_.orderBy("o", "chunk_id").limit(together).collect()
        for r in found:
            if left[r.family] > 0 and calls.get(r.opportunity_id, 0) < per_call and r.d not in texts:
                left[r.family] -= 1
                calls[r.opportunity_id] = calls.get(r.opportunity_id, 0) + 1
                texts.add(r.d)
                taken.append(r.chunk_id)
        if len(found) < together:
            break
        at = (found[-1].o, found[-1].chunk_id)
    split = spark.createDataFrame([(c, "test" if i < test_size else "dev") for i, c in enumerate(taken)], f"chunk_id {dict(df.dtypes)['chunk_id']}, split string")
    return df.dropDuplicates(["chunk_id"]).join(F.broadcast(split), "chunk_id")  # a row a taken one


def halved_sample(calls: DataFrame, used: DataFrame, size: int, per_source: int = 3, seed: int = 1) -> DataFrame:
    """Half of ``size`` calls that can be rejected and half that can't, ``per_source`` a source in all, without used ones, in seeded order.

    ``opportunity_id, source, rejectable`` in. The second half takes what room the first
    leaves a source. ``per_source`` rows a source at most reach a half's one ordering.
    """
    placed = calls.join(used.select("opportunity_id").distinct(), "opportunity_id", "left_anti").withColumn("__o", seeded(F.col("opportunity_id"), seed=seed))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("__o", "opportunity_id"))
    first = placed.where("rejectable").withColumn("__r", rank).where(F.col("__r") <= per_source).orderBy("__o", "opportunity_id").limit(size // 2)
    spent = first.groupBy("source").agg(F.count("*").alias("__spent"))
    rest = placed.where("not rejectable").withColumn("__r", rank).where(F.col("__r") <= per_source).join(spent, "source", "left")
    second = rest.where(F.col("__r") <= per_source - F.coalesce("__spent", F.lit(0))).orderBy("__o", "opportunity_id").limit(size // 2)
    return first.select(*calls.columns).union(second.select(*calls.columns))


def unused(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not used before."""
    return df.join(used.select(key).distinct(), key, "left_anti")


def judging_pool(tops: DataFrame, judged: DataFrame, seed: int = 1) -> DataFrame:
    """Each (persona, item) in any variant's top, unless judged, with its place in the persona's seeded order."""
    new = tops.select("persona", "item").distinct().join(judged.select("persona", "item"), ["persona", "item"], "left_anti")
    w = Window.partitionBy("persona").orderBy(seeded(F.col("persona"), F.col("item"), seed=seed), "item")
    return new.withColumn("pos", F.row_number().over(w))


def targeted(chunks: DataFrame, cues: dict[str, str], quota: int, per_call: int = 2, seed: int = 1) -> DataFrame:
    """For each class in turn ``quota`` chunks with its cue, in seeded order, each once and ``per_call`` a call over all classes.

    ``opportunity_id, chunk_id, text`` in; adds ``keyword_class``. What is picked is at most
    quota times classes.
    """
    placed, picked = chunks.withColumn("__o", seeded(F.col("chunk_id"), seed=seed)), None
    for name, cue in cues.items():
        pool = placed.where(F.lower("text").rlike(cue))
        room = F.lit(per_call)
        if picked is not None:
            spent = picked.groupBy("opportunity_id").agg(F.count("*").alias("__spent"))
            pool = pool.join(picked.select("chunk_id"), "chunk_id", "left_anti").join(spent, "opportunity_id", "left")
            room = per_call - F.coalesce("__spent", F.lit(0))
        rank = F.row_number().over(Window.partitionBy("opportunity_id").orderBy("__o", "chunk_id"))
        new = pool.withColumn("__r", rank).where(F.col("__r") <= room).orderBy("__o", "chunk_id").limit(quota).select(*chunks.columns, F.lit(name).alias("keyword_class"))
        picked = materialise(new if picked is None else picked.union(new), "targeted")
    return picked


def apply_review(labels: DataFrame, human: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """The adjudicated label, else the reviewer's, else the old one; SKIP moves a row out."""
    h = human.select("chunk_id", F.col("label").alias("__h"))
    a = adjudicated.select("chunk_id", F.col("label").alias("__a"))
    joined = labels.join(h, "chunk_id", "left").join(a, "chunk_id", "left")
    final = F.coalesce("__a", "__h", "label")
    state = F.when(final == "SKIP", "moved").when(F.coalesce("__a", "__h").isNull(), "kept").when(final == F.col("label"), "confirmed").otherwise("changed")
    return joined.select("chunk_id", final.alias("final_label"), state.alias("state"))


def dominance(df: DataFrame, group: str) -> DataFrame:
    """Rows and share of each group."""
    per = df.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def multilabel_union(df: DataFrame, parts: str, label: str) -> DataFrame:
    """Split sentences put together again: the sorted union of labels, NONE dropped beside others."""
    sets = df.groupBy(F.col(parts).alias("base")).agg(F.array_sort(F.collect_set(label)).alias("s"))
    real = F.array_remove("s", "NONE")
    return sets.select("base", F.concat_ws("|", F.when(F.size(real) > 0, real).otherwise(F.col("s"))).alias("labels"))


def group_folds(df: DataFrame, group: str, folds: int, seed: int = 1) -> DataFrame:
    """A fold for each group, in seeded order, so that none is in two folds."""
    w = Window.orderBy(seeded(F.col("grp"), seed=seed))  # one row a group
    return df.select(F.col(group).alias("grp")).distinct().withColumn("fold", (F.row_number().over(w) - 1) % folds)


def leakage(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups found in more than one fold."""
    return df.groupBy(group).agg(F.countDistinct(fold).alias("n")).where("n > 1")


def source_capped(calls: DataFrame, room: Column) -> DataFrame:
    """The calls that a walk in ``__o`` order takes, skipping those that would go beyond their source's ``room``.

    A walk takes calls while their running sum fits; the first that doesn't is skipped, and
    so are all later ones too large for what is left. Each round takes such a stretch for all
    sources at once by running sums over range partitions; what is left of a source shrinks
    each time.
    """
    columns, taken = calls.columns, None
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))  # a null source is a source of its own
    left = materialise(calls.withColumns({"__room": room, "__source": named}).where("n_chunks > 0 and n_chunks <= __room"), "calls")
    while not left.isEmpty():
        summed = materialise(running_sum(left, F.col("n_chunks"), ["__o", "opportunity_id"], ["__source"]).drop("total"), "summed")
        new = summed.where("run <= __room")
        taken = new.select(*columns) if taken is None else taken.union(new.select(*columns))
        spent = new.groupBy("__source").agg(F.max("run").alias("__spent"))
        rest = summed.where("run > __room").join(spent, "__source").withColumn("__room", F.col("__room") - F.col("__spent"))
        left = materialise(rest.where("n_chunks <= __room").select(*columns, "__room", "__source"), "calls")
    return materialise(taken, "taken") if taken is not None else calls.where("false")


def capped_calls(calls: DataFrame, target: int, share: float, seed: int = 1, held: DataFrame | None = None, relax: bool = True) -> DataFrame:
    """Whole calls in seeded order until their chunks reach ``target``, with ``relaxed``.

    ``opportunity_id, source, n_chunks`` in. A call that would take its source beyond
    ``share`` of the target is deferred, and does not count. Where the walk ends short,
    deferred calls fill up in the same order. ``held``: ``source, n`` chunks of a pool that
    counts towards the cap and the size it is a share of.
    """
    placed = calls.withColumn("__o", seeded(F.col("opportunity_id"), seed=seed))
    most, room = max(1, round(target * share)), None
    if held is not None:
        most = max(1, round((target + (held.agg(F.sum("n")).first()[0] or 0)) * share))
        placed = placed.join(held.select("source", F.col("n").alias("__held")), "source", "left")
        room = most - F.coalesce("__held", F.lit(0))
    taken = source_capped(placed, F.lit(most) if room is None else room)
    walk = materialise(running_sum(taken, F.col("n_chunks"), ["__o", "opportunity_id"]), "walk")
    out = walk.where(F.col("run") - F.col("n_chunks") < target).select(*calls.columns, F.lit(False).alias("relaxed"))
    total = walk.agg(F.max("run")).first()[0] or 0
    if relax and total < target:
        rest = placed.where("n_chunks > 0").join(taken.select("opportunity_id"), "opportunity_id", "left_anti")
        more = running_sum(rest, F.col("n_chunks"), ["__o", "opportunity_id"]).where(F.col("run") - F.col("n_chunks") + total < target)
        out = out.union(more.select(*calls.columns, F.lit(True)))
    return out


def batches(df: DataFrame, order: list[str], size: int = 60) -> DataFrame:
    """Rows in ``order`` with their ``batch``, from 1, of ``size`` rows; write with ``partitionBy("batch")``."""
    placed = running_sum(df, F.lit(1), order).drop("total")
    return placed.withColumn("batch", F.ceil(F.col("run") / size)).drop("run")


def scope_queue(rows: DataFrame, reviewed: DataFrame, queued: DataFrame, scope: Column, checked_only: list[str]) -> DataFrame:
    """A row a distinct sentence that nobody read for its scope and that the rules keep about the applicant.

    ``opportunity_id, chunk_index, text, is_heading, heading, label, suspected, polarity`` in. Taken are
    sentences of check-only classes and those that the safety net raised, without waivers,
    headings, and texts reviewed in any round or queued already; with occurrences and the
    first example in call order, its neighbours included.
    """
    w = Window.partitionBy("opportunity_id").orderBy("chunk_index")
    sentences = rows.groupBy("opportunity_id", "chunk_index").agg(F.first("text").alias("text"))
    near = sentences.select("opportunity_id", "chunk_index", F.lag("text").over(w).alias("previous_text"), F.lead("text").over(w).alias("next_text"))
    shown = rows.withColumn("shown", F.when(F.col("label") == "NONE", F.col("suspected")).otherwise(F.col("label")))
    wanted = F.col("shown").isin(*checked_only) | ((F.col("label") == "NONE") & F.col("shown").isNotNull())
    kept = shown.where(wanted & (F.coalesce("polarity", F.lit("")) != "WAIVES") & ~F.coalesce("is_heading", F.lit(False)) & (scope == "APPLICANT"))
    read = reviewed.select("text").union(queued.select("text")).distinct()
    fresh = kept.join(read, "text", "left_anti").join(near, ["opportunity_id", "chunk_index"])
    example = F.min(F.struct("opportunity_id", "chunk_index", "shown", "heading", "previous_text", "next_text")).alias("e")
    once = fresh.groupBy("text").agg(F.count("*").alias("occurrences"), example)
    return once.select("text", F.col("e.shown").alias("label"), "occurrences", F.col("e.opportunity_id").alias("example_call"), F.col("e.heading").alias("heading"), F.col("e.previous_text").alias("previous_text"), F.col("e.next_text").alias("next_text"))


def merged_reviews(reviews: DataFrame, queued: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reviews with a round's answers appended, and the answers that can't be: ``text, label, error``.

    An answer must be to a queued (text, label) and new; one that only keeps a sentence about
    the applicant adds nothing. A round is applied only if no answer is wrong.
    """
    key = ["text", "label"]
    asked = queued.select(*key).distinct().withColumn("__q", F.lit(True))
    old = reviews.select(*key).distinct().withColumn("__old", F.lit(True))
    judged = answers.join(asked, key, "left").join(old, key, "left")
    error = F.when(F.col("__q").isNull(), "not queued").when(F.col("__old").isNotNull(), "already reviewed")
    says = ~((F.col("decision") == "scope") & (F.col("scope") == "APPLICANT"))
    wrong = judged.withColumn("error", error).where("error is not null").select(*key, "error")
    new = judged.where(error.isNull() & says).select(*reviews.columns)
    return reviews.unionByName(new), wrong


def updated_reviews(reviews: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews with the decision, scope and polarity of a second reading where there is one, and the readings that match no review."""
    key, fields = ["text", "label"], ["decision", "scope", "polarity"]
    new = updates.select(*key, *(F.col(c).alias(f"__{c}") for c in fields), F.lit(True).alias("__u"))
    joined = reviews.join(new, key, "left")
    out = joined.withColumns({c: F.when(F.col("__u"), F.col(f"__{c}")).otherwise(F.col(c)) for c in fields}).select(*reviews.columns)
    return out, updates.join(reviews.select(*key), key, "left_anti").select(*key)


def value_errors(value: Column, countries: list[str], regions: list[str], types: list[str]) -> Column:
    """What is wrong with a reviewed value, null if nothing: codes, regions and types must be known, ages in order, and something checkable stated."""
    bad = lambda field, known: F.size(F.array_except(F.coalesce(value[field], F.array().cast("array<string>")), F.array(*map(F.lit, known)))) > 0
    stated = F.coalesce(*(F.when(value[f].isNotNull(), True) for f in ("min_age", "max_age", "countries", "broad_regions", "types")), F.lit(False))
    return F.when(bad("countries", countries), "countries").when(bad("broad_regions", regions), "broad_regions").when(bad("types", types), "types").when(F.coalesce(value["min_age"] > value["max_age"], F.lit(False)), "ages").when(~stated, "nothing to check")


def invalid_rows(df: DataFrame, scopes: list[str], decisions: list[str], polarities: list[str]) -> DataFrame:
    """Reviewed rows with the first thing wrong with them."""
    why = F.coalesce(F.when(~F.coalesce(F.col("scope").isin(*scopes), F.lit(True)), "scope"), F.when(~F.coalesce(F.col("decision").isin(*decisions), F.lit(False)), "decision"), F.when(~F.coalesce(F.col("polarity").isin(*polarities), F.lit(True)), "polarity"))
    return df.withColumn("error", why).where("error is not null")


def relabel(df: DataFrame, changes: DataFrame, tag: str) -> DataFrame:
    """New labels where a change exists and the note does not hold its tag yet."""
    c = changes.select("chunk_id", F.col("new_label").alias("__n"))
    joined = df.join(c, "chunk_id", "left")
    due = F.col("__n").isNotNull() & ~F.contains(F.coalesce("notes", F.lit("")), F.lit(tag))
    return joined.withColumns({"label": F.when(due, F.col("__n")).otherwise(F.col("label")), "notes": F.when(due, F.concat_ws(" ", "notes", F.lit(tag))).otherwise(F.col("notes"))}).drop("__n")
