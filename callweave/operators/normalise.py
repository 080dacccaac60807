"""Normalisation: deadlines, vocabulary, places, funding, duplicates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.text import strip
from callweave.operators.ordered import running_sum

MONTHS = "january february march april may june july august september october november december".split()


def needs_processing(raw: DataFrame, done: DataFrame) -> DataFrame:
    """Ids that are new or whose language changed."""
    old = done.select("id", F.col("lang").alias("__lang"), F.lit(True).alias("__old"))
    joined = raw.select("id", "lang").join(old, "id", "left")
    return joined.where(F.col("__old").isNull() | ~F.col("lang").eqNullSafe(F.col("__lang"))).select("id", "lang")


#: Names of the months by language.
MONTH_NAMES = {
    "en": MONTHS,
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}


def _dates(text: Column, pattern: str, year: int | Column, month: int, day: int, numbers: dict[str, int] | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def read(m: Column) -> Column:
        part = lambda i: F.regexp_extract(m, pattern, i)
        table = F.create_map(*(F.lit(x) for kv in (numbers or {}).items() for x in kv)) if numbers else None
        number = part(month) if table is None else F.try_element_at(table, part(month)).cast("string")
        return F.try_to_date(F.concat_ws("-", part(year) if isinstance(year, int) else year, F.lpad(number, 2, "0"), F.lpad(part(day), 2, "0")), "yyyy-MM-dd")

    return F.filter(F.transform(found, read), lambda d: d.isNotNull())


def parse_deadline(text: Column, as_of: str, window_years: int = 10, languages: Sequence[str] = ("en",)) -> Column:
    """The date that a deadline text states, or null.

    Day.month.year dates win, the latest of them; else the latest of ISO and month-name
    dates within the window around ``as_of``. Month names are of ``languages``, English ones also
    by three letters. A date without a year borrows the only one that the text states; a
    bare year is no date; impossible dates are passed over.
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    numeric = _dates(lower, r"\b([0-9]{1,2})\.\s?([0-9]{1,2})\.\s?(20[0-9]{2})\b", 3, 2, 1)
    numbers = {n: i + 1 for lang in languages for i, n in enumerate(MONTH_NAMES[lang])} | ({n[:3]: i + 1 for i, n in enumerate(MONTHS)} if "en" in languages else {})
    names = "|".join(sorted(numbers, key=len, reverse=True))
    years = F.array_distinct(F.regexp_extract_all(lower, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)))
    only = F.when(F.size(years) == 1, years[0]).otherwise("none")
    first, then = rf"\b([0-9]{{1,2}})(?:st|nd|rd|th|er)?\.?\s+(?:of |de )?({names})\b\.?", rf"\b({names})\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?\b"
    other = F.concat(
        _dates(lower, r"\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\b", 1, 2, 3),
        _dates(lower, rf"{first},?\s+(?:de )?([0-9]{{4}})\b", 3, 2, 1, numbers),
        _dates(lower, rf"{then},?\s+([0-9]{{4}})\b", 3, 1, 2, numbers),
        _dates(lower, rf"{first}(?!,?\s+(?:de )?[0-9]{{4}})", only, 2, 1, numbers),
        _dates(lower, rf"{then}(?!,?\s+[0-9]{{4}}|[0-9])", only, 1, 2, numbers),
    )
    near = F.filter(other, lambda d: F.abs(F.year(d) - F.year(F.to_date(F.lit(as_of)))) <= window_years)
    return F.coalesce(F.array_max(numeric), F.array_max(near))


def is_closed(deadline: Column, as_of: str) -> Column:
    """A known deadline before ``as_of``; unknown counts as open."""
    return F.coalesce(deadline < F.to_date(F.lit(as_of)), F.lit(False))


def distinct_values(df: DataFrame, value: str, lang: str) -> DataFrame:
    """Each distinct trimmed value, and whether any row in English has it."""
    v = strip(F.col(value))
    return df.where(F.col(value).isNotNull()).groupBy(v.alias("value")).agg(F.max(F.col(lang) == "en").alias("english"))


def apply_value_map(df: DataFrame, value: str, mapping: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """``canonical``: the value's labels in the vocabulary; null stays null, unmapped is empty."""
    m = mapping.select(F.col("value").alias("__v"), F.col("labels").alias("__l"))
    known = F.array_intersect(F.coalesce("__l", F.array().cast("array<string>")), F.array(*map(F.lit, vocabulary)))
    joined = df.join(m, F.regexp_replace(F.col(value), "^\\s+|\\s+$", "") == F.col("__v"), "left")
    return joined.withColumn("canonical", F.when(F.col(value).isNotNull(), known)).drop("__v", "__l")


def correct_places(df: DataFrame, city: str, country: str, cities: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The reviewed country of an id, else its city's, else the one extracted; with a change flag."""
    by_city = cities.select(F.col("city").alias("__city"), F.col("country").alias("__c1"))
    by_id = reviewed.select("id", F.col("country").alias("__c2"))
    joined = df.join(by_city, F.col(city) == F.col("__city"), "left").join(by_id, "id", "left")
    placed = joined.withColumn("place_country", F.coalesce("__c2", "__c1", country))
    return placed.withColumn("changed", ~F.col("place_country").eqNullSafe(F.col(country))).drop("__city", "__c1", "__c2")


def valid_component(df: DataFrame, periods: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Amounts without an ISO-shaped currency become null, unknown periods too; unknown categories are dropped."""
    iso = F.col("currency").rlike("^[A-Z]{3}$")
    return df.where(F.col("category").isin(*categories)).withColumns({
        "amount": F.when(iso, F.col("amount")), "currency": F.when(iso, F.col("currency")), "period": F.when(F.col("period").isin(*periods), F.col("period")),
    })


def ungrounded(df: DataFrame, amount: str, source: str) -> DataFrame:
    """Rows whose amount's digits are in no number of the source text."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(F.col(source), F.lit("")), F.lit("([0-9][0-9.,' ]*)"), F.lit(1)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    digits = F.col(amount).cast("bigint").cast("string")
    return df.where(F.col(amount).isNotNull() & ~F.exists(numbers, lambda n: F.contains(n, digits)))


def work_batches(todo: DataFrame, key: str, size: int) -> DataFrame:
    """Open keys in batches of ``size`` with their place in it, in key order.

    Ranks come from a range partition's count and the place within it, so no task sees all keys.
    """
    placed = running_sum(todo.select(key), F.lit(1), [key])
    return placed.select(key, F.floor((F.col("run") - 1) / size).alias("batch"), ((F.col("run") - 1) % size).alias("pos"))


def drop_duplicates(df: DataFrame, source: str, title: str, length: Column, key: str) -> DataFrame:
    """Pairs of dropped and kept rows of one source and title: the longest text stays, then the highest id.

    The kept row of a group is a partial maximum; only then are rows joined to it.
    """
    lean = df.select(F.col(source).alias("__s"), F.lower(F.regexp_replace(title, "^\\s+|\\s+$", "")).alias("__t"), length.alias("__len"), F.col(key).alias("__id"))
    best = lean.groupBy("__s", "__t").agg(F.max(F.struct("__len", "__id")).alias("__best"), F.count("*").alias("__n")).where("__n > 1")
    return lean.join(best, ["__s", "__t"]).where(F.col("__id") != F.col("__best.__id")).select(F.col("__id").alias("dropped"), F.col("__best.__id").alias("kept"))


def funding_labels(df: DataFrame) -> DataFrame:
    """Per call its amounts, one for each currency and period; differing amounts read "up to" the largest."""
    one = df.where("amount is not null").groupBy("opportunity_id", "currency", "period").agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    money = F.concat(F.when(F.col("lo") < F.col("hi"), "up to ").otherwise(""), F.round("hi").cast("bigint").cast("string"), F.lit(" "), F.col("currency"), F.coalesce(F.concat(F.lit(" per "), F.col("period")), F.lit("")))
    return one.withColumn("m", money).groupBy("opportunity_id").agg(F.concat_ws("; ", F.array_sort(F.collect_list("m"))).alias("label"))


def headline_funding(df: DataFrame, rates: dict[str, float], least: float, most: float) -> DataFrame:
    """Calls with exactly one money component, whose amount in EUR is within bounds."""
    rate = F.create_map(*(F.lit(x) for kv in rates.items() for x in kv))[F.col("currency")]
    one = df.where("amount is not null").groupBy("opportunity_id").agg(F.count("*").alias("n"), F.first(F.col("amount") * rate).alias("eur"))
    return one.where((F.col("n") == 1) & F.col("eur").between(least, most)).select("opportunity_id", F.round("eur", 2).alias("eur"))


#: Texts that are cut into trigrams together, and numbers of a table that goes to the tasks.
TEXTS_TOGETHER, KNOWN_NUMBERS = 256, 1 << 20


def padded_letters(text: Column) -> Column:
    """A text's lower-cased letters, with one space between words and at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+", " ")), F.lit(" "))


def letter_trigrams(text: Column) -> Column:
    """All trigrams of a text's lower-cased letters, with one space between words and at either end.

    Three copies of the text, shifted by one, are cut into pieces of three characters, so that no
    piece is found by walking the text from its start.
    """
    padded = padded_letters(text)
    pieces = lambda shift: F.regexp_extract_all(F.substring(padded, 1 + shift, 1 << 30), F.lit("(?s)(...)"), F.lit(1))
    return F.when(F.length(padded) < 3, F.array(padded)).otherwise(F.concat(pieces(0), pieces(1), pieces(2)))


def _codes(texts: Sequence[str]) -> np.ndarray:
    """The characters' numbers of texts put together, with zeros before texts of less than three."""
    return np.frombuffer("".join(t.rjust(3, "\0") for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)


def trigram_numbers(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of padded texts as numbers, 21 bits a character, and the place of each one's text."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c, row = _codes(texts), np.repeat(np.arange(len(texts)), [max(3, len(t)) for t in texts])
    inside = row[:-2] == row[2:]
    return ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside], row[:-2][inside]


def _gram(number: int) -> str:
    return "".join(chr(x) for x in (number >> 42, (number >> 21) & 0x1FFFFF, number & 0x1FFFFF) if x)


def _counted(numbers: np.ndarray, of: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds (below ``kinds``), trigrams and how often each pair occurs; in a table over the letters at hand, unless these are many."""
    parts = [numbers >> 42, (numbers >> 21) & 0x1FFFFF, numbers & 0x1FFFFF]
    seen = np.zeros(1 << 21, bool)
    for x in parts:
        seen[x] = True
    letters = np.flatnonzero(seen)
    k = len(letters)
    if kinds * k**3 > 1 << 24:
        each = [np.unique(numbers[of == i], return_counts=True) for i in range(kinds)]
        return np.repeat(np.arange(kinds), [len(x) for x, _ in each]), np.concatenate([x for x, _ in each]), np.concatenate([n for _, n in each])
    place = np.cumsum(seen) - 1
    a, b, c = (place[x] for x in parts)
    table = np.bincount(((of * k + a) * k + b) * k + c)
    at = np.flatnonzero(table)
    return at // k**3, (letters[at // k**2 % k] << 42) | (letters[at // k % k] << 21) | letters[at % k], table[at]


def trigram_counts(df: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang, gram, n``: letter trigrams of each language, null aside, counted within batches of texts first."""
    kind = dict(df.dtypes)[lang]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, each = batch.column("lang").dictionary_encode(), {}
            which = named.indices.to_numpy()
            for at in range(0, batch.num_rows, TEXTS_TOGETHER):
                numbers, row = trigram_numbers(batch.column("t").slice(at, TEXTS_TOGETHER).to_pylist())
                spoken, of = np.unique(which[at : at + TEXTS_TOGETHER], return_inverse=True)
                kinds, numbers, n = _counted(numbers, of[row], len(spoken))
                for i, x in enumerate(spoken):
                    each.setdefault(x, []).append((numbers[kinds == i], n[kinds == i]))
            for i, found in each.items():
                numbers, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([k for _, k in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(np.full(len(n), i))), pa.array([_gram(x) for x in numbers.tolist()], pa.string()), pa.array(n)], names=["lang", "gram", "n"])

    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), padded_letters(F.col(text)).alias("t"))
    return rows.mapInArrow(make, f"lang {kind}, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language_profiles(df: DataFrame, lang: str, text: str, most: int = 500) -> DataFrame:
    """``lang, gram, logp``: each language's most frequent letter trigrams; counts are summed in tasks first."""
    counts = trigram_counts(df, lang, text)
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return top.select("lang", "gram", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("logp"))


def trusted_language(df: DataFrame, sources: DataFrame, detected: str, confidence: str, least: float = 0.9) -> DataFrame:
    """A source's language unless it is English; else the detected one where it is sure; else English."""
    tag = sources.select("source", F.col("lang").alias("__tag"))
    joined = df.join(tag, "source", "left")
    return joined.withColumn("row_language", F.when(F.col("__tag") != "en", F.col("__tag")).when(F.col(confidence) >= least, F.col(detected)).otherwise("en")).drop("__tag")


def quoted_disciplines(labels: Column, quotes: Column, text: Column, own: Column, vocabulary: Sequence[str]) -> Column:
    """A call's disciplines with those whose quote is in its text, in the vocabulary's order."""
    body = F.lower(F.regexp_replace(text, "\\s+", " "))
    found = F.filter(F.arrays_zip(labels.alias("l"), quotes.alias("q")), lambda x: F.contains(body, F.lower(x["q"])))
    every = F.array_union(F.coalesce(own, F.array().cast("array<string>")), F.transform(found, lambda x: x["l"]))
    return F.filter(F.array(*map(F.lit, vocabulary)), lambda v: F.array_contains(every, v))


def accepted_translation(original: Column, translated: Column) -> Column:
    """A translated list only where it has as many items; kinds are copied by position."""
    return F.when(F.size(original) == F.size(translated), F.zip_with(original, translated, lambda o, t: F.struct(o["kind"].alias("kind"), t.alias("item"))))


def fee_label(has_fee: Column, amount: Column, currency: Column) -> Column:
    """What a card says about the fee; not stated is not the same as none."""
    money = F.trim(F.concat(F.coalesce(currency, F.lit("")), F.lit(" "), F.format_number(amount, 0)))
    return F.when(has_fee.isNull(), "Not stated").when(~has_fee, "None").when(amount.isNull(), "Yes, amount not stated").otherwise(money)


def shown_countries(countries: Column, anywhere: str) -> Column:
    """A call's countries without the wildcard; "International" where that is all."""
    named = F.array_remove(countries, anywhere)
    return F.when((F.size(named) == 0) & F.array_contains(countries, anywhere), F.array(F.lit("International"))).otherwise(named)


def shown_disciplines(disciplines: Column, other: str) -> Column:
    """A call's disciplines without the one that says nothing about the arts."""
    return F.array_remove(disciplines, other)


def card_funding(df: DataFrame, raw: str = "funding", light: Sequence[str] = ("mentoring", "fee waiver")) -> DataFrame:
    """A call's funding in one line: amounts, one for each currency and period, then support without a figure, money and support in kind first; else the call's own words.

    ``opportunity_id, category, amount, currency, period`` and ``raw`` in.
    """
    key = "opportunity_id"
    amounts = df.where("amount is not null").groupBy(key, "currency", "period").agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    period = F.when(F.coalesce("period", F.lit("one-time")) == "one-time", "").otherwise(F.concat(F.lit(" "), "period"))
    said = F.concat(F.when(F.col("lo") < F.col("hi"), "up to ").otherwise(""), F.coalesce("currency", F.lit("")), F.lit(" "), F.format_number("hi", 0), period)
    money = amounts.groupBy(key).agg(F.array_sort(F.collect_list(said)).alias("__m"))
    kinds = df.where("amount is null and category is not null").select(key, F.lower("category").alias("c")).distinct()
    support = kinds.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("c").isin(*light).alias("l"), "c"))), lambda x: x["c"]).alias("__s"))
    words = df.groupBy(key).agg(F.max(raw).alias("__raw"))
    joined = words.join(money, key, "left").join(support, key, "left")
    none = F.array().cast("array<string>")
    label = F.concat_ws(" + ", F.concat(F.coalesce("__m", none), F.coalesce("__s", none)))
    first = F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 100_000))
    return joined.select(key, F.when(label != "", first).otherwise(F.coalesce("__raw", F.lit("Not stated"))).alias("label"))


def _joined_sums(df: DataFrame, key: str, text: str, profiles: DataFrame) -> DataFrame:
    """``key, lang, s``: as ``_known_sums``, by a join of each text's trigrams with the profiles, which may be of any size."""
    counts = df.select(F.col(key).alias("key"), F.explode(letter_trigrams(F.col(text))).alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("n"))
    floor = profiles.groupBy("lang").agg(F.min("logp").alias("least"))
    every = profiles.select("gram").distinct().crossJoin(floor).join(profiles, ["lang", "gram"], "left").select("gram", "lang", F.coalesce("logp", "least").alias("logp"))
    return counts.join(every, "gram").groupBy("key", "lang").agg(F.sum(F.col("n") * F.col("logp")).alias("s"))


def _known_sums(df: DataFrame, key: str, text: str, profiles: DataFrame) -> DataFrame:
    """``key, lang, s``: log-probabilities of each text by language, summed where the text lies; the profiles go to the tasks."""
    rows = profiles.collect()  # KNOWN_NUMBERS at most
    langs, grams = sorted({r.lang for r in rows}), sorted({r.gram for r in rows})
    known = np.array([trigram_numbers([g])[0][0] for g in grams], np.int64)
    order = np.argsort(known)
    place, column = {grams[i]: k for k, i in enumerate(order)}, {x: i for i, x in enumerate(langs)}
    logp = np.full((len(grams), len(langs)), np.nan)
    for r in rows:
        logp[place[r.gram], column[r.lang]] = r.logp
    sent = df.sparkSession.sparkContext.broadcast((known[order], np.where(np.isnan(logp), np.nanmin(logp, axis=0), logp)))
    together, types = max(1, min(TEXTS_TOGETHER, (1 << 22) // len(grams))), [dict(df.dtypes)[key], dict(profiles.dtypes)["lang"]]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logp = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, together):
                part = batch.slice(start, together)
                numbers, row = trigram_numbers(part.column("t").to_pylist())
                at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
                hit = known[at] == numbers
                counts = np.bincount(row[hit] * len(known) + at[hit], minlength=part.num_rows * len(known)).reshape(part.num_rows, -1)
                told = np.flatnonzero(counts.any(axis=1))
                keys = part.column("key").take(pa.array(np.repeat(told, len(langs))))
                yield pa.RecordBatch.from_arrays([keys, pa.array(langs * len(told)), pa.array((counts[told] @ logp).ravel())], names=["key", "lang", "s"])

    texts = df.select(F.col(key).alias("key"), padded_letters(F.col(text)).alias("t"))
    return texts.mapInArrow(make, f"key {types[0]}, lang {types[1]}, s double").groupBy("key", "lang").agg(F.sum("s").alias("s"))


def language_scores(df: DataFrame, key: str, text: str, profiles: DataFrame) -> DataFrame:
    """``key, detected, confidence``: the language whose trigram profile gives a text the largest log-probability, and its softmax share.

    Each text's trigrams are looked up in the profiles where the text lies; profiles beyond
    ``KNOWN_NUMBERS`` (trigrams times languages) are joined instead. A
    trigram that a profile lacks has the profile's least probability, one that no profile
    has is left out. Texts without any known trigram are absent.
    """
    size = profiles.agg(F.count_distinct("lang").alias("langs"), F.count_distinct("gram").alias("grams")).first()
    sums = (_known_sums if 0 < size.langs * size.grams <= KNOWN_NUMBERS else _joined_sums)(df, key, text, profiles)
    all_of = Window.partitionBy("key")
    share = F.exp(F.col("s") - F.max("s").over(all_of))
    placed = sums.withColumn("share", share).withColumn("confidence", F.col("share") / F.sum("share").over(all_of)).withColumn("r", F.row_number().over(all_of.orderBy(F.desc("s"), "lang")))
    return placed.where("r = 1").select("key", F.col("lang").alias("detected"), "confidence")
