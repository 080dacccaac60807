"""Discovery, link harvesting, incremental merge and acceptance of pages."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.text import flattened, folded, strip

DEAD_LINK = "^(#|mailto:|tel:|javascript:)"
#: Hosts whose links are never calls.
SOCIAL = ("facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com")


def make_id(url: Column, prefix: str) -> Column:
    """The prefix and the first 12 hex digits of the URL's SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(url, 256), 1, 12))


def normalise_link(href: Column, base: Column) -> Column:
    """An absolute URL without its fragment; null for dead and social links.

    Absolute links stay, links from the root take the base's scheme and host, others
    replace what follows the base's last slash.
    """
    link = F.regexp_replace(F.regexp_replace(href, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", ""), "#.*$", "")
    root = F.regexp_extract(base, "^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^(.*/)", 1)
    full = F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))
    host = F.regexp_extract(full, "^[a-z]+://(?:www\\.)?([^/?#:]+)", 1)
    return F.when(href.rlike(DEAD_LINK) | (link == "") | host.isin(*SOCIAL), F.lit(None)).otherwise(full)


def harvest_links(pages: DataFrame, key: str, base: str, html: str) -> DataFrame:
    """``key, pos, url, title`` of a page's anchors, within <main> where there is one.

    The first anchor of each URL counts; anchors without text are left out; page order stays.
    """
    inner = F.regexp_extract(html, "(?s)<main[^>]*>(.*?)</main>", 1)
    scope = F.when(inner != "", inner).otherwise(F.col(html))
    anchors = F.regexp_extract_all(scope, F.lit("(?s)(<a [^>]*>.*?</a>)"), F.lit(1))
    rows = pages.select(F.col(key).alias("key"), F.col(base).alias("base"), F.posexplode(anchors).alias("pos", "a"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("a", "<[^>]*>", " "), "[ \\t\\r\\n]+", " "), "^ | $", "")
    links = rows.select("key", "pos", normalise_link(F.regexp_extract("a", "href=\"([^\"]*)\"", 1), F.col("base")).alias("url"), text.alias("title"))
    good = links.where("url is not null and title <> ''")
    first = Window.partitionBy("key", "url").orderBy("pos")
    return good.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def fingerprint(links: DataFrame) -> DataFrame:
    """One hash for each page's set of links, whatever their order."""
    joined = F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("|", "url", "title"))))
    return links.groupBy("key").agg(F.sha2(joined, 256).alias("hash"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Keys whose hash is new or differs."""
    old = before.select("key", F.col("hash").alias("__old"))
    return now.join(old, "key", "left").where(~F.col("hash").eqNullSafe(F.col("__old"))).select("key")


def seen_ids(*tables: DataFrame) -> DataFrame:
    """Ids of any stage."""
    out = tables[0].select("id")
    for other in tables[1:]:
        out = out.unionByName(other.select("id"))
    return out.distinct()


def unseen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates whose id no stage holds."""
    return candidates.join(seen.select("id"), "id", "left_anti")


def merge_by_id(old: DataFrame, new: DataFrame, key: str = "id", position: str | None = None) -> DataFrame:
    """New rows take the place of old ones, one a key: of repeated new rows the last by ``position``, or the largest without one.

    Old rows are only anti-joined, so they are not sorted or aggregated.
    """
    row = F.struct(*new.columns)
    once = new.groupBy(key).agg((F.max(row) if position is None else F.max_by(row, F.struct(position, row))).alias("__r")).select("__r.*")
    return old.join(new.select(key), key, "left_anti").unionByName(once)


def last_per_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key in file order."""
    w = Window.partitionBy(key).orderBy(F.desc(position))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def manual_intake(df: DataFrame, required: Sequence[str], url: str, position: str, prefix: str = "manual") -> DataFrame:
    """Trimmed rows with all required columns, the last one per URL, with their id."""
    trimmed = df.withColumns({c: F.nullif(strip(F.col(c)), F.lit("")) for c in required})
    whole = trimmed.dropna(subset=list(required))
    return last_per_key(whole, url, position).withColumn("id", make_id(F.col(url), prefix))


def rank_documents(links: DataFrame, call_words: str, skip_words: str, top: int = 3) -> DataFrame:
    """A page's best linked documents: 3 for a call word, 2 within the content, 1 on the same host, 2 at least."""
    fold = folded(F.concat_ws(" ", "url", "title"))
    score = F.when(fold.rlike(call_words), 3).otherwise(0) + F.when(F.col("in_content"), 2).otherwise(0) + F.when(F.col("same_host"), 1).otherwise(0)
    kept = links.withColumn("score", score).where((F.col("score") >= 2) & ~fold.rlike(skip_words))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "pos")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("key", "rank", "url", "score")


def site_wide(links: DataFrame, least: int = 10) -> DataFrame:
    """URLs that so many pages link to; not specific to any of them."""
    return links.groupBy("url").agg(F.countDistinct("key").alias("n_pages")).where(F.col("n_pages") >= least)


PLACEHOLDER = "(?i)^\\s*(not (stated|specified|available|provided|mentioned)|n/?a|none|unknown|tbd|-+)\\s*\\.?\\s*$"


def drop_placeholders(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Words that stand for a missing value become null."""
    return df.withColumns({c: F.when(F.col(c).rlike(PLACEHOLDER), F.lit(None)).otherwise(F.col(c)) for c in columns})


def verbatim_misses(df: DataFrame, source: str, fields: Sequence[str]) -> Column:
    """C14: names of fields of which a piece of three or more words is not in the source."""
    body = flattened(F.coalesce(F.col(source), F.lit("")))

    def miss(field: str) -> Column:
        pieces = F.filter(F.transform(F.split(F.coalesce(F.col(field), F.lit("")), "[.;:!?\\n]+"), flattened), lambda p: F.size(F.split(p, " ")) >= 3)
        # the source is flattened once, as the item of a list, and not for each piece
        found = F.get(F.transform(F.array(body), lambda b: F.forall(pieces, lambda p: F.contains(b, p))), 0)
        return F.when(~found, F.lit(field))

    return F.array_compact(F.array(*map(miss, fields)))


def gate(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``reason`` is the first rule that holds; null means accepted."""
    reason = F.coalesce(*(F.when(c, F.lit(name)) for name, c in rules))
    return df.withColumn("reason", reason)


def furthest_stage(curated: DataFrame, stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """C20: for each id the first of the stages, ordered from the furthest, that holds it."""
    out = curated.select("id")
    for name, table in stages:
        out = out.join(table.select("id", F.lit(name).alias(f"__{name}")).distinct(), "id", "left")
    return out.select("id", F.coalesce(*(F.col(f"__{n}") for n, _ in stages), F.lit("not added")).alias("stage"))


def never_extracted(sources: DataFrame, *tables: DataFrame) -> DataFrame:
    """Sources of which no table has a row."""
    done = tables[0].select("source")
    for other in tables[1:]:
        done = done.union(other.select("source"))
    return sources.select("source").distinct().join(done, "source", "left_anti")


def attach_texts(pages: DataFrame, attached: DataFrame, most: int | None = None) -> DataFrame:
    """Page texts with their documents' whole texts below, in rank order; only a given ``most`` cuts each to so many characters."""
    body = F.col("text") if most is None else F.substring("text", 1, most)
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n"), body)
    more = attached.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))).alias("m"))
    joined = pages.join(more, "key", "left")
    return joined.withColumn("text", F.concat_ws("\n", "text", F.transform("m", lambda x: x["t"]))).drop("m")


def deadline_passed(deadline_text: Column, title: Column, parsed: Column, as_of: str) -> Column:
    """Whether a call is over: rolling or no text is not; then years alone, then the parsed date.

    Without a year in the deadline the title's only year counts. A last year before this
    one is over; else the parsed date decides, and an unknown one is not over.
    """
    years = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("\\b(20[0-9]{2})\\b"), F.lit(1)))
    mine, titled = years(deadline_text), years(title)
    used = F.when(F.size(mine) > 0, mine).when(F.size(titled) == 1, titled).otherwise(F.array().cast("array<string>"))
    today = F.to_date(F.lit(as_of))
    rolling = F.lower(deadline_text).rlike("\\b(rolling|ongoing|open-ended)\\b")
    return F.when(deadline_text.isNull() | rolling | (F.size(used) == 0), False).when(F.array_max(used).cast("int") < F.year(today), True).otherwise(F.coalesce(parsed <= today, F.lit(False)))


KINDS = [("deadline passed", "deadline passed"), ("not open to individuals", "not open to individuals"), ("fetch/extract error", "fetch/extract error")]


def reason_kind(reason: Column) -> Column:
    """C17: the kind of a reason of rejection, by how it begins."""
    return F.coalesce(*(F.when(reason.startswith(p), F.lit(n)) for n, p in KINDS), F.lit("other"))


def extraction_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """C17: per outcome of a second extraction: pages, and mean lengths of the requirements before and after.

    ``id, status (accepted or rejected), requirements_text`` on both sides, ``reason`` on the
    new one; a page that could not be read again is an error.
    """
    before = old.select("id", F.col("status").alias("__a"), F.length("requirements_text").alias("__la"), F.col("requirements_text").alias("__ta"))
    both = before.join(new.select("id", F.col("status").alias("__b"), F.length("requirements_text").alias("__lb"), F.col("requirements_text").alias("__tb"), "reason"), "id")
    failed = F.coalesce(F.col("reason").startswith("fetch/extract error"), F.lit(False))
    same = F.when(F.col("__ta").eqNullSafe(F.col("__tb")), "unchanged").otherwise("changed")
    kind = F.when(failed, "error").when((F.col("__a") == "accepted") & (F.col("__b") == "accepted"), same).otherwise(F.concat_ws(" to ", "__a", "__b"))
    return both.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("__la"), 4).alias("mean_before"), F.round(F.avg("__lb"), 4).alias("mean_after"))


def rejection_kinds(new: DataFrame) -> DataFrame:
    """C17: rejected pages by kind of reason."""
    return new.where("status = 'rejected'").groupBy(reason_kind(F.coalesce("reason", F.lit(""))).alias("kind")).agg(F.count("*").alias("n"))


def filled_shares(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """C17: of accepted rows the share with each field stated; one pass."""
    stated = [F.round(F.avg(F.coalesce((F.trim(F.col(f).cast("string")) != "").cast("double"), F.lit(0.0))), 6).alias(f) for f in fields]
    return df.agg(*stated).select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("share")) for f in fields))).alias("x")).select("x.*")


def flags_per_field(df: DataFrame, flags: str) -> DataFrame:
    """C17: rows by the field that a flag names; a flag of a list item counts for its list."""
    return df.select(F.explode(flags).alias("f")).groupBy(F.substring_index("f", "[", 1).alias("field")).agg(F.count("*").alias("n"))


BROKEN = "\u00c3[\u0080-\u00bf]|\u00e2\u20ac|\ufffd"


def badly_read(df: DataFrame, text: str, least: int = 300) -> DataFrame:
    """Pages with fewer characters than ``least``, or with letters that were read in a wrong encoding."""
    why = F.when(F.length(F.coalesce(F.col(text), F.lit(""))) < least, "short").when(F.col(text).rlike(BROKEN), "mojibake")
    return df.withColumn("why", why).where("why is not null")


def applied(raw: DataFrame, rejected: DataFrame, processed: DataFrame, pages: DataFrame, results: DataFrame, passed: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables after a second extraction: accepted, rejected, processed, and counts by outcome.

    ``pages``: ``id, status`` (accepted or rejected). ``results``: ``id, status, body, reason``; pages that could not be
    read have none, or one that says fetch/extract error: of these only accepted ones that
    are over (``passed``, on ``raw``) move. Ids whose accepted row changed or left go out of
    ``processed``. ``raw``: ``id, body`` and what ``passed`` reads; ``rejected``: ``id, reason``.
    """
    read = results.where(~F.coalesce(F.col("reason").startswith("fetch/extract error"), F.lit(False))).select("id", F.col("status").alias("__s"), F.col("body").alias("__b"), F.col("reason").alias("__r"))
    over = raw.select("id", F.coalesce(passed, F.lit(False)).alias("__over"), F.col("body").alias("__old"))
    all_ids = pages.select("id", "status").join(read, "id", "left").join(over, "id", "left")
    move = (
        F.when(F.col("__s") == "accepted", "accepted").when(F.col("__s") == "rejected", "rejected")
        .when((F.col("status") == "accepted") & F.coalesce("__over", F.lit(False)), "expired").when(F.col("status") == "accepted", "kept").otherwise("unread")
    )
    judged = all_ids.withColumn("outcome", move)
    into, out = judged.where("outcome = 'accepted'"), judged.where("outcome in ('rejected', 'expired')")
    new_raw = raw.select("id", "body").join(into.union(out).select("id"), "id", "left_anti").union(into.select("id", "__b"))
    why = F.when(F.col("outcome") == "expired", "deadline passed").otherwise(F.col("__r"))
    new_rejected = rejected.select("id", "reason").join(into.union(out).select("id"), "id", "left_anti").union(out.select("id", why))
    changed = into.where(~F.col("__b").eqNullSafe(F.col("__old"))).select("id").union(out.where("__over is not null").select("id"))
    return new_raw, new_rejected, processed.join(changed, "id", "left_anti"), judged.groupBy("outcome").agg(F.count("*").alias("n"))


#: Pages whose texts a worker holds before it hands them on.
PAGES_AT_ONCE = 256


def read_pages(batches, least: int):
    """C11: ``key, text`` of batches of ``key, html``; only a few pages at a time are Python strings."""
    import pyarrow as pa

    for whole in batches:
        for at in range(0, whole.num_rows, PAGES_AT_ONCE):
            batch = whole.slice(at, PAGES_AT_ONCE)
            texts = [page_text(h or "", least) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])


def content_text(df: DataFrame, key: str, html: str, most: int | None = None, least: int = 300) -> DataFrame:
    """C11: ``key, text`` of the part of a page that holds the call, without menus and the page's own head and foot.

    The first <article> with ``least`` characters of text, else <main>, else the page. <nav> goes
    everywhere, <header> and <footer> only outside <article>, <main> and <section>. A batch of pages at a
    time through the standard library's parser; ``most`` is the feature's budget of characters, off unless given.
    """

    def read(batches):
        return read_pages(batches, least)

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(read, f"key {kind}, text string")
    return out if most is None else out.withColumn("text", F.substring("text", 1, most))


#: Elements whose text nobody sees, and those that have no end.
HIDDEN = {"script", "style", "template"}
VOID = {"br", "hr", "img", "input", "link", "meta", "wbr", "area", "base", "col", "embed", "source", "track"}
Path = tuple[tuple[str, int], ...]


class Page(HTMLParser):
    """One page, read as a stream of tags: pieces of text and anchors, each with the elements around it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.count = 0
        self.pieces: list[tuple[str, Path]] = []
        self.anchors: list[tuple[str, list[str], Path]] = []
        self.inside: list[int] = []  # numbers of open anchors, by the element that opened them
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.count += 1
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.anchors.append((href, [], tuple(self.open)))
            self.inside.append(self.count)
        self.open = [*self.open, (tag, self.count)]

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            self.inside = [n for n in self.inside if n not in {k for _, k in self.open[at:]}]
            self.open = self.open[:at]

    def handle_data(self, data):
        if data.strip() and not any(t in HIDDEN for t, _ in self.open):
            said = " ".join(data.split())
            self.pieces.append((said, tuple(self.open)))
            if self.inside:
                self.anchors[-1][1].append(said)

    def first(self, tag: str) -> tuple[str, int] | None:
        """The page's first element of a kind that holds text or a link."""
        paths = [p for _, p in self.pieces] + [p for *_, p in self.anchors]
        return min((e for p in paths for e in p if e[0] == tag), key=lambda e: e[1], default=None)

    def content(self, least: int) -> tuple[str, int] | None:
        """The element that holds the call: the first article with ``least`` characters, else main; none for the page."""
        for tag in ("article", "main"):
            found = self.first(tag)
            if found and len(" ".join(t for t, p in self.pieces if found in p)) >= least:
                return found
        return None


def is_chrome(path: Path) -> bool:
    """Whether something lies in a menu, or in the head or foot of the page rather than of its content."""
    tags = [t for t, _ in path]
    outer = [i for i, t in enumerate(tags) if t in ("header", "footer")]
    return "nav" in tags or any(not {"article", "main", "section"} & set(tags[:i]) for i in outer)


def page_text(html: str, least: int) -> str:
    """The text of one page's content scope, its pieces joined by one space."""
    page = Page(html)
    scope = page.content(least)
    return " ".join(t for t, path in page.pieces if (scope is None or scope in path) and not is_chrome(path))


def page_links(pages: DataFrame, key: str, base: str, html: str, least: int = 300) -> DataFrame:
    """``key, pos, url, title, in_main, in_content, in_chrome, same_host`` of all anchors of a page with a place to go.

    ``in_main``: within <main>, or the page has none; ``in_content``: within the element that
    holds the call, or there is none; ``in_chrome``: within a menu, or the page's head or foot;
    ``same_host``: the link stays on the page's host. Null pages give none. Pages are read a
    batch at a time by the standard library's parser.
    """
    kind = pages.schema[key].dataType.simpleString()

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for k, where, text in zip(*(batch.column(c).to_pylist() for c in ("key", "base", "html")), strict=True):
                page = Page(text or "")
                main, scope = page.first("main"), page.content(least)
                out += [(k, where, i, href, " ".join(said), main is None or main in path, scope is None or scope in path, is_chrome(path)) for i, (href, said, path) in enumerate(page.anchors)]
            types = (batch.column("key").type, pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "base", "pos", "href", "title", "in_main", "in_content", "in_chrome"])

    rows = pages.select(F.col(key).alias("key"), F.col(base).alias("base"), F.col(html).alias("html"))
    found = rows.mapInArrow(read, f"key {kind}, base string, pos int, href string, title string, in_main boolean, in_content boolean, in_chrome boolean")
    host = lambda c: F.lower(F.regexp_extract(c, "^[a-zA-Z]+://([^/?#]+)", 1))
    named = found.withColumn("url", normalise_link(F.col("href"), F.col("base"))).where("url is not null")
    return named.select("key", "pos", "url", "title", "in_main", "in_content", "in_chrome", (host(F.col("url")) == host(F.col("base"))).alias("same_host"))


def main_links(links: DataFrame) -> DataFrame:
    """``key, pos, url, title`` of the links that a crawl follows: within <main>, with text, the first of each URL; ``pos`` counts a page's anchors there."""
    inner = links.where("in_main")
    first = inner.where("title <> ''").groupBy("key", "url").agg(F.min(F.struct("pos", "title")).alias("m"))
    start = inner.groupBy("key").agg(F.min("pos").alias("__p"))
    return first.join(start, "key").select("key", (F.col("m.pos") - F.col("__p")).alias("pos"), "url", "m.title")
