"""Links with their place on the page."""

from callweave.operators import ingest

LONG = "Long text about the call. " * 20
PAGE = f"""<html><header><a href="/home">Home</a></header><nav><a href="/menu">Menu <b>one</b></a></nav>
<main><article><header><a href="#top">Top</a><a href="form.pdf">The <i>form</i></a></header>{LONG}<a href="https://b.org/x"><img src="i.png"></a></article><a href="form.pdf">Again</a></main>
<footer><a href="HTTPS://A.org/terms.pdf">Terms</a><a>no place</a><a href="mailto:me@a.org">Mail</a></footer><script>var x = '<a href="/no">no</a>';</script></html>"""


def test_links_know_their_place(spark):
    rows = [(1, "https://a.org/calls/1", PAGE), (2, "https://a.org/c", "<p>x <a href='y'>Y</a></p><a href='/z'>open"), (3, "https://a.org/c", None)]
    df = spark.createDataFrame(rows, "id int, url string, html string")
    links = ingest.page_links(df, "id", "url", "html")
    got = {(r.key, r.url, r.title): (r.in_main, r.in_content, r.in_chrome, r.same_host) for r in links.collect()}
    assert got == {
        (1, "https://a.org/home", "Home"): (False, False, True, True), (1, "https://a.org/menu", "Menu one"): (False, False, True, True),
        (1, "https://a.org/calls/form.pdf", "The form"): (True, True, False, True), (1, "https://b.org/x", ""): (True, True, False, False), (1, "https://a.org/calls/form.pdf", "Again"): (True, False, False, True),
        (1, "https://a.org/calls/HTTPS://A.org/terms.pdf", "Terms"): (False, False, True, True),
        (2, "https://a.org/y", "Y"): (True, True, False, True), (2, "https://a.org/z", "open"): (True, True, False, True),
    }
    main = {(r.key, r.url, r.title) for r in ingest.main_links(links).collect()}
    assert main == {(1, "https://a.org/calls/form.pdf", "The form"), (2, "https://a.org/y", "Y"), (2, "https://a.org/z", "open")}


def test_a_page_is_read_once_for_text_and_links():
    page = ingest.Page(PAGE)
    assert page.content(300)[0] == "article" and page.content(10_000) is None and page.first("main")[0] == "main"
    assert ingest.page_text(PAGE, 300).startswith("Top The form Long text") and "Menu" not in ingest.page_text(PAGE, 10_000)


def test_work_pages(spark):
    from callweave.operators import facts

    lines = [
        ("Ada Field", None), ("Surplus", None), ("2026 - 1 channel video - 14 min", None), ("A film of found footage.", None), ("It goes on.", None), ("12", None), ("Not told any more.", None),
        ("City Loop", None), ("(for six screens)", None), ("Sound piece. 2018 - 2019", None), ("Walks on rubble.", None), ("Installation view", None),
        ("MFA Painting", "Education"), ("2016 - 2018", "Education"), ("Lives in Wells", None), ("Lives in Wells since 2018", None), ("Memories", "Works"), ("2021", "Other"), ("Last Work", "Works"), ("2012", "Works"),
    ]
    df = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(lines)] + [(2, 0, "2020", None), (2, 1, "Only a title", None)], "key int, pos int, line string, section string")
    got = {r.title: (r.pos, r.years, r.medium, r.summary, r.status) for r in facts.work_pages(df, "2026-05-01").collect()}
    assert got == {
        "Surplus": (1, "2026", "1 channel video - 14 min", "A film of found footage. It goes on.", "current"),
        "City Loop": (7, "2018 - 2019", "Sound piece", "Walks on rubble.", "past"),
        "Last Work": (18, "2012", None, None, "past"),
    }
    assert facts.work_pages(df.where("false"), "2026-05-01").count() == 0
