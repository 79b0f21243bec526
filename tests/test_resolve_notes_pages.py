import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import notes, pages
from broadsheet.operators.resolve import removal_set, resolve_values
from broadsheet.schemas import NOTE, VALUE
from tests.test_functions import plain_slug

SITE = "site.org"


def by_hand(values, stored):
    """The rules, pair by pair."""
    matched, blocked, warned = set(), set(), set()
    for value in {v for v in values if v and v.strip()}:
        low = value.lower()
        if low.startswith(("http://", "https://")):
            host = low.split("://")[1].split("/")[0].split("#")[0].split("?")[0]
            if host == SITE:
                fragment = value.partition("#")[2]
                if not fragment:
                    warned.add(value)
                for url, title, _ in stored:
                    slug = plain_slug(title, url)
                    if fragment and (fragment == slug or fragment.startswith(slug + "-")):
                        matched.add(url)
                continue
            key = low.split("#")[0].rstrip("/")
            hits = {u for u, _, _ in stored if u.rstrip("/") == key} or {u for u, _, _ in stored if key in u.lower()}
            matched |= hits
            if not hits:
                blocked.add(key)
        else:
            hits = set()
            for url, title, source in stored:
                slug = plain_slug(title, url)
                if any(low in (x or "").lower() for x in (url, title, source)) or low in slug or slug in low:
                    hits.add(url)
            matched |= hits
            if not hits:
                warned.add(value)
    return {("matched", k) for k in matched} | {("preemptive", k) for k in blocked} | {("warning", k) for k in warned}


STORED = [
    ("https://a.org/news/1", "Hello, World", "Daily"), ("https://a.org/news/12/", "Hello, World!", "Daily"),
    ("https://b.org/x", None, None), ("https://c.org/é", "été à Paris", "Le Jour"),
    ("https://a.org/sports", "A very " + "long " * 30 + "title", "weekly"),
]
VALUES = [
    "HTTPS://A.org/news/1/#top", "https://a.org/news/12", "https://a.org/news", "https://a.org/none",
    "https://site.org/", "https://site.org/#hello-world", "https://SITE.org/x#hello-world-2", "https://site.org/#nope",
    "WEEKLY", "paris", "say hello-world again", "zzz", "", "  ", None, "é", "a", "https://a.org/news/1?x=1#y",
    "orld! ", "https://a.org/" + "long" * 40,
]


def test_rules(spark):
    articles = spark.createDataFrame(STORED, "url string, title string, source string")
    values = spark.createDataFrame([(v,) for v in VALUES + VALUES], VALUE)
    got = resolve_values(values, articles, SITE)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(by_hand(VALUES, STORED))
    assert removal_set(got).count() == len({k for o, k in rows if o != "warning"})


def test_many_values_share_an_ending(spark):
    tail = "?utm_source=newsletter&utm_medium=email"
    stored = [(f"https://p.org/{i}/story{tail}", "same title", "s") for i in range(60)]
    values = [f"https://p.org/{i}{j}/story{tail}" for i in range(20) for j in ("", "x")] + [f"{i}/story{tail}" for i in range(30)]
    random.Random(1).shuffle(values)
    articles = spark.createDataFrame(stored, "url string, title string, source string")
    got = resolve_values(spark.createDataFrame([(v,) for v in values], VALUE), articles, SITE)
    assert sorted(tuple(r) for r in got.collect()) == sorted(by_hand(values, stored))


def test_no_pairwise_join(spark, plan):
    articles = spark.createDataFrame(STORED, "url string, title string, source string")
    values = spark.createDataFrame([(v,) for v in VALUES], VALUE)
    text = plan(resolve_values(values, articles, SITE))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def note(i, text="", **more):
    row = {"id": f"{i}", "html": "", "text": text, "title": "", "createdAt": 1.0, "tagLinks": "[]", "trashed": 0, "deleted": 0}
    row.update(more)
    return tuple(row[f] for f in NOTE.names)


def test_matching_notes(spark, rows):
    df = spark.createDataFrame([
        note(1, tagLinks='["Press45"]'), note(2, title="A RIVER runs"), note(3, "the river"), note(4, tagLinks='["other"]'),
        note(5, "river", trashed=1), note(6, "river", deleted=1), note(7, text=None, title=None, tagLinks=None),
    ], NOTE)
    assert rows(notes.matching_notes(df, "press45", "River"), "id") == [("1",), ("2",), ("3",)]


def test_note_links(spark):
    texts = {
        "Head\n#tag\nhttps://a.org/1\nBy": "https://a.org/1",
        "Head\r\n\t https://a.org/2.,) \r\nBy": "https://a.org/2",
        "see https://a.org/3 here": None,
        "1\n2\n3\n4\n5\n6\nhttps://a.org/late": None,
        "1\n2\n3\n4\n5\nhttps://a.org/sixth": "https://a.org/sixth",
        "http://localhost:9/x\nhttps://a.org/4": "https://a.org/4",
        "https://a.org/5 ": "https://a.org/5",
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(notes.note_source_url()).collect()] == list(texts.values())
    html = spark.createDataFrame([('<a href="http://localhost/i"><a href="/rel"><a href="https://x.org/1">',), (None,)], "html string")
    assert [r[0] for r in html.select(notes.note_hint_link()).collect()] == ["https://x.org/1", None]


def test_note_funnel(spark, rows):
    df = spark.createDataFrame([
        note(1, "https://a.org/1"), note(2, "https://a.org/1"), note(3, "https://A.org/1"), note(4, "https://www.YouTube.com/w"),
        note(5, "nothing"), note(6, "https://notyoutube.com/w"),
    ], NOTE)
    resolved = notes.resolve_notes(df)
    assert notes.note_funnel(resolved).first().asDict() == {"matching": 6, "candidates": 3, "unresolved": 1, "excluded": 1}
    assert rows(notes.note_candidates(resolved), "id") == [("1",), ("3",), ("6",)]
    assert rows(notes.note_candidates(resolved, limit=2), "id") == [("1",), ("3",)]


FULL = '<html><head><meta property="og:title" content="T &amp; U"><meta content=\'It is "so"\' property=\'og:description\'/>' \
       '<meta property="article:published_time" content="2026-07-01T10:00:00Z"><title>other</title></head></html>'


def test_page_metadata(spark):
    cases = [
        (FULL, ("T & U", 'It is "so"', "2026-07-01")),
        ("<title>\n Only &lt;this&gt; </title><h1>x</h1>", ("Only <this>", None, None)),
        ('<h1><b>Bold</b> head</h1><meta name="description" content="d"><time datetime="2026-01-02">x</time>', ("Bold head", "d", "2026-01-02")),
        ("<p>nothing</p>", (None, None, None)),
        (None, (None, None, None)),
    ]
    df = spark.createDataFrame([(i, "https://H.org/x", h) for i, (h, _) in enumerate(cases)], "page_id int, url string, html string")
    out = pages.extract_page_metadata(df).orderBy("page_id").select("title", "description", "published_at")
    assert [tuple(r) for r in out.collect()] == [w for _, w in cases]


def test_ingest_statuses(spark, articles, exclusions, rows):
    data = [
        (1, "https://A.org/1", FULL, None), (2, "https://a.org/1", FULL, None), (3, "https://a.org/stored", FULL, None),
        (4, "https://a.org/barred/", FULL, None), (5, "https://a.org/5", None, None), (6, "https://a.org/6", "<title>t</title>", None),
        (7, "https://a.org/7", "<title>t</title><time datetime='2026-01-01'>", "given"),
    ]
    df = spark.createDataFrame(data, "page_id int, url string, html string, set_description string")
    out = pages.classify_ingest(df, articles({"url": "https://a.org/stored"}), exclusions("https://a.org/barred"))
    assert rows(out, "page_id", "status", "detail") == [
        (1, "inserted", "T & U"), (2, "duplicate", None), (3, "duplicate", None), (4, "duplicate", None),
        (5, "fetch_failed", None), (6, "missing_fields", "description, published_at"), (7, "inserted", "t"),
    ]
    assert rows(pages.inserted_articles(out), "url", "description", "source", "manual_review") == [
        ("https://a.org/1", 'It is "so"', "a.org", False), ("https://a.org/7", "given", "a.org", False),
    ]
    assert rows(pages.ingest_summary(out.filter("page_id < 3")), "status", "pages") == [
        ("duplicate", 1), ("fetch_failed", 0), ("inserted", 1), ("missing_fields", 0),
    ]


def test_one_url_on_a_third_of_all_pages(spark, articles, exclusions):
    df = spark.range(3000).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") % 3 == 0, "https://hot.org/").otherwise(F.concat(F.lit("https://p.org/"), "id")).alias("url"),
        F.lit(FULL).alias("html"),
    )
    out = pages.classify_ingest(df, articles(), exclusions())
    assert out.filter("status = 'inserted'").count() == 2001
    assert out.filter("status = 'inserted' and url like '%hot%'").first().page_id == 0


def test_entities_in_titles(spark):
    from broadsheet.operators.pages import extract_page_metadata

    def title(text):
        html = f"<html><head><title>{text}</title></head></html>"
        return extract_page_metadata(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first().title

    assert title("It&#8217;s &#x1F600; &mdash; &amp;#39; A&B &#0; &#xD800; &#39;x&#39;") == "It’s \U0001f600 — &#39; A&B &#0; &#xD800; 'x'"
    assert title("plain & simple") == "plain & simple"


LD = '<script type="application/ld+json">{}</script>'


def metadata(spark, *htmls):
    frame = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
    got = pages.extract_page_metadata(frame).collect()
    return [(r["title"], r["description"], r["published_at"]) for r in sorted(got, key=lambda r: r["page_id"])]


def test_attributes_are_read_with_their_quotes(spark):
    assert metadata(
        spark,
        "<meta property='og:title' content=\"a > b &amp; 'c'\"><meta content=\"x property='og:title'\" name=description><meta property=article:published_time content=2024-02-03T10:00>",
        "<script>var s='<meta property=\"og:title\" content=\"no\">'</script><!-- <title>no</title> --><svg><title>icon</title></svg><title>real &eacute;</title>"
        "<meta name='date' content='soon'><meta name='dc.date' content='2019-09-09'>",
        "<title lang='a>b'>own <b class='>'>x</b></title><time datetime='bad'></time><time datetime=2021-01-02>",
        "<meta property='og:title' content='never closed><title>t</title>", "", None,
    ) == [
        ("a > b & 'c'", "x property='og:title'", "2024-02-03"), ("real é", None, "2019-09-09"), ("own x", None, "2021-01-02"),
        ("t", None, None), (None, None, None), (None, None, None),
    ]


def test_linked_data(spark):
    graph = '{"@graph": [{"@type": "Organization", "name": "Org"}, {"@type": ["NewsArticle", "X"], "headline": "From &amp; graph", "description": "d", "datePublished": "2024-05-06T01:02:03Z"}]}'
    nested = '[{"@type": "WebPage", "name": "page"}, {"@type": "WebPage", "mainEntity": {"@type": "Article", "headline": "inner", "dateCreated": "2020-01-01"}}]'
    assert metadata(
        spark, LD.format(graph) + "<title>t</title>", LD.format(nested), LD.format("no json") + LD.format('{"@type": "http://schema.org/WebPage", "name": "w"}'),
        LD.format('{"@type": "BreadcrumbList", "name": "crumbs"}') + "<title>t</title>", LD.format('[1, "x", null, {"@graph": {"headline": "h"}}]'),
        '<meta property="og:title" content="tag">' + LD.format(graph),
    ) == [
        ("From & graph", "d", "2024-05-06"), ("inner", None, "2020-01-01"), ("w", None, None), ("t", None, None), ("h", None, None), ("tag", "d", "2024-05-06"),
    ]


def test_a_very_long_page(spark):
    body = "<p class='a > b'>x</p><script>if (a < b) { c = '</p>'; }</script>" * 5_000
    assert metadata(spark, f"<title>t</title>{body}<meta name=description content='last'>") == [("t", "last", None)]
