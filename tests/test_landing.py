import json
from datetime import datetime

from broadsheet.operators.merge import new_articles
from broadsheet.schemas import ALLOWED_SOURCE, API_RESPONSE, ARTICLE, EXCLUSION, FEED_RESPONSE
from broadsheet.sources import api, feeds

RUN_AT = datetime(2026, 7, 1, 12, 0)
NAMES = ["Daily", "Weekly", "Fox News"]


def item(url="https://a.org/1", title="T", source="Daily", at="2026-07-01T10:00:00+02:00", **more):
    named = source if more.pop("plain", False) else {"id": None, "name": source}
    return {"source": named, "title": title, "url": url, "publishedAt": at, **more}


def responses(spark, *bodies):
    data = [
        (category, i, 1, code, body if isinstance(body, str) else json.dumps({"status": "ok", "articles": body}))
        for i, (category, code, body) in enumerate(bodies)
    ]
    return spark.createDataFrame(data, API_RESPONSE)


def accepted(spark, landed, names=NAMES, urls="", domains=""):
    allowed = spark.createDataFrame([(n,) for n in names], ALLOWED_SOURCE)
    return api.api_articles(api.read_api_landing(landed), allowed, urls, domains)


def test_fields_and_defaults(spark, rows):
    landed = responses(spark, ("general", 200, [
        item("HTTPS://A.org/1", author=None, description=""),
        item("https://a.org/2", source="Weekly", plain=True, description="D “quoted”"),
        item("https://a.org/3", author="Me", description=None),
    ]))
    out = accepted(spark, landed)
    assert rows(out, "url", "source", "description", "author", "published_at") == [
        ("https://a.org/1", "Daily", "No description available.", None, "2026-07-01 10:00"),
        ("https://a.org/2", "Weekly", "D “quoted”", "Unknown Author", "2026-07-01 10:00"),
        ("https://a.org/3", "Daily", "No description available.", "Me", "2026-07-01 10:00"),
    ]


def test_bad_responses_give_no_rows(spark):
    landed = responses(
        spark, ("a", 200, json.dumps({"status": "error", "articles": [item()]})),
        ("b", 500, [item()]), ("c", 200, "not json"), ("d", 200, []),
    )
    assert api.read_api_landing(landed).count() == 0


def test_first_sighting_settles_a_url(spark, rows):
    landed = responses(
        spark, ("one", 200, [item(source="Unknown"), item("https://a.org/2", title="[Removed]")]),
        ("two", 200, [item(), item("https://a.org/2"), item("https://a.org/3")]),
        ("three", 200, [item("https://A.org/3", title="again")]),
    )
    assert rows(accepted(spark, landed), "url", "category") == [("https://a.org/3", "two")]


def test_source_checks(spark, rows):
    landed = responses(spark, ("g", 200, [
        item("https://a.org/1", source="Fox News"), item("https://a.org/2", source="daily"),
        item("https://cnn.com/3"), item("https://a.org/4"),
    ]))
    assert rows(accepted(spark, landed, domains="fox-news,cnn"), "url") == [("https://a.org/4",)]
    assert accepted(spark, landed, names=[]).count() == 0
    assert accepted(spark, landed, urls="https://A.org/4").filter("url like '%/4'").count() == 0


def test_rejects_name_the_field(spark, rows):
    no_title = item("https://a.org/5")
    del no_title["title"]
    landed = responses(spark, ("g", 200, [
        item(None), item("https://a.org/1", at="x"), no_title, item("https://a.org/6", title=None),
        {"title": "t", "url": "https://a.org/7", "publishedAt": "2026-07-01"},
    ]))
    sighted = api.read_api_landing(landed)
    assert rows(api.api_rejects(sighted), "reason") == [("published_at",), ("source",), ("title",), ("url",)]
    assert rows(accepted(spark, landed), "url", "title") == [("https://a.org/6", None)]


def test_allowed_sources(spark, rows):
    bodies = spark.createDataFrame(
        [('{"status":"ok","sources":[{"id":"x","name":"Daily"},{"name":"Weekly"},{"name":"Daily"}]}',),
         ('{"status":"error","sources":[{"name":"No"}]}',)], "body string")
    assert rows(api.allowed_sources(bodies), "name") == [("Daily",), ("Weekly",)]


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"
 xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Feed &amp; Co</title>
<item><title>One</title><link>https://f.org/1</link><description>D1</description>
 <dc:creator>Ann</dc:creator><pubDate>Wed, 01 Jul 2026 10:00:00 +0200</pubDate></item>
<item><link>https://F.org/2</link><content:encoded><![CDATA[<b>long</b>]]></content:encoded>
 <pubDate>whenever</pubDate></item>
<item><title>no link</title></item>
<item><title>Barred</title><link>https://BAD.org/x</link></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom</title>
<entry><title>Dup</title><link rel="self" href="https://self/"/><link rel="alternate" href="https://f.org/2"/>
 <updated>2026-07-01T09:00:00Z</updated></entry>
<entry><title>New</title><link href="https://f.org/3"/><author><name>Bob</name></author>
 <published>2026-07-01T09:00:00-01:00</published><updated>2026-07-02T09:00:00Z</updated><summary>S</summary></entry>
</feed>"""


def landed_feeds(spark, *bodies):
    return spark.createDataFrame([("u", i, code, body) for i, (code, body) in enumerate(bodies)], FEED_RESPONSE)


def test_feeds(spark, rows):
    landed = landed_feeds(spark, (200, RSS), (404, RSS.replace("f.org", "gone.org")), (200, "<rss><chan"), (200, ATOM))
    out = feeds.feed_articles(feeds.read_feed_landing(landed), RUN_AT, "bad.org")
    assert rows(out, "url", "title", "source", "author", "description", "published_at", "category") == [
        ("https://F.org/2", "No title", "Feed & Co", "RSS Feed", "<b>long</b>", "2026-07-01 12:00", "politics"),
        ("https://f.org/1", "One", "Feed & Co", "Ann", "D1", "2026-07-01 08:00", "politics"),
        ("https://f.org/3", "New", "Atom", "Bob", "S", "2026-07-01 10:00", "politics"),
    ]


def test_api_wins_over_feed(spark, rows):
    landed = responses(spark, ("g", 200, [item("https://f.org/1", title="From API")]))
    rss = feeds.feed_articles(feeds.read_feed_landing(landed_feeds(spark, (200, RSS))), RUN_AT, "bad.org")
    batch = feeds.land_all(accepted(spark, landed), rss)
    empty = spark.createDataFrame([], ARTICLE)
    fresh = new_articles(empty, batch, spark.createDataFrame([], EXCLUSION), feeds.LANDING_ORDER)
    assert rows(fresh, "url", "title") == [("https://f.org/1", "From API"), ("https://f.org/2", "No title")]


BROKEN = [
    # Entities XML does not know, a bare ampersand, markup in a text, a title that is not the feed's.
    "<rss><channel><image><title>logo</title></image><title>F&nbsp;x</title><item><title>A &eacute; &#8217;&unknown;</title>"
    "<link>http://a/1?x=1&y=2</link><description>one <b>two<br> three</description></item><item><title>Z</title><guid>http://a/g</guid></item></channel></rss>",
    # Cut off in the middle: what is closed counts.
    "<rss><channel><title>cut</title><item><title>A</title><link>http://a/2</link></item><item><title>open</title><link>http://a/3</link><description>half",
    # An item that is never closed ends where the next begins.
    "<rss><channel><title>open</title><item><title>A</title><item><title>B</title><link>http://a/4</link></item></channel>",
    # Tags as character data, in comments and in quotes.
    "<feed><title>at</title><entry><title>x<![CDATA[ <entry> & ]]></title><!-- <link href='http://a/no'/> --><link rel=self href=http://a/s />"
    "<link rel='alternate' title=\"a > b\" href='http://a/5?a=1&amp;b=2'><author><name>N</name></author><content type=\"a>b\">con</content></entry></feed",
    "<rss><channel><title>never <![CDATA[ closed <item><title>A</title></item>",
    "no feed", "", None,
]


def test_broken_feeds_are_salvaged(spark, rows):
    got = feeds.read_feed_landing(landed_feeds(spark, *[(200, b) for b in BROKEN]))
    assert rows(got, "feed_ord", "pos", "source", "title", "url", "description", "author") == [
        (0, 0, "F\xa0x", "A é ’&unknown;", "http://a/1?x=1&y=2", "one <b>two<br> three", None),
        (0, 1, "F\xa0x", "Z", "http://a/g", None, None),
        (1, 0, "cut", "A", "http://a/2", None, None),
        (1, 1, "cut", "open", "http://a/3", None, None),
        (2, 0, "open", "A", None, None, None),
        (2, 1, "open", "B", "http://a/4", None, None),
        (3, 0, "at", "x <entry> &", "http://a/5?a=1&b=2", None, "N"),
    ]


def test_permanent_guids_are_links(spark, rows):
    item_ = "<item><title>{}</title>{}</item>"
    items = [
        item_.format("a", "<guid>http://g/1</guid>"), item_.format("b", '<guid isPermaLink="true">http://g/2</guid>'),
        item_.format("c", '<guid isPermaLink="false">http://g/3</guid>'), item_.format("d", "<guid>http://g/4</guid><link>http://l/4</link>"),
    ]
    for end in ("</channel></rss>", "&nbsp;</channel>"):
        body = "<rss><channel><title>t</title>" + "".join(items) + end
        got = feeds.read_feed_landing(landed_feeds(spark, (200, body)))
        assert rows(got, "title", "url") == [("a", "http://g/1"), ("b", "http://g/2"), ("c", None), ("d", "http://l/4")]


def test_a_very_long_broken_feed(spark):
    item_ = "<item><title>t</title><link>http://a/{}</link><description>" + "<p>x &nbsp;" * 400 + "</description></item>"
    body = "<rss><channel>" + "".join(item_.format(k) for k in range(300))
    got = feeds.read_feed_landing(landed_feeds(spark, (200, body)))
    assert got.select("url").distinct().count() == 300
