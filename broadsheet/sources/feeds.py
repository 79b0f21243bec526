"""RSS and Atom documents as article rows."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import markup
from broadsheet.functions.text import once, strip_ws
from broadsheet.functions.times import feed_minute
from broadsheet.operators.dedup import dedup_first
from broadsheet.operators.filters import apply_feed_defaults, exclude_substring

SIGHTING_ORDER = ["feed_ord", "pos"]

# One schema reads both formats; whatever a document lacks comes back null.
_RSS_ITEM = (
    "struct<title:string, link:string, description:string, encoded:string, "
    "author:string, creator:string, pubDate:string, date:string, updated:string, guid:struct<_VALUE:string, _isPermaLink:string>>"
)
_LINK = "struct<_href:string, _rel:string, _VALUE:string>"
_ATOM_ENTRY = (
    f"struct<title:string, link:array<{_LINK}>, summary:string, content:string, "
    "author:struct<name:string>, published:string, updated:string>"
)
DOCUMENT = (
    f"channel struct<title:string, item:array<{_RSS_ITEM}>>, "
    f"item array<{_RSS_ITEM}>, title string, entry array<{_ATOM_ENTRY}>"
)


def _permalink(permanent: Column, value: Column) -> Column:
    """A guid is the item's link unless it says that it is none."""
    return F.when(F.lower(F.coalesce(permanent, F.lit("true"))) != "false", F.nullif(F.trim(value), F.lit("")))


def _alternate(links: Column) -> Column:
    """The address among link elements: without a relation or the alternate one first."""
    main = F.filter(links, lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    chosen = F.coalesce(F.get(main, F.lit(0)), F.get(links, F.lit(0)))
    return F.coalesce(chosen["_href"], chosen["_VALUE"])


def _parsed(body: Column) -> Column:
    """Source and items of a well-formed document; null items otherwise."""

    def read(d: Column) -> Column:
        from_rss = F.transform(
            F.coalesce(d["channel"]["item"], d["item"]),
            lambda i: F.struct(
                i["title"].alias("title"),
                F.coalesce(F.nullif(F.trim(i["link"]), F.lit("")), _permalink(i["guid"]["_isPermaLink"], i["guid"]["_VALUE"])).alias("url"),
                i["description"].alias("description"),
                i["encoded"].alias("summary"),
                F.coalesce(i["author"], i["creator"]).alias("author"),
                i["pubDate"].alias("published"),
                F.coalesce(i["updated"], i["date"]).alias("updated"),
            ),
        )
        from_atom = F.transform(
            d["entry"],
            lambda e: F.struct(
                e["title"].alias("title"),
                _alternate(e["link"]).alias("url"),
                e["summary"].alias("description"),
                e["content"].alias("summary"),
                e["author"]["name"].alias("author"),
                e["published"].alias("published"),
                e["updated"].alias("updated"),
            ),
        )
        return F.struct(F.coalesce(d["channel"]["title"], d["title"]).alias("source"), F.coalesce(from_rss, from_atom).alias("items"))

    return once(F.from_xml(body, DOCUMENT, {"ignoreNamespace": "true"}), read)


_ITEM = r"<(?:rss:|atom:)?(?:item|entry)(?=[\s/>])" + markup.INSIDE + ">"
_ITEM_END = r"(?is)</(?:rss:|atom:)?(?:item|entry)\s*>.*"
#: Blocks that hold titles and links of their own.
_INNER = r"(?is)<(image|textinput|source)(?=[\s/>])" + markup.INSIDE + r"(?<!/)>.*?</\1\s*>"


def _text(c: Column, *names: str) -> Column:
    """Text of the first element that has one of the names, in the order of the names."""
    found = F.coalesce(*[F.nullif(strip_ws(markup.element(c, n)), F.lit("")) for n in names])
    return F.nullif(strip_ws(markup.decode_entities(found)), F.lit(""))


def _salvaged(body: Column) -> Column:
    """Source and items of a document that is no well-formed XML.

    An item runs from its start tag to its end tag, the next item's start tag,
    or the end of what was received; of its fields those count that are closed.
    """

    def item(piece: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(piece, _ITEM_END, ""), _INNER, "")
        links = F.transform(markup.tags(text, "(?:atom:)?link"), markup.attributes)
        links = F.transform(links, lambda a: F.struct(markup.attribute(a, "href").alias("_href"), markup.attribute(a, "rel").alias("_rel"), F.lit(None).cast("string").alias("_VALUE")))
        permanent = markup.attribute(markup.attributes(F.get(markup.tags(text, "guid"), F.lit(0))), "ispermalink")
        author = _text(text, "author", "dc:creator")
        return F.struct(
            _text(text, "(?:atom:)?title", "dc:title").alias("title"),
            F.coalesce(_text(text, "link"), _alternate(F.filter(links, lambda x: x["_href"].isNotNull())), _permalink(permanent, _text(text, "guid"))).alias("url"),
            _text(text, "description", "summary").alias("description"),
            _text(text, "content:encoded", "content").alias("summary"),
            F.coalesce(_text(markup.element(text, "author"), "name"), author).alias("author"),
            _text(text, "pubDate", "published").alias("published"),
            _text(text, "updated", "dc:date").alias("updated"),
        )

    def read(pieces: Column) -> Column:
        # One-element lambdas: the head and each item are cut out once.
        head = once(F.regexp_replace(F.get(pieces, F.lit(0)), _INNER, ""), lambda h: _text(h, "(?:atom:)?title"))
        after = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.struct(head.alias("source"), F.transform(after, item).alias("items"))

    return once(F.split(markup.without_sections(body), "(?i)" + _ITEM), read)


def read_feed_landing(feeds: DataFrame) -> DataFrame:
    """Entries of the feeds that came, in order.

    Well-formed documents are parsed as XML. Of all others (unknown entities,
    unescaped characters, mismatched or missing tags, cut off in the middle)
    the items are salvaged one by one. An item without a link has the address
    of its permanent guid.
    """
    came = feeds.filter(F.coalesce("status_code", F.lit(200)) == 200)
    # One-element explodes: a document is parsed once, and salvaged only where that gave no items.
    docs = came.select("feed_url", "feed_ord", "body", F.explode(F.array(_parsed(F.col("body")))).alias("d"))
    salvaged = F.when(F.col("d.items").isNull(), _salvaged(F.col("body"))).otherwise(F.col("d"))
    docs = docs.select("feed_url", "feed_ord", F.explode(F.array(salvaged)).alias("d"))
    return docs.select("feed_url", "feed_ord", "d.source", F.posexplode("d.items").alias("pos", "e")).select(
        "feed_url", "feed_ord", "pos", "source", "e.*"
    )


def feed_articles(entries: DataFrame, run_at: datetime, exclude_urls="") -> DataFrame:
    """Accepted articles of one landing: exclusion first, then the first of each url."""
    linked = exclude_substring(entries.filter("url is not null and url <> ''"), exclude_urls)
    first = dedup_first(linked, F.lower("url"), [F.col(c) for c in SIGHTING_ORDER])
    return (
        apply_feed_defaults(first)
        .withColumn("published_at", feed_minute("published", "updated", run_at))
        .select(
            *SIGHTING_ORDER, "url", "published_at", "title", "description", "source",
            "category", "author",
        )
    )


def land_all(api: DataFrame, feeds: DataFrame) -> DataFrame:
    """API and feed articles as one batch; LANDING_ORDER puts the API first."""
    fields = ["url", "published_at", "title", "description", "source", "category", "author"]
    from_api = api.select(
        F.lit(0).alias("source_ord"), F.col("category_ord").alias("doc_ord"), "page", "pos", *fields
    )
    from_feeds = feeds.select(
        F.lit(1).alias("source_ord"), F.col("feed_ord").alias("doc_ord"), F.lit(0).alias("page"),
        "pos", *fields,
    )
    return from_api.unionByName(from_feeds)


LANDING_ORDER = ["source_ord", "doc_ord", "page", "pos"]
