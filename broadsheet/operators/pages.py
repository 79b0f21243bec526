"""Metadata of fetched pages, and the outcome of ingesting them."""

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import markup
from broadsheet.functions.keys import host_of, store_key
from broadsheet.functions.text import once, strip_ws
from broadsheet.operators.dedup import dedup_first
from broadsheet.operators.merge import absent_from, not_excluded
from broadsheet.schemas import as_articles
from broadsheet.session import materialise

STATUSES = ["inserted", "duplicate", "fetch_failed", "missing_fields"]
REQUIRED = ["title", "description", "published_at"]


# Names of meta elements, the best first.
TITLES = ["og:title", "twitter:title", "dc.title", "parsely-title"]
DESCRIPTIONS = ["og:description", "description", "twitter:description", "dc.description"]
DATES = ["article:published_time", "og:published_time", "datepublished", "parsely-pub-date", "dc.date.issued", "dc.date", "dcterms.created", "pubdate", "date"]
# Types of linked data, the best first.
ARTICLE_TYPES = ["newsarticle", "reportagenewsarticle", "analysisnewsarticle", "opinionnewsarticle", "article", "blogposting", "liveblogposting", "report"]
PAGE_TYPES = ["webpage", "itempage", "videoobject"]

#: Parts of a page whose text is no markup of the page's own.
_ASIDE = r"(?is)<!--.*?-->|<(script|style|template|svg)(?=[\s>])" + markup.INSIDE + r"(?<!/)>.*?</\1\s*>"
_SCRIPT = r"(?is)<script(?=[\s/>])" + markup.INSIDE + r">.*?</script\s*>"
_DAY = r"^\s*(\d{4}-\d{2}-\d{2})"


def _first(*candidates: Column) -> Column:
    return F.coalesce(*[F.nullif(strip_ws(c), F.lit("")) for c in candidates])


def _element(html: Column, name: str) -> Column:
    """Text of the first element of a name, without the tags in it."""
    return markup.decode_entities(F.regexp_replace(markup.element(html, name), "(?s)<" + markup.INSIDE + ">", ""))


def _metas(html: Column) -> Column:
    """All meta elements as array<struct<key, content>>, keys in lower case."""

    def one(inside: Column) -> Column:
        return once(markup.attributes(inside), lambda a: F.struct(
            F.lower(F.trim(F.coalesce(*[markup.attribute(a, n) for n in ("property", "name", "itemprop")]))).alias("key"),
            markup.attribute(a, "content").alias("content"),
        ))

    return F.transform(markup.tags(html, "meta"), one)


def _meta(metas: Column, names: list[str], fit=lambda c: strip_ws(c) != "") -> Column:
    """Content of the first meta element of the first name that has one which fits."""

    def named(name: str) -> Column:
        return F.get(F.filter(metas, lambda m: (m["key"] == name) & fit(m["content"])), F.lit(0))["content"]

    return F.coalesce(*map(named, names))


def _inner(node: Column, path: str) -> Column:
    """What a node of linked data holds under a path, as an array of nodes, be it one, many or none."""
    many, one = F.try_variant_get(node, path, "array<variant>"), F.try_variant_get(node, path, "variant")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def _linked_data(html: Column) -> Column:
    """Nodes of all JSON-LD blocks as array<struct<rank, title, description, day>>, in order of rank and place.

    Walks arrays, graphs and main entities. Types of articles come first, then
    whatever has a headline, then types of pages; other nodes (people,
    publishers, breadcrumbs) are left out. Blocks that are no JSON are skipped.
    """

    def nodes(block: Column) -> Column:
        body = F.regexp_replace(block, r"(?is)^<script" + markup.INSIDE + r">\s*|\s*</script\s*>$", "")
        top = _inner(F.try_parse_json(body), "$")
        walked = F.flatten(F.transform(top, lambda n: F.concat(F.array(n), _inner(n, "$['@graph']"))))
        return F.flatten(F.transform(walked, lambda n: F.concat(F.array(n), _inner(n, "$.mainEntity"), _inner(n, "$.mainEntityOfPage"))))

    def text(node: Column, name: str) -> Column:
        return F.try_variant_get(node, f"$.{name}", "string")

    def candidate(node: Column, place: Column) -> Column:
        kinds = F.transform(_inner(node, "$['@type']"), lambda k: F.lower(F.regexp_replace(F.try_variant_get(k, "$", "string"), "^https?://schema.org/", "")))
        rank = F.when(F.arrays_overlap(kinds, F.array(*map(F.lit, ARTICLE_TYPES))), 0).when(text(node, "headline").isNotNull(), 1)
        rank = rank.when(F.arrays_overlap(kinds, F.array(*map(F.lit, PAGE_TYPES))), 2)
        return F.struct(
            rank.alias("rank"), place.alias("place"),
            markup.decode_entities(F.coalesce(text(node, "headline"), text(node, "name"))).alias("title"),
            markup.decode_entities(text(node, "description")).alias("description"),
            F.nullif(F.regexp_extract(F.coalesce(text(node, "datePublished"), text(node, "dateCreated"), text(node, "uploadDate")), _DAY, 1), F.lit("")).alias("day"),
        )

    scripts = F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(0))
    kind = lambda s: markup.attribute(markup.attributes(F.get(markup.tags(s, "script"), F.lit(0))), "type")
    blocks = F.filter(scripts, lambda s: F.lower(F.trim(kind(s))).startswith("application/ld+json"))
    found = F.flatten(F.transform(blocks, nodes))
    return F.array_sort(F.filter(F.transform(found, candidate), lambda c: c["rank"].isNotNull()))


def _ranked(nodes: Column, field: str) -> Column:
    return F.get(F.filter(nodes, lambda n: strip_ws(n[field]) != ""), F.lit(0))[field]


def extract_page_metadata(pages: DataFrame) -> DataFrame:
    """Add title, description and published_at ('YYYY-MM-DD'), null where a page has none.

    Meta elements come first, then linked data (JSON-LD), then the page's own
    elements: title and h1, and the first time element with a date.
    """
    # One-element lambdas: aside parts, meta elements and linked data are read once per page.
    def fields(html: Column, metas: Column, linked: Column) -> Column:
        times = F.transform(markup.tags(html, "time"), lambda t: F.regexp_extract(markup.attribute(markup.attributes(t), "datetime"), _DAY, 1))
        dated = _meta(metas, DATES, lambda c: F.regexp_extract(c, _DAY, 1) != "")
        return F.struct(
            _first(_meta(metas, TITLES), _ranked(linked, "title"), _element(html, "title"), _element(html, "h1")).alias("title"),
            _first(_meta(metas, DESCRIPTIONS), _ranked(linked, "description")).alias("description"),
            F.coalesce(F.regexp_extract(dated, _DAY, 1), _ranked(linked, "day"), F.get(F.filter(times, lambda t: t != ""), F.lit(0))).alias("published_at"),
        )

    whole = F.col("html")
    linked = F.when(F.contains(F.lower(whole), F.lit("ld+json")), _linked_data(whole))
    found = once(F.regexp_replace(whole, _ASIDE, " "), lambda html: once(_metas(html), lambda m: once(linked, lambda n: fields(html, m, n))))
    # One-element inline: later filters must not repeat the extraction.
    return pages.select("*", F.inline(F.array(found)))


def resolve_fields(pages: DataFrame) -> DataFrame:
    """Override, else extracted, else null; the source defaults to the host.

    Overrides are optional columns set_title, set_description,
    set_published_at and set_source of the pages.
    """
    found = extract_page_metadata(pages)
    for field in REQUIRED:
        if f"set_{field}" in pages.columns:
            found = found.withColumn(field, F.coalesce(f"set_{field}", field))
    source = host_of("url")
    if "set_source" in pages.columns:
        source = F.coalesce(F.nullif(F.col("set_source"), F.lit("")), source)
    return found.withColumn("source", source)


def classify_ingest(
    pages: DataFrame, store: DataFrame, exclusions: DataFrame, order: str = "page_id"
) -> DataFrame:
    """Outcome of ingesting each page: its url, fields, status and detail.

    Pages are read once; what follows works on the extracted fields. `order` is a column unique per page; of several pages of one url the first
    complete one is inserted. An excluded url reports duplicate. Winners are
    joined back on `order`, so a url held by very many pages is no hot key.
    """
    fields = resolve_fields(pages)
    missing = F.array_compact(
        F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED])
    )
    fields = materialise(
        fields.select(
            order, "url", "source", *REQUIRED, F.array_join(missing, ", ").alias("_missing"),
            F.col("html").isNotNull().alias("_fetched"),
        ),
        "fields",
    )
    complete = fields.filter("_fetched and _missing = ''").select(
        store_key("url").alias("url"), order
    )
    first = dedup_first(complete, "url", [F.col(order)])
    winners = absent_from(not_excluded(first, exclusions), store).select(
        order, F.lit(True).alias("_won")
    )
    status = (
        F.when(~F.col("_fetched"), "fetch_failed")
        .when(F.col("_missing") != "", "missing_fields")
        .when(F.col("_won"), "inserted")
        .otherwise("duplicate")
    )
    detail = F.when(F.col("status") == "missing_fields", F.col("_missing")).when(
        F.col("status") == "inserted", F.col("title")
    )
    return (
        fields.join(winners, order, "left")
        .withColumn("status", status)
        .withColumn("detail", detail)
        .drop("_missing", "_fetched", "_won")
    )


def inserted_articles(classified: DataFrame) -> DataFrame:
    """The new rows of a classified batch as articles."""
    new = classified.filter("status = 'inserted'").withColumn("url", store_key("url"))
    return as_articles(new.select("url", "source", *REQUIRED))


def ingest_summary(classified: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Pages per status, a status nobody has included."""
    spark = classified.sparkSession
    every = spark.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in statuses or STATUSES])).alias("status"),
        F.lit(0).cast("bigint").alias("_n"),
    )
    one = classified.select("status", F.lit(1).cast("bigint").alias("_n"))
    return every.unionByName(one).groupBy("status").agg(F.sum("_n").alias("pages"))
