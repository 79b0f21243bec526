"""News API responses as article rows."""

from pyspark.sql import DataFrame, functions as F

from broadsheet.functions.keys import store_key
from broadsheet.functions.times import iso_minute
from broadsheet.operators.dedup import dedup_first
from broadsheet.operators.filters import (
    apply_api_defaults, drop_sentinels, exclude_exact, exclude_sources,
)
from broadsheet.operators.merge import allowed_only

SIGHTING_ORDER = ["category_ord", "page", "pos"]

_ITEM = (
    "url string, title string, description string, source string, author string, "
    "publishedAt string"
)


def read_api_landing(responses: DataFrame) -> DataFrame:
    """Articles of the good responses, in order of sighting, fields as sent.

    A response counts if its HTTP status is 200 and its own status 'ok'. The
    source is an object with a name, or plain text.
    """
    # One-element inlines: a later filter must not parse the text again.
    body = F.array(F.from_json("body", "status string, articles array<string>"))
    items = (
        responses.filter(F.coalesce("status_code", F.lit(200)) == 200)
        .select("category", "category_ord", "page", F.inline(body))
        .filter("status = 'ok'")
        .select("category", "category_ord", "page", F.posexplode("articles").alias("pos", "raw"))
        .select("*", F.explode(F.array(F.from_json("raw", _ITEM))).alias("a"))
    )
    named = F.get_json_object("a.source", "$.name")
    is_object = F.col("a.source").startswith("{")

    def sent(key: str):
        # Only a null field needs the raw keys: explicit null or absent.
        return F.col(f"a.{key}").isNotNull() | F.array_contains(F.json_object_keys("raw"), key)

    return items.select(
        "category", "category_ord", "page", "pos",
        store_key("a.url").alias("url"),
        "a.title", "a.description",
        F.when(is_object, named).otherwise(F.col("a.source")).alias("source"),
        "a.author",
        F.col("a.publishedAt").alias("published_raw"),
        sent("author").alias("has_author"),
        sent("title").alias("has_title"),
    )


def _reject_reason():
    return (
        F.when(F.coalesce(F.col("url"), F.lit("")) == "", "url")
        .when(F.col("source").isNull(), "source")
        .when(~F.col("has_title"), "title")
        .when(iso_minute("published_raw").isNull(), "published_at")
    )


def api_rejects(sighted: DataFrame) -> DataFrame:
    """Rows that cannot become articles, each with the field at fault."""
    return sighted.withColumn("reason", _reject_reason()).filter("reason is not null")


def api_articles(sighted: DataFrame, allowed: DataFrame, exclude_urls="", exclude_domains="") -> DataFrame:
    """Accepted articles of one landing.

    A url is settled by its first sighting, even where a later check rejects
    it: deduplication comes before every source check.
    """
    usable = exclude_exact(sighted.filter("url is not null and url <> ''"), exclude_urls)
    first = dedup_first(usable, "url", [F.col(c) for c in SIGHTING_ORDER])
    kept = drop_sentinels(
        allowed_only(exclude_sources(first, exclude_domains), allowed), "published_raw"
    )
    return (
        apply_api_defaults(kept.filter(_reject_reason().isNull()))
        .withColumn("published_at", iso_minute("published_raw"))
        .select(
            *SIGHTING_ORDER, "url", "published_at", "title", "description", "source",
            "category", "author",
        )
    )


def allowed_sources(bodies: DataFrame) -> DataFrame:
    """Source names of a source-list response (column body); none if it is not ok."""
    shape = "status string, sources array<struct<name:string>>"
    return (
        bodies.select(F.from_json("body", shape).alias("b"))
        .filter("b.status = 'ok'")
        .select(F.explode("b.sources.name").alias("name"))
        .filter("name is not null")
        .distinct()
    )
