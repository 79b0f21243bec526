"""Row-level predicates and defaults. None of them shuffles."""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from broadsheet.functions.keys import store_key
from broadsheet.functions.text import clean_terms, contains_any
from broadsheet.functions.times import cutoff_text

# Source names whose domain spelling differs from the name itself.
SOURCE_ALIASES = {
    "abc news": "abc-news",
    "cbs news": "cbs-news",
    "cnn": "cnn",
    "fox news": "fox-news",
    "msnbc": "msnbc",
    "nbc news": "nbc-news",
    "newsweek": "newsweek",
    "breitbart news": "breitbart-news",
    "espn": "espn",
    "mtv news": "mtv-news",
    "the huffington post": "the-huffington-post",
    "new york post": "new-york-post",
    "the washington times": "the-washington-times",
    "the american conservative": "the-american-conservative",
    "national review": "national-review",
    "google news": "google-news",
}

# Markers of withdrawn articles, and texts for absent fields.
REMOVED_TITLE = "[Removed]"
REMOVED_SOURCE = "removed"
REMOVED_URL = "https://removed.com"
REMOVED_TIME = "1970-01-01T00:00:00Z"
NO_DESCRIPTION = "No description available."
NO_AUTHOR = "Unknown Author"
NO_TITLE = "No title"
FEED_NAME = "RSS Feed"
FEED_CATEGORY = "politics"


def drop_sentinels(df: DataFrame, time_column: str = "published_at") -> DataFrame:
    """Drop withdrawn articles; a null field is no marker."""
    marked = (
        F.col("title").eqNullSafe(REMOVED_TITLE)
        | F.lower("source").eqNullSafe(REMOVED_SOURCE)
        | F.lower("url").eqNullSafe(REMOVED_URL)
        | F.col(time_column).eqNullSafe(REMOVED_TIME)
    )
    return df.filter(~marked)


def exclude_exact(df: DataFrame, urls) -> DataFrame:
    """Drop rows whose whole lowercased url is listed."""
    terms = clean_terms(urls)
    return df.filter(~F.coalesce(F.lower("url").isin(terms), F.lit(False))) if terms else df


def exclude_substring(df: DataFrame, terms) -> DataFrame:
    """Drop rows whose lowercased url contains a listed term."""
    return df.filter(~F.coalesce(contains_any(F.lower("url"), terms), F.lit(False)))


def exclude_sources(df: DataFrame, domains) -> DataFrame:
    """Drop rows whose source, its domain spelling or whose url names a listed domain."""
    terms = clean_terms(domains)
    if not terms:
        return df
    source = F.lower("source")
    aliased = [name for name, domain in SOURCE_ALIASES.items() if domain in terms]
    hit = contains_any(source, terms) | contains_any(F.lower("url"), terms)
    if aliased:
        hit = hit | source.isin(aliased)
    return df.filter(~F.coalesce(hit, F.lit(False)))


def apply_api_defaults(df: DataFrame) -> DataFrame:
    """Blank description gets a text; the author only where its key was absent."""
    return df.withColumn(
        "description",
        F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit(NO_DESCRIPTION)),
    ).withColumn(
        "author", F.when(F.col("has_author"), F.col("author")).otherwise(F.lit(NO_AUTHOR))
    )


def apply_feed_defaults(df: DataFrame) -> DataFrame:
    """Texts for fields an entry lacks; every feed article has one category."""
    return df.withColumns(
        {
            "title": F.coalesce("title", F.lit(NO_TITLE)),
            "description": F.coalesce("description", "summary", F.lit(NO_DESCRIPTION)),
            "author": F.coalesce("author", F.lit(FEED_NAME)),
            "source": F.coalesce("source", F.lit(FEED_NAME)),
            "category": F.lit(FEED_CATEGORY),
        }
    )


def is_expired(run_at: datetime, hours: float):
    old = (F.col("published_at") < cutoff_text(run_at, hours)) & (F.col("manual_review") == False)  # noqa: E712
    return F.coalesce(old, F.lit(False))


def apply_retention(articles: DataFrame, run_at: datetime, hours: float) -> DataFrame:
    """Keep recent, pinned and undated rows; text comparison as stored."""
    return articles.filter(~is_expired(run_at, hours))


def expired(articles: DataFrame, run_at: datetime, hours: float) -> DataFrame:
    """The rows apply_retention drops."""
    return articles.filter(is_expired(run_at, hours))


def recent(articles: DataFrame, run_at: datetime, hours: float) -> DataFrame:
    """Rows dated within the last hours; undated rows are not recent."""
    return articles.filter(
        (F.col("published_at") != "") & (F.col("published_at") >= cutoff_text(run_at, hours))
    )


def by_url(articles: DataFrame, url: str) -> DataFrame:
    return articles.filter(F.col("url") == store_key(F.lit(url)))


def by_category(articles: DataFrame, category: str) -> DataFrame:
    return articles.filter(F.col("category") == category)
