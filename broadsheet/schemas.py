"""Explicit schemas of every table the operators read or write."""

from pyspark.sql import DataFrame, functions as F, types as T


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "int": T.IntegerType(), "bigint": T.LongType(),
}


def _struct(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


ARTICLE = _struct(
    "url string, published_at string, title string, description string, source string, "
    "category string, author string, relevance_score double, sentiment_score double, "
    "manual_review boolean"
)
EXCLUSION = _struct("url string, reason string, excluded_at string")
API_RESPONSE = _struct(
    "category string, category_ord int, page int, status_code int, body string"
)
FEED_RESPONSE = _struct("feed_url string, feed_ord int, status_code int, body string")
ALLOWED_SOURCE = _struct("name string")
NOTE = _struct(
    "id string, html string, text string, title string, createdAt double, "
    "tagLinks string, trashed int, deleted int"
)
PAGE = _struct("url string, html string")
SCORE = _struct("target string, url string, score double")
JUDGE_REPLY = _struct(
    "batch_id bigint, expected_count int, content string, reasoning_content string"
)
VALUE = _struct("value string")

ARTICLE_COLUMNS = ARTICLE.names
PUBLISHED_COLUMNS = ["url", "title", "description", "source", "published_at"]


def as_articles(df: DataFrame) -> DataFrame:
    """Fit any frame to ARTICLE: absent columns become null, the pin flag false."""
    have = set(df.columns)
    columns = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in ARTICLE
    ]
    return df.select(*columns).withColumn(
        "manual_review", F.coalesce("manual_review", F.lit(False))
    )
