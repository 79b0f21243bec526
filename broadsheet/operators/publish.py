"""What is published: slugs, the ranked list, and the daily archive digest."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from broadsheet.functions.text import html_escape, script_safe, slug
from broadsheet.operators.ordering import newest_first, positions, top_articles
from broadsheet.schemas import PUBLISHED_COLUMNS

EMPTY_DIGEST = "<p>No archived articles for this date.</p>"  # fixed value


def _with_suffix(numbered: DataFrame) -> DataFrame:
    suffix = F.when(F.col("_nth") > 0, F.concat(F.lit("-"), F.col("_nth") + 1)).otherwise("")
    return numbered.withColumn("slug", F.concat("_base", suffix)).drop("_base", "_nth")


def unique_slugs(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Add a slug; its n-th use in publish order gets the ending -n from 2 on.

    A title may be shared by any number of rows: they are numbered across tasks.
    """
    based = df.withColumn("_base", slug("title", "url"))
    return _with_suffix(positions(based, order or newest_first(), within=["_base"], name="_nth"))


def published_articles(store: DataFrame, limit: int = 30) -> DataFrame:
    """The newest articles with rank and slug; the limit bounds what shares a slug."""
    top = top_articles(store.select(*PUBLISHED_COLUMNS), limit).withColumn("_base", slug("title", "url"))
    nth = F.row_number().over(Window.partitionBy("_base").orderBy("rank")) - 1
    return _with_suffix(top.withColumn("_nth", nth.cast("bigint")))


def publish_payload(published: DataFrame) -> DataFrame:
    """One JSON array of a published list (bounded by its limit), safe inside a script element."""
    fields = F.struct(*PUBLISHED_COLUMNS, "slug")
    items = F.array_sort(F.collect_list(F.struct("rank", fields.alias("item"))))
    json = F.to_json(F.transform(items, lambda i: i["item"]), {"ignoreNullFields": "false"})
    return published.agg(F.count("*").alias("articles"), script_safe(json).alias("payload"))


def list_item() -> Column:
    """One article as an HTML list item; the title falls back to the url."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"))
    return F.concat(
        F.lit('  <li><a href="'), html_escape("url"), F.lit('" target="_blank">'),
        html_escape(title), F.lit("</a> &mdash; "),
        html_escape(F.coalesce("source", F.lit(""))), F.lit("</li>"),
    )


DIGEST_ORDER = ["snapshot_date", "section", "published_at", "source", "title", "description", "url"]


def digest_lines(articles: DataFrame, dates: DataFrame) -> DataFrame:
    """The listing of each archive date as lines.

    A date's listing has no bound, so it stays rows: order by digest_order()
    inside a date to read it. `articles` are the distinct rows per
    snapshot_date, `dates` every date with a snapshot, empty ones included.
    """
    items = articles.select("snapshot_date", *PUBLISHED_COLUMNS).withColumns(
        {"section": F.lit(2), "line": list_item()}
    )
    filled = articles.select("snapshot_date").distinct().withColumn("_any", F.lit(True))
    date = html_escape(F.col("snapshot_date").cast("string"))
    heading = F.concat(F.lit("<h2>"), date, F.lit("</h2>"))

    def line(section: int, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), text.alias("line"))

    frame = F.when(
        F.col("_any"),
        F.array(line(0, heading), line(1, F.lit("<ul>")), line(3, F.lit("</ul>"))),
    ).otherwise(F.array(line(0, heading), line(1, F.lit(EMPTY_DIGEST))))
    frames = (
        dates.select("snapshot_date").distinct()
        .join(filled, "snapshot_date", "left")
        .select("snapshot_date", F.inline(frame))
    )
    blank = {c: F.lit(None).cast("string") for c in PUBLISHED_COLUMNS}
    return items.unionByName(frames.withColumns(blank)).select(*DIGEST_ORDER, "line")


def digest_order() -> list[Column]:
    return [
        F.col("snapshot_date"), F.col("section"), F.col("published_at").desc_nulls_last(),
        *[F.col(c).asc_nulls_last() for c in DIGEST_ORDER[3:]],
    ]


def write_digests(lines: DataFrame, path: str) -> None:
    """Text files per date; file names sort in line order, a long date spans several.

    Only the dates among the lines are replaced; folders of other dates stay as they are.
    """
    (
        lines.orderBy(*digest_order())
        .select("snapshot_date", F.col("line").alias("value"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date").text(path)
    )
