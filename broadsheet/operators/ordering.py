"""Orders of the listings, and positions in an order at any size."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from broadsheet.session import materialise


def newest_first() -> list[Column]:
    """Store order: newest first, then source; nulls last; url breaks ties."""
    return [
        F.col("published_at").desc_nulls_last(),
        F.col("source").asc_nulls_last(),
        F.col("url").asc(),
    ]


def most_relevant_first() -> list[Column]:
    """Relevance order: score, ties in store order."""
    return [F.col("relevance_score").desc(), *newest_first()]


def store_order(articles: DataFrame) -> DataFrame:
    return articles.orderBy(*newest_first())


def relevance_order(articles: DataFrame) -> DataFrame:
    return articles.orderBy(*most_relevant_first())


def top_articles(articles: DataFrame, limit: int = 30) -> DataFrame:
    """The newest `limit` articles with their rank; no full sort is planned."""
    return ranked_limit(articles, newest_first(), limit)


def ranked_limit(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """First `limit` rows of an order, with rank 1..limit."""
    top = df.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return top.withColumn("rank", rank)


_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def positions(
    df: DataFrame, order: list[Column], within: list[str] | None = None,
    name: str = "position",
) -> DataFrame:
    """Add the 0-based position of each row in a total order, optionally per group.

    Rows are range-partitioned and sorted, numbered inside each partition and
    written once; partition sizes (one row per partition) give the offsets.
    No task ever holds more than one range partition, however large a group is.
    Pass only the columns that are needed: they are written to the shared folder.
    """
    within = within or []
    layout = [F.col(c).asc_nulls_first() for c in within] + list(order)
    written = materialise(
        df.orderBy(*layout).withColumn("_id", F.monotonically_increasing_id()), "positions"
    )
    written = written.withColumn("_part", F.shiftright("_id", _ROW_BITS))
    if not within:
        local = F.col("_id") - F.shiftleft(F.col("_part"), _ROW_BITS)
        sizes = written.groupBy("_part").agg(F.count("*").alias("_n"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
        # One row per range partition, so at most spark.sql.shuffle.partitions rows.
        out = written.join(F.broadcast(offsets), "_part")
        return out.withColumn(name, local + F.col("_off")).drop("_id", "_part", "_off")

    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, c in enumerate(within)]
    knames = [f"_k{i}" for i in range(len(within))]
    written = written.select("*", *keys)
    pieces = written.groupBy("_part", *knames).agg(F.count("*").alias("_n"))
    # Rows here are (partition, group) counts: a group has at most one per partition.
    before = Window.partitionBy(*knames).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        pieces.withColumn("_off", F.sum("_n").over(before))
        .filter("_off is not null")
        .select("_part", *knames, "_off")
    )
    # Only a group that continues into a partition is carried: one row per partition at most.
    here = Window.partitionBy("_part", *knames).orderBy("_id")
    out = written.withColumn("_row", F.row_number().over(here) - 1).join(
        F.broadcast(carried), ["_part", *knames], "left"
    )
    return out.withColumn(
        name, F.col("_row").cast("bigint") + F.coalesce("_off", F.lit(0))
    ).drop("_id", "_part", "_row", "_off", *knames)
