"""Incremental landing: new response files flow into the raw store."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.plans.jobs import Settings, append_batch
from broadsheet.schemas import API_RESPONSE, FEED_RESPONSE
from broadsheet.sources.api import SIGHTING_ORDER, api_articles, read_api_landing
from broadsheet.sources.feeds import feed_articles, read_feed_landing
from broadsheet.sources.partitioned import PartitionedStore
from broadsheet.sources.store import Store


#: How long a delivery is remembered.
REMEMBERED = "2 days"


def new_deliveries(stream: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """The stream without documents that came before, with the same place and the same body.

    Feeds are polled far more often than they change, and files are delivered
    again. What is remembered per document is its place and the hash of its
    body, for a time counted by the clock of the stream; all copies are equal, so it does not matter
    which one passes. An older copy passes again, and adds nothing to a store.
    """
    keys = [c for c in stream.columns if c != "body"]
    marked = stream.withColumns({"landed_at": F.current_timestamp(), "print": F.sha2(F.coalesce("body", F.lit("")), 256)})
    return marked.withWatermark("landed_at", remembered).dropDuplicatesWithinWatermark([*keys, "print"]).select(*stream.columns)


def _run(stream: DataFrame, on_batch, checkpoint: str) -> StreamingQuery:
    return (
        new_deliveries(stream).writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_landing(
    spark: SparkSession, landing: str, store: Store | PartitionedStore, allowed: DataFrame, exclusions: DataFrame,
    checkpoint: str, cfg: Settings | None = None, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Insert API responses (JSON lines files) as they land, then stop.

    Documents that came before are dropped by the stream's own state, articles
    that are stored already by the store. Delivery is at least once; a batch
    delivered twice adds nothing the second time. A store that is laid out by
    url buckets is searched in the buckets of a batch's urls alone.
    """
    cfg = cfg or Settings()
    stream = spark.readStream.schema(API_RESPONSE).option(
        "maxFilesPerTrigger", files_per_batch
    ).json(landing)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        articles = api_articles(
            read_api_landing(batch), allowed, cfg.exclude_urls, cfg.exclude_domains
        )
        append_batch(store, articles, exclusions, SIGHTING_ORDER)

    return _run(stream, on_batch, checkpoint)


def stream_feeds(
    spark: SparkSession, landing: str, store: Store | PartitionedStore, exclusions: DataFrame, checkpoint: str,
    run_at: datetime, cfg: Settings | None = None, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Insert feed documents (JSON lines files) as they land, then stop."""
    cfg = cfg or Settings()
    stream = spark.readStream.schema(FEED_RESPONSE).option(
        "maxFilesPerTrigger", files_per_batch
    ).json(landing)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        articles = feed_articles(read_feed_landing(batch), run_at, cfg.exclude_urls)
        append_batch(store, articles, exclusions, ["feed_ord", "pos"])

    return _run(stream, on_batch, checkpoint)
