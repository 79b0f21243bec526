"""Joins that decide what enters, leaves or changes in a store.

Stores are unique by url and batches are reduced to one row per url before
they meet a store, so no join key repeats on both sides. No join is forced
to broadcast: Spark does so from the measured size, and shuffles beyond it.
"""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from broadsheet.functions.keys import exclusion_key, store_key
from broadsheet.functions.sieve import with_matches, without_keys
from broadsheet.functions.times import exclusion_stamp
from broadsheet.operators.dedup import dedup_first
from broadsheet.session import materialise


def _keys(df: DataFrame, key) -> DataFrame:
    return df.select(key.alias("_key")).filter("_key is not null").distinct()


def not_excluded(articles: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drop articles whose exclusion key is listed."""
    listed = _keys(exclusions, exclusion_key("url"))
    return (
        articles.withColumn("_key", exclusion_key("url"))
        .join(listed, "_key", "left_anti")
        .drop("_key")
    )


def cleared(articles: DataFrame, exclusions: DataFrame) -> DataFrame:
    """not_excluded for stored articles, which are cheap to read twice: only rows a sieve cannot clear are shuffled."""
    keyed = articles.withColumn("_key", exclusion_key("url"))
    return without_keys(keyed, "_key", _keys(exclusions, exclusion_key("url"))).drop("_key")


def allowed_only(articles: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep articles of a listed source, spelled exactly; an empty list passes nothing."""
    names = allowed.select(F.col("name").alias("source")).distinct()
    return articles.join(names, "source", "left_semi").select(*articles.columns)


def absent_from(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of a batch whose url the store lacks.

    The store is first cut down to the urls of the batch: with a small batch
    that is a filter over the store's url column, and no store row is shuffled.
    The batch is looked at several times, so hand in a materialised one if it is
    costly; its rows are shuffled only where the urls found may hold theirs.
    """
    urls = batch.select("url").distinct()
    present = materialise(store.select("url").join(urls, "url", "left_semi"), "present")
    return without_keys(batch, "url", present)


def first_sightings(batch: DataFrame, exclusions: DataFrame, order: list) -> DataFrame:
    """The first row of each url of a batch, by store key, where that is not excluded."""
    keyed = batch.withColumn("url", store_key("url")).filter("url is not null and url <> ''")
    return not_excluded(dedup_first(keyed, "url", order), exclusions)


def new_articles(store: DataFrame, batch: DataFrame, exclusions: DataFrame, order: list) -> DataFrame:
    """The rows an insert would add: first of each url, not excluded, not stored yet.

    The reduced batch is written once: it is parsed and deduplicated a single
    time, and its known size decides whether its urls are broadcast.
    """
    return absent_from(materialise(first_sightings(batch, exclusions, order), "batch"), store)


def insert_absent(store: DataFrame, batch: DataFrame, exclusions: DataFrame, order: list) -> DataFrame:
    """The store after an insert; a stored row never changes."""
    added = new_articles(store, batch, exclusions, order)
    return store.unionByName(added.select(*store.columns))


def with_pinned(kept: DataFrame, store: DataFrame) -> DataFrame:
    """Add the pinned rows that were not kept, with the values they have in the store."""
    pinned = store.filter("manual_review")
    return kept.unionByName(pinned.join(kept.select("url"), "url", "left_anti").select(*kept.columns))


def remove_keys(store: DataFrame, urls: DataFrame) -> DataFrame:
    """The store without the listed urls."""
    return store.join(_keys(urls, store_key("url")).withColumnRenamed("_key", "url"), "url", "left_anti")


def removed_by_keys(store: DataFrame, urls: DataFrame) -> DataFrame:
    """The rows remove_keys takes out."""
    return store.join(_keys(urls, store_key("url")).withColumnRenamed("_key", "url"), "url", "left_semi")


def mark_reviewed(store: DataFrame, urls: DataFrame) -> DataFrame:
    """Pin the listed urls; nothing else changes. Rows that are pinned, or that a sieve of the urls clears, are not shuffled."""
    marks = _keys(urls, store_key("url")).select(F.col("_key").alias("url"), F.lit(True).alias("_mark"))
    pinned = F.coalesce("manual_review", F.lit(False))
    marked = with_matches(store.filter(~pinned), "url", marks)
    todo = marked.withColumn("manual_review", F.coalesce("_mark", "manual_review")).select(*store.columns)
    return store.filter(pinned).unionByName(todo)


def merge_reviewed(store: DataFrame, staging: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Insert staged rows, then pin every staged url that is stored."""
    order = [F.col("published_at").desc_nulls_last(), F.col("source").asc_nulls_last()]
    return mark_reviewed(insert_absent(store, staging, exclusions, order), staging)


# Exclusion list

def add_exclusions(
    exclusions: DataFrame, urls: DataFrame, run_at: datetime, reason: str | None = None
) -> DataFrame:
    """Append lowercased urls that the list lacks as written."""
    fresh = urls.select(F.lower("url").alias("url")).filter("url is not null").distinct()
    added = fresh.join(exclusions.select("url"), "url", "left_anti").select(
        "url", F.lit(reason or "").alias("reason"), F.lit(exclusion_stamp(run_at)).alias("excluded_at")
    )
    return exclusions.unionByName(added)


def upsert_exclusions(exclusions: DataFrame, changes: DataFrame, order: list) -> DataFrame:
    """Set entries by exclusion key; of several changes to one key the last in order wins."""
    keyed = changes.withColumn("url", exclusion_key("url")).filter("url is not null and url <> ''")
    last = dedup_first(keyed, "url", order).select(*exclusions.columns)
    return exclusions.join(last.select("url"), "url", "left_anti").unionByName(last)


def drop_exclusions(exclusions: DataFrame, urls: DataFrame) -> DataFrame:
    """Remove entries by exclusion key."""
    keys = _keys(urls, exclusion_key("url"))
    return (
        exclusions.withColumn("_key", exclusion_key("url"))
        .join(keys, "_key", "left_anti")
        .drop("_key")
    )


def is_excluded(urls: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Flag each url that the list holds."""
    listed = _keys(exclusions, exclusion_key("url")).withColumn("_hit", F.lit(True))
    return (
        urls.withColumn("_key", exclusion_key("url"))
        .join(listed, "_key", "left")
        .withColumn("excluded", F.coalesce("_hit", F.lit(False)))
        .select(*urls.columns, "excluded")
    )
