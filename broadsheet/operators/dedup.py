"""First-wins deduplication."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from broadsheet.functions.sieve import split_by_keys


def dedup_first(df: DataFrame, key: Column | str, order: list) -> DataFrame:
    """Keep the first row of each key in the given order.

    A `row_number() = 1` filter is planned with a group limit on the map
    side: each map task sends at most one row per key, so a key holding a
    third of all rows still reaches its reducer as a handful of rows.
    """
    key = F.col(key) if isinstance(key, str) else key
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


def dedup_stored(df: DataFrame, key: str, order: list) -> DataFrame:
    """The same for a table that is cheap to read several times: only rows whose key may repeat are shuffled; keys are not null."""
    repeated = df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    clear, unsure = split_by_keys(df, key, repeated)
    return clear.unionByName(dedup_first(unsure, key, order))
