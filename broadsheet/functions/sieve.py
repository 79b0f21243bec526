"""A bounded filter ahead of a join: what cannot match is not shuffled."""

from pyspark.sql import DataFrame, functions as F

#: Bits of a sieve: 1 MB, 4 MB as numbers, whatever the number of keys.
SIEVE = 1 << 23
_WIDTH = 8 * 4096  # bits of one bitmap


def _marked(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df with `__may`: whether the value's bit is set among those of the keys; never false for a key."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    bits = keys.select(place(F.col(keys.columns[0])).alias("bit"))
    maps = bits.groupBy(F.floor(F.col("bit") / _WIDTH).alias("__map")).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(_WIDTH))).alias("__bits")
    )
    # Bytes become numbers once per bitmap: a row then costs one look into an array.
    number = lambda k: F.conv(F.hex(F.substring(F.col("__bits"), k, F.lit(1))), 16, 10).cast("int")
    maps = maps.select("__map", F.transform(F.sequence(F.lit(1), F.lit(_WIDTH // 8)), number).alias("__bits"))
    at = F.pmod(F.col("__bit"), F.lit(_WIDTH)).cast("int")
    set_ = F.getbit(F.get("__bits", F.shiftright(at, 3)), at.bitwiseAND(F.lit(7))) == 1
    rows = df.withColumn("__bit", place(F.col(column))).withColumn("__map", F.floor(F.col("__bit") / _WIDTH))
    # At most SIEVE / _WIDTH bitmaps: the broadcast is bounded.
    return rows.join(F.broadcast(maps), "__map", "left").withColumn("__may", F.coalesce(set_, F.lit(False)))


def sieve(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df without most of the rows whose value is not among keys (a frame of one column of the same type).

    A join still has to follow: rows may pass by chance, all of them where
    keys by far outnumber the bits.
    """
    return _marked(df, column, keys).where("__may").select(*df.columns)


def split_by_keys(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose value is surely not among keys, and the others."""
    marked = _marked(df, column, keys)
    return marked.where("NOT __may").select(*df.columns), marked.where("__may").select(*df.columns)


def without_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df without the rows whose value is among keys: an anti join that shuffles only rows the sieve cannot clear."""
    marked = _marked(df, column, keys)
    key = keys.select(F.col(keys.columns[0]).alias("__key"))
    unsure = marked.where("__may").join(key, F.col(column) == F.col("__key"), "left_anti")
    return marked.where("NOT __may").unionByName(unsure).select(*df.columns)


def with_matches(df: DataFrame, column: str, others: DataFrame) -> DataFrame:
    """df with the further columns of others, which has one row per key in a column of that name; null where it has none.

    A left join that shuffles only rows the sieve cannot clear, and these once. No side is broadcast.
    """
    marked = _marked(df, column, others.select(column))
    new = [f for f in others.schema if f.name != column]
    clear = marked.where("NOT __may").select(*df.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])
    unsure = marked.where("__may").select(*df.columns).join(others.hint("merge"), column, "left")
    return clear.unionByName(unsure)
