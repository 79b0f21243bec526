"""Small helpers shared by the operators of this subpackage."""

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Where the package lies.
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), computed once however often use names it.

    A lambda variable is evaluated once per row; a column that the optimizer
    inlines into another lambda would be evaluated once per element.
    """
    return F.transform(F.array(value), use)[0]


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with this library on the path of the Python workers where they see the driver's files."""
    paths = df.sparkSession.sparkContext.environment
    if HOME not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, paths.get("PYTHONPATH")]))
    return df.mapInArrow(work, schema)


def map_rows(df: DataFrame, work: Callable[[list[dict]], Iterable[dict]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows, so long texts do not pile up as Python objects."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = list(work(batch.slice(at, rows).to_pylist()))
                yield pa.RecordBatch.from_pylist(out, schema=target)

    return map_batches(df, run, schema)


class Kept:
    """A cache of at most two generations of `size` entries; what is used moves on to the newer one."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and key in self.old:
            found = self.old[key]
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def __contains__(self, key) -> bool:
        return key in self.new or key in self.old
