"""CSV files curators keep by hand: the exclusion list and value lists."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.operators.merge import upsert_exclusions
from broadsheet.schemas import EXCLUSION


def exclusions_from(rows: DataFrame, order: list) -> DataFrame:
    """Listed rows as an exclusion list: keys normalised, blanks out, the last row of a key wins."""
    empty = rows.sparkSession.createDataFrame([], EXCLUSION)
    filled = rows.withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("reason", "excluded_at")}
    )
    return upsert_exclusions(empty, filled, order)


def _read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV with header, in a file or a folder of files. Fields may hold line breaks
    at every size; so a file is one task, and a long list comes as a folder of
    several, as `write_exclusions` leaves it."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', **options)


def read_exclusions(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame:
    """Exclusion list from a CSV file with header url,reason,excluded_at."""
    if missing_ok and not path_exists(spark, path):
        return spark.createDataFrame([], EXCLUSION)
    rows = _read_csv(spark, path, schema=EXCLUSION).select(
        "*", "_metadata.file_path", "_metadata.file_block_start",
        F.monotonically_increasing_id().alias("_line"),
    )
    last_first = [F.col(c).desc() for c in ("file_path", "file_block_start", "_line")]
    return exclusions_from(rows, last_first)


def write_exclusions(exclusions: DataFrame, path: str) -> None:
    """Full rewrite to a new folder; the list read must not be the folder written."""
    exclusions.select(*EXCLUSION.names).write.csv(
        path, header=True, escape='"', emptyValue="", mode="errorifexists"
    )


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """Values from the url column of a CSV file, blank rows left out."""
    rows = _read_csv(spark, path)
    return rows.select(F.col("url").alias("value")).filter(
        "value is not null and trim(value) <> ''"
    )


def _locate(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _locate(spark, path)
    return fs.exists(hadoop)


def subfolders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders in a folder that start with a prefix, in order."""
    fs, hadoop = _locate(spark, path)
    if not fs.exists(hadoop):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory()]
    return sorted(n for n in names if n.startswith(prefix))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it; an absent one is no error."""
    fs, hadoop = _locate(spark, path)
    fs.delete(hadoop, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, hadoop = _locate(spark, path)
    fs.mkdirs(hadoop)
