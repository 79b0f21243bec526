"""An article store whose folders are days and url buckets.

A plain Parquet folder, partitioned by Spark's own writer. What an operation
does not concern it neither reads nor writes:

* `recent` and `expire` go by day: whole folders are skipped or dropped, and
  only the day the limit falls into is looked at row by row. Pinned rows have
  a folder of their own beside the days, undated rows one without a day, so
  neither is in the way.
* `insert`, `remove` and `pin` go by url: only the buckets that a batch's urls
  fall into are searched, by their url column alone, and only the folders that
  hold one of them are written anew (dynamic partition overwrite).

New content is first written beside the folders it is for. Once it is whole
it counts: an operation that dies later is finished by the next one, one that
dies before has changed nothing. The first content of an empty store is written
straight to its place under a mark: until the mark is gone the store is empty.
One writer at a time.
"""

from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from broadsheet.functions.times import cutoff_text
from broadsheet.operators import filters
from broadsheet.operators.merge import absent_from, mark_reviewed, remove_keys, removed_by_keys
from broadsheet.operators.metrics import Counts
from broadsheet.schemas import ARTICLE, ARTICLE_COLUMNS, as_articles
from broadsheet.session import materialise
from broadsheet.sources.lists import make_folder, path_exists, remove_folder, subfolders

PINNED = "pinned"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for null
LAYOUT = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ARTICLE) + ", day string, bucket int"


class PartitionedStore:
    """A table of articles, unique by url, in folders day=.../bucket=..."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        """`buckets` belongs to the store: a path is always opened with the same number."""
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets
        self._pending = f"{self.path}/_pending"
        self._first = f"{self.path}/_first"

    # Where a row lies

    def bucket(self, url="url") -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def _placed(self, articles: DataFrame) -> DataFrame:
        # An empty text sorts before all dates and cannot name a folder; "0" does both.
        date = F.when(F.col("published_at") == "", "0").otherwise(F.left("published_at", F.lit(10)))
        day = F.when(F.col("manual_review"), PINNED).otherwise(date)
        return as_articles(articles).withColumns({"day": day, "bucket": self.bucket()})

    def _folders(self) -> list[tuple[str, str]]:
        """(day folder, bucket folder) of all partitions."""
        return [
            (day, bucket) for day in subfolders(self.spark, self.path, "day=")
            for bucket in subfolders(self.spark, f"{self.path}/{day}", "bucket=")
        ]

    # Reading

    def placed(self) -> DataFrame:
        """All rows with the columns their folders stand for; filters on these skip folders."""
        self._finish()
        if not subfolders(self.spark, self.path, "day=") or path_exists(self.spark, self._first):
            return self.spark.createDataFrame([], LAYOUT)
        return self.spark.read.schema(LAYOUT).parquet(self.path)

    def read(self) -> DataFrame:
        return self.placed().select(*ARTICLE_COLUMNS)

    def recent(self, run_at: datetime, hours: float) -> DataFrame:
        """filters.recent over the days since the limit; the pinned rows' folder sorts after all days."""
        since = cutoff_text(run_at, hours)[:10]
        return filters.recent(self.placed().where(F.col("day") >= since), run_at, hours).select(*ARTICLE_COLUMNS)

    def _near(self, urls: DataFrame) -> DataFrame:
        """The rows of the buckets that some urls fall into; there are at most `buckets` numbers to know."""
        wanted = [r[0] for r in urls.select(self.bucket()).distinct().collect()]
        return self.placed().where(F.col("bucket").isin(wanted))

    def absent(self, batch: DataFrame) -> DataFrame:
        """Rows of a materialised batch whose url is not stored."""
        return absent_from(batch, self._near(batch))

    # Changing

    def insert(self, articles: DataFrame) -> int:
        """Add the rows whose url is not stored yet, as new files of their folders; returns their number.

        The articles have one row per url. A batch delivered again adds nothing.
        """
        self._undo()
        batch = materialise(as_articles(articles), "batch")
        fresh = self.absent(batch)
        added = fresh.select("url").count()
        if added:
            self._write(self._placed(fresh), "append")
        return added

    def refresh(self, articles: DataFrame, run_at: datetime, hours: float, counts: Counts) -> None:
        """Drop what is too old, then insert the rest; stored rows are counted by their category column alone."""
        old = self.placed().where(F.col("day") <= cutoff_text(run_at, hours)[:10]).select("published_at", "manual_review", "category")
        materialise(counts.watch(filters.expired(old, run_at, hours), {"removed": F.lit(True)}).select("category"), "removed")
        self.expire(run_at, hours)
        self.insert(articles)
        materialise(counts.watch(self.placed().select("category"), {"stored": F.lit(True)}), "stored")

    def expire(self, run_at: datetime, hours: float) -> int:
        """filters.apply_retention: older days go as folders, unread; returns the number of rows dropped."""
        self._undo()
        cutoff = cutoff_text(run_at, hours)
        rows = self.placed()
        old = [d for d in subfolders(self.spark, self.path, "day=") if d != f"day={NO_DAY}" and unquote(d[4:]) < cutoff[:10]]
        gone = rows.where(F.col("day") < cutoff[:10]).count()  # from the files' footers
        edge = rows.where(F.col("day") == cutoff[:10])
        late = filters.expired(edge, run_at, hours).count()
        if late:
            self._replace(edge, filters.apply_retention(edge, run_at, hours))
        for folder in old:
            remove_folder(self.spark, f"{self.path}/{folder}")
        return gone + late

    def remove(self, urls: DataFrame) -> int:
        """remove_keys on the folders that hold one of the urls; returns the number of rows removed."""
        hit = self._holding(urls)
        gone = removed_by_keys(hit, urls).count()
        if gone:
            self._replace(hit, remove_keys(hit, urls))
        return gone

    def pin(self, urls: DataFrame) -> None:
        """mark_reviewed; what gets pinned moves to the folder of pinned rows as new files."""
        hit = self._holding(urls).where(F.coalesce(F.col("day") != PINNED, F.lit(True)))
        found = materialise(removed_by_keys(hit, urls).select(*ARTICLE_COLUMNS), "pinned")
        if found.isEmpty():
            return
        moved = mark_reviewed(found, urls)
        buckets = [r[0] for r in found.select(self.bucket()).distinct().collect()]
        pinned = self.placed().where((F.col("day") == PINNED) & F.col("bucket").isin(buckets))
        self._replace(hit.unionByName(pinned), remove_keys(hit, urls).unionByName(pinned).select(*ARTICLE_COLUMNS).unionByName(moved))

    def write(self, articles: DataFrame) -> None:
        """Replace the whole content."""
        self._undo()
        old = self.placed()
        if subfolders(self.spark, self.path, "day="):
            self._replace(old, articles)
            return
        make_folder(self.spark, self._first)
        self._write(self._placed(articles), "append")
        remove_folder(self.spark, self._first)

    def append(self, articles: DataFrame) -> None:
        """Add rows that are not stored; the caller has left out stored urls."""
        self._undo()
        self._write(self._placed(articles), "append")

    def clear(self) -> int:
        removed = self.placed().count()
        self.write(self.spark.createDataFrame([], ARTICLE))
        return removed

    def _holding(self, urls: DataFrame) -> DataFrame:
        """All rows of the folders that hold one of the urls. Urls alone are read to find these."""
        found = removed_by_keys(self._near(_by_key(urls)).select("url", "day", "bucket"), urls).select("day", "bucket").distinct().collect()
        folders = [self._folder(r["day"], r["bucket"]) for r in found]  # names of folders, not rows
        if not folders:
            return self.spark.createDataFrame([], LAYOUT)
        return self.spark.read.schema(LAYOUT).option("basePath", self.path).parquet(*folders)

    def _folder(self, day: str | None, bucket: int) -> str:
        if day is None:
            return f"{self.path}/day={NO_DAY}/bucket={bucket}"
        names = {unquote(d[4:]): d for d in subfolders(self.spark, self.path, "day=") if d != f"day={NO_DAY}"}
        return f"{self.path}/{names.get(day, f'day={day}')}/bucket={bucket}"

    def _write(self, placed: DataFrame, mode: str) -> None:
        # Rows of a folder meet, and a day with very many rows is split again by its size.
        rows = placed.hint("rebalance", "day", "bucket")
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("day", "bucket").parquet(self.path)

    def _replace(self, old: DataFrame, new: DataFrame) -> None:
        """Give the folders of the rows in `old` the rows of `new`, which lie in these folders."""
        self._placed(new).write.mode("overwrite").parquet(f"{self._pending}/rows")
        old.select("day", "bucket").distinct().write.mode("overwrite").parquet(f"{self._pending}/folders")
        self._finish()

    def _undo(self) -> None:
        """Remove what a first write that died has left."""
        if path_exists(self.spark, self._first):
            for day in subfolders(self.spark, self.path, "day="):
                remove_folder(self.spark, f"{self.path}/{day}")
            remove_folder(self.spark, self._first)

    def _finish(self) -> None:
        """Carry out a change whose new content is whole."""
        if not path_exists(self.spark, f"{self._pending}/folders/_SUCCESS"):
            return
        rows = self.spark.read.schema(LAYOUT).parquet(f"{self._pending}/rows")
        folders = self.spark.read.schema("day string, bucket int").parquet(f"{self._pending}/folders")
        self._write(rows, "overwrite")
        filled = rows.select("day", "bucket").distinct()
        emptied = folders.join(filled, (folders.day.eqNullSafe(filled.day)) & (folders.bucket == filled.bucket), "left_anti")
        for r in emptied.collect():  # names of folders
            remove_folder(self.spark, self._folder(r["day"], r["bucket"]))
        remove_folder(self.spark, self._pending)


def _by_key(urls: DataFrame) -> DataFrame:
    return urls.select(F.lower("url").alias("url")).where("url IS NOT NULL")
