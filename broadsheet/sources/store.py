"""Article stores and the snapshot archive: plain Parquet folders."""

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from broadsheet.functions.sieve import sieve
from broadsheet.functions.times import timestamp_of
from broadsheet.operators.filters import apply_retention, is_expired
from broadsheet.operators.merge import absent_from, mark_reviewed, remove_keys
from broadsheet.operators.metrics import Counts
from broadsheet.schemas import ARTICLE, ARTICLE_COLUMNS, as_articles
from broadsheet.session import materialise
from broadsheet.sources.lists import path_exists, subfolders


class Store:
    """A table of articles, unique by url.

    `write` makes a new version folder v=N; `append` adds a segment folder to
    the newest version, so an insert costs its own rows only. A folder counts
    once Spark has put _SUCCESS into it: a failed job leaves the store as it
    was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _done(self, folder: str) -> bool:
        return path_exists(self.spark, f"{folder}/_SUCCESS")

    def version(self) -> int:
        """Number of the newest version, 0 for an empty store."""
        for name in reversed(subfolders(self.spark, self.path, "v=")):
            if self._done(f"{self.path}/{name}/base"):
                return int(name[2:])
        return 0

    def _folder(self, version: int) -> str:
        return f"{self.path}/v={version:010d}"

    def read(self) -> DataFrame:
        version = self.version()
        if not version:
            return self.spark.createDataFrame([], ARTICLE)
        folder = self._folder(version)
        segments = [f"{folder}/{s}" for s in subfolders(self.spark, folder, "add-")]
        paths = [f"{folder}/base", *[s for s in segments if self._done(s)]]
        return as_articles(self.spark.read.schema(ARTICLE).parquet(*paths))

    def write(self, articles: DataFrame) -> int:
        """Replace the content; returns the new version."""
        version = self.version() + 1
        # A folder of this number without _SUCCESS is a failed attempt of an earlier job.
        as_articles(articles).write.mode("overwrite").parquet(f"{self._folder(version)}/base")
        return version

    def append(self, articles: DataFrame) -> None:
        """Add new rows as a segment of their own; the caller has left out stored urls."""
        if not self.version():
            self.write(self.spark.createDataFrame([], ARTICLE))
        folder = self._folder(self.version())
        as_articles(articles).write.parquet(f"{folder}/add-{uuid.uuid4().hex}")

    def insert(self, articles: DataFrame, ready: bool = False) -> int:
        """Add the rows whose url is not stored, one per url, as a segment; returns their number.

        Urls alone tell what is new; the rows are written once, where they belong.
        `ready`: the articles are a materialised table already.
        """
        batch = as_articles(articles) if ready else materialise(as_articles(articles), "batch")
        added = absent_from(batch, self.read())
        number = added.select("url").count()
        if number:
            self.append(added)
        return number

    def refresh(self, articles: DataFrame, run_at: datetime, hours: float, counts: Counts) -> None:
        """Drop what is too old, then add the rows whose url is not stored, one per url, in one new version."""
        before = self.read()
        batch = materialise(as_articles(articles), "batch")
        added = absent_from(batch, apply_retention(before, run_at, hours))
        rows = before.withColumn("_old", is_expired(run_at, hours)).unionByName(added.withColumn("_old", F.lit(False)))
        rows = counts.watch(rows, {"removed": F.col("_old"), "stored": ~F.col("_old")})
        self.write(rows.filter(~F.col("_old")))

    def remove(self, urls: DataFrame) -> None:
        self.write(remove_keys(self.read(), urls))

    def pin(self, urls: DataFrame) -> None:
        self.write(mark_reviewed(self.read(), urls))

    def clear(self) -> int:
        """Empty the store; returns the number of rows it had."""
        removed = self.read().count()
        self.write(self.spark.createDataFrame([], ARTICLE))
        return removed


def run_name(run_at: datetime, run_id: str = "") -> str:
    return run_at.strftime("%Y-%m-%dT%H%M") + (f"-{run_id}" if run_id else "")


RUNS = "store string, snapshot_date date, run string, articles bigint"


class Archive:
    """Append-only dated snapshots of stores, and a ledger of the runs that wrote them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.rows = f"{path.rstrip('/')}/rows"
        self.ledger = f"{path.rstrip('/')}/runs"

    def runs(self) -> DataFrame:
        if not path_exists(self.spark, self.ledger):
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(self.ledger)

    def refuse(self, stores: list[str], run_at: datetime, run_id: str = "") -> None:
        """Raise if one of the stores has this run's snapshot already; jobs ask before their first write."""
        run = run_name(run_at, run_id)
        taken = self.runs().filter(F.col("store").isin(stores) & (F.col("run") == run))
        if not taken.isEmpty():
            raise ValueError(f"{' or '.join(stores)} already has snapshot {run}")

    def snapshot(self, articles: DataFrame, store: str, run_at: datetime, run_id: str = "") -> None:
        """Add the rows of a store as of run_at.

        A second snapshot of a store in the same minute is refused unless its
        run id differs. A run owns its folder and enters the ledger last, so a
        repeated attempt replaces its own rows only.
        """
        self.refuse([store], run_at, run_id)
        run = run_name(run_at, run_id)
        folder = f"{self.rows}/store={store}/snapshot_date={run_at:%Y-%m-%d}/run={run}"
        counted = Observation()
        rows = stamped(articles, store, run_at).drop("store", "snapshot_date")
        rows.observe(counted, F.count("*").alias("n")).write.mode("overwrite").parquet(folder)
        entry = self.spark.range(1).select(
            F.lit(store).alias("store"), F.lit(run_at.date()).alias("snapshot_date"),
            F.lit(run).alias("run"), F.lit(counted.get["n"]).cast("bigint").alias("articles"),
        )
        entry.write.mode("append").parquet(self.ledger)

    def read(self, store: str | None = None) -> DataFrame:
        """Every archived row of the runs in the ledger; a store or date filter prunes folders."""
        schema = f"{_ddl()}, run_at timestamp, store string, snapshot_date date, run string"
        if not path_exists(self.spark, self.rows):
            return self.spark.createDataFrame([], schema)
        rows, done = self.spark.read.schema(schema).parquet(self.rows), self.runs()
        if store is not None:
            rows, done = rows.filter(F.col("store") == store), done.filter(F.col("store") == store)
        # Rows of a run that failed before its ledger entry are not archived.
        return rows.join(done.select("store", "snapshot_date", "run").distinct(), ["store", "snapshot_date", "run"], "left_semi").select(*rows.columns)


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ARTICLE)


def stamped(articles: DataFrame, store: str, run_at: datetime) -> DataFrame:
    """Rows of a store as its snapshot of run_at."""
    return articles.select(*ARTICLE_COLUMNS).withColumns(
        {
            "run_at": timestamp_of(run_at),
            "store": F.lit(store),
            "snapshot_date": F.lit(run_at.date()),
        }
    )


def archive_articles(archive: DataFrame) -> DataFrame:
    """Distinct published fields per date; an edited title is a second row.

    Rows are told apart by 128 bits of their fields. Prints alone are shuffled
    to find the first snapshot of each; the texts that follow are those of the
    rows found, since the sieve holds back the copies of later snapshots.
    """
    fields = ["snapshot_date", "url", "title", "description", "source", "published_at"]
    # Nulls are skipped by the hash, so each field says whether it is one.
    given = [F.struct(F.col(c).isNull(), F.col(c)) for c in fields]
    prints = {"_p": F.xxhash64(*given), "_q": F.xxhash64(F.lit(1), *reversed(given))}
    rows = archive.select(*fields, "run_at").withColumns(prints)
    rows = rows.withColumn("_row", F.xxhash64("_p", "_q", "run_at"))
    first = rows.groupBy("_p", "_q").agg(F.min("run_at").alias("run_at"))
    found = sieve(rows, "_row", first.select(F.xxhash64("_p", "_q", "run_at").alias("_row")))
    return found.dropDuplicates(["_p", "_q"]).select(*fields)


def archive_dates(runs: DataFrame) -> DataFrame:
    """Dates with a snapshot, newest first, from rows or ledger."""
    return runs.select("snapshot_date").distinct().orderBy(F.col("snapshot_date").desc())
