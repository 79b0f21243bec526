import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import publish
from broadsheet.operators.ordering import newest_first, positions, store_order, top_articles
from broadsheet.session import shared_dir
from broadsheet.sources.store import Archive, Store, archive_articles, archive_dates

RUN_AT = datetime(2026, 7, 1, 4, 0)


@pytest.fixture()
def many_tasks(spark):
    """Keep every range partition, so that groups do spread over tasks."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def hot(spark, n=9000):
    """A third of the rows share one title, one time and one source."""
    same = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.concat(F.lit("u"), F.lpad("id", 6, "0")).alias("url"),
        F.when(same, "Same!").when(F.col("id") % 3 == 1, None).otherwise(F.col("id").cast("string")).alias("title"),
        F.when(same, "2026-01-01 00:00").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("published_at"),
        F.when(same, "s").otherwise(F.col("id").cast("string")).alias("source"),
    )


def newest(r):
    none = r.published_at is None
    return (none, [-ord(c) for c in r.published_at or ""] + [1], r.source is None, r.source or "", r.url)


def test_positions_over_many_tasks(spark, many_tasks):
    df = hot(spark)
    got = {r.url: r.position for r in positions(df, newest_first()).collect()}
    want = sorted(df.collect(), key=newest)
    assert got == {r.url: i for i, r in enumerate(want)}


def test_slugs_of_a_hot_title(spark, many_tasks):
    df = hot(spark)
    numbered = positions(df, newest_first(), within=["title"], name="n").withColumn("task", F.spark_partition_id())
    assert numbered.filter("title = 'Same!'").select("task").distinct().count() > 1
    got = {r.url: r.slug for r in publish.unique_slugs(df).collect()}
    seen, want = {}, {}
    from tests.test_functions import plain_slug

    for r in sorted(df.collect(), key=newest):
        base = plain_slug(r.title, r.url)
        seen[base] = seen.get(base, 0) + 1
        want[r.url] = base if seen[base] == 1 else f"{base}-{seen[base]}"
    assert got == want


def test_nothing_to_number(spark):
    assert publish.unique_slugs(hot(spark, 0)).count() == 0
    assert positions(hot(spark, 0), newest_first()).count() == 0


class Unset:
    """A session without the setting."""

    class conf:
        get = staticmethod(lambda key, default: default)

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": master})


def test_tables_go_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    files = positions(hot(spark, 30), newest_first()).inputFiles()
    assert files and all(shared_dir(spark) in f for f in files)


def test_only_a_local_session_may_lack_the_setting():
    assert shared_dir(Unset("local[2]")) == shared_dir(Unset("local[2]"))
    with pytest.raises(RuntimeError):
        shared_dir(Unset("yarn"))


def test_bounded_slugs_agree(spark):
    df = hot(spark, 300)
    a = publish.published_articles(df.withColumn("description", df["title"]), 300).select("url", "slug")
    b = publish.unique_slugs(df).select("url", "slug")
    assert sorted(a.collect()) == sorted(b.collect())


def test_top_list_is_no_full_sort(spark, articles, plan):
    df = articles(*[{"url": f"u{i}", "published_at": f"2026-01-{i + 1:02d} 00:00", "source": "s"} for i in range(20)])
    top = top_articles(df, 3)
    assert "TakeOrderedAndProject" in plan(top)
    assert [(r.url, r["rank"]) for r in top.orderBy("rank").collect()] == [("u19", 1), ("u18", 2), ("u17", 3)]


def test_nulls_come_last(articles):
    df = articles(
        {"url": "a"}, {"url": "b", "published_at": "2026-01-01 00:00"},
        {"url": "c", "published_at": "2026-01-01 00:00", "source": "z"},
        {"url": "d", "published_at": "2026-01-01"}, {"url": "e", "source": "q"},
    )
    assert [r.url for r in store_order(df).collect()] == ["c", "b", "d", "e", "a"]


def test_payload(articles):
    text = "“smart” \"plain\" é </script>"
    df = articles(
        {"url": "a", "title": text, "published_at": "2026-01-02 00:00"},
        {"url": "b", "title": text, "published_at": "2026-01-01 00:00"},
        {"url": "c", "published_at": "2025-01-01 00:00"},
    )
    out = publish.publish_payload(publish.published_articles(df, 2)).first()
    assert out.articles == 2 and "</" not in out.payload and "é" in out.payload
    back = json.loads(out.payload)
    assert [b["title"] for b in back] == [text, text] and back[0]["source"] is None
    assert [b["slug"] for b in back] == ["smart-plain-script", "smart-plain-script-2"]
    empty = publish.publish_payload(publish.published_articles(df.limit(0))).first()
    assert (empty.articles, empty.payload) == (0, "[]")


def test_store_versions_and_segments(spark, articles, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.read().count() == 0
    store.write(articles({"url": "a"}))
    store.append(articles({"url": "b"}))
    store.append(articles({"url": "c"}))
    assert rows(store.read(), "url") == [("a",), ("b",), ("c",)] and store.version() == 1
    store.write(store.read().filter("url <> 'a'"))
    assert rows(store.read(), "url") == [("b",), ("c",)] and store.version() == 2
    assert store.clear() == 2 and store.read().count() == 0


def test_failed_write_leaves_the_store(spark, articles, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(articles({"url": "a"}))
    boom = articles({"url": "b"}).withColumn("title", F.raise_error(F.lit("boom")).cast("string"))
    for attempt in (store.write, store.append):
        with pytest.raises(Exception):
            attempt(boom)
        assert rows(store.read(), "url") == [("a",)]


def test_store_without_the_flag_column(spark, rows, tmp_path):
    spark.createDataFrame([("a", "t")], "url string, title string").write.parquet(
        str(tmp_path / "s" / "v=0000000001" / "base")
    )
    assert rows(Store(spark, str(tmp_path / "s")).read(), "url", "title", "manual_review") == [("a", "t", False)]


def test_archive(spark, articles, rows, tmp_path, plan):
    archive = Archive(spark, str(tmp_path / "a"))
    assert archive.read().count() == 0 and archive_dates(archive.runs()).count() == 0
    one = articles({"url": "a", "title": "T", "published_at": "2026-07-01 01:00"})
    edited = articles({"url": "a", "title": "T2", "published_at": "2026-07-01 01:00"})
    archive.snapshot(one, "filtered", RUN_AT)
    with pytest.raises(ValueError):
        archive.snapshot(one, "filtered", RUN_AT)
    archive.snapshot(one, "filtered", RUN_AT, run_id="again")
    archive.snapshot(edited, "filtered", RUN_AT.replace(hour=12))
    archive.snapshot(one, "raw", RUN_AT)
    archive.snapshot(one.limit(0), "filtered", RUN_AT.replace(day=3))
    assert archive.read().count() == 4 and archive.read("filtered").count() == 3
    distinct = archive_articles(archive.read("filtered"))
    assert rows(distinct, "snapshot_date", "title") == [(date(2026, 7, 1), "T"), (date(2026, 7, 1), "T2")]
    dates = archive_dates(archive.runs().filter("store = 'filtered'"))
    assert [r[0] for r in dates.collect()] == [date(2026, 7, 3), date(2026, 7, 1)]
    pruned = plan(archive.read("filtered").filter("snapshot_date = '2026-07-01'").select("url"))
    assert "PartitionFilters: [isnotnull(store" in pruned and "ReadSchema: struct<url:string>" in pruned


def test_digest_files(spark, articles, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"))
    archive.snapshot(articles(
        {"url": "u?a&b", "title": "<old>", "published_at": "2026-07-01 01:00", "source": "S"},
        {"url": "n", "title": "", "published_at": "2026-07-01 02:00"},
    ), "filtered", RUN_AT)
    archive.snapshot(articles(), "filtered", RUN_AT.replace(day=2))
    lines = publish.digest_lines(archive_articles(archive.read("filtered")), archive.runs())
    publish.write_digests(lines, str(tmp_path / "out"))

    def digest(day):
        folder = tmp_path / "out" / f"snapshot_date=2026-07-{day:02d}"
        return "".join(p.read_text() for p in sorted(folder.glob("part-*")))

    assert digest(1) == (
        '<h2>2026-07-01</h2>\n<ul>\n  <li><a href="n" target="_blank">n</a> &mdash; </li>\n'
        '  <li><a href="u?a&amp;b" target="_blank">&lt;old&gt;</a> &mdash; S</li>\n</ul>\n'
    )
    assert digest(2) == "<h2>2026-07-02</h2>\n<p>No archived articles for this date.</p>\n"
