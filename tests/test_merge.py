from datetime import datetime

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import filters, merge
from broadsheet.operators.dedup import dedup_first
from broadsheet.sources.lists import exclusions_from, read_exclusions, read_values, write_exclusions

RUN_AT = datetime(2026, 7, 1, 12, 0)
BY_URL = ["published_at"]


def test_insert_is_first_wins_and_idempotent(articles, exclusions, rows):
    store = articles({"url": "u1", "title": "old"})
    batch = articles(
        {"url": "U1", "title": "new"}, {"url": "U2", "title": "late", "published_at": "2026-02-01"},
        {"url": "u2", "title": "early", "published_at": "2026-01-01"}, {"url": None}, {"url": ""},
        {"url": "U3/", "title": "barred"},
    )
    once = merge.insert_absent(store, batch, exclusions("u3"), BY_URL)
    want = [("u1", "old"), ("u2", "early")]
    assert rows(once, "url", "title") == want
    assert rows(merge.insert_absent(once, batch, exclusions("u3"), BY_URL), "url", "title") == want
    assert merge.new_articles(once, batch, exclusions("u3"), BY_URL).count() == 0


def test_trailing_slash_is_part_of_the_store_key(articles, exclusions, rows):
    batch = articles({"url": "a/"}, {"url": "a"})
    assert rows(merge.insert_absent(articles(), batch, exclusions(), BY_URL), "url") == [("a",), ("a/",)]


def test_exclusion_ignores_case_and_slashes(articles, exclusions, rows):
    df = articles({"url": "https://a.org/x//"}, {"url": "https://a.org/y"})
    assert rows(merge.not_excluded(df, exclusions("HTTPS://A.org/X/")), "url") == [("https://a.org/y",)]


def test_retention(articles, rows):
    df = articles(
        {"url": "old", "published_at": "2026-07-01 03:59"},
        {"url": "edge", "published_at": "2026-07-01 04:00"},
        {"url": "pinned", "published_at": "2020-01-01 00:00", "manual_review": True},
        {"url": "undated"}, {"url": "day", "published_at": "2026-07-01"},
        {"url": "noflag", "published_at": "2020-01-01 00:00", "manual_review": None},
    )
    assert rows(filters.apply_retention(df, RUN_AT, 8), "url") == [("edge",), ("noflag",), ("pinned",), ("undated",)]
    assert rows(filters.expired(df, RUN_AT, 8), "url") == [("day",), ("old",)]
    assert rows(filters.recent(df, RUN_AT, 8), "url") == [("edge",)]


def test_pins(articles, rows):
    store = articles({"url": "a"}, {"url": "b"}, {"url": "c", "manual_review": True})
    kept = articles({"url": "a", "sentiment_score": -1.0})
    assert rows(merge.with_pinned(kept, store), "url", "sentiment_score") == [("a", -1.0), ("c", None)]
    marked = merge.mark_reviewed(store, articles({"url": "A"}, {"url": "a"}, {"url": "zz"}))
    assert rows(marked, "url", "manual_review") == [("a", True), ("b", False), ("c", True)]


def test_merge_reviewed_twice_changes_nothing(articles, exclusions, rows):
    store = articles({"url": "a", "title": "kept"})
    staging = articles({"url": "a", "title": "staged"}, {"url": "b", "title": "new"}, {"url": "x"})
    once = merge.merge_reviewed(store, staging, exclusions("x"))
    want = [("a", "kept", True), ("b", "new", True)]
    assert rows(once, "url", "title", "manual_review") == want
    assert rows(merge.merge_reviewed(once, staging, exclusions("x")), "url", "title", "manual_review") == want


def test_remove(articles, rows):
    store = articles({"url": "a"}, {"url": "b"})
    urls = articles({"url": "A"}, {"url": "c"})
    assert rows(merge.remove_keys(store, urls), "url") == [("b",)]
    assert rows(merge.removed_by_keys(store, urls), "url") == [("a",)]


def test_exclusion_list(spark, articles, exclusions, rows, tmp_path):
    listed = exclusions("a", "b")
    more = merge.add_exclusions(listed, articles({"url": "A"}, {"url": "C"}, {"url": "c"}), RUN_AT, None)
    assert rows(more, "url", "excluded_at") == [("a", ""), ("b", ""), ("c", "2026-07-01T12:00")]
    assert rows(merge.drop_exclusions(more, articles({"url": "B/"})), "url") == [("a",), ("c",)]
    flags = merge.is_excluded(articles({"url": "A/"}, {"url": "z"}), more)
    assert rows(flags, "url", "excluded") == [("A/", True), ("z", False)]


def test_exclusion_files(spark, rows, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('url,reason,excluded_at\nHttp://A/,"one, two",t1\n,blank,\nhttp://b,,\nhttp://a//,last,t2\n')
    listed = read_exclusions(spark, str(path))
    assert rows(listed, "url", "reason", "excluded_at") == [("http://a", "last", "t2"), ("http://b", "", "")]
    assert read_exclusions(spark, str(tmp_path / "none.csv")).count() == 0
    write_exclusions(listed, str(tmp_path / "out"))
    again = spark.read.csv(str(tmp_path / "out"), header=True, schema="url string, reason string, excluded_at string")
    assert rows(exclusions_from(again, [F.col("url")]), "url", "reason") == [("http://a", "last"), ("http://b", "")]
    with pytest.raises(Exception):
        write_exclusions(listed, str(tmp_path / "out"))
    assert [r.value for r in read_values(spark, str(path)).collect()] == ["Http://A/", "http://b", "http://a//"]


def test_sentinels_and_null_title(spark, rows):
    df = spark.createDataFrame(
        [("a", None, "S", "t"), ("b", "[Removed]", "S", "t"), ("c", "T", "Removed", "t"),
         ("HTTPS://removed.com", "T", "S", "t"), ("d", "T", "S", "1970-01-01T00:00:00Z")],
        "url string, title string, source string, published_at string",
    )
    assert rows(filters.drop_sentinels(df), "url") == [("a",)]


def test_exact_and_substring_exclusion_differ(articles, rows):
    df = articles({"url": "https://bad.com/1"}, {"url": "bad.com"})
    assert rows(filters.exclude_exact(df, "bad.com"), "url") == [("https://bad.com/1",)]
    assert filters.exclude_substring(df, "bad.com").count() == 0
    assert filters.exclude_substring(df, "").count() == 2


def test_source_exclusion(articles, rows):
    df = articles(
        {"url": "1", "source": "Fox News"}, {"url": "2", "source": "CNN International"},
        {"url": "https://cnn.com", "source": "X"}, {"url": "4", "source": None}, {"url": "5", "source": "Ok"},
    )
    assert rows(filters.exclude_sources(df, "fox-news,cnn"), "url") == [("4",), ("5",)]


def test_dedup_limits_each_key_before_the_shuffle(spark, plan):
    df = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) as k")
    out = dedup_first(df.repartition(4), "k", [F.col("id")])
    text = plan(out)
    assert text.index("Exchange hashpartitioning(k") < text.index("row_number(), 1, Partial")
    assert out.filter("k = 'hot'").first().id == 0
    assert out.count() == df.select("k").distinct().count()
