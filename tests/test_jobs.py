import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from broadsheet.plans import curation, jobs, listing
from broadsheet.operators.judge import attach_scores, judge_batches, score_with, sentiment_gate
from broadsheet.operators.relevance import relevance_gate
from broadsheet.schemas import ALLOWED_SOURCE, API_RESPONSE, FEED_RESPONSE, NOTE, PAGE, SCORE, VALUE
from broadsheet.sources.store import Archive, Store
from broadsheet.streaming.landing import stream_feeds, stream_landing
from tests.test_landing import RSS, item
from tests.test_resolve_notes_pages import FULL, note

RUN_AT = datetime(2026, 7, 1, 12, 0)
LEX = [("river", 3.0), ("flood", 1.0)]


class World:
    def __init__(self, spark, path):
        self.spark = spark
        self.raw, self.filtered = Store(spark, f"{path}/raw"), Store(spark, f"{path}/filtered")
        self.archive = Archive(spark, f"{path}/archive")
        self.allowed = spark.createDataFrame([("Daily",)], ALLOWED_SOURCE)

    def landing(self, *items):
        body = json.dumps({"status": "ok", "articles": list(items)})
        return self.spark.createDataFrame([("general", 0, 1, 200, body)], API_RESPONSE)

    def run(self, judge, exclusions, run_at=RUN_AT, items=(), feed=None, **cfg):
        feeds = self.spark.createDataFrame([("u", 0, 200, feed)] if feed else [], FEED_RESPONSE)
        settings = jobs.Settings(lexicon=LEX, exclude_urls="bad.org", **cfg)
        return jobs.curate(
            self.raw, self.filtered, self.archive, self.landing(*items), feeds, self.allowed,
            exclusions, judge, run_at, settings,
        )


@pytest.fixture()
def world(spark, tmp_path):
    return World(spark, tmp_path)


def by_title(rows):
    """Flood news is bad news."""
    return rows.select("url", F.when(F.col("title").contains("flood"), -0.5).otherwise(0.5).alias("score"))


ITEMS = [
    item("https://a.org/1", "river flood"), item("https://a.org/2", "river walk"), item("https://a.org/3", "nothing"),
    item("https://a.org/4", "flood", source="Unknown"), item("https://a.org/5", "flood barred"),
]


def test_curate(world, articles, exclusions, rows):
    world.raw.write(articles(
        {"url": "https://a.org/1", "title": "old river flood", "published_at": "2026-07-01 09:00"},
        {"url": "stale", "title": "flood", "published_at": "2026-06-01 09:00"},
        {"url": "pinned", "title": "off topic", "published_at": "2026-06-01 09:00", "manual_review": True},
    ))
    facts = world.run(by_title, exclusions("https://a.org/5"), items=ITEMS, feed=RSS)
    assert rows(world.raw.read(), "url", "title") == [
        ("https://a.org/1", "old river flood"), ("https://a.org/2", "river walk"), ("https://a.org/3", "nothing"),
        ("https://f.org/1", "One"), ("https://f.org/2", "No title"), ("pinned", "off topic"),
    ]
    assert rows(world.filtered.read(), "url", "relevance_score", "sentiment_score") == [
        ("https://a.org/1", 4.0, -0.5), ("pinned", None, None),
    ]
    assert {k: facts[k] for k in ("removed", "stored", "relevant", "negative")} == {
        "removed": 1, "stored": 6, "relevant": 2, "negative": 1,
    }
    assert facts["published"].first().articles == 2
    assert world.archive.read("articles").count() == 6 and world.archive.read("filtered_articles").count() == 2


def test_rerun_changes_nothing(world, exclusions, rows):
    world.run(by_title, exclusions(), items=ITEMS)
    before = rows(world.raw.read(), "url"), rows(world.filtered.read(), "url", "sentiment_score")
    world.run(by_title, exclusions(), run_at=RUN_AT.replace(minute=5), items=ITEMS)
    assert (rows(world.raw.read(), "url"), rows(world.filtered.read(), "url", "sentiment_score")) == before


@pytest.mark.parametrize("kind", ["raises", "partial"])
def test_judge_failure_keeps_the_filtered_store(world, articles, exclusions, rows, kind):
    def judge(rows_):
        if kind == "raises":
            raise RuntimeError("down")
        return by_title(rows_).limit(1)

    world.filtered.write(articles({"url": "kept"}))
    facts = world.run(judge, exclusions(), items=ITEMS)
    assert facts["judge_error"]
    assert rows(world.filtered.read(), "url") == [("kept",)]
    assert world.archive.read("filtered_articles").count() == 0 and world.archive.read("articles").count() > 0


def test_nothing_relevant_leaves_only_pins(world, articles, exclusions, rows):
    world.raw.write(articles({"url": "pinned", "manual_review": True}))
    world.filtered.write(articles({"url": "gone"}))
    world.run(None, exclusions(), items=[item("https://a.org/3", "nothing")])
    assert rows(world.filtered.read(), "url") == [("pinned",)]


def test_switches(world, articles, exclusions, rows):
    world.filtered.write(articles({"url": "kept"}))
    world.run(by_title, exclusions(), items=ITEMS, filter_enabled=False)
    assert rows(world.filtered.read(), "url") == [("kept",)]
    world.run(None, exclusions(), run_at=RUN_AT.replace(minute=1), sentiment_enabled=False)
    assert rows(world.filtered.read(), "url", "sentiment_score") == [
        ("https://a.org/1", None), ("https://a.org/2", None), ("https://a.org/5", None),
    ]


def test_user_scorer_as_judge(world, exclusions, rows):
    def judge(relevant):
        return score_with(judge_batches(relevant, 2), lambda b: [-1.0 if "walk" in t else 1.0 for t in b["title"]])

    world.run(judge, exclusions(), items=ITEMS)
    assert rows(world.filtered.read(), "url") == [("https://a.org/2",)]


def test_single_plan_equals_the_stages(spark, articles, exclusions, rows):
    store = articles(
        {"url": "a", "title": "river flood"}, {"url": "b", "title": "river", "manual_review": True, "relevance_score": 9.0},
        {"url": "c", "title": "flood"}, {"url": "d", "title": "river", "manual_review": True},
        {"url": "e", "title": "none", "manual_review": True}, {"url": "x", "title": "flood"},
    )
    scores = spark.createDataFrame([("t", u, s) for u, s in (("a", -1.0), ("b", 1.0), ("c", 0.0), ("d", -0.5), ("x", -1.0))], SCORE)
    kept = sentiment_gate(attach_scores(relevance_gate(store, 1.0, LEX), scores))
    staged = curation.rebuilt_filtered(store, kept, exclusions("X"))
    columns = ("url", "relevance_score", "sentiment_score", "manual_review")
    assert rows(curation.curated_articles(store, scores, exclusions("X"), lexicon=LEX), *columns) == rows(staged, *columns)
    assert rows(staged, "url") == [("a",), ("b",), ("c",), ("d",), ("e",)]


def test_remove(world, articles, exclusions, rows):
    world.raw.write(articles({"url": "https://a.org/1", "title": "x"}, {"url": "https://a.org/2", "title": "y"}))
    world.filtered.write(articles({"url": "https://a.org/1", "title": "x"}))
    values = world.spark.createDataFrame([("https://a.org/1/",), ("https://new.org/",)], VALUE)
    listed, outcomes = jobs.remove_articles(values, world.raw, world.filtered, world.archive, exclusions(), "site.org", RUN_AT, "why")
    assert rows(world.raw.read(), "url") == [("https://a.org/2",)] and world.filtered.read().count() == 0
    assert rows(listed, "url", "reason", "excluded_at") == [
        ("https://a.org/1", "why", "2026-07-01T12:00"), ("https://new.org", "why", "2026-07-01T12:00"),
    ]
    version = world.raw.version()
    nothing = world.spark.createDataFrame([("no such words",)], VALUE)
    jobs.remove_articles(nothing, world.raw, world.filtered, world.archive, listed, "site.org", RUN_AT)
    assert world.raw.version() == version


def test_import_notes(world, exclusions, rows):
    spark = world.spark
    clips = spark.createDataFrame([
        note(1, "https://a.org/1\nriver"), note(2, "https://a.org/2\nriver"), note(3, "river"), note(4, "https://youtu.be/x\nriver"),
    ], NOTE)
    fetched = spark.createDataFrame([("https://a.org/1", FULL)], PAGE)
    funnel, dry = jobs.import_notes(clips, fetched, world.raw, exclusions(), "t", "river", dry_run=True)
    assert rows(dry, "url") == [("https://a.org/1",), ("https://a.org/2",)] and world.raw.version() == 0
    funnel, outcomes = jobs.import_notes(clips, fetched, world.raw, exclusions(), "t", "river")
    assert rows(outcomes, "url", "status") == [("https://a.org/1", "inserted"), ("https://a.org/2", "fetch_failed")]
    assert rows(world.raw.read(), "url", "title") == [("https://a.org/1", "T & U")]
    assert funnel.first().unresolved == 1
    _, again = jobs.import_notes(clips, fetched, world.raw, exclusions(), "t", "river")
    assert rows(again, "status") == [("duplicate",), ("fetch_failed",)] and world.raw.read().count() == 1


def test_merge_reviewed_job(world, articles, exclusions, rows, tmp_path):
    staging = Store(world.spark, f"{tmp_path}/staging")
    assert jobs.merge_reviewed_staging(staging, world.raw, world.filtered, world.archive, exclusions(), RUN_AT) == {}
    staging.write(articles({"url": "a", "title": "staged"}, {"url": "b"}))
    world.raw.write(articles({"url": "a", "title": "raw"}))
    added = jobs.merge_reviewed_staging(staging, world.raw, world.filtered, world.archive, exclusions(), RUN_AT)
    assert added == {"articles": 1, "filtered_articles": 2}
    assert rows(world.raw.read(), "url", "title", "manual_review") == [("a", "raw", True), ("b", None, True)]
    assert world.archive.read("articles").count() == 2


def test_add_pages_lifts_exclusion_and_pins(world, articles, exclusions, rows):
    world.raw.write(articles({"url": "https://a.org/2", "title": "known"}))
    data = [(1, "https://A.org/1", FULL), (2, "https://a.org/2", FULL), (3, "https://a.org/3", None)]
    batch = world.spark.createDataFrame(data, "page_id int, url string, html string")
    listed, outcomes, counts = jobs.add_pages(batch, world.raw, world.filtered, exclusions("https://a.org/1", "other"))
    assert rows(listed, "url") == [("other",)]
    assert rows(outcomes, "page_id", "status") == [(1, "inserted"), (2, "duplicate"), (3, "fetch_failed")]
    assert rows(world.filtered.read(), "url", "title", "manual_review") == [
        ("https://a.org/1", "T & U", True), ("https://a.org/2", "known", True),
    ]
    assert rows(world.raw.read(), "manual_review") == [(False,), (False,)]


def test_publish_archive(world, articles, tmp_path):
    world.archive.snapshot(articles({"url": "a", "title": "T"}), "filtered_articles", RUN_AT)
    jobs.publish_archive(world.archive, f"{tmp_path}/out")
    assert "<h2>2026-07-01</h2>" in "".join(p.read_text() for p in (tmp_path / "out").glob("*/part-*"))


def test_listings(spark, articles):
    store = articles(
        {"url": "a", "title": "flood", "published_at": "2026-07-01 11:00"}, {"url": "b", "title": "river", "published_at": "2026-07-01 10:00"},
        {"url": "c", "title": "x", "published_at": "2026-07-01 11:30"}, {"url": "d", "title": "river", "published_at": "2026-06-01 10:00"},
    )
    assert [r.url for r in listing.list_articles(store, RUN_AT, 8).collect()] == ["c", "a", "b"]
    top = listing.list_articles(store, RUN_AT, 8, topic_only=True, limit=1, lexicon=LEX).collect()
    assert [(r.url, r["rank"]) for r in top] == [("b", 1)]
    assert [r.url for r in listing.list_articles(store, RUN_AT, 8, topic_only=True, lexicon=LEX).collect()] == ["b", "a"]


def test_compare_needs_every_score(spark, articles):
    store = articles(*[{"url": u, "title": "flood", "published_at": "2026-07-01 11:00"} for u in "ab"])
    data = [("local", "a", -1.0), ("remote", "a", 1.0), ("local", "b", -1.0)]
    cfg = jobs.Settings(lexicon=LEX)
    assert jobs.compare_targets(store, spark.createDataFrame(data, SCORE), RUN_AT, 8, cfg=cfg) is None
    full = spark.createDataFrame([*data, ("remote", "b", -1.0)], SCORE)
    _rows, summary = jobs.compare_targets(store, full, RUN_AT, 8, cfg=cfg)
    assert summary.first().asDict() == {"articles": 2, "mean_abs_delta": 1.0, "disagreements": 1}


def test_stream_is_incremental_and_idempotent(world, exclusions, rows, tmp_path):
    folder = f"{tmp_path}/landing"

    def go(checkpoint):
        stream_landing(world.spark, folder, world.raw, world.allowed, exclusions(), f"{tmp_path}/{checkpoint}").awaitTermination()
        return rows(world.raw.read(), "url", "title")

    world.landing(item("https://a.org/1", "one"), item("https://a.org/1", "again")).write.json(folder)
    assert go("c1") == [("https://a.org/1", "one")]
    world.landing(item("https://a.org/1", "later"), item("https://a.org/2", "two")).write.mode("append").json(folder)
    want = [("https://a.org/1", "one"), ("https://a.org/2", "two")]
    assert go("c1") == want
    # A lost checkpoint delivers everything again.
    assert go("c2") == want


def test_feed_stream(world, exclusions, rows, tmp_path):
    world.spark.createDataFrame([("u", 0, 200, RSS)], FEED_RESPONSE).write.json(f"{tmp_path}/feeds")
    stream_feeds(world.spark, f"{tmp_path}/feeds", world.raw, exclusions(), f"{tmp_path}/c", RUN_AT, jobs.Settings(exclude_urls="bad.org")).awaitTermination()
    assert rows(world.raw.read(), "url", "title") == [("https://f.org/1", "One"), ("https://f.org/2", "No title")]


def test_publication_and_rejects(world, exclusions, rows, tmp_path):
    site, rejects = f"{tmp_path}/site", f"{tmp_path}/rejects"
    bad = dict(item("https://a.org/9", "river flood"), publishedAt="some day")

    def run(run_at, *items):
        return jobs.curate(
            world.raw, world.filtered, world.archive, world.landing(*items), world.spark.createDataFrame([], FEED_RESPONSE),
            world.allowed, exclusions(), by_title, run_at, jobs.Settings(lexicon=LEX), site=site, rejects=rejects,
        )

    assert run(RUN_AT, bad)["site_written"] is False  # an empty store leaves the publication alone
    assert run(RUN_AT.replace(day=2), bad, *ITEMS)["rejected"] == 1
    assert rows(world.spark.read.parquet(rejects), "url", "reason") == [("https://a.org/9", "published_at")] * 2
    first = world.spark.read.text(f"{site}/payload").first().value
    assert "https://a.org/1" in first
    old = sorted((tmp_path / "site/digests/snapshot_date=2026-07-01").iterdir())
    run(RUN_AT.replace(day=3), item("https://a.org/7", "new flood by the river"))
    assert sorted((tmp_path / "site/digests/snapshot_date=2026-07-01").iterdir()) == old
    assert (tmp_path / "site/digests/snapshot_date=2026-07-03").exists()


def test_unfinished_run_is_not_archived(world, articles, tmp_path):
    world.archive.snapshot(articles({"url": "a"}), "articles", RUN_AT)
    articles({"url": "b"}).write.parquet(f"{tmp_path}/archive/rows/store=articles/snapshot_date=2026-07-02/run=2026-07-02T1200")
    assert [r.url for r in world.archive.read("articles").collect()] == ["a"]


def test_a_removal_that_dies_leaves_the_url_blocked(spark, world, articles, exclusions, tmp_path, monkeypatch):
    from broadsheet.sources.lists import read_exclusions

    world.raw.write(articles({"url": "https://a.org/1", "title": "river flood"}))
    values = spark.createDataFrame([("https://a.org/1",)], VALUE)

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "remove", dies)  # the first write to a store
    with pytest.raises(RuntimeError):
        jobs.remove_articles(values, world.raw, world.filtered, world.archive, exclusions(), "site.org", RUN_AT, exclusion_file=str(tmp_path / "listed"))
    listed = read_exclusions(spark, str(tmp_path / "listed"))
    assert [r["url"] for r in listed.collect()] == ["https://a.org/1"]
    world.raw.clear()
    world.run(by_title, listed, items=ITEMS[:1], hours=1e6)
    assert world.raw.read().count() == 0


def test_a_repeated_run_is_refused_before_it_writes(world, exclusions):
    world.run(by_title, exclusions(), items=ITEMS, hours=1e6)
    version = world.raw.version()
    with pytest.raises(ValueError):
        world.run(by_title, exclusions(), items=ITEMS, hours=1e6)
    assert world.raw.version() == version


def test_facts_by_category(world, articles, exclusions):
    world.raw.write(articles({"url": "https://b.org/1", "title": "river flood", "published_at": "2020-01-01 00:00", "category": "old"}))
    facts = world.run(by_title, exclusions(), items=ITEMS, hours=48, categories=["general"])
    assert facts["by_category"]["removed"] == {"general": 0, "other": 1}
    assert {s: facts["by_category"][s]["general"] for s in ("stored", "relevant", "negative", "filtered", "pinned")} == {
        s: facts[s] for s in ("stored", "relevant", "negative", "filtered", "pinned")
    }


def _folders(spark, path, label):
    """Names of the tables a job has left below the shared folder, by their label."""
    from broadsheet.sources.lists import subfolders

    return set(subfolders(spark, path, f"{label}-"))


def test_merge_reviewed_staging_writes_a_batch_once(world, spark, articles, exclusions, rows):
    """One batch for both stores; a repeated url, a barred one, one that is stored already, and rows no one staged."""
    from broadsheet.session import shared_dir

    staging = Store(spark, world.raw.path + "-staging")
    staging.write(articles(
        {"url": "https://a.org/1", "title": "older", "published_at": "2026-06-01 09:00"},
        {"url": "https://A.org/1", "title": "newer", "published_at": "2026-06-02 09:00"},
        {"url": "https://a.org/2", "title": "barred"}, {"url": "https://a.org/3", "title": "again"}, {"url": "", "title": "blank"},
    ))
    for store in (world.raw, world.filtered):
        store.write(articles({"url": "https://a.org/3", "title": "stored"}, {"url": "https://a.org/4", "title": "not staged"}))
    before = {label: _folders(spark, shared_dir(spark), label) for label in ("batch", "added")}
    added = jobs.merge_reviewed_staging(staging, world.raw, world.filtered, world.archive, exclusions("https://A.org/2/"), RUN_AT)
    assert added == {"articles": 1, "filtered_articles": 1}
    want = [("https://a.org/1", "newer", True), ("https://a.org/3", "stored", True), ("https://a.org/4", "not staged", False)]
    for store in (world.raw, world.filtered):
        assert rows(store.read(), "url", "title", "manual_review") == want
    assert rows(world.archive.read("articles"), "url", "title", "manual_review") == want
    assert len(_folders(spark, shared_dir(spark), "batch") - before["batch"]) == 1
    assert _folders(spark, shared_dir(spark), "added") == before["added"]


def test_curate_writes_texts_of_the_filtered_store_once(world, spark, articles, exclusions, rows):
    from broadsheet.session import shared_dir

    before = {label: _folders(spark, shared_dir(spark), label) for label in ("filtered", "judged")}
    facts = world.run(by_title, exclusions("https://a.org/5"), items=ITEMS)
    assert facts["relevant"] == 2 and facts["negative"] == 1 and facts["filtered"] == 1
    assert rows(world.filtered.read(), "url", "sentiment_score") == [("https://a.org/1", -0.5)]
    assert _folders(spark, shared_dir(spark), "filtered") == before["filtered"]
    judged, = _folders(spark, shared_dir(spark), "judged") - before["judged"]
    assert spark.read.parquet(f"{shared_dir(spark)}/{judged}").columns == ["url", "category", "sentiment_score"]
