"""The store laid out by day and url bucket: what it reads, what it writes anew, and what a lost job leaves."""

import os
from datetime import datetime

import pytest

from broadsheet.operators import filters, merge
from broadsheet.sources.partitioned import PartitionedStore

RUN_AT = datetime(2024, 1, 20, 12, 0)


@pytest.fixture
def stored(spark, articles, tmp_path):
    """Thirty days of articles, four a day, some pinned, undated or oddly dated."""
    rows = [{"url": f"https://a.org/{d}-{k}", "published_at": f"2024-01-{d:02d} {6 * k:02d}:00", "title": "t", "manual_review": k == 3 and d % 7 == 0} for d in range(1, 31) for k in range(4)]
    rows += [{"url": "https://a.org/none"}, {"url": "https://a.org/empty", "published_at": ""}, {"url": "https://a.org/odd", "published_at": "a/b: c%d"}]
    rows += [{"url": "https://a.org/none-pinned", "manual_review": True}]
    frame = articles(*rows)
    made = PartitionedStore(spark, str(tmp_path / "store"), buckets=4)
    made.write(frame)
    return made, frame


def files(store):
    """Data files with their times: what an operation did not touch stays the same file."""
    out = {}
    for folder, _, names in os.walk(store.path):
        out |= {os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return out


def urls(df):
    return sorted(r["url"] for r in df.select("url").collect())


def days(paths):
    return {p.split("day=")[1].split("/")[0] for p in paths}


def test_recent_skips_older_days(stored, plan):
    store, frame = stored
    got = store.recent(RUN_AT, 72)
    assert urls(got) == urls(filters.recent(frame, RUN_AT, 72))
    text = plan(got)
    assert "PartitionFilters: [isnotnull(day" in text and ">= 2024-01-17" in text


def test_absent_searches_the_buckets_of_a_batch(spark, stored, articles, plan):
    store, frame = stored
    batch = articles({"url": "https://a.org/3-1"}, {"url": "https://b.org/new"})
    wanted = {r[0] for r in batch.select(store.bucket()).collect()}
    near = store._near(batch)
    filters_of = plan(near).split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters_of and all(str(b) in filters_of for b in wanted)
    assert {r["bucket"] for r in near.select("bucket").distinct().collect()} == wanted
    assert urls(store.absent(batch)) == ["https://b.org/new"]
    assert "ReadSchema: struct<url:string>" in plan(store.absent(batch))


def test_retention_drops_folders_and_looks_into_one_day(stored):
    store, frame = stored
    before = files(store)
    assert store.expire(RUN_AT, 72) == filters.expired(frame, RUN_AT, 72).count()
    after = files(store)
    assert urls(store.read()) == urls(filters.apply_retention(frame, RUN_AT, 72))
    fresh = {f for f in after if f not in before or after[f] != before[f]}
    assert days(fresh) == {"2024-01-17"}
    assert not any(d < "2024-01-17" for d in days(after) if d[0] == "2")
    assert store.expire(RUN_AT, 72) == 0 and files(store) == after


def test_changes_write_only_what_they_concern(stored, articles):
    store, frame = stored
    before = files(store)
    named = articles({"url": "HTTPS://A.org/5-1"}, {"url": "https://a.org/odd"}, {"url": "https://b.org/none"})
    assert store.remove(named) == 2
    assert days(set(before) ^ set(files(store))) == {"2024-01-05", "a%2Fb%3A c%25d"}
    assert urls(store.read()) == urls(merge.remove_keys(frame, named))
    before = files(store)
    marks = articles({"url": "https://a.org/6-1"}, {"url": "https://a.org/none"}, {"url": "https://a.org/7-3"})
    store.pin(marks)
    assert days(set(before) ^ set(files(store))) <= {"2024-01-06", "pinned", "__HIVE_DEFAULT_PARTITION__"}
    pinned = {r["url"] for r in store.read().where("manual_review").collect()}
    assert pinned == {f"https://a.org/{d}-3" for d in (7, 14, 21, 28)} | {"https://a.org/6-1", "https://a.org/none", "https://a.org/none-pinned"}
    after = files(store)
    store.pin(marks)
    assert files(store) == after


def test_inserting_again_adds_nothing(stored, articles):
    store, frame = stored
    batch = articles({"url": "https://b.org/1", "published_at": "2024-01-03 00:00"}, {"url": "https://a.org/3-1", "title": "other"})
    before = files(store)
    assert store.insert(batch) == 1
    after = files(store)
    assert set(before) <= set(after) and len(after) == len(before) + 1
    assert store.insert(batch) == 0 and files(store) == after
    assert store.read().where("url = 'https://a.org/3-1'").first()["title"] == "t"


def test_a_change_that_died_is_finished_or_left_undone(spark, stored, articles, monkeypatch):
    store, frame = stored
    named = articles({"url": "https://a.org/5-1"}, {"url": "https://a.org/9-2"})

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(PartitionedStore, "_write", dies)
    with pytest.raises(RuntimeError):
        store.remove(named)  # the new content is whole, nothing of it is in place
    monkeypatch.undo()
    assert urls(PartitionedStore(spark, store.path, 4).read()) == urls(merge.remove_keys(frame, named))

    before = urls(store.read())
    monkeypatch.setattr(PartitionedStore, "_placed", dies)
    with pytest.raises(RuntimeError):
        store.remove(articles({"url": "https://a.org/6-1"}))
    monkeypatch.undo()
    assert urls(PartitionedStore(spark, store.path, 4).read()) == before


def test_an_empty_store(spark, articles, tmp_path):
    store = PartitionedStore(spark, str(tmp_path / "none"))
    some = articles({"url": "https://a.org/1", "published_at": "2024-01-19 00:00"})
    assert store.read().count() == 0 and store.recent(RUN_AT, 72).count() == 0 and store.expire(RUN_AT, 1) == 0
    assert store.remove(some) == 0
    store.pin(some)
    assert store.insert(some) == 1 and store.clear() == 1 and store.read().count() == 0


def test_the_first_content_is_written_straight_or_undone(spark, articles, tmp_path, monkeypatch):
    store = PartitionedStore(spark, str(tmp_path / "first"), 2)
    some = articles({"url": "https://a.org/1", "published_at": "2024-01-19 00:00"}, {"url": "https://a.org/2", "manual_review": True})
    with monkeypatch.context() as m:  # died after its rows were in place, before the mark was gone
        m.setattr("broadsheet.sources.partitioned.remove_folder", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.write(some)
    assert store.read().count() == 0 and store.expire(RUN_AT, 1) == 0 and store.read().count() == 0
    monkeypatch.setattr(PartitionedStore, "_replace", None)  # nothing to protect: no copy beside the store
    store.write(some)
    assert urls(PartitionedStore(spark, store.path, 2).read()) == ["https://a.org/1", "https://a.org/2"]
