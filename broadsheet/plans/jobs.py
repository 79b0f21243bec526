"""Jobs over stores: the scheduled run and the curator's commands."""

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation, functions as F

from broadsheet.functions.keys import store_key
from broadsheet.functions.lexicon import DEFAULT_LEXICON, Lexicon
from broadsheet.operators.dedup import dedup_stored
from broadsheet.operators.judge import (
    attach_scores, compare_judges, compare_summary, sentiment_gate,
)
from broadsheet.operators.merge import add_exclusions, cleared, drop_exclusions, first_sightings
from broadsheet.operators.metrics import Counts
from broadsheet.operators.notes import matching_notes, note_candidates, note_funnel, resolve_notes
from broadsheet.operators.pages import classify_ingest, ingest_summary, inserted_articles
from broadsheet.operators.publish import (
    digest_lines, publish_payload, published_articles, write_digests,
)
from broadsheet.operators.relevance import relevance_gate
from broadsheet.operators.resolve import removal_set, resolve_values
from broadsheet.plans.curation import rebuilt_filtered
from broadsheet.plans.listing import list_articles
from broadsheet.session import materialise
from broadsheet.sources.api import api_articles, api_rejects, read_api_landing
from broadsheet.sources.feeds import LANDING_ORDER, feed_articles, land_all, read_feed_landing
from broadsheet.sources.lists import subfolders, write_exclusions
from broadsheet.sources.partitioned import PartitionedStore
from broadsheet.sources.store import Archive, Store, archive_articles, run_name

RAW, FILTERED = "articles", "filtered_articles"


@dataclass
class Settings:
    """What a run can be told; the defaults are those of the scheduled run."""

    hours: float = 8
    exclude_urls: str = "goodbullhunting.com,queerty.com"  # fixed value
    exclude_domains: str = ""
    filter_enabled: bool = True
    min_score: float = 1.0
    sentiment_enabled: bool = True
    max_score: float = 0.0
    limit: int = 30
    categories: list[str] = field(default_factory=lambda: ["politics", "general"])  # those that are counted by name
    lexicon: Lexicon = field(default_factory=lambda: list(DEFAULT_LEXICON))


def land(responses: DataFrame, feeds: DataFrame, allowed: DataFrame, run_at: datetime, cfg: Settings) -> DataFrame:
    """Landing tables to one batch of accepted articles."""
    api = api_articles(read_api_landing(responses), allowed, cfg.exclude_urls, cfg.exclude_domains)
    rss = feed_articles(read_feed_landing(feeds), run_at, cfg.exclude_urls)
    return land_all(api, rss)


def _unscored(batch: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("double")
    return batch.withColumns({"relevance_score": nothing, "sentiment_score": nothing, "manual_review": F.lit(False)})


def refresh(
    raw: Store | PartitionedStore, responses: DataFrame, feeds: DataFrame, allowed: DataFrame, exclusions: DataFrame,
    run_at: datetime, cfg: Settings | None = None, counts: Counts | None = None,
) -> dict:
    """Prune the raw store and insert what landed, with no gate; returns the counts."""
    cfg = cfg or Settings()
    counts = counts or Counts(cfg.categories)
    batch = _unscored(land(responses, feeds, allowed, run_at, cfg))
    raw.refresh(first_sightings(batch, exclusions, [F.col(c) for c in LANDING_ORDER]), run_at, cfg.hours, counts)
    return _totals(counts)


def _totals(counts: Counts) -> dict:
    return {stage: sum(found.values()) for stage, found in counts.by_stage().items()}


def curate(
    raw: Store | PartitionedStore, filtered: Store | PartitionedStore, archive: Archive,
    responses: DataFrame, feeds: DataFrame, allowed: DataFrame, exclusions: DataFrame,
    judge: Callable[[DataFrame], DataFrame] | None, run_at: datetime,
    cfg: Settings | None = None, run_id: str = "", site: str | None = None, rejects: str | None = None,
) -> dict:
    """The scheduled run; returns its facts and the published frame.

    `site` is the folder the payload and the digests are published to,
    `rejects` that of the rows that could not become articles, by run.

    `judge` takes the relevant articles and gives (url, score). If it raises
    or leaves an article unscored, the filtered store and its archive stay as
    they are; the raw store is written and archived all the same. A run whose
    snapshot exists already is refused before anything is written.

    Facts are counted while rows are written: totals by stage, and by stage
    and category under "by_category".
    """
    cfg = cfg or Settings()
    archive.refuse([RAW, FILTERED], run_at, run_id)
    counts = Counts(cfg.categories)
    exclusions = materialise(exclusions, "exclusions")  # its size is known then, and a small list is not met by shuffled texts
    facts = refresh(raw, responses, feeds, allowed, exclusions, run_at, cfg, counts)
    store = raw.read()

    if cfg.filter_enabled:
        gated = counts.watch(relevance_gate(store, cfg.min_score, cfg.lexicon), {"relevant": F.lit(True)})
        relevant = materialise(gated, "relevant")
        kept = None
        if not cfg.sentiment_enabled or not _totals(counts)["relevant"]:
            kept = sentiment_gate(relevant, enabled=False)
            facts["negative"] = _totals(counts)["relevant"]
        else:
            try:
                # Scores are settled and counted by url alone; texts meet them once, where the filtered store is written.
                score, unscored = F.col("sentiment_score"), Counts([])
                scored = unscored.watch(attach_scores(relevant.select("url", "category", "sentiment_score"), judge(relevant)), {"unscored": score.isNull()})
                judged = materialise(counts.watch(scored, {"negative": F.coalesce(score <= cfg.max_score, F.lit(False))}), "judged")
                if not _totals(unscored)["unscored"]:
                    kept = sentiment_gate(attach_scores(relevant, judged.select("url", score.alias("score"))), cfg.max_score)
                else:
                    facts["judge_error"] = "some articles have no score"
            except Exception as e:  # the judge is user code: its failure is an outcome
                facts["judge_error"] = str(e)
        if kept is not None:
            rebuilt = counts.watch(rebuilt_filtered(store, kept, exclusions), {"filtered": F.lit(True), "pinned": F.col("manual_review")})
            filtered.write(rebuilt)
            archive.snapshot(filtered.read(), FILTERED, run_at, run_id)
    archive.snapshot(store, RAW, run_at, run_id)
    seen = counts.by_stage() if "judge_error" not in facts else {k: v for k, v in counts.by_stage().items() if k != "negative"}
    facts = {stage: sum(found.values()) for stage, found in seen.items()} | facts | {"by_category": seen}
    facts["published"] = publish_payload(published_articles(filtered.read(), cfg.limit))
    if rejects:
        counted = Observation()
        bad = api_rejects(read_api_landing(responses)).observe(counted, F.count("*").alias("n"))
        bad.write.mode("overwrite").parquet(f"{rejects.rstrip('/')}/run={run_name(run_at, run_id)}")
        facts["rejected"] = counted.get["n"]
    if site:
        facts["site_written"] = publish(filtered, archive, site, cfg.limit)
    return facts


def compare_targets(
    store: DataFrame, scores: DataFrame, run_at: datetime, hours: float,
    limit: int | None = None, cfg: Settings | None = None, targets: tuple[str, str] = ("local", "remote"),
) -> tuple[DataFrame, DataFrame] | None:
    """Rows and summary of a comparison; None if a target left an article unscored."""
    cfg = cfg or Settings()
    asked = materialise(
        list_articles(store, run_at, hours, True, limit, cfg.min_score, cfg.lexicon), "asked"
    )
    compared = materialise(compare_judges(asked, scores, cfg.max_score, *targets), "compared")
    if compared.count() < asked.count():
        return None
    return compared, compare_summary(compared)


def publish_archive(archive: Archive, path: str, store: str = FILTERED) -> None:
    """Write the digests of the archive dates that have none yet, and of the newest date anew, in one job."""
    dates = archive.runs().filter(F.col("store") == store).select("snapshot_date").distinct()
    newest = dates.agg(F.max("snapshot_date").alias("d")).first()["d"]
    done = [name.split("=")[1] for name in subfolders(archive.spark, path, "snapshot_date=")]
    due = dates.filter(~F.col("snapshot_date").cast("string").isin(done) | (F.col("snapshot_date") == F.lit(newest)))
    rows = archive_articles(archive.read(store).join(due, "snapshot_date", "left_semi"))
    write_digests(digest_lines(rows, due), path)


def publish(filtered: Store, archive: Archive, path: str, limit: int = 30) -> bool:
    """Write the payload and the digests below path; an empty store leaves all as it was."""
    stored = filtered.read()
    if stored.isEmpty():
        return False
    payload = publish_payload(published_articles(stored, limit)).select(F.col("payload").alias("value"))
    payload.write.mode("overwrite").text(f"{path.rstrip('/')}/payload")
    if not archive.runs().filter(F.col("store") == FILTERED).isEmpty():
        publish_archive(archive, f"{path.rstrip('/')}/digests")
    return True


def remove_articles(
    values: DataFrame, raw: Store, filtered: Store, archive: Archive, exclusions: DataFrame,
    site_host: str, run_at: datetime, reason: str | None = None, run_id: str = "",
    site: str | None = None, exclusion_file: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Remove and block what the values name; returns (new exclusion list, outcomes).

    Without any match nothing is written. `exclusion_file` is a new folder for
    the new exclusion list, `site` the publication to refresh.
    """
    resolved = materialise(resolve_values(values, raw.read(), site_host), "resolved")
    urls = removal_set(resolved)
    if urls.isEmpty():
        return exclusions, resolved
    archive.refuse([RAW, FILTERED], run_at, run_id)
    # Blocked before removed: a job that dies in between leaves nothing the next run could land again.
    blocked = materialise(add_exclusions(exclusions, urls, run_at, reason), "blocked")
    if exclusion_file:
        write_exclusions(blocked, exclusion_file)
    for store, name in ((raw, RAW), (filtered, FILTERED)):
        store.remove(urls)
        archive.snapshot(store.read(), name, run_at, run_id)
    if site:
        publish(filtered, archive, site)
    return blocked, resolved


def import_notes(
    notes: DataFrame, pages: DataFrame, staging: Store, exclusions: DataFrame,
    tag: str, keyword: str, limit: int | None = None, dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Notes to staged articles; returns (funnel, outcomes per candidate or None on a dry run).

    `pages` (url, html) holds the fetched page of each candidate; one that is
    absent counts as fetch_failed.
    """
    resolved = resolve_notes(matching_notes(notes, tag, keyword))
    funnel = note_funnel(resolved)
    candidates = note_candidates(resolved, limit)
    if dry_run:
        return funnel, candidates.select("url", "title")
    # A page fetched twice is one page: a candidate must stay one row.
    fetched = candidates.select("id", "url").join(
        pages.groupBy("url").agg(F.max("html").alias("html")), "url", "left"
    )
    return funnel, _ingest(fetched, staging, exclusions, "id")


def _ingest(pages: DataFrame, store: Store, exclusions: DataFrame, order: str) -> DataFrame:
    outcomes = materialise(classify_ingest(pages, store.read(), exclusions, order), "ingest")
    store.insert(inserted_articles(outcomes))
    return outcomes


def merge_reviewed_staging(
    staging: Store, raw: Store, filtered: Store, archive: Archive, exclusions: DataFrame,
    run_at: datetime, run_id: str = "", site: str | None = None,
) -> dict[str, int]:
    """Merge staged articles into both stores and pin them; returns new rows per store."""
    reviewed = staging.read()
    added: dict[str, int] = {}
    if reviewed.isEmpty():
        return added
    archive.refuse([RAW, FILTERED], run_at, run_id)
    order = [F.col("published_at").desc_nulls_last(), F.col("source").asc_nulls_last()]
    keyed = dedup_stored(reviewed.withColumn("url", store_key("url")).filter("url <> ''"), "url", order)
    # Every staged url gets pinned, so new rows come pinned and only what was stored before is written anew.
    batch = materialise(cleared(keyed, exclusions).withColumn("manual_review", F.lit(True)), "batch")
    for store, name in ((raw, RAW), (filtered, FILTERED)):
        store.pin(reviewed)
        added[name] = store.insert(batch, ready=True)
        archive.snapshot(store.read(), name, run_at, run_id)
    if site:
        publish(filtered, archive, site)
    return added


def add_pages(
    pages: DataFrame, raw: Store, filtered: Store, exclusions: DataFrame, order: str = "page_id",
    exclusion_file: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ingest pages by hand; returns (new exclusion list, outcomes, counts per status).

    An added url is no longer excluded. What is in the raw store afterwards is
    copied to the filtered store and pinned there.
    """
    allowed = materialise(drop_exclusions(exclusions, pages.select("url")), "exclusions")
    outcomes = _ingest(pages, raw, allowed, order)
    urls = outcomes.filter("status in ('inserted', 'duplicate')").select(store_key("url").alias("url")).distinct()
    added = materialise(raw.read().join(urls, "url", "left_semi"), "added")
    if not added.isEmpty():
        filtered.insert(first_sightings(added, allowed, [F.col("url")]))
        filtered.pin(added)
    if exclusion_file:
        write_exclusions(allowed, exclusion_file)
    return allowed, outcomes, ingest_summary(outcomes)


def append_batch(store: Store, batch: DataFrame, exclusions: DataFrame, order: list[str]) -> int:
    """Insert a small batch as a segment of its own; returns the rows added.

    A batch delivered again finds its rows stored and adds nothing.
    """
    return store.insert(first_sightings(_unscored(batch), exclusions, [F.col(c) for c in order]))
