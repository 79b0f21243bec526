"""Article links from a note collection."""

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions.keys import host_of
from broadsheet.functions.text import strip_ws
from broadsheet.operators.dedup import dedup_first

# Hosts of video and question platforms, which are no articles.
PLATFORM_HOSTS = ("youtube.com", "www.youtube.com", "youtu.be", "quora.com", "www.quora.com")
LINES_SCANNED = 6


def matching_notes(notes: DataFrame, tag: str, keyword: str) -> DataFrame:
    """Live notes carrying the tag or mentioning the keyword in title or text."""
    keyword = keyword.lower()
    hit = (
        F.lower("tagLinks").contains(tag.lower())
        | F.lower("title").contains(keyword)
        | F.lower("text").contains(keyword)
    )
    return notes.filter((F.col("trashed") == 0) & (F.col("deleted") == 0) & hit)


def note_source_url(text: str = "text") -> Column:
    """The first of the leading lines that is a link and nothing else."""
    lines = F.slice(F.split(F.col(text), r"\R", LINES_SCANNED + 1), 1, LINES_SCANNED)
    bare = F.transform(lines, lambda line: F.rtrim(strip_ws(line), F.lit(".,)")))
    links = F.filter(
        bare, lambda line: line.rlike(r"(?U)^https?://\S+$") & ~line.contains("localhost")
    )
    return F.get(links, F.lit(0))


def note_hint_link(html: str = "html") -> Column:
    """The first link in the note's HTML: a lead for the curator, never inserted."""
    # Fixed value: the pattern of a link.
    links = F.regexp_extract_all(F.col(html), F.lit('href="(https?://[^"]+)"'), F.lit(1))
    return F.get(F.filter(links, lambda link: ~link.contains("localhost")), F.lit(0))


def excluded_host(url: str = "url", hosts=PLATFORM_HOSTS) -> Column:
    return F.coalesce(host_of(url).isin(*hosts), F.lit(False))


def resolve_notes(notes: DataFrame, hosts=PLATFORM_HOSTS) -> DataFrame:
    """Add url, hint_link and outcome: candidate, excluded or unresolved."""
    outcome = (
        F.when(F.col("url").isNull(), "unresolved")
        .when(excluded_host("url", hosts), "excluded")
        .otherwise("candidate")
    )
    return (
        notes.withColumn("url", note_source_url())
        .withColumn("hint_link", F.when(F.col("url").isNull(), note_hint_link()))
        .withColumn("outcome", outcome)
    )


def note_candidates(resolved: DataFrame, limit: int | None = None) -> DataFrame:
    """One note per candidate url, compared exactly; the first by id."""
    first = dedup_first(resolved.filter("outcome = 'candidate'"), "url", [F.col("id")])
    return first.orderBy("id").limit(limit) if limit else first


def note_funnel(resolved: DataFrame) -> DataFrame:
    """Candidates count distinct urls, the others notes."""
    return resolved.agg(
        F.count("*").alias("matching"),
        F.count_distinct(F.when(F.col("outcome") == "candidate", F.col("url"))).alias("candidates"),
        F.count_if(F.col("outcome") == "unresolved").alias("unresolved"),
        F.count_if(F.col("outcome") == "excluded").alias("excluded"),
    )
