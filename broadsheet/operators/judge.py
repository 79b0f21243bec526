"""Batches for an external judge, its replies, and the gates on its scores."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions.text import strip_ws
from broadsheet.operators.dedup import dedup_first
from broadsheet.operators.ordering import most_relevant_first, positions

# The prompt's heading and the patterns that unwrap a reply.
PROMPT_HEADING = "Score the following articles:\n\n"
CODE_FENCE = r"(?m)^```(?:json)?\s*|\s*```$"
OUTER_ARRAY = r"(?s)\[.*\]"

SCORED_BATCH = "batch_id bigint, idx bigint, url string, score double, error string"


def judge_batches(relevant: DataFrame, batch_size: int = 100) -> DataFrame:
    """Cut articles, most relevant first, into batches of batch_size.

    Adds batch_id and the 0-based idx inside the batch; a batch_size above
    the number of articles gives the single batch 0.
    """
    slim = relevant.select(
        "url", "title", "description", "source", "published_at", "relevance_score"
    )
    placed = positions(slim, most_relevant_first())
    return placed.withColumns(
        {
            "batch_id": F.floor(F.col("position") / batch_size).cast("bigint"),
            "idx": (F.col("position") % batch_size).cast("bigint"),
        }
    ).drop("position")


def judge_prompts(batches: DataFrame) -> DataFrame:
    """One prompt text per batch; a batch holds at most batch_size articles."""
    item = F.concat(
        F.col("idx").cast("string"), F.lit(". Title: "), F.coalesce("title", F.lit("")),
        F.lit("\n   Description: "), F.coalesce("description", F.lit("")),
    )
    items = F.array_sort(F.collect_list(F.struct("idx", item.alias("text"))))
    return batches.groupBy("batch_id").agg(
        F.count("*").cast("int").alias("expected_count"),
        F.concat(
            F.lit(PROMPT_HEADING), F.array_join(F.transform(items, lambda i: i["text"]), "\n")
        ).alias("prompt"),
    )


def decode_replies(replies: DataFrame) -> DataFrame:
    """Parse each reply into entries, the indices it misses and a status.

    All of it is local to the row. Status is ok, unparsable, not_an_array,
    malformed_entry or missing_scores.
    """
    blank = F.coalesce(strip_ws("content"), F.lit("")) == ""
    content = F.when(
        blank, F.coalesce(F.nullif(F.col("reasoning_content"), F.lit("")), F.col("content"))
    ).otherwise(F.col("content"))
    strict = {"allowSingleQuotes": "false"}

    def items(c: str) -> Column:
        """Elements of an array: this reader takes a bare NaN and, of a repeated key, the last."""
        return F.when(F.col(c).startswith("["), F.from_json(c, "array<string>", strict))

    is_json = items("_clean").isNotNull() | F.try_parse_json("_clean").isNotNull()
    found = F.nullif(F.regexp_extract("_clean", OUTER_ARRAY, 0), F.lit(""))
    shape = "array<struct<index:string,sentiment_score:string>>"
    parsed = (
        replies.withColumn("_clean", strip_ws(F.regexp_replace(content, CODE_FENCE, "")))
        .withColumn("_json", F.when(is_json, F.col("_clean")).otherwise(found))
        .withColumn("_len", F.size(items("_json")))
        .withColumn("_len", F.when(F.col("_len") >= 0, F.col("_len")))
        .withColumn("_raw", F.from_json("_json", shape, strict))
        .withColumn(
            "entries",
            F.transform(
                F.when(F.col("_len").isNotNull(), F.col("_raw")),
                lambda e: F.struct(
                    F.when(
                        e["index"].rlike(r"^\s*[+-]?\d+(\.0+)?\s*$"),
                        F.regexp_replace(F.trim(e["index"]), r"\.0+$", "").try_cast("bigint"),
                    ).alias("idx"),
                    F.btrim(e["sentiment_score"], F.lit(' "')).try_cast("double").alias("score"),
                ),
            ),
        )
    )
    wanted = F.when(
        F.col("expected_count") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("expected_count").cast("bigint") - 1)
    ).otherwise(F.array().cast("array<bigint>"))
    malformed = (
        F.col("entries").isNull()
        | (F.size("entries") != F.col("_len"))
        | F.exists("entries", lambda e: e.isNull() | e["idx"].isNull() | e["score"].isNull())
    )
    status = (
        F.when(F.col("_json").isNull() | (F.col("_len").isNull() & F.try_parse_json("_json").isNull()), "unparsable")
        .when(F.col("_len").isNull(), "not_an_array")
        .when(malformed, "malformed_entry")
        .when(F.size("missing") > 0, "missing_scores")
        .otherwise("ok")
    )
    return (
        parsed.withColumn(
            "missing",
            F.array_except(
                wanted,
                F.coalesce(F.transform("entries", lambda e: e["idx"]), F.array().cast("array<bigint>")),
            ),
        )
        .withColumn("status", status)
        .select("batch_id", "expected_count", "status", "missing", "entries")
    )


def judge_batch_status(replies: DataFrame) -> DataFrame:
    """Status of each reply and the number of indices it misses."""
    return decode_replies(replies).select(
        "batch_id", "expected_count", "status", F.size("missing").cast("bigint").alias("missing")
    )


def parse_judge_replies(replies: DataFrame) -> DataFrame:
    """(batch_id, idx, score) of the good replies; a later duplicate index wins."""
    entries = (
        decode_replies(replies)
        .filter("status = 'ok'")
        .select("batch_id", "expected_count", F.posexplode("entries").alias("_pos", "_e"))
        .select("batch_id", "expected_count", "_pos", "_e.idx", "_e.score")
        .filter("idx >= 0 and idx < expected_count")
        .withColumn("_key", F.struct("batch_id", "idx"))
    )
    return dedup_first(entries, "_key", [F.col("_pos").desc()]).select("batch_id", "idx", "score")


def score_with(batches: DataFrame, scorer: Callable[[pd.DataFrame], Sequence[float]]) -> DataFrame:
    """Run a user's scorer on each batch (at most batch_size rows at a time).

    The scorer gets the batch ordered by idx and returns one number per row.
    If it raises or leaves a row out, the rows of that batch carry the error
    and no score, so the coverage check fails the run.
    """
    return score_opened(batches, lambda: scorer)


def score_opened(batches: DataFrame, open_scorer: Callable[[], Callable[[pd.DataFrame], Sequence[float]]]) -> DataFrame:
    """score_with for a scorer that is costly to set up: it is opened once per task, before the first batch.

    Rows come in Arrow batches, which bound the memory with the batch that is
    being filled. If opening raises, all rows of the task carry the error.
    """

    def scored(batch: pd.DataFrame, scorer, failure: str | None) -> pd.DataFrame:
        out = batch[["batch_id", "idx", "url"]].copy()
        try:
            if failure:
                return out.assign(score=None, error=failure)
            scores = [float(s) for s in scorer(batch)]
            if len(scores) != len(batch):
                raise ValueError(f"{len(scores)} scores for {len(batch)} articles")
            return out.assign(score=scores, error=None)
        except Exception as e:  # the judge is user code: any failure is its result
            return out.assign(score=None, error=str(e))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, failure, held = None, None, None
        for frame in frames:
            if scorer is None and failure is None and len(frame):
                try:
                    scorer = open_scorer()
                except Exception as e:  # so is setting it up
                    failure = str(e) or type(e).__name__
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = rows["batch_id"].iloc[-1] if len(rows) else None
            for number, batch in rows.groupby("batch_id", sort=True):
                if number != last:
                    yield scored(batch.reset_index(drop=True), scorer, failure)
            held = rows[rows["batch_id"] == last].reset_index(drop=True) if len(rows) else None
        if held is not None and len(held):
            yield scored(held, scorer, failure)

    rows = batches.select("batch_id", "idx", "url", "title", "description")
    return rows.repartition("batch_id").sortWithinPartitions("batch_id", "idx").mapInPandas(run, SCORED_BATCH)


def attach_scores(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """Set sentiment_score by url; null where the judge gave none.

    Scores are reduced to one per url first (the most critical one, should a
    url be scored twice), in the partitioning the join needs anyway.
    """
    one = scores.groupBy("url").agg(F.min("score").alias("_score"))
    return (
        articles.join(one, "url", "left")
        .withColumn("sentiment_score", F.col("_score"))
        .select(*articles.columns)
    )


def sentiment_gate(
    judged: DataFrame, max_score: float = 0.0, enabled: bool = True
) -> DataFrame:
    """Keep scores up to max_score; switched off, everything passes unscored."""
    if not enabled:
        return judged.withColumn("sentiment_score", F.lit(None).cast("double"))
    return judged.filter(F.col("sentiment_score") <= max_score)


def label_gate(judged: DataFrame, max_score: float = 0.0) -> DataFrame:
    """Label instead of filter: keep or drop."""
    return judged.withColumn(
        "verdict", F.when(F.col("sentiment_score") <= max_score, "keep").otherwise("drop")
    )


def compare_judges(
    articles: DataFrame, scores: DataFrame, max_score: float = 0.0,
    local: str = "local", remote: str = "remote",
) -> DataFrame:
    """Scores of two judges side by side, for articles both have scored.

    Both targets are gathered in one grouping by url instead of a self-join.
    """

    def of(target: str):
        return F.min(F.when(F.col("target") == target, F.col("score")))

    pair = (
        scores.filter(F.col("target").isin(local, remote))
        .groupBy("url")
        .agg(of(local).alias("local_score"), of(remote).alias("remote_score"))
        .filter("local_score is not null and remote_score is not null")
    )
    agree = (F.col("local_score") <= max_score) == (F.col("remote_score") <= max_score)
    return (
        articles.select("url", "title")
        .join(pair, "url")
        .withColumn("delta", F.col("local_score") - F.col("remote_score"))
        .withColumn("agree", agree)
    )


def compare_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count("*").alias("articles"),
        F.avg(F.abs("delta")).alias("mean_abs_delta"),
        F.count_if(~F.col("agree")).alias("disagreements"),
    )
