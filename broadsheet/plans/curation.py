"""The curation plan as pure frames; jobs.py adds reading and writing."""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from broadsheet.functions.lexicon import DEFAULT_LEXICON, Lexicon
from broadsheet.operators.filters import apply_retention
from broadsheet.operators.judge import attach_scores
from broadsheet.operators.merge import insert_absent, not_excluded, with_pinned
from broadsheet.operators.relevance import relevance_score


def refreshed_store(
    store: DataFrame, landed: DataFrame, exclusions: DataFrame, order: list[str],
    run_at: datetime, hours: float,
) -> DataFrame:
    """Retention first, then the insert: an old item landed now stays until the next run."""
    kept = apply_retention(store, run_at, hours)
    batch = landed.withColumns(
        {
            "relevance_score": F.lit(None).cast("double"),
            "sentiment_score": F.lit(None).cast("double"),
            "manual_review": F.lit(False),
        }
    )
    return insert_absent(kept, batch, exclusions, [F.col(c) for c in order])


def rebuilt_filtered(store: DataFrame, kept: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Kept articles and the pinned ones, exclusions applied once more."""
    return not_excluded(with_pinned(kept, store), exclusions)


def curated_articles(
    store: DataFrame, scores: DataFrame, exclusions: DataFrame,
    min_score: float = 1.0, max_score: float = 0.0, lexicon: Lexicon = DEFAULT_LEXICON,
) -> DataFrame:
    """Relevance gate, judge gate, pins and exclusions in one pass over the store.

    Same rows as rebuilt_filtered over the gates, without reading or scoring
    the store twice: a row stays if it passes both gates or is pinned, and a
    pinned row that fails them keeps the scores it is stored with.
    """
    stored = store.withColumns({"_rel": F.col("relevance_score"), "_sent": F.col("sentiment_score")})
    # Only rows that can still stay carry their texts into the join.
    chance = relevance_score(stored, lexicon).filter(
        (F.col("relevance_score") >= min_score) | F.col("manual_review")
    )
    judged = attach_scores(chance, scores)
    passed = F.coalesce(
        (F.col("relevance_score") >= min_score) & (F.col("sentiment_score") <= max_score), F.lit(False)
    )
    kept = judged.withColumn("_passed", passed).filter("_passed or manual_review")
    merged = kept.withColumns(
        {
            "relevance_score": F.when(F.col("_passed"), F.col("relevance_score")).otherwise(F.col("_rel")),
            "sentiment_score": F.when(F.col("_passed"), F.col("sentiment_score")).otherwise(F.col("_sent")),
        }
    )
    return not_excluded(merged.select(*store.columns), exclusions)
