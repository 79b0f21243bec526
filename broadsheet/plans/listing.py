"""Read-only listings over a store."""

from datetime import datetime

from pyspark.sql import DataFrame

from broadsheet.functions.lexicon import DEFAULT_LEXICON, Lexicon
from broadsheet.operators.filters import recent
from broadsheet.operators.judge import (
    attach_scores, compare_judges, compare_summary, label_gate,
)
from broadsheet.operators.ordering import most_relevant_first, newest_first, ranked_limit
from broadsheet.operators.relevance import relevance_gate


def list_articles(
    store: DataFrame, run_at: datetime, hours: float, topic_only: bool = False,
    limit: int | None = None, min_score: float = 1.0, lexicon: Lexicon = DEFAULT_LEXICON,
) -> DataFrame:
    """Recent articles, newest first; topic_only keeps relevant ones, most relevant first."""
    rows = recent(store, run_at, hours)
    order = newest_first()
    if topic_only:
        rows, order = relevance_gate(rows, min_score, lexicon), most_relevant_first()
    return ranked_limit(rows, order, limit) if limit else rows.orderBy(*order)


def judge_listing(
    store: DataFrame, scores: DataFrame, run_at: datetime, hours: float,
    limit: int | None = None, min_score: float = 1.0, max_score: float = 0.0,
    lexicon: Lexicon = DEFAULT_LEXICON,
) -> DataFrame:
    """Recent relevant articles with one judge's score and its verdict."""
    rows = list_articles(store, run_at, hours, True, limit, min_score, lexicon)
    return label_gate(attach_scores(rows, scores).filter("sentiment_score is not null"), max_score)


def compare(
    store: DataFrame, scores: DataFrame, run_at: datetime, hours: float,
    limit: int | None = None, min_score: float = 1.0, max_score: float = 0.0,
    lexicon: Lexicon = DEFAULT_LEXICON,
) -> tuple[DataFrame, DataFrame]:
    """Two judges on recent relevant articles: the rows, and their summary."""
    rows = list_articles(store, run_at, hours, True, limit, min_score, lexicon)
    compared = compare_judges(rows, scores, max_score)
    return compared, compare_summary(compared)
