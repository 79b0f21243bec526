"""Keyword relevance."""

from pyspark.sql import DataFrame, functions as F

from broadsheet.functions.lexicon import (
    DEFAULT_LEXICON, WORD, Lexicon, listed, listed_words, matched_keywords, topic_text, weight_sum,
)
from broadsheet.functions.sieve import sieve
from broadsheet.functions.text import once


def with_keywords(articles: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Add the distinct keywords present in each article.

    The one-element explodes keep the optimizer from copying the text and its
    words into every keyword's test, and the matching into every later filter
    and projection: a text is cut into words once.
    """
    keywords = listed(entry[0] for entry in lexicon)
    words = F.explode(F.array(listed_words(topic_text(), keywords))).alias("__words")
    text = F.explode(F.array(topic_text())).alias("__text")
    found = F.explode(F.array(matched_keywords(F.col("__text"), F.col("__words"), keywords))).alias("keywords")
    return articles.select("*", words).select("*", text).select(*articles.columns, found)


def relevance_score(articles: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Set relevance_score: the weights of the keywords present, each counted once."""
    return (
        with_keywords(articles, lexicon)
        .withColumn("relevance_score", weight_sum(F.col("keywords"), lexicon))
        .drop("keywords")
    )


def relevance_gate(
    articles: DataFrame, min_score: float = 1.0, lexicon: Lexicon = DEFAULT_LEXICON
) -> DataFrame:
    """Keep articles scoring at least min_score."""
    return relevance_score(articles, lexicon).filter(F.col("relevance_score") >= min_score)


def keyword_frequency(articles: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Number of articles containing each keyword; absent keywords have no row."""
    return (
        with_keywords(articles, lexicon)
        .select(F.explode("keywords").alias("keyword"))
        .groupBy("keyword")
        .agg(F.count("*").alias("articles"))
    )


def score_by_table(articles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """relevance_score from a LEXICON(keyword, tier, weight) table of any size.

    The same function of article and lexicon as relevance_score: each tier a
    keyword stands in counts once, keywords without a word character match
    nothing. Texts are keyed by their digest, so equal texts are scored once
    and urls may repeat or be null. A keyword is looked up by that of its words
    which the fewest keywords have, so phrases that share a common word do not
    meet every article with it; words no keyword is looked up by go before any
    shuffle. A phrase found this way is verified against the whole text.
    """
    terms = (
        lexicon.select(F.lower("keyword").alias("keyword"), "tier", "weight")
        .distinct()
        .groupBy("keyword")
        .agg(F.sum("weight").alias("weight"))
        .filter(F.col("keyword").rlike(f"[{WORD}]"))
    )
    parts = terms.select(
        "keyword", "weight", F.explode(F.array_distinct(F.regexp_extract_all("keyword", F.lit(f"[{WORD}]+"), F.lit(0)))).alias("word")
    )
    holders = parts.groupBy("word").agg(F.count("*").alias("n"))
    keyed = (
        parts.join(holders, "word")
        .groupBy("keyword", "weight")
        .agg(F.min(F.struct("n", "word")).alias("rarest"))
        .select("keyword", "weight", F.col("rarest.word").alias("word"), (F.col("keyword") == F.col("rarest.word")).alias("whole"))
    )
    texts = articles.select(topic_text().alias("_text"))
    words = sieve(
        texts.select(F.md5("_text").alias("_key"), F.explode(F.array_distinct(F.split("_text", f"[^{WORD}]+"))).alias("word")),
        "word", keyed.select("word"),
    )
    phrase = F.when(~F.col("whole"), F.struct("keyword", "weight"))
    found = (
        words.distinct().join(keyed, "word")
        .groupBy("_key")
        .agg(
            F.sum(F.when(F.col("whole"), F.col("weight"))).alias("_words"),
            F.collect_set(phrase).alias("_phrases"),
        )
    )

    def present(text, p):
        literal = F.regexp_replace(p["keyword"], r"([^\p{L}\p{N}_\s])", r"\\$1")
        pattern = F.concat(F.lit(f"(^|[^{WORD}])"), literal, F.lit(f"($|[^{WORD}])"))
        return F.contains(text, p["keyword"]) & F.rlike(text, pattern)

    kept = once(topic_text(), lambda text: F.filter("_phrases", lambda p: present(text, p)))
    phrases = F.aggregate(kept, F.lit(0.0), lambda total, p: total + p["weight"])
    score = F.coalesce("_words", F.lit(0.0)) + F.coalesce(phrases, F.lit(0.0))
    return (
        articles.withColumn("_key", F.md5(topic_text()))
        .join(found, "_key", "left")
        .withColumn("relevance_score", score)
        .select(*articles.columns)
    )
