"""The stages of corpus_pipeline: (spark, docs, sf_dir) -> DataFrame each."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.functions.sieve import without_keys
from broadsheet.llm import bpe, chosenpath, decontamination, language, linededup, toxicity
from broadsheet.llm.common import table
from broadsheet.llm.queries import vocabulary
from broadsheet.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; labels held out elsewhere are not learned from here either."""
    labels = table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, labels.where(~language.held_out(F.col("doc_id"))))
    toxic = materialise(scored.where("predicted = 1").select("doc_id"), "toxic")
    return without_keys(docs, "doc_id", toxic)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks of lines go from the later document; a document that loses all its lines goes with them."""
    name, taken = "lines lost", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    kept = linededup.deduplicate(docs, name)
    lost = F.col(name) > 0
    kept = kept.where(~lost | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(lost, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays."""
    gone = materialise(chosenpath.near_duplicates(docs).where("NOT kept").select("doc_id"), "near")
    return without_keys(docs, "doc_id", gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a test item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text."""
    return bpe.token_digests(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", tokens),
]
