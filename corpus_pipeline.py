"""Clean a corpus of documents: each stage is one operator of broadsheet.llm."""

from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import stages
from broadsheet.session import materialise

STAGES = stages.STAGES

#: SQL cannot express the learned and aligning stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
