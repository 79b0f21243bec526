"""Facts about a run."""

from pyspark.sql import Column, DataFrame, Observation, functions as F


def run_metrics(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows per named stage and category, as (stage, category, articles), for stages of several tables."""
    counted = None
    for name, df in stages.items():
        part = df.groupBy("category").agg(F.count("*").alias("articles")).select(
            F.lit(name).alias("stage"), "category", "articles"
        )
        counted = part if counted is None else counted.unionByName(part)
    return counted


def stage_metrics(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """The same for stages that are conditions on one table, in one pass; a stage without rows in a category has no row."""
    counts = df.groupBy("category").agg(*[F.count_if(cond).alias(f"_{k}") for k, cond in enumerate(stages.values())])
    each = F.array(*[F.struct(F.lit(name).alias("stage"), F.col(f"_{k}").alias("articles")) for k, name in enumerate(stages)])
    return counts.select("category", F.inline(each)).filter("articles > 0").select("stage", "category", "articles")


class Counts:
    """Rows per stage and category, counted while a job writes them anyway.

    Stages are conditions on the rows that pass. `categories` are the names a
    run is configured with; rows of any other, or of none, count as "other".
    Read `by_stage` after the job that writes what `watch` gave.
    """

    def __init__(self, categories: list[str]):
        self.categories = list(dict.fromkeys(categories))
        self._observed: list[tuple[Observation, list[str]]] = []

    def watch(self, df: DataFrame, stages: dict[str, Column]) -> DataFrame:
        seen = Observation()
        known = F.coalesce(F.col("category").isin(self.categories), F.lit(False))
        counts = []
        for k, condition in enumerate(stages.values()):
            counts += [F.count_if(condition & (F.col("category") == c)).alias(f"{k}:{j}") for j, c in enumerate(self.categories)]
            counts.append(F.count_if(condition & ~known).alias(f"{k}:other"))
        self._observed.append((seen, list(stages)))
        return df.observe(seen, *counts)

    def by_stage(self) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {}
        for seen, stages in self._observed:
            found = seen.get
            for k, stage in enumerate(stages):
                out[stage] = {c: found[f"{k}:{j}"] for j, c in enumerate(self.categories)} | {"other": found[f"{k}:other"]}
        return out
