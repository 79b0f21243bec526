import json

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import judge
from broadsheet.schemas import JUDGE_REPLY, SCORE


def reply(*pairs):
    return json.dumps([{"index": i, "sentiment_score": s} for i, s in pairs])


GOOD = reply((0, -0.5), (1, 0.25))
REPLIES = [
    (GOOD, None, "ok"),
    (f"```json\n{GOOD}\n```", None, "ok"),
    (f"Sure! {GOOD} Done.", None, "ok"),
    ("  ", GOOD, "ok"),
    (None, GOOD, "ok"),
    ('[{"index": "0", "sentiment_score": "-0.5"}, {"index": 1, "sentiment_score": 0.25}]', None, "ok"),
    ('[{"index": 3, "index": 0, "sentiment_score": -0.5}, {"index": 1, "sentiment_score": 0.25}]', None, "ok"),
    (reply((0, 9), (0, -0.5), (1, 0.25), (7, 1)), None, "ok"),
    ('{"index": 0, "sentiment_score": 1}', None, "not_an_array"),
    ("no json", None, "unparsable"),
    ("[broken", None, "unparsable"),
    ("", None, "unparsable"),
    (reply((0, 1)), None, "missing_scores"),
    ("[]", None, "missing_scores"),
    (reply((0, None), (1, 1)), None, "malformed_entry"),
    ('[{"index": 0}, {"index": 1, "sentiment_score": 1}]', None, "malformed_entry"),
    ('[{"index": 1.7, "sentiment_score": 1}]', None, "malformed_entry"),
    ("[1, 2]", None, "malformed_entry"),
]


def test_replies(spark, rows):
    data = [(i, 2, c, r) for i, (c, r, _) in enumerate(REPLIES)]
    df = spark.createDataFrame(data, JUDGE_REPLY)
    got = {r.batch_id: r.status for r in judge.judge_batch_status(df).collect()}
    assert [got[i] for i in range(len(REPLIES))] == [s for _, _, s in REPLIES]
    scores = rows(judge.parse_judge_replies(df), "batch_id", "idx", "score")
    good = [i for i, (_, _, s) in enumerate(REPLIES) if s == "ok"]
    assert scores == [(i, k, s) for i in good for k, s in ((0, -0.5), (1, 0.25))]


def test_bare_nan_is_a_score_the_gate_drops(spark, articles):
    df = spark.createDataFrame([(0, 2, '[{"index": 0, "sentiment_score": NaN}, {"index": 1, "sentiment_score": -1}]', None)], JUDGE_REPLY)
    assert judge.judge_batch_status(df).first().status == "ok"
    scores = {r.idx: r.score for r in judge.parse_judge_replies(df).collect()}
    assert scores[0] != scores[0] and scores[1] == -1.0
    found = articles({"url": "a", "sentiment_score": scores[0]}, {"url": "b", "sentiment_score": scores[1]})
    assert [r.url for r in judge.sentiment_gate(found).collect()] == ["b"]


def test_empty_batch_is_covered(spark):
    df = spark.createDataFrame([(1, 0, "[]", None)], JUDGE_REPLY)
    assert judge.judge_batch_status(df).first().status == "ok"


@pytest.fixture()
def relevant(articles):
    return articles(*[
        {"url": f"u{i}", "title": f"t{i}", "description": None, "relevance_score": float(i % 3)} for i in range(7)
    ])


def test_batches_follow_relevance_order(relevant, rows):
    batches = judge.judge_batches(relevant, 3)
    assert rows(batches, "batch_id", "idx", "url") == [
        (0, 0, "u2"), (0, 1, "u5"), (0, 2, "u1"), (1, 0, "u4"), (1, 1, "u0"), (1, 2, "u3"), (2, 0, "u6"),
    ]
    prompts = {r.batch_id: r for r in judge.judge_prompts(batches).collect()}
    assert prompts[2].prompt == "Score the following articles:\n\n0. Title: t6\n   Description: "
    assert prompts[0].expected_count == 3
    assert "\n1. Title: t5\n   Description: \n2. Title: t1" in prompts[0].prompt


def test_scorer_sees_whole_ordered_batches(relevant, rows):
    out = judge.score_with(judge.judge_batches(relevant, 4), lambda b: [len(b) + i for i in b["idx"]])
    assert rows(out, "batch_id", "idx", "score") == [
        (b, i, float(n + i)) for b, n in ((0, 4), (1, 3)) for i in range(n)
    ]


def test_scorer_failure_is_a_result(relevant, rows):
    def scorer(batch):
        if batch["batch_id"].iloc[0] == 1:
            raise RuntimeError("down")
        return [0.0] * (len(batch) - 1)

    out = judge.score_with(judge.judge_batches(relevant, 4), scorer)
    assert rows(out.select("batch_id", "score", "error").distinct(), "batch_id", "score", "error") == [
        (0, None, "3 scores for 4 articles"), (1, None, "down"),
    ]


def test_gates(spark, articles, rows):
    df = articles(*[{"url": u} for u in "abcde"])
    data = [("t", "a", -1.0), ("t", "b", 0.0), ("t", "c", 0.1), ("t", "d", float("nan")), ("t", "zz", -1.0)]
    judged = judge.attach_scores(df, spark.createDataFrame(data, SCORE))
    assert rows(judge.sentiment_gate(judged), "url") == [("a",), ("b",)]
    assert rows(judge.label_gate(judged), "url", "verdict")[:3] == [("a", "keep"), ("b", "keep"), ("c", "drop")]
    off = judge.sentiment_gate(judged, enabled=False)
    assert off.count() == 5 and off.filter("sentiment_score is not null").isEmpty()


def test_compare(spark, articles, rows):
    df = articles(*[{"url": u} for u in "abc"])
    data = [("local", "a", -0.5), ("remote", "a", 0.5), ("local", "b", -0.5), ("remote", "b", -0.25), ("local", "c", 1.0)]
    out = judge.compare_judges(df, spark.createDataFrame(data, SCORE))
    assert rows(out, "url", "delta", "agree") == [("a", -1.0, False), ("b", -0.25, True)]
    assert judge.compare_summary(out).first().asDict() == {
        "articles": 2, "mean_abs_delta": 0.625, "disagreements": 1,
    }


def test_repeated_scores_never_multiply_articles(spark, articles):
    df = articles({"url": "a"}, {"url": "b"})
    scores = spark.range(3000).select(
        F.lit("local").alias("target"), F.when(F.col("id") % 3 < 2, "a").otherwise("b").alias("url"),
        (F.col("id") / 3000).alias("score"),
    )
    assert judge.attach_scores(df, scores).count() == 2


def test_a_scorer_is_opened_once_per_task(spark, articles, tmp_path):
    """Batches larger than an Arrow batch arrive whole and in order; set-up runs once per task with rows."""
    import os
    import uuid

    relevant = articles(*[{"url": f"u{k:03}", "title": "t", "relevance_score": float(100 - k // 7)} for k in range(100)])
    batches = judge.judge_batches(relevant, 9)
    folder = str(tmp_path)

    def open_scorer():
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda b: [len(b) * 1000 + i for i in b["idx"]]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = judge.score_opened(batches, open_scorer)
        rows = got.collect()
        tasks = got.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 100 and all(r["error"] is None for r in rows)
    assert all(r["score"] == (1000 if r["batch_id"] == 11 else 9000) + r["idx"] for r in rows)
    assert 1 <= len(os.listdir(folder)) <= max(tasks, 8)

    def broken():
        raise ValueError("no model")

    assert {r["error"] for r in judge.score_opened(batches, broken).collect()} == {"no model"}
    none = articles().transform(lambda a: judge.judge_batches(a.withColumn("relevance_score", a["relevance_score"]), 4))
    assert judge.score_opened(none, broken).collect() == []
