from broadsheet.functions.sieve import sieve, without_keys


def test_sieve_loses_no_key_and_clears_most_others(spark):
    keys = spark.range(0, 300_000, 1009).toDF("k")
    rows = spark.range(0, 300_000, 7).toDF("doc_id").selectExpr("doc_id", "1 AS note")
    kept = sieve(rows, "doc_id", keys)
    assert kept.columns == ["doc_id", "note"]
    assert rows.join(keys, rows["doc_id"] == keys["k"]).count() == kept.join(keys, kept["doc_id"] == keys["k"]).count() > 0
    assert kept.count() < 0.01 * rows.count()
    assert without_keys(rows, "doc_id", keys).count() == rows.join(keys, rows["doc_id"] == keys["k"], "left_anti").count()


def test_nulls_repeats_and_no_keys(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "word string")
    keys = spark.createDataFrame([("a",), (None,)], "word string")
    assert sorted(str(r.word) for r in without_keys(rows, "word", keys).collect()) == ["None", "b"]
    assert without_keys(rows, "word", keys.limit(0)).count() == 4
    assert sieve(rows, "word", keys.limit(0)).count() == 0
