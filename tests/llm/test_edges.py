"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib

import public_tokenizers
import pytest

from broadsheet.llm import bpe, chat, chosenpath, decontamination, language, license, linededup, quality, recompression, stages, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
CLASH = ["lines lost", "ids", "words", "anchors", "lines", "row", "rep", "node", "w", "l", "dense", "spans", "lost", "hash", "terms", "score"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASH)


def frame(spark, rows):
    """(doc_id, text[, lang]) with columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, *CLASH) for r in rows], SCHEMA)


LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
ODD = [(None, None), (None, "some words here"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (7, "a b c d e f g")]

OPERATORS = {
    "bpe": lambda d: bpe.token_digests(d, PATH),
    "quality": lambda d: quality.apply_policy(quality.ledger(d), quality.STANDARD),
    "license": license.scan_documents,
    "line": linededup.line_digests,
    "line_rows": linededup.deduplicate,
    "substring": recompression.removed_words,
    "substring_rows": recompression.deduplicate,
    "near": chosenpath.near_duplicates,
    "language": lambda d: language.identify(d, *language.learn(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_document_whatever_it_holds(spark, name):
    out = OPERATORS[name](frame(spark, ODD))
    got = out.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ODD)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


def test_rows_keep_their_other_columns(spark):
    for operator in (linededup.deduplicate, recompression.deduplicate):
        out = operator(frame(spark, ODD))
        assert out.columns == ["doc_id", "text", "lang", *CLASH]
        assert all(r[c] == c for r in out.collect() for c in CLASH)


def test_toxicity_edges(spark):
    labels = "doc_id long, toxic int, hash string"
    docs = frame(spark, ODD)
    for rows in ([], [(1, 1, ""), (None, 1, ""), (4, None, "")], [(1, 1, ""), (2, 0, ""), (6, 0, "")]):
        got = toxicity.score(docs, spark.createDataFrame(rows, labels)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(frame(spark, []), spark.createDataFrame([], labels)).collect() == []


def test_decontamination_edges(spark):
    items = "item_id long, text string, words string"
    docs = frame(spark, ODD)
    assert decontamination.contaminated(docs, spark.createDataFrame([], items)).collect() == []
    given = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "two words", ""), (4, "a b c d e f g", ""), (5, "a b c d e f g", "")], items)
    got = decontamination.contaminated(docs, given).collect()
    assert sorted((r["doc_id"], r["item_id"], r["start_word"], r["end_word"]) for r in got) == [(7, 4, 0, 7), (7, 5, 0, 7)]
    assert decontamination.decontaminate(docs, given).count() == len(ODD) - 1
    assert decontamination.contaminated(frame(spark, []), given).collect() == []


def test_chat_edges(spark):
    schema = "conv_id long, turn int, role string, text string, window string, own string"
    rows = [
        (1, 0, "system", "be good", "", ""), (1, 1, "user", None, "", ""), (1, 2, "assistant", "x " * 4000, "", ""), (1, 2, "assistant", "x " * 4000, "", ""),
        (1, None, "assistant", "", "", ""), (None, 1, None, "a\\|<\\|<|b", "", ""), (2, 1, "assistant", "<|im_end|>\n", "", ""), (3, 1, "sys\ntem\\n<|im_end|>", "t", "", ""),
    ]
    got = chat.windows(spark.createDataFrame(rows, schema), budget=40, history=10)
    back = [(r["conv_id"], t["role"], t["text"]) for r in chat.read_back(got).orderBy("conv_id", "window").collect() for t in r["turns"]]
    assert sorted(back, key=str) == sorted([(r[0], r[2] or "", r[3] or "") for r in rows], key=str)
    assert chat.conversation_digests(chat.windows(spark.createDataFrame([], schema))).collect() == []
    assert "<|" not in got.selectExpr("replace(replace(formatted, '<|im_start|>', ''), '<|im_end|>', '') x").agg({"x": "max"}).first()[0]


def test_defined_results(spark):
    docs = frame(spark, ODD)
    near = {(r["doc_id"], r["n_shingles"]): r for r in chosenpath.near_duplicates(docs).collect()}
    assert near[(6, near[[k for k in near if k[0] == 6][0]]["n_shingles"])]["component_id"] == 5
    assert [near[k]["kept"] for k in near if k[0] in (1, 2, 3)] == [True] * 3
    removed = {r["doc_id"]: r for r in recompression.removed_words(docs).collect()}
    assert removed[5]["n_removed"] == 0 and removed[6]["n_removed"] == removed[6]["n_words"] == 30_000
    assert removed[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [r["lang_pred"] for r in language.identify(docs, *language.learn(docs)).collect()] == ["und"] * len(ODD)
    kept = {r["doc_id"]: r["kept"] for r in quality.apply_policy(quality.ledger(docs), quality.BASE).collect()}
    assert kept == {None: False, 1: False, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False}


def test_stages_on_odd_rows(spark, tmp_path):
    docs = frame(spark, [(1, "Good words stand here and nothing else does.\nAnd one more line of a few words."), (2, "Good words stand here and nothing else does.\nAnd one more line of a few words."), (3, None), (4, "")])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in stages.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", *CLASH], name
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 3, 4]
    assert stages.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 3


def test_sieve_loses_no_key(spark):
    from broadsheet.functions.sieve import sieve, without_keys

    keys = spark.range(0, 3_000_000, 1009).toDF("k")
    rows = spark.range(0, 3_000_000, 7).toDF("doc_id").selectExpr("doc_id", "1 AS note")
    kept = sieve(rows, "doc_id", keys)
    assert kept.columns == ["doc_id", "note"]
    assert rows.join(keys, rows["doc_id"] == keys["k"]).count() == kept.join(keys, kept["doc_id"] == keys["k"]).count() > 0
    assert kept.count() < 0.01 * rows.count()
    assert without_keys(rows, "doc_id", keys).count() == rows.join(keys, rows["doc_id"] == keys["k"], "left_anti").count()


def test_texts_meet_their_deletions_in_one_join(spark, plan):
    """The texts are shuffled once: not for the ones that change and again for those that might not."""
    text = plan(linededup.deduplicate(frame(spark, ODD)))
    assert text.count("SortMergeJoin") == 1 and "LeftAnti" not in text


def test_word_cache_stays_small():
    with open(PATH, encoding="utf-8") as file:
        tokenizer = bpe.Tokenizer(file.read())
    for k in range(350_000):
        tokenizer.encode(f"{k:x}")
    assert len(tokenizer.new) + len(tokenizer.old) <= 300_000 and len(tokenizer.automaton.arcs) <= 300_000
