"""Line deduplication against the alignment of every document with every earlier one, whoever holds a line first."""

import os
import random
from collections import Counter

import pytest

from broadsheet.llm import linededup

SF = "/root/testdata/sf0.01"


def _all_pairs(texts):
    """Lines with a word, and those that go, by document."""
    lines = {d: [x for line in (t or "").split("\n") if (x := line.strip())] for d, t in texts.items()}
    places, gone = {}, {}
    for d in sorted(lines):
        seen, names = Counter(), []
        for x in lines[d]:
            seen[x] += 1
            names.append((x, seen[x]))
        out = set()
        for there in places.values():
            pairs = [(k, there[n]) for k, n in enumerate(names) if n in there]
            chain = [pairs[i] for i in linededup.patience(pairs)]
            block = []
            for p in [*chain, None]:
                if block and (p is None or p[0] != block[-1][0] + 1 or p[1] != block[-1][1] + 1):
                    if any(len(lines[d][k].split()) >= linededup.RARE_WORDS for k, _ in block):
                        out.update(k for k, _ in block)
                    block = []
                if p:
                    block.append(p)
        gone[d] = out
        places[d] = {n: k for k, n in enumerate(names)}
    return lines, gone


def _left(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = linededup.deduplicate(docs).collect()
    return {r["doc_id"]: [x for line in (r["text"] or "").split("\n") if (x := line.strip())] for r in rows}


def _wanted(texts):
    lines, gone = _all_pairs(texts)
    return {d: [x for k, x in enumerate(xs) if k not in gone[d]] for d, xs in lines.items()}


P, Q, R = "the first line of five words", "the second line of five words", "the third line of five words"


def test_a_later_holder_in_the_same_order_is_met(spark):
    """Both lines of 3 stand in 2 as they do in 3; their first holder has them the other way round."""
    texts = {1: f"{P}\n{Q}", 2: f"{Q}\n{P}", 3: f"words of its own stand here\n{Q}\n{P}"}
    assert _left(spark, texts)[3] == ["words of its own stand here"]


def test_a_later_holder_of_the_whole_block_is_met(spark):
    """Short lines go with their block, before and after the rare line, though its first holder has no such block."""
    texts = {1: f"{P}\nother", 2: f"{P}\nok\nyes\nmore", 3: f"low\n{Q}\n{P}", 4: f"none\n\n{P}\nok\nyes\nend", 5: f"no\nlow\n{Q}\nok", 6: "ok\nyes", 7: None}
    left = _left(spark, texts)
    assert left[4] == ["none", "end"] and left[5] == ["no", "ok"] and left[6] == ["ok", "yes"]
    assert left == _wanted(texts)


@pytest.mark.parametrize("seed", range(2))
def test_all_pairs_of_documents_made_to_overlap(spark, seed):
    """Copies, reordered copies, pieces and shuffled lines, with a line that most documents have."""
    draw = random.Random(seed)
    pool = [f"line {k} of five words" for k in range(25)] + ["ok", "a b", "--", "yes", "no"]
    texts = {}
    for d in draw.sample(range(1000), 150):
        kind = draw.random()
        old = texts[draw.choice(list(texts))].split("\n") if texts else []
        if kind < 0.15:
            xs = old
        elif kind < 0.35:
            xs = old[len(old) // 2 :] + old[: len(old) // 2]
        elif kind < 0.5:
            xs = [f"only {d} has this line", *old]
        elif kind < 0.65:
            xs = draw.sample(old, len(old))
        else:
            xs = [draw.choice(pool) for _ in range(draw.randint(0, 12))]
        if draw.random() < 0.5:
            xs = [*xs[:3], R, *xs[3:]]
        texts[d] = "\n".join(xs)
    assert _left(spark, texts) == _wanted(texts)


def test_rounds_go_on_to_the_last_holder(spark, monkeypatch):
    """One holder of many has the line in this order, and lines few documents cross stay cheap."""
    tried = []
    settled = linededup._settled
    monkeypatch.setattr(linededup, "_settled", lambda pairs, shared: (tried.append(pairs.count()), settled(pairs, shared))[1])
    block = [f"line {k} of the block here" for k in range(5)]
    texts = {d: "\n".join([*block, R, f"more {d % 50} of some more words"]) for d in range(200)}
    texts[100] = "\n".join([R, P])
    texts |= {d: "\n".join([f"words of {d} stand here alone", R, *block, f"more {d % 50} of some more words"]) for d in (200, 201, 202)}
    assert _left(spark, texts) == _wanted(texts)
    assert len(tried) > 2 and sum(tried) < 200 * 203 / 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_all_pairs_of_the_given_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert _left(spark, texts) == _wanted(texts)
