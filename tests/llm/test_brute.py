"""Every operator against a brute-force version over the driver's smallest tables, or held-out labels."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Reference

from broadsheet.llm import bpe, chosenpath, decontamination, license, linededup, quality, recompression, toxicity
from broadsheet.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def given(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@needs
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    import duckdb

    from verify import normal

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert normal(got.collect(), got.columns) == normal(result.fetchall(), columns)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


# 1: the public tokenizer as the brute-force version, over the table and over hostile strings


@needs
def test_bpe_query(spark, given):
    reference = Reference.from_file(PATH)
    for r in QUERIES["op1_bpe"](spark, SF).collect():
        ids = reference.encode(given[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_hostile_texts():
    reference = Reference.from_file(PATH)
    with open(PATH, encoding="utf-8") as file:
        own = bpe.Tokenizer(file.read())
    own.KEPT = 50  # generations of the cache change often
    draw = random.Random(5)
    parts = list("abcdefghijklmnopqrstuvwxyz'  .,!?<|>\n\t0123456789") + ["<|endoftext|>", "<|startoftext|>", "é", "É", "Σ", "ß", "日", "😀", "́", "\x1c", "\x85", "\xa0", "İ", "ǅ", "the", "ing", "\x00", "​", "aaaa", "%%%", "½", "Ⅷ"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))
        ids = list(memoryview(own.encode(text)).cast("I"))
        assert ids == reference.encode(text, add_special_tokens=False).ids, text
        assert own.decode(own.encode(text)) == reference.decode(ids, skip_special_tokens=False)


def test_bpe_columns(spark):
    docs = spark.createDataFrame([(1, "Hello there"), (2, None)], "k int, text string")
    both = bpe.decode(bpe.encode(docs, PATH), PATH).orderBy("k").collect()
    assert both[0]["decoded"] == "hello</w> there</w>" and both[1]["ids"] == [] and both[1]["decoded"] == ""
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("k", "ids"), PATH)


# 2: ablations by counting documents one by one


@needs
def test_ablations(spark):
    ledger = quality.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    rows = ledger.collect()
    bits = {r.name: 1 << k for k, r in enumerate(quality.RULES)}
    for a in quality.ablations(ledger, (quality.BASE, quality.STANDARD)).collect():
        mask = quality.mask(quality.BASE if a["policy"] == 1 else quality.STANDARD)
        failed = [r["fail_bits"] & mask for r in rows]
        assert a["n_failed"] == sum(bool(f & bits[a["rule"]]) for f in failed)
        assert a["n_failed_alone"] == sum(f == bits[a["rule"]] for f in failed)
        assert a["n_removed"] == sum(bool(f) for f in failed)


# 4: alignment of every later document with every earlier one, no hashes and no shuffles


def _line_brute(texts):
    lines = {d: [x for line in t.split("\n") if (x := line.strip())] for d, t in texts.items()}

    def named(xs):
        seen = Counter()
        for x in xs:
            seen[x] += 1
            yield x, seen[x]

    def rare(line):
        return len(line.split()) >= linededup.RARE_WORDS

    names_of = {d: list(named(xs)) for d, xs in lines.items()}
    holders = defaultdict(set)
    for d, names in names_of.items():
        for n in names:
            holders[n].add(d)
    first, heads = {}, {}
    out = {}
    for d in sorted(lines):
        names = names_of[d]
        shared = [k for k, n in enumerate(names) if len(holders[n]) > 1]
        run = tuple(names[: len(shared)])
        if shared == list(range(len(shared))) and any(rare(x) for x, _ in run):
            if run in heads:  # all it shares, in order, is all that an earlier document shares
                out[d] = set(shared)
            heads.setdefault(run, d)
        by_other = defaultdict(list)
        if d not in out:  # aligned in whole with the first holder of each rare line
            for o in {first[n][0] for n in names if n in first and rare(n[0])}:
                there = {n: k for k, n in enumerate(names_of[o])}
                by_other[o] = [(k, there[n]) for k, n in enumerate(names) if n in there]
        gone = set()
        for pairs in by_other.values():
            # longest ascending sequence by the plain recurrence
            best = [1] * len(pairs)
            for i in range(len(pairs)):
                best[i] = 1 + max((best[j] for j in range(i) if pairs[j][1] < pairs[i][1]), default=0)
            gone.add((len(pairs), max(best)))
            found = linededup.patience(pairs)
            assert len(found) == max(best) and all(pairs[a][1] < pairs[b][1] for a, b in zip(found, found[1:]))
            chain = [pairs[i] for i in found]
            block = []
            for p in [*chain, None]:
                if block and (p is None or p[0] != block[-1][0] + 1 or p[1] != block[-1][1] + 1):
                    if any(len(lines[d][k].split()) >= linededup.RARE_WORDS for k, _ in block):
                        out.setdefault(d, set()).update(k for k, _ in block)
                    block = []
                if p:
                    block.append(p)
        for k, n in enumerate(names):
            first.setdefault(n, (d, k))
    return lines, out


@needs
def test_line_dedup_query(spark, given):
    lines, gone = _line_brute(given)
    got = {r["doc_id"]: r for r in QUERIES["op4_line_dedup"](spark, SF).collect()}
    assert len(got) == len(given)
    for d, r in got.items():
        assert r["n_removed"] == len(gone.get(d, ())) and r["n_lines"] == len(lines[d]) - len(gone.get(d, ()))
    texts = {r["doc_id"]: r["text"] for r in linededup.deduplicate(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for d, text in texts.items():
        assert [x for line in text.split("\n") if (x := line.strip())] == [x for k, x in enumerate(lines[d]) if k not in gone.get(d, ())]


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_documents_made_to_overlap(spark, seed):
    """Copies, reordered copies and mixtures; no line of an exact copy stays, short lines included."""
    draw = random.Random(seed)
    pool = [f"line {k} of five words" for k in range(30)] + ["ok", "a b", "--"]
    texts = {}
    for d in range(60):
        kind = draw.random()
        old = texts[draw.choice(list(texts))].split("\n") if texts else []
        if kind < 0.3 and old:
            xs = list(old)
        elif kind < 0.5 and old:
            xs = old[len(old) // 2 :] + old[: len(old) // 2]
        elif kind < 0.7 and old:
            xs = [*old, f"only {d} has this line"]
        else:
            xs = [draw.choice(pool) for _ in range(draw.randint(0, 8))]
        texts[d] = "\n".join(xs)
    lines, gone = _line_brute(texts)
    docs = spark.createDataFrame([(d, t, 0) for d, t in texts.items()], "doc_id long, text string, `lines lost` int").repartition(3)
    got = {r["doc_id"]: r for r in linededup.deduplicate(docs, "removed lines").collect()}
    for d, r in got.items():
        assert [x for line in r["text"].split("\n") if (x := line.strip())] == [x for k, x in enumerate(lines[d]) if k not in gone.get(d, ())]
    first = {}
    for d in sorted(texts):
        if texts[d] in first and any(len(x.split()) >= linededup.RARE_WORDS for x in lines[d]):
            assert not got[d]["text"].strip()
        first.setdefault(texts[d], d)


def test_moved_block_is_aligned_once():
    one = ["first line of the text here", "second line of the text here", "third line of the text here"]
    texts = {1: "\n".join(one), 2: "\n".join([one[2], "own words stand between them here", one[0], one[1]]), 3: "ok\n" + one[0] + "\nok"}
    assert _line_brute(texts)[1] == {2: {2, 3}, 3: {1}}


# 5: licences by hand


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Released under the MIT License.", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("All rights reserved.", ["All-Rights-Reserved"]),
        ("SPDX-License-Identifier: GPL-2.0-only", ["SPDX:gpl-2-0-only"]),
        ("foo is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License", ["LGPL-2.1"]),
        ("We license music. Warranties are a nice thing.", []),
        ("", []),
    ],
)
def test_license_names(text, want):
    assert [m["licence"] for m in license.scan(text) if m["licence"]] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under CC BY 4.0.", "CC-BY-4.0"),
        ("Available under Creative Commons Attribution 4.0", "CC-4.0"),
        ("Available under the\tCC BY-SA 4.0", "CC-BY-SA-4.0"),
        ("word " * 1000 + "is released into the public domain " + "word " * 1000, "Public-Domain"),
    ],
)
def test_license_without_trigger_words_or_in_a_long_run(text, want):
    assert [m["licence"] for m in license.scan(text)] == [want]


def test_license_sequence_takes_the_longest_rule_and_bridges_gaps():
    header = "Copyright (c) 2020 X\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list.\n * hi\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
    assert [m["licence"] for m in license.scan(header)] == [None, "BSD-2-Clause"]
    more = header + "3. Neither the name of the X nor the names of its contributors may be used to endorse without specific prior written permission\n"
    assert license.scan(more)[1]["licence"] == "BSD-3-Clause"
    far = header.replace(" * hi\n", " * hi\n" * 9)
    assert license.scan(far)[1]["licence"] is None


def test_every_known_sentence_has_a_trigger():
    assert all(any(t in pattern for t in license.TRIGGERS) for _, pattern in license.SENTENCES)
    known = {name for name, _ in license.SENTENCES}
    assert all(set(rule) <= known for _, rule in license.RULES)


@needs
def test_license_query(spark, given):
    for r in QUERIES["op5_license"](spark, SF).collect():
        lines = {x.strip() for x in given[r["doc_id"]].split("\n")}
        assert ("MIT" in r["licences"]) == any(x.endswith("Released under the MIT License.") for x in lines)
        assert ("CC-BY-NC-4.0" in r["licences"]) == any(x.endswith("Licensed under CC BY-NC 4.0.") for x in lines)


# 6 and 7: labels the models have not seen


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["score"], labels[r["doc_id"]]) for r in QUERIES["op6_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    area = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    right = np.mean([(s >= 0.5) == bool(y) for s, y in rows])
    assert area > 0.9 and right > 0.95
    assert abs(np.mean([s for s, _ in rows]) - np.mean([y for _, y in rows])) < 0.05  # calibrated


def test_nearest_by_blocks_is_exact():
    draw = np.random.default_rng(3)
    examples = []
    for k in range(700):
        terms = sorted(draw.choice(40, draw.integers(1, 7), replace=False).tolist())
        examples.append((terms, draw.integers(1, 4, len(terms)).tolist(), int(draw.random() < 0.3), k))
    index = toxicity.Index(draw.random(40) + 0.1, examples)
    dense = np.zeros((len(index.vectors), 40))
    for k, (terms, counts) in enumerate(index.vectors):
        dense[k, list(terms)] = index.weights(terms, counts)
    for terms, counts, _, _ in examples[:60]:
        query = np.zeros(40)
        query[terms] = index.weights(terms, counts)
        cos = dense @ query
        want = np.sort(cos)[::-1][: toxicity.K]
        ids, got = index.nearest(terms, counts)
        assert np.allclose(got, want) and np.allclose(cos[ids], got)


def _labelled(spark, texts, labels):
    """Scores of (text, toxic) rows learned from the first `labels` of them."""
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts[:labels])], "doc_id long, toxic int")
    return {r["doc_id"]: r["score"] for r in toxicity.score(docs, known).collect()}


def _comments(draw, n, toxic_of_ten):
    """Filler words, and one of a few words of either label."""
    filler, words = [f"f{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)], {1: ["vile", "scum"], 0: ["kind", "dear"]}
    return [(" ".join([*draw.choices(filler, k=12), draw.choice(words[y])]), y) for y in (int(k % 10 < toxic_of_ten) for k in range(n))]


@pytest.mark.parametrize("toxic_of_ten", [1, 5, 8])
def test_toxicity_at_every_base_rate(spark, toxic_of_ten):
    texts = _comments(random.Random(toxic_of_ten), 600, toxic_of_ten)
    scores = _labelled(spark, texts, 400)
    assert all((scores[k] >= 0.5) == bool(texts[k][1]) for k in range(400, 600))


def test_copies_of_a_toxic_text_leave_the_terms_of_others(spark):
    """One toxic text of 1000 own words, labelled 200 times, among comments that are toxic by other words."""
    draw = random.Random(4)
    own = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(1000))
    texts = [(own, 1)] * 200 + _comments(draw, 600, 1)
    scores = _labelled(spark, texts, 600)
    assert scores[0] >= 0.5 and all((scores[k] >= 0.5) == bool(texts[k][1]) for k in range(600, 800))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op7_language"](spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.97


# 8: full alignment of every item with every document


def _plain_sw(item, text):
    h = [[0.0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a == b else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
    return max(map(max, h))


def test_alignment_is_smith_waterman():
    draw = np.random.default_rng(1)
    for _ in range(200):
        item, text = draw.integers(0, 4, draw.integers(1, 12)), draw.integers(-1, 4, draw.integers(1, 30))
        score, start, end = decontamination.align(item, text)
        assert abs(score - _plain_sw(item.tolist(), [t if t >= 0 else None for t in text.tolist()])) < 1e-9
        assert abs(_plain_sw(item.tolist(), [t if t >= 0 else None for t in text[start:end].tolist()]) - score) < 1e-9


@needs
def test_decontamination_query(spark, given):
    items = {r["item_id"]: decontamination.words_of_text(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    vocabulary = {w: k for k, w in enumerate(sorted({w for ws in items.values() for w in ws}))}
    coded = {k: np.array([vocabulary[w] for w in ws]) for k, ws in items.items()}
    want = {}
    for d, text in given.items():
        ids = np.array([vocabulary.get(w, -1) for w in decontamination.words_of_text(text)])
        counts = Counter(ids.tolist())
        for k, item in coded.items():
            if sum(min(n, counts[w]) for w, n in Counter(item.tolist()).items()) >= len(item) / 2 and len(ids):
                similarity = decontamination._best(item, ids)[0] / len(item)
                if similarity >= decontamination.THRESHOLD:
                    want[d, k] = similarity
    assert got == pytest.approx(want) and want


def test_edited_copies_are_found(spark):
    draw = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    items = [[draw.choice(words) for _ in range(40)] for _ in range(5)]
    rows = []
    for k, item in enumerate(items):
        edited = [draw.choice(words) if draw.random() < 0.2 else w for w in item if draw.random() > 0.05]
        rows.append((k, " ".join([draw.choice(words) for _ in range(50)] + edited + [draw.choice(words) for _ in range(50)])))
    rows += [(100 + k, " ".join(draw.choice(words) for _ in range(140))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, given).collect()) == [(k, k) for k in range(5)]


def _similarity(item, text):
    """Smith-Waterman over words, cell by cell."""
    above, best = [0.0] * (len(text) + 1), 0.0
    for word in item:
        row = [0.0]
        for j, other in enumerate(text):
            row.append(max(0.0, above[j] + (1.0 if word == other else -0.5), above[j + 1] - 0.5, row[j] - 0.5))
        best, above = max(best, *row), row
    return best / len(item)


def test_edited_copies_are_found_as_plain_alignment_finds_them(spark):
    draw = random.Random(11)
    words = [f"w{k}" for k in range(2000)]
    items = [[draw.choice(words) for _ in range(draw.randint(20, 50))] for _ in range(12)]
    rows = []
    for k, item in enumerate(items):
        for percent in (0, 10, 20, 30, 40, 50):
            edited = []
            for w in item:
                u = draw.random() * 300
                edited += [w] if u >= 3 * percent else [[], [draw.choice(words)], [w, draw.choice(words)]][int(u // percent)]
            rows.append((len(rows), [draw.choice(words) for _ in range(30)] + edited + [draw.choice(words) for _ in range(30)]))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    given = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, given).collect()}
    want = {(d, k) for d, t in rows for k, i in enumerate(items) if _similarity(i, t) >= decontamination.THRESHOLD}
    assert got == want and {(6 * k + j, k) for k in range(12) for j in range(4)} <= got  # all up to 30 per cent
    assert not any(k != d // 6 for d, k in got)


def test_short_common_items_are_found_whole(spark):
    rows = [(1, "the cat of the in a hat"), (2, "of the in"), (3, "the of in a")] + [(k, "the of in a and to") for k in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame([(1, "of the in a"), (2, "a in the of the"), (3, "of the in a")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in decontamination.contaminated(docs, given).collect()) == [(1, 1, 1.0), (1, 3, 1.0)]


# 9: window by window, over texts made to repeat


def _substring_brute(texts):
    first, out = {}, {}
    for d in sorted(texts):
        w = WORD.findall(texts[d] or "")
        gone = set()
        windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        for i, x in enumerate(windows):
            if first.get(x, d) < d:
                gone.update(range(i, i + 50))
        for x in windows:
            first.setdefault(x, d)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_substring_dedup_on_repetitive_texts(spark, letters):
    draw = random.Random(letters)
    words = [f"v{k}" for k in range(letters)]
    texts = {}
    for d in range(60):
        parts = []
        for _ in range(draw.randint(0, 4)):
            kind = draw.random()
            if kind < 0.5 and texts:
                w = WORD.findall(texts[draw.choice(list(texts))])
                at = draw.randint(0, len(w))
                parts += w[at : at + draw.randint(30, 90)]
            elif kind < 0.7:
                parts += [draw.choice(words)] * draw.randint(1, 90)
            else:
                parts += [draw.choice(words) for _ in range(draw.randint(1, 80))]
        texts[d] = " ".join(parts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompression.removed_words(docs).collect()}
    assert got == _substring_brute(texts)


# 10: all pairs, over groups of near copies larger than a leaf


def _near_brute(texts, width, percent):
    sets = {}
    for d, text in texts.items():
        w = WORD.findall(text)
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    group = {d: d for d in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = root(a), root(b)
                    group[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


@pytest.mark.parametrize("leaf", [chosenpath.LEAF, 8])
def test_near_duplicates_in_large_groups(spark, monkeypatch, leaf):
    """A chain of copies of copies, a group of copies of one text, and strangers; with small leaves the groups are crowds."""
    monkeypatch.setattr(chosenpath, "LEAF", leaf)
    monkeypatch.setattr(chosenpath, "SHARE", 16)
    draw = random.Random(7)
    words = [f"t{k}" for k in range(3000)]
    fresh = lambda n: [draw.choice(words) for _ in range(n)]

    def edit(w, times):
        w = list(w)
        for _ in range(times):
            w[draw.randrange(len(w))] = draw.choice(words)
        return w

    base, chain, rows = fresh(150), [fresh(150)], []
    for _ in range(60):
        rows.append(edit(base, draw.randint(0, 4)))
    for _ in range(40):
        chain.append(edit(chain[-1], 2))
    rows += chain + [fresh(draw.randint(1, 150)) for _ in range(60)] + [["x", "y"]] * 3 + [["z"]]
    draw.shuffle(rows)
    texts = {d: " ".join(w) for d, w in enumerate(rows)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in chosenpath.near_duplicates(docs, 3, 85).collect()}
    want = _near_brute(texts, 3, 85)
    assert {d: v[0] for d, v in got.items()} == {d: v[0] for d, v in want.items()}
    assert got == want


def test_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 102), (102, 101)]
    got = {r["node"]: r["component"] for r in chosenpath.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {101: 100, 102: 100}


# the pipeline


@needs
def test_pipeline(spark, given):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "tokens"]
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in out}
    assert len(ids) == len(out) and ids <= set(given)
    toxic = {r["doc_id"] for r in QUERIES["op6_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert not ids & toxic

    # Every later stage by its brute-force version, one after the other, over whole texts.
    texts = {d: t for d, t in given.items() if d not in toxic}
    _, gone = _line_brute(texts)
    for d in list(texts):
        if gone.get(d):
            left, k = [], -1
            for line in texts[d].split("\n"):
                k += bool(line.strip())
                if not line.strip() or k not in gone[d]:
                    left.append(line)
            texts[d] = "\n".join(left)
            if not texts[d].strip():
                del texts[d]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    near = _near_brute({d: t.translate(lower) for d, t in texts.items()}, 5, 80)
    texts = {d: t for d, t in texts.items() if near[d][2]}
    items = [decontamination.words_of_text(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    vocabulary = {w: k for k, w in enumerate(sorted({w for item in items for w in item}))}
    items = [np.array([vocabulary[w] for w in item]) for item in items if len(item) >= decontamination.LEAST]

    def leaks(text):
        ids = np.array([vocabulary.get(w, -1) for w in decontamination.words_of_text(text)])
        return any(decontamination._best(item, ids)[0] / len(item) >= decontamination.THRESHOLD for item in items)

    texts = {d: t for d, t in texts.items() if not leaks(t)}
    assert len(toxic) and len(texts) < len(given) - len(toxic)
    reference, want = Reference.from_file(PATH), {}
    for d, text in texts.items():
        tokens = reference.encode(text, add_special_tokens=False).ids
        decoded = reference.decode(tokens, skip_special_tokens=False)
        want[d] = (len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out} == want


def test_vectors_hold_the_counts_of_kept_terms():
    text = "Loweiä loweischaft LOWEI lowe idiot, idiots idiot'; 12 loweiä"
    counts = toxicity.term_counts(text)
    terms = sorted(counts)[::2] + ["absent", "abse*"]
    assert dict(toxicity.vector(text, toxicity.lookups(terms))) == {k: counts[t] for k, t in enumerate(terms) if t in counts}
    assert toxicity.vector(None, toxicity.lookups(terms)) == [] == toxicity.vector(text, toxicity.lookups([]))


@pytest.mark.parametrize("block", [chosenpath.BLOCK, 3000])
def test_rows_apart_of_a_large_group(spark, monkeypatch, block):
    """Copies with 0 to 8 of 60 words changed: most are linked through leaders, some only with few others; one block, and many."""
    monkeypatch.setattr(chosenpath, "LEAF", 20)
    monkeypatch.setattr(chosenpath, "BLOCK", block)
    draw = random.Random(5)
    base, texts = [f"b{k}" for k in range(60)], {}
    for d in range(250):
        w = list(base)
        for _ in range(draw.randint(0, 8)):
            w[draw.randrange(60)] = f"n{draw.randrange(10_000)}"
        texts[d] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in chosenpath.near_duplicates(docs, 3, 85).collect()}
    assert got == _near_brute(texts, 3, 85)


def test_rows_of_a_group_below_the_threshold(spark, monkeypatch):
    """Texts that are all candidates of each other and few of them linked: pairs that go to the shuffle grow with texts, not with their square."""
    draw, texts, sent = random.Random(3), {}, []
    base = [f"b{k}" for k in range(240)]
    for d in range(190):
        w = list(base)
        for at in draw.sample(range(240), 6):
            w[at] = f"n{draw.randrange(100_000)}"
        texts[d] = " ".join(w)
    texts |= {190 + d: texts[d].replace("b0 ", "", 1) for d in range(0, 190, 10)}
    kept = chosenpath.materialise

    def counted(df, label):
        out = kept(df, label)
        if label == "pairs":
            sent.append(out.count())
        return out

    monkeypatch.setattr(chosenpath, "materialise", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in chosenpath.near_duplicates(docs, 3, 85).collect()}
    assert got == _near_brute(texts, 3, 85)
    assert max(sent) <= 20 * len(texts), sent


def test_long_texts_of_a_leaf_meet_in_blocks(spark, monkeypatch):
    """The same with leaves whose shingles pass a block."""
    monkeypatch.setattr(chosenpath, "BLOCK", 4000)
    test_rows_of_a_group_below_the_threshold(spark, monkeypatch)
