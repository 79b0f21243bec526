"""Spelling variants against plain comparison of all pairs, and odd rows."""

import random
import zlib
from collections import Counter

from broadsheet.llm import variants


def near(a, b):
    """One replaced, inserted or deleted code point, by trying all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words, ratio=10):
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in links.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, str(form[w]), root(w), words[w], len(links[w]), words.get(form[w], 0)) for w in words)


def made(seed, count=400, letters="aabé"):
    """Words over few letters, many one edit apart, with runs of one letter, and counts over some powers of ten."""
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(1, 6))): int(10 ** rng.uniform(0.3, 4)) for _ in range(count)}


def test_variants_against_all_pairs(spark):
    for seed in range(3):
        words = made(seed)
        got = variants.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
        assert sorted((r["word"], str(r["form"]), r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in got) == brute(words)


def test_neighbours_against_all_pairs(spark):
    words = made(7, 200)
    got = variants.neighbours(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, words[a], words[b]) for a in words for b in words if near(a, b))


def test_a_range_holds_one_row_per_character(spark):
    """However many words there are, so no range grows with the data."""
    words = spark.createDataFrame([(w, 2) for w in made(1, 3000, "abcd")], "word string, n long")
    assert variants._ranges(words).groupBy("key").count().where("count > 5").isEmpty()


def test_chains_are_followed_to_the_last(spark):
    chain = [("aaaaaa" + "b" * k, 10 ** (12 - k)) for k in range(12)]
    got = {r["word"]: r["root"] for r in variants.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {"aaaaaa"}


TEXTS = [
    (None, "Another other another"), (None, None), (1, None), (2, ""), (3, "ÀÉÎõü÷×ÿ àéîõüßß _straße1strasse"), (4, "STRASSEN strassen Straßen " * 50),
    (5, "x" * 20_000 + " " + "separate seperate " * 3000), (6, "repeated rows"), (6, "repeated rows"), (-7, "repeated rows"),
]


def counted(docs, slip=31):
    import re

    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def test_counts_of_odd_texts(spark):
    many = TEXTS + [(k, "misspelt words happen whereever writers hurry") for k in range(200)]
    docs = spark.createDataFrame([(*r, "", 0) for r in many], "doc_id long, text string, word string, n int")
    for slip in (31, 2, 0):
        assert {r["word"]: r["n"] for r in variants.count_words(docs, slip=slip).collect()} == counted(many, slip)


def test_odd_words(spark):
    schema = "word string, n long, key string, c string"
    assert variants.variants(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, 3), ("", 3), ("a\x00b", 3), ("a", 1), ("ab", 2), ("ab", 8), ("abc", 1)]
    got = variants.variants(spark.createDataFrame([(*r, "", "") for r in rows], schema)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", "ab", "ab", 1, 1, 10), ("ab", None, "ab", 10, 2, None), ("abc", "ab", "ab", 1, 1, 10)]))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.count_words(empty)).collect() == []
