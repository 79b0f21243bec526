"""Spelling variants: words one edit apart, grouped under the spelling that is far more frequent.

Permuterm rotations. A word ends in a mark, and all rotations of word and mark
are sorted. Two words x a y and x b y have the rotations y|xa and y|xb, which
stand in one prefix range, that of y|x; the word x y has y|x itself as a
rotation. So an edit at any place, be it a replacement, an insertion or a
deletion, is found by a prefix range that skips the edited character at its
end. Here each rotation is one row: the prefix that names the range, and the
character after it (none for the whole rotation of the shorter word). A scan of
the sorted ranges gives each word, per range, the number and the best of its
neighbours there.

A range holds at most one row per character of the alphabet, since prefix and
character spell the word; no range can be hot, and no pair is written out. The
two ends of an indel inside a run of one character share a range for every
place of the run, and count in that of the first alone.

Null texts have no words; a null doc_id counts as no characters in the mark of
a slip. Rows that repeat a document count their words again. Words that hold
the mark character U+0000, null and empty words are left out by `variants`;
rows that repeat a word are added up. Other columns are ignored.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from broadsheet.llm.common import map_batches
from broadsheet.session import materialise

MARK = "\x00"
#: Words counted per task before they are handed on.
HELD = 300_000


def count_words(docs: DataFrame, min_length: int = 7, min_count: int = 2, slip: int = 31) -> DataFrame:
    """word, n: runs of letters of all texts, A-Z in lower case, of at least min_length code points and min_count occurrences.

    `slip` misspells one in so many, reproducibly: with h the crc32 of
    "<doc_id>:<run>", a run with h divisible by slip loses its code point
    h % length. 0 takes runs as they are.
    """
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)  # a shorter run cannot grow

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not text:
                        continue
                    text = text.lower() if text.isascii() else text.encode().lower().decode()  # bytes: A-Z alone
                    if not slip:
                        held.update(runs.findall(text))
                        continue
                    seed = zlib.crc32(f"{doc if doc is not None else ''}:".encode())
                    for run, times in Counter(runs.findall(text)).items():
                        h = zlib.crc32(run.encode(), seed)
                        if h % slip == 0:
                            gone = h % len(run)
                            run = run[:gone] + run[gone + 1 :]
                            if len(run) < min_length:
                                continue
                        held[run] += times
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    found = map_batches(docs.select(F.col("doc_id").cast("string"), "text"), count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _ranges(words: DataFrame) -> DataFrame:
    """key, c, n: every prefix range a word stands in, and the character after the prefix ('' for the whole rotation)."""
    size = F.length("word")

    def skipping(i):
        return F.struct(F.concat(F.expr("substr(word, i + 2)"), F.lit(MARK), F.expr("substr(word, 1, i)")).alias("key"), F.expr("substr(word, i + 1, 1)").alias("c"))

    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    whole = F.struct(F.concat(F.expr("substr(word, i + 1)"), F.lit(MARK), F.expr("substr(word, 1, i)")).alias("key"), F.lit("").alias("c"))
    entries = F.when(F.col("i") < size, F.array(whole, skipping(F.col("i")))).otherwise(F.array(whole))
    return places.select("n", F.explode(entries).alias("e")).select("e.key", "e.c", "n")


def _spelt(key, c):
    """The word of a prefix and the character after it: the mark parts end and beginning."""
    at = F.instr(key, MARK)
    return F.concat(F.substring(key, at + 1, F.length(key)), c, F.substring(key, F.lit(1), at - 1))


def _scan(ranges: DataFrame) -> DataFrame:
    """Per range and word in it: how many near words the range gives it, and the best of them, as struct(-n, word)."""
    group = Window.partitionBy("key")
    order = group.orderBy((F.col("c") == "").asc(), F.col("n").desc(), F.col("c").asc())
    skips = F.col("c") != ""
    # The first place of a run of one character stands for all of them: the character before is another, or the word's start.
    leads = skips & (F.substring("key", -1, 1) != F.col("c"))
    scanned = ranges.select(
        "key", "c", "n", leads.alias("leads"),
        F.row_number().over(order).alias("place"),
        F.first(F.struct("n", "c")).over(order).alias("top"),
        F.lead(F.struct("n", "c")).over(order).alias("next"),
        F.count(F.when(skips, 1)).over(group).alias("skipping"),
        F.count(F.when(leads, 1)).over(group).alias("leading"),
        F.max(F.when(~skips, F.col("n"))).over(group).alias("whole"),
        F.min(F.when(leads, F.struct((-F.col("n")).alias("m"), F.col("c").alias("c")))).over(group).alias("lead"),
    )
    other = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))
    replaced = F.when(skips & (F.col("skipping") > 1), F.struct((-other["n"]).alias("m"), _spelt(F.col("key"), other["c"]).alias("near")))
    shorter = F.when(F.col("leads") & F.col("whole").isNotNull(), F.struct((-F.col("whole")).alias("m"), _spelt(F.col("key"), F.lit("")).alias("near")))
    longer = F.when(~skips & (F.col("leading") > 0), F.struct(F.col("lead.m").alias("m"), _spelt(F.col("key"), F.col("lead.c")).alias("near")))
    n_near = (
        F.when(skips, F.col("skipping") - 1).otherwise(F.col("leading"))
        + F.when(F.col("leads") & F.col("whole").isNotNull(), 1).otherwise(0)
    )
    return scanned.where((F.col("skipping") > 1) | ((F.col("leading") > 0) & F.col("whole").isNotNull())).select(
        _spelt(F.col("key"), F.col("c")).alias("word"), n_near.alias("n_near"), F.least(replaced, shorter, longer).alias("best"),
    ).where("n_near > 0")


def neighbours(words: DataFrame) -> DataFrame:
    """word, near, n, near_n: all pairs one edit apart, in both directions. A range pairs at most one word per character."""
    group = Window.partitionBy("key")
    found = _ranges(_clean(words)).withColumn("all", F.collect_list(F.struct("c", "n")).over(group)).where(F.size("all") > 1)
    leads = lambda c: F.substring("key", -1, 1) != c
    pairs = found.select("key", "c", "n", F.explode("all").alias("o")).where(
        (F.col("c") != F.col("o.c"))
        & ((F.col("c") != "") | leads(F.col("o.c"))) & ((F.col("o.c") != "") | leads(F.col("c")))
    )
    return pairs.select(_spelt(F.col("key"), F.col("c")).alias("word"), _spelt(F.col("key"), F.col("o.c")).alias("near"), "n", F.col("o.n").alias("near_n"))


def _clean(words: DataFrame) -> DataFrame:
    fit = (F.length("word") > 0) & ~F.contains(F.col("word"), F.lit(MARK))
    return words.where(fit).groupBy("word").agg(F.sum("n").cast("long").alias("n"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of a frame of words and counts.

    form is the near word of largest n (ties: the smallest in code points) where
    that n is at least ratio times the word's; root follows forms to the last.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = materialise(_clean(words), "words")
    none = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<m:bigint,near:string>").alias("best"), "n")
    near = _scan(_ranges(words)).withColumn("n", F.lit(None).cast("long"))
    found = none.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    form = -F.col("best.m") >= ratio * F.col("n")
    found = materialise(
        found.select("word", F.when(form, F.col("best.near")).alias("form"), "n", "n_near", F.when(form, -F.col("best.m")).alias("form_n")), "forms"
    )
    roots = _roots(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: each link followed to its end. Every step multiplies n, so few rounds of doubling suffice."""
    roots = materialise(links, "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = roots.join(ahead, "root", "left")
        stepped = materialise(stepped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if stepped.where("moved").isEmpty():
            return stepped.drop("moved")
        roots = stepped.drop("moved")
