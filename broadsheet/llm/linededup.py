"""Line deduplication by pairwise alignment.

A later document loses every line that its alignment with some earlier document
deletes. Two documents are aligned in whole: all lines that both have count,
short ones too. A line that a document has several times counts as
first, second, ... occurrence, which makes every line unique in its document,
as patience alignment asks for. The common lines of a pair, in the later
document's order, are reduced to the longest sequence that also ascends in the
earlier one. What is left falls into blocks: lines that follow each other in
both documents, blank lines aside. A block is deleted from the later document
if it has a rare line, one of at least RARE_WORDS words; shorter lines, which
documents share by chance, go only with their block.

The result is that of all pairs, but few need the work. A document whose shared
lines are those of an earlier one, in the same order and ahead of all others, meets
the first of these alone and loses them all. Of any other document a rare line can
go only by one that has it, a short line only by one that has the whole run from it
to the nearest rare line, on one side or the other: these names lead to partners.
Each name leads to its first holder; this settles all lines but those that stand
in another order there. For the lines left, the other earlier holders follow in
rounds, about STEP times as many each time, until a line is deleted or all earlier
holders of its names have been aligned with it.

Line hashes are 128 bits wide over the line without outer white space. Only
sums per hash and the shared lines are shuffled; what a task gathers is the
lines that a pair shares, or a document with all others. Line order is by doc_id: the smaller is earlier.

Null and empty texts have no lines. Texts without deletions stay as they are.
doc_id is a number (a text
that is none fails the job). Rows without doc_id stay as they are and precede no other. doc_id names a
document: rows that repeat it repeat its text, and all lose the same lines.
Extra columns stay.
"""

import struct
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from broadsheet.functions.sieve import with_matches, without_keys
from broadsheet.llm.common import map_batches, map_rows
from broadsheet.session import materialise

RARE_WORDS = 5

#: So many times as many holders of a name are tried in each further round.
STEP = 8

_NAME = ["h1", "h2", "time"]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, line (among those with a word), rare, hash in two parts, occurrence."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            doc, line, rare, h1, h2, time = [], [], [], [], [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen: Counter = Counter()
                for k, x in enumerate(stripped for x in (text or "").split("\n") if (stripped := x.strip())):
                    h = xxhash.xxh3_128_intdigest(x)
                    seen[h] += 1
                    doc.append(key)
                    line.append(k)
                    rare.append(len(x.split(None, RARE_WORDS)) >= RARE_WORDS)
                    h1.append((h >> 64) - (1 << 63))
                    h2.append((h & (1 << 64) - 1) - (1 << 63))
                    time.append(seen[h])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(rare, pa.bool_()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(time, pa.int32())],
                ["doc_id", "line", "rare", "h1", "h2", "time"],
            )


def patience(pairs: list[tuple[int, int]]) -> list[int]:
    """Places in pairs (ascending in the first number) of a longest subsequence ascending in the second."""
    ends, tops, back = [], [], []
    for k, (_, a) in enumerate(pairs):
        pile = bisect_left(ends, a)
        back.append(tops[pile - 1] if pile else -1)
        if pile == len(ends):
            ends.append(a)
            tops.append(k)
        else:
            ends[pile], tops[pile] = a, k
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def aligned(shared: list[tuple[int, int, int, bool]]) -> list[int]:
    """Lines to delete, given (earlier document, its line, own line, rare) of every shared line."""
    by_other = defaultdict(list)
    for other, there, here, rare in shared:
        by_other[other].append((here, there, rare))
    out = []
    for lines in by_other.values():
        lines.sort()
        kept = [lines[k] for k in patience([(here, there) for here, there, _ in lines])]
        block: list[tuple[int, int, bool]] = []
        for x in [*kept, None]:
            if block and (x is None or x[0] != block[-1][0] + 1 or x[1] != block[-1][1] + 1):
                if any(rare for _, _, rare in block):
                    out += [here for here, _, _ in block]
                block = []
            if x is not None:
                block.append(x)
    return sorted(set(out))


def runs(lines: list[tuple[int, bool, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """A line and a name, for every run of lines without a gap that leads from a rare line to a short one, over short ones.

    Takes line, rare and name of a document's shared lines. Times of 0 and -1, after and before the rare line, are no occurrence's.
    """
    for side, places in enumerate((sorted(lines), sorted(lines, reverse=True))):
        run, last = None, 0
        for line, rare, *name in places:
            if rare:
                run = struct.pack("<qqi", *name)
            elif run and abs(line - last) == 1:
                h = xxhash.xxh3_128_intdigest(run + struct.pack("<qqi", *name))
                run = h.to_bytes(16)
                yield line, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), -side
            else:
                run = None
            last = line


def _settled(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id and line of what goes by aligning the pairs (doc_id, o)."""
    mine = shared.select("doc_id", F.col("line").alias("h"), F.col("rare").alias("r"), *_NAME)
    theirs = shared.select(F.col("doc_id").alias("o"), F.col("line").alias("t"), *_NAME)
    both = mine.join(pairs, "doc_id").join(theirs, ["o", *_NAME])
    gathered = both.groupBy("doc_id", "o").agg(F.collect_list(F.struct("t", "h", "r")).alias("shared"))

    def work(rows):
        for row in rows:
            for line in aligned([(row["o"], x["t"], x["h"], x["r"]) for x in row["shared"]]):
                yield {"doc_id": row["doc_id"], "line": line}

    return map_rows(gathered, work, "doc_id long, line int").distinct()


def deletions(docs: DataFrame) -> DataFrame:
    """doc_id and `lines` to delete (numbers among the lines with a word), for documents that lose some."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id long, line int, rare boolean, h1 long, h2 long, time int"
    lines = materialise(map_batches(known, _lines, schema), "lines")
    holders = lambda df: df.groupBy(*_NAME).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    shared = materialise(lines.join(holders(lines), _NAME).dropDuplicates(["doc_id", "line", *_NAME]), "shared")

    # Lines 0 to n - 1 all shared, named twice over by their places and hashes.
    mark = lambda *c: F.bit_xor(F.xxhash64(*c))
    whole = shared.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("line").alias("end"), F.max("rare").alias("rare"),
        mark("line", *_NAME).alias("s1"), mark(F.lit(1), *_NAME, "line").alias("s2"),
    ).where("n = end + 1 AND rare")
    heads = whole.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail")
    copies = materialise(whole.join(heads, ["n", "s1", "s2"]).where("head < doc_id").select("doc_id", "n"), "copies")

    # Copies are no partners either: the first of their class gives the same alignment, and is earlier.
    rest = materialise(without_keys(shared, "doc_id", copies.select("doc_id")), "rest")
    mixed = rest.groupBy("doc_id").agg(F.collect_list(F.struct("line", "rare", *_NAME)).alias("lines"), F.every("rare").alias("all"), F.some("rare").alias("any")).where("any AND NOT all")

    def lead(rows):
        for row in rows:
            for found in runs([(x["line"], x["rare"], x["h1"], x["h2"], x["time"]) for x in row["lines"]]):
                yield {"doc_id": row["doc_id"], **dict(zip(["line", *_NAME], found))}

    short = materialise(map_rows(mixed.select("doc_id", "lines"), lead, "doc_id long, line int, h1 long, h2 long, time int"), "short")
    rare = rest.where("rare").drop("rare")
    led = rare.unionByName(short.join(holders(short), _NAME)).where("first < doc_id")
    found = [materialise(_settled(led.select("doc_id", F.col("first").alias("o")).distinct(), rest), "found")]

    left = lambda df: materialise(df.join(found[-1], ["doc_id", "line"], "left_anti"), "left")
    todo = left(led.where("n > 2"))  # two: the first and the document itself
    if not todo.isEmpty():
        # A holder's round goes by its hash, so any part of the holders that settles a line is met early.
        at = F.greatest(F.lit(1.0), F.col("n") * F.pmod(F.xxhash64("o"), F.lit(1 << 40)) / (1 << 40))
        names = rare.select("doc_id", *_NAME).unionByName(short.select("doc_id", *_NAME)).withColumnRenamed("doc_id", "o")
        others = names.join(todo.select(*_NAME, "n").distinct(), _NAME).select(*_NAME, "o", F.floor(F.log(float(STEP), at)).cast("int").alias("round"))
        others = materialise(others, "others")
        for k in range(others.agg(F.max("round")).first()[0] + 1):
            pairs = todo.join(others.where(F.col("round") == k), _NAME).where("o < doc_id AND o <> first").select("doc_id", "o").distinct()
            found.append(materialise(_settled(pairs, rest), "found"))
            todo = left(todo)
            if todo.isEmpty():
                break

    lost = reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    numbers = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: (k - 1).cast("int"))
    return lost.unionByName(copies.select("doc_id", numbers.alias("lines")))


def without(text: str | None, lines: list[int] | None) -> str | None:
    """The text without the given lines, numbered among those with a word."""
    if not text or not lines:
        return text
    gone, k, out = set(lines), 0, []
    for line in text.split("\n"):
        if line.strip():
            k += 1
            if k - 1 in gone:
                continue
        out.append(line)
    return "\n".join(out)


def deduplicate(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """docs with the deletions made in `text`; `removed` names a further column, the number of lines each row lost."""
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", others)
    gone = materialise(deletions(docs), "deletions")
    # Texts that surely lose nothing stay where they are, the others are shuffled once; deletions grow with the texts and are never broadcast.
    found = with_matches(rows, "doc_id", gone)
    schema = StructType([StructField("text", StringType()), StructField("lost", IntegerType()), StructField("row", rows.schema["row"].dataType)])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                gone = part.column(1).to_pylist()
                new = part.column(0)
                if any(gone):
                    new = pa.array([without(t, g) for t, g in zip(new.to_pylist(), gone)], pa.string())
                yield pa.RecordBatch.from_arrays([new, pa.array([len(g or ()) for g in gone], pa.int32()), part.column(2)], ["text", "lost", "row"])

    out = map_batches(found.select("text", "lines", "row"), rewrite, schema)
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*columns, *([F.col("lost").alias(removed)] if removed else []))


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (left, with a word), n_removed, kept_sha256 (null text counts as empty)."""
    kept = deduplicate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "n_removed")
    text = F.coalesce("text", F.lit(""))
    n = F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"\S")))
    return kept.select("doc_id", n.cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(text, 256).alias("kept_sha256"))
