"""Substring deduplication by recompression.

Words are named by hashes, and two rounds of recompression name what stands
together: first runs of one symbol, then pairs whose left and right part fall
on different sides of a division of all symbols. A name is a hash of what it
stands for, so every task names alike and equal substrings get equal symbols,
but for a few at either end, where a run or a pair may reach over the edge.
With symbols held to 2 words after the first round and 4 after the second,
an occurrence of a window differs within MARGIN words of its ends at most.

The symbol of least hash that starts in the middle of a window is its anchor.
Equal windows choose the same anchor at the same place, so repeats show as
anchors whose surroundings (CORE words that lie in every window of that
anchor) occur in two documents. An anchor's whole stretch (all words of its
windows) is named too: if an earlier document has that stretch, all of its
windows repeat. Where only the core is shared, each window is named by a
fingerprint of its words and looked up under the core's name.

Names are 64 bits wide; what decides is always two of them, core and stretch
or core and window. Anchors that no other document shares are dropped after one
aggregation with map-side combining; no group is gathered in a task, copies
are never paired with each other, and texts are read from the second pass on
only for documents with a repeat.

Null and empty texts have no words; a text shorter than a window loses none.
doc_id is a number (a text that is none fails the job). Rows without doc_id are kept whole and precede no other. doc_id names a
document: rows that repeat it repeat its text, and do not count as its
predecessors. Extra columns are ignored by `removed_words` and kept by `deduplicate`.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from broadsheet.llm.common import map_batches, words_of
from broadsheet.session import materialise

WINDOW = 50
CAPS = (2, 4)
#: Words that the rounds can change at an edge: per round a run's (cap) and a pair's (cap - 1).
MARGIN = sum(2 * cap - 1 for cap in CAPS)
#: An anchor starts in [MARGIN, LAST] of its windows.
LAST = WINDOW - MARGIN - CAPS[-1]
#: The words from MARGIN before an anchor lie in all its windows, CORE of them.
CORE = MARGIN + WINDOW - LAST
#: Words handled at once.
SLICE = 1 << 21
#: Bits of a position beside the hash that orders symbols.
BITS = 24

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _name(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + np.uint64(0x632BE59BD9B4E019 * kind & (1 << 64) - 1)) ^ (b * np.uint64(0xD6E8FEB86659FD93)))


def recompress(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and names of the symbols after all rounds; no symbol reaches over documents."""
    name, size, start, own = words, np.ones(len(words), np.int64), np.arange(len(words)), doc
    for turn, cap in enumerate(CAPS):
        # Runs of one symbol, where they stay within the cap.
        first = np.ones(len(name), bool)
        first[1:] = (name[1:] != name[:-1]) | (own[1:] != own[:-1])
        heads = np.flatnonzero(first)
        times = np.diff(np.append(heads, len(name)))
        joined = (times > 1) & (times * size[heads] <= cap)
        keep = first | ~np.repeat(joined, times)
        name, size = name.copy(), size.copy()
        name[heads[joined]] = _name(2 * turn + 1, name[heads[joined]], times[joined].astype(np.uint64))
        size[heads[joined]] *= times[joined]
        name, size, start, own = name[keep], size[keep], start[keep], own[keep]
        # Pairs of a left and a right symbol, by a bit of the name.
        left = (mix(name + np.uint64(turn + 1)) & np.uint64(1)) == 0
        pair = np.flatnonzero(left[:-1] & ~left[1:] & (own[:-1] == own[1:]) & (size[:-1] + size[1:] <= cap))
        name, size = name.copy(), size.copy()
        name[pair] = _name(2 * turn + 2, name[pair], name[pair + 1])
        size[pair] += size[pair + 1]
        keep = np.ones(len(name), bool)
        keep[pair + 1] = False
        name, size, start, own = name[keep], size[keep], start[keep], own[keep]
    return start, name


_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


class Prints:
    """Fingerprints of any stretch of words, from prefix sums."""

    def __init__(self, words: np.ndarray):
        global _powers
        n = len(words)
        if len(_powers[0]) <= n:
            inverse = pow(_BASE, -1, 1 << 64)
            grow = max(n + 1, 1 << 16)
            both = []
            for base in (_BASE, inverse):
                x = np.full(grow, base, np.uint64)
                x[0] = 1
                both.append(np.cumprod(x, dtype=np.uint64))
            _powers = (both[0], both[1])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * _powers[0][:n], out=self.sums[1:])

    def __call__(self, at: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[at + size] - self.sums[at]) * _powers[1][at])


def anchors(words: np.ndarray, doc: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors with the first and last start of their windows, and the names of core and stretch."""
    n = len(words)
    none = {c: np.empty(0, np.int64) for c in ("at", "lo", "hi", "core", "stretch")}
    if n < WINDOW:
        return none
    start, name = recompress(words, doc)
    order = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    bits = np.uint64(max(BITS, n.bit_length()))
    order[start] = (mix(name) >> bits << bits) | start.astype(np.uint64)
    low, width = order, 1
    while 2 * width <= LAST - MARGIN + 1:
        low, width = np.minimum(low[: len(low) - width], low[width:]), 2 * width
    rest = LAST - MARGIN + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    low = low[MARGIN : MARGIN + n - WINDOW + 1]
    whole = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at[~whole] = -1
    edge = np.ones(len(at), bool)
    edge[1:] = at[1:] != at[:-1]
    lo = np.flatnonzero(edge)
    hi = np.append(lo[1:], len(at)) - 1
    used = at[lo] >= 0
    lo, hi = lo[used], hi[used]
    at = at[lo]
    prints = Prints(words)
    place = ((at - lo) * WINDOW + (hi - lo)).astype(np.uint64)
    return {
        "at": at, "lo": lo, "hi": hi,
        "core": prints(at - MARGIN, CORE).view(np.int64),
        "stretch": mix(prints(lo, hi - lo + WINDOW) + place).view(np.int64),
    }


def _slices(batch: pa.RecordBatch, column: str = "words") -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole documents of a batch, about SLICE words at once: first row, row after the last, words, document and offset of each."""
    lists = batch.column(batch.schema.get_field_index(column))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy().view(np.uint64)
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        begin = offsets[row : end + 1]
        yield row, end, values[begin[0] : begin[-1]], np.repeat(np.arange(row, end), np.diff(begin)), begin - begin[0]
        row = end


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for row, _, words, doc, begin in _slices(batch):
            found = anchors(words, doc)
            at = found["at"]
            own = doc[at] if len(at) else np.empty(0, np.int64)
            first = begin[own - row]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[own], pa.int64()), pa.array(found["core"], pa.int64()), pa.array(found["stretch"], pa.int64()),
                    pa.array(at - first, pa.int32()), pa.array(found["lo"] - first, pa.int32()), pa.array(found["hi"] - first, pa.int32()),
                ],
                ["doc_id", "core", "stretch", "at", "lo", "hi"],
            )


def _hashed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words"), *more)


def shared_anchors(docs: DataFrame) -> DataFrame:
    """Anchors whose core a smaller doc_id has too, or that such anchors must be compared with.

    `whole` anchors repeat an earlier stretch; the others are open: their
    windows have to be looked at one by one.
    """
    found = materialise(
        map_batches(_hashed(docs.where("doc_id IS NOT NULL")), _find, "doc_id long, core long, stretch long, at int, lo int, hi int"), "anchors"
    )
    cores = found.groupBy("core").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    shared = materialise(found.join(cores.select("core", "first"), "core"), "shared")
    stretches = shared.groupBy("core", "stretch").agg(F.min("doc_id").alias("holder"))
    many = stretches.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core", F.lit(True).alias("open"))
    judged = shared.join(stretches, ["core", "stretch"]).join(many, "core", "left")
    return judged.where("holder < doc_id OR open").select("doc_id", "core", "at", "lo", "hi", (F.col("holder") < F.col("doc_id")).alias("whole"))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open anchors' windows: core, distance from the anchor, fingerprint, and where they start."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        opened = batch.column(batch.schema.get_field_index("open"))
        for row, end, words, _, begin in _slices(batch):
            prints = Prints(words)
            part = opened.slice(row, end - row).flatten()
            core, at, lo, hi = (part.field(c).to_numpy().astype(np.int64) for c in ("core", "at", "lo", "hi"))
            counts = np.diff(opened.slice(row, end - row).offsets.to_numpy())
            own = np.repeat(np.arange(row, end), counts)
            times = hi - lo + 1
            which = np.repeat(np.arange(len(core)), times)
            start = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + lo[which]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[own[which]], pa.int64()), pa.array(core[which], pa.int64()), pa.array(start - at[which], pa.int32()),
                    pa.array(prints(start + begin[own[which] - row], WINDOW).view(np.int64), pa.int64()), pa.array(start, pa.int32()),
                ],
                ["doc_id", "core", "away", "print", "start"],
            )


def _removed_windows(texts: DataFrame) -> DataFrame:
    """(doc_id, start) of open windows that a smaller doc_id has too."""
    open_ = F.filter("anchors", lambda a: ~a["whole"])
    rows = texts.where(F.size(open_) > 0).select("doc_id", "text", F.transform(open_, lambda a: F.struct(a["core"].alias("core"), a["at"].alias("at"), a["lo"].alias("lo"), a["hi"].alias("hi"))).alias("open"))
    windows = materialise(map_batches(_hashed(rows, "open"), _windows, "doc_id long, core long, away int, print long, start int"), "windows")
    name = ["core", "away", "print"]
    firsts = windows.groupBy(*name).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return windows.join(firsts.drop("last"), name).where("first < doc_id").select("doc_id", "start").distinct()


_WORD = re.compile("[^\x20\x09-\x0d]+")


def _kept(text: str | None, spans: list[tuple[int, int]]) -> tuple[list[str], int]:
    """The words that no span covers, and the number of words."""
    words = _WORD.findall(text or "")
    out, at = [], 0
    for lo, hi in sorted(spans):
        if lo > at:
            out += words[at:lo]
        at = max(at, hi)
    return out + words[at:], len(words)


def _spans(texts: DataFrame) -> DataFrame:
    """`spans` of words to remove beside every row with anchors."""
    windows = _removed_windows(texts).groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    whole = F.transform(F.filter("anchors", lambda a: a["whole"]), lambda a: F.struct(a["lo"].alias("lo"), (a["hi"] + WINDOW).alias("hi")))
    single = F.transform(F.coalesce("starts", F.array().cast("array<int>")), lambda s: F.struct(s.alias("lo"), (s + WINDOW).alias("hi")))
    return texts.join(windows, "doc_id", "left").withColumn("spans", F.concat(whole, single)).drop("anchors", "starts")


def removed_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = shared_anchors(docs).groupBy("doc_id").agg(F.collect_list(F.struct("core", "at", "lo", "hi", "whole")).alias("anchors"))
    words = words_of(F.col("text"))
    clean = F.col("anchors").isNull()
    # One pass over the texts: documents without a repeat are done here, and only the others keep their text.
    parted = materialise(
        docs.join(found, "doc_id", "left").select(
            "doc_id",
            F.when(clean, F.size(words)).cast("long").alias("n_words"),
            F.when(clean, F.sha2(F.array_join(words, " "), 256)).alias("kept_sha256"),
            F.when(~clean, F.coalesce("text", F.lit(""))).alias("text"),
            "anchors",
        ),
        "parted",
    )
    done = parted.where("anchors IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(at, 256).to_pylist():
                    kept, n = _kept(row["text"], [(s["lo"], s["hi"]) for s in row["spans"]])
                    out.append((row["doc_id"], n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
                columns = list(zip(*out)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    changed = _spans(parted.where("anchors IS NOT NULL").select("doc_id", "text", "anchors"))
    return done.unionByName(map_batches(changed, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeated words removed; the text of a changed document is its kept words, joined by spaces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*docs.columns).alias("row"))
    found = shared_anchors(rows).groupBy("doc_id").agg(F.collect_list(F.struct("core", "at", "lo", "hi", "whole")).alias("anchors"))
    joined = rows.join(found, "doc_id", "left")
    changed = _spans(materialise(joined.where("anchors IS NOT NULL"), "repeats"))
    schema = StructType([StructField("text", StringType()), StructField("row", rows.schema["row"].dataType)])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, covered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept, n = _kept(text, [(s["lo"], s["hi"]) for s in covered])
                new.append(text if len(kept) == n else " ".join(kept))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), batch.column(2)], ["text", "row"])

    out = joined.where("anchors IS NULL").select("text", "row").unionByName(map_batches(changed.select("text", "spans", "row"), rewrite, schema))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
