"""Benchmark decontamination by rare seeds and local alignment.

Words are runs of letters and digits in lower case. At every position of a
test item the seed is the shortest n-gram, of three words or more, that is
rare: the product of its words' frequencies over all documents is RARE at
most. Documents choose their n-grams by the same rule, so a shared passage
shares its seeds, while "of the in" starts a longer one. Frequencies are of
single words, so a leak found in a third of all documents stays as rare as it
was. An n-gram that is not rare at MOST words is taken as it is. An item of fewer
words than that, none of whose n-grams is rare, has its whole sequence as its
seed: it is found where it stands word by word.

Seeds lead from a document to the items that have them and to the place of
the alignment. There Smith-Waterman over words (match 1, mismatch and gap
minus PENALTY) scores the passage against the whole item; the best score over
the item's number of words is the similarity, so copies with words changed,
dropped or added still score. From THRESHOLD on the document is contaminated.
Measured on sf0.1 with items of 15 to 59 words planted in clean documents, of
copies with 20, 25, 30 and 35 per cent of the words replaced 0.99, 0.94, 0.87
and 0.70 are found, with words dropped, replaced and added 1.00, 1.00, 0.99 and
0.92; a clean passage that shares a seed reaches 0.35 at most.

Items go to the executors in blocks of BLOCK_WORDS words, the bound of what is
broadcast; a larger benchmark takes more passes, with the same result.

Null and empty texts and items match nothing, neither do items of fewer than
three words. A very long text costs in proportion to its length. Repeated
items are reported each; rows that repeat a doc_id are judged together. Extra
columns are ignored. Of equal alignments the first in the text is reported.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadsheet.functions.sieve import without_keys
from broadsheet.llm.common import map_batches, map_rows
from broadsheet.llm.recompression import mix
from broadsheet.session import materialise

LEAST, MOST, RARE = 3, 8, 1e-7
PENALTY, THRESHOLD = 0.5, 0.45
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")


def words_of_text(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def rare_grams(ids: np.ndarray, surprise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the rare n-grams of a word sequence; -1 stands for a word no item has.

    surprise: minus the log frequency by word id.
    """
    need = -np.log(RARE)
    n = len(ids)
    if n < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids >= 0
    at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
    code = np.zeros(len(at), np.uint64)
    total = np.zeros(len(at))
    starts, codes = [], []
    for k in range(MOST):
        here = at + k
        inside = here < n
        inside[inside] = ids[here[inside]] >= 0
        at, code, total = at[inside], code[inside], total[inside]
        word = ids[at + k]
        code = mix(code * np.uint64(31) + word.astype(np.uint64) + np.uint64(1))
        total = total + surprise[word]
        if k >= LEAST - 1:
            done = (total >= need) if k < MOST - 1 else np.ones(len(at), bool)
            starts.append(at[done])
            codes.append(code[done])
            at, code, total = at[~done], code[~done], total[~done]
    return np.concatenate(starts), np.concatenate(codes)


def whole_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words at every place; meaningless where a word is -1."""
    code = np.zeros(max(len(ids) - size + 1, 0), np.uint64)
    for k in range(size):
        code = mix(code * np.uint64(31) + ids[k : k + len(code)].astype(np.uint64) + np.uint64(1))
    return code


def _best(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment score, and where it ends in item and text (first of equals, by item then text)."""
    ramp = PENALTY * np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1)
    best, end_item, end_text = 0.0, -1, -1
    for i, word in enumerate(item):
        row = np.zeros(len(text) + 1)
        row[1:] = np.maximum(above[:-1] + np.where((text == word) & (word >= 0), 1.0, -PENALTY), above[1:] - PENALTY)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp  # gaps in the item
        np.maximum(row, 0, out=row)
        j = int(np.argmax(row))
        if row[j] > best + 1e-9:
            best, end_item, end_text = float(row[j]), i, j - 1
        above = row
    return best, end_item, end_text


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman score of an item in a stretch of text, and the stretch it covers there."""
    score, i, j = _best(item, text)
    if score <= 0:
        return 0.0, 0, 0
    _, _, back = _best(item[: i + 1][::-1], text[: j + 1][::-1])
    return score, j - back, j + 1


class Items:
    """A block of test items: their words as numbers, and their seeds."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocabulary: dict[str, int] = {}
        for _, words in items:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary))
        self.keys = [key for key, _ in items]
        self.words = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in items]
        self.surprise = np.zeros(len(self.vocabulary))
        self.codes, self.where = np.empty(0, np.uint64), []
        self.short: dict[int, dict[int, list[int]]] = {}  # size -> hash of the whole -> items

    def seed(self, counts: dict[str, int], total: int) -> None:
        for word, k in self.vocabulary.items():
            self.surprise[k] = -np.log((counts.get(word, 0) + 1) / (total + 1))
        found = defaultdict(list)
        for k, words in enumerate(self.words):
            starts, codes = rare_grams(words, self.surprise)
            for at, code in zip(starts, codes):
                found[int(code)].append((k, int(at)))
            if not len(codes):
                self.short.setdefault(len(words), {}).setdefault(int(whole_codes(words, len(words))[0]), []).append(k)
        self.codes = np.array(sorted(found), np.uint64)
        self.where = [found[int(c)] for c in self.codes]

    def matches(self, text: str | None) -> list[dict]:
        """Items of which the text has a copy."""
        words = words_of_text(text)
        if len(words) < LEAST or not (len(self.codes) or self.short):
            return []
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        starts, codes = rare_grams(ids, self.surprise)
        place = np.searchsorted(self.codes, codes)
        hit = np.flatnonzero(self.codes[np.minimum(place, len(self.codes) - 1)] == codes) if len(self.codes) else []
        windows = defaultdict(list)
        for size, items in self.short.items():
            wholes = whole_codes(ids, size)
            for start in np.flatnonzero(np.isin(wholes, np.array(list(items), np.uint64))):
                for item in items[int(wholes[start])]:
                    if (ids[start : start + size] == self.words[item]).all():
                        windows[item].append((int(start), int(start) + size))
        for h in hit:
            for item, at in self.where[place[h]]:
                size = len(self.words[item])
                begin = int(starts[h]) - at
                windows[item].append((max(0, begin - size // 2), min(len(ids), begin + size + size // 2)))
        out = []
        for item, spans in sorted(windows.items()):
            best = (0.0, 0, 0)
            spans.sort()
            lo, hi = spans[0]
            for a, b in [*spans[1:], (len(ids) + 1, 0)]:
                if a <= hi:
                    hi = max(hi, b)
                    continue
                score, start, end = align(self.words[item], ids[lo:hi])
                if score > best[0]:
                    best = (score, lo + start, lo + end)
                lo, hi = a, b
            similarity = best[0] / len(self.words[item])
            if similarity >= THRESHOLD:
                out.append({"item_id": self.keys[item], "similarity": similarity, "start_word": best[1], "end_word": best[2]})
        return out


def _word_counts(docs: DataFrame, vocabulary) -> tuple[dict[str, int], int]:
    """Counts of the items' words over all documents, and of all words. At most a block's words come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, total = vocabulary.value, Counter(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.slice(at, 256).column(0).to_pylist():
                    words = words_of_text(text)
                    total += len(words)
                    for word, n in Counter(words).items():
                        if word in known:
                            sums[word] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([*sums, None], pa.string()), pa.array([*sums.values(), total], pa.int64())], ["word", "n"]
        )

    rows = map_batches(docs.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))
    return counts, counts.pop(None, 0)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """Items of three words or more, block by block."""
    block, size = [], 0
    for row in items.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id").toLocalIterator():
        words = words_of_text(row["text"])
        if len(words) < LEAST:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, end_word: one row per document and test item it has a copy of."""
    spark = docs.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("doc_id", docs), ("item_id", items))}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, similarity double, start_word int, end_word int"
    out = None
    for block in _blocks(items):
        prepared = Items(block)
        prepared.seed(*_word_counts(docs, spark.sparkContext.broadcast(set(prepared.vocabulary))))
        shared = spark.sparkContext.broadcast(prepared)

        def work(rows, shared=shared):
            for row in rows:
                for match in shared.value.matches(row["text"]):
                    yield {"doc_id": row["doc_id"], **match}

        found = map_rows(docs.select("doc_id", "text"), work, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a copy of a test item."""
    found = materialise(contaminated(docs, items).select("doc_id").distinct(), "contaminated")
    return without_keys(docs, "doc_id", found)
