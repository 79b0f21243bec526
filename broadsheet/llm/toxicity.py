"""Toxicity by the nearest labelled examples.

Terms are words in lower case and their first four and five letters, so that
an inflected form meets its stem. A term is kept if its tie to the label is
strong enough (phi squared of term and label over EFFECT, at every size of the
table) and beyond chance (chi-squared over twice the log of the number of terms
tested, in three texts at least), whichever label has it more often and at
every base rate; copies of a text count once for each label they have, so no
text crowds out the words of others. A strength does not grow with the table
as a test's power does: words of one group of edited copies pass only while
that group is a fair share of all, so the terms settle. Vectors are TF-IDF over
all these terms, the document frequencies counted over the whole table. The index holds at most
MAX_EXAMPLES distinct labelled texts, those with the smallest hash; equal
vectors share an entry with their number of labels.

The index is inverted by blocks of BLOCK entries: per term the largest weight
in each block that has the term. A query's products with these maxima bound
every block's best cosine; the FIRST blocks of best bound are opened, then all
whose bound reaches the K-th best cosine found, as whole lists if those are
many, so the K nearest are exact.
They vote with the cosine to
the power SHARPNESS; a logistic fit of leave-one-out votes on the examples
calibrates the score. The nearest entries are the evidence.

Null and empty texts have no terms: their score, as that of any text without
terms, is the calibrated share of toxic rows among examples without terms.
With no labelled rows all scores are 0. Repeated rows are scored each; a
document labelled twice votes twice. Extra columns are ignored.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadsheet.functions.sieve import sieve
from broadsheet.llm.common import map_batches, map_rows
from broadsheet.session import materialise

MAX_EXAMPLES = 20_000
K, BLOCK, FIRST, SHARPNESS = 25, 64, 4, 4
#: Least phi squared of a term and the label: the share of the label's variance that the term tells.
EFFECT = 0.01
#: Terms a task counts before it hands them on.
FLUSH = 500_000
STEMS = (4, 5)
LETTERS = re.compile(r"[^\W\d_]+")


def term_counts(text: str | None) -> Counter:
    """Terms of a whole text with their counts."""
    out: Counter = Counter()
    for word, n in Counter(LETTERS.findall((text or "").lower())).items():
        out[word] += n
        for size in STEMS:
            if len(word) > size:
                out[word[:size] + "*"] += n
    return out


def lookups(terms: list[str]) -> list[tuple[int | None, dict[str, int]]]:
    """The kept terms by kind: whole words, then the stems of each length."""
    out = [(None, {t: k for k, t in enumerate(terms) if not t.endswith("*")})]
    return out + [(size, {t[:-1]: k for k, t in enumerate(terms) if t.endswith("*") and len(t) == size + 1}) for size in STEMS]


def vector(text: str | None, tables: list[tuple[int | None, dict[str, int]]]) -> list[tuple[int, int]]:
    """(term, count) of the kept terms of a whole text, as term_counts counts them."""
    if not any(kept for _, kept in tables):
        return []
    counts = Counter(LETTERS.findall((text or "").lower()))
    out: Counter = Counter()
    for size, kept in tables:
        if size is None:
            for word in counts.keys() & kept.keys():
                out[kept[word]] += counts[word]
        elif kept:
            for word, n in counts.items():
                if word[:size] in kept and len(word) > size:
                    out[kept[word[:size]]] += n
    return sorted(out.items())


def choose_terms(labelled: DataFrame) -> list[str]:
    """The terms that tell toxic (0 or 1) apart, over all distinct texts of (hash, text, toxic)."""
    labelled = labelled.dropDuplicates(["hash", "toxic"])
    totals = labelled.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    n, p = totals["n"], totals["p"] or 0
    if not p or p == n:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pre-aggregated: what leaves a task is its terms, not its words. FLUSH bounds the memory.
        df: Counter = Counter()
        pos: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    terms = term_counts(text)
                    df.update(terms.keys())
                    if toxic:
                        pos.update(terms.keys())
                if len(df) > FLUSH:
                    yield flushed(df, pos)
                    df, pos = Counter(), Counter()
        yield flushed(df, pos)

    def flushed(df: Counter, pos: Counter) -> pa.RecordBatch:
        hits = map(pos.__getitem__, df)
        return pa.RecordBatch.from_arrays(
            [pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64()), pa.array(hits, pa.int64())], ["term", "df", "pos"]
        )

    rows = map_batches(labelled.select("text", "toxic"), count, "term string, df long, pos long")
    counts = rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    # A term that fails even with all its rows toxic is not worth carrying on.
    tested = materialise(counts.where("df >= 3"), "terms")
    bound = 2 * float(np.log(max(tested.count(), 2)))
    a, b = F.col("pos"), F.col("df") - F.col("pos")
    c, d = F.lit(p) - a, F.lit(n - p) - b
    chi = F.lit(float(n)) * F.pow(a * d - b * c, F.lit(2.0)) / (F.col("df") * (F.lit(float(n)) - F.col("df")) * F.lit(float(p) * (n - p)))
    best = tested.where(f"df < {n}").withColumn("chi", chi).where((F.col("chi") > bound) & (F.col("chi") > EFFECT * n))
    return best.select("term").orderBy("term").toArrow().column(0).to_pylist()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of every range, one range after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


class Index:
    """Labelled vectors, inverted by blocks."""

    def __init__(self, idf: np.ndarray, examples: list[tuple]):
        """examples: (terms, counts, toxic, id), and the number of labels if it is not one."""
        self.idf = idf
        merged: dict[tuple, list] = {}
        for terms, counts, toxic, key, *labels in examples:
            entry = merged.setdefault((tuple(terms), tuple(counts)), [0, 0, key])
            entry[0] += labels[0] if labels else 1
            entry[1] += toxic * (labels[0] if labels else 1)
            entry[2] = min(entry[2], key)
        empty = merged.pop(((), ()), [0, 0, None])
        self.empty = (empty[0], empty[1])
        self.vectors = sorted(merged)
        self.n = np.array([merged[v][0] for v in self.vectors], float)
        self.pos = np.array([merged[v][1] for v in self.vectors], float)
        self.key = [merged[v][2] for v in self.vectors]
        self.blocks = -(-len(self.vectors) // BLOCK)
        # Postings by term, then entry; a run is what a block has of a term.
        sizes = np.array([len(terms) for terms, _ in self.vectors], int)
        term = np.array([t for terms, _ in self.vectors for t in terms], int)
        entry = np.repeat(np.arange(len(sizes)), sizes)
        weight = np.concatenate([np.empty(0), *[self.weights(*v) for v in self.vectors]])
        order = np.lexsort((entry, term))
        term, self.entry, self.weight = term[order], entry[order], weight[order]
        block = self.entry // BLOCK
        self.start = np.flatnonzero(np.diff(term * self.blocks + block, prepend=-1))
        self.length = np.diff(self.start, append=len(term))
        self.block = block[self.start]
        self.maximum = np.maximum.reduceat(self.weight, self.start) if len(term) else np.empty(0)
        self.runs = np.searchsorted(term[self.start], np.arange(len(idf) + 1))
        self.lists = np.searchsorted(term, np.arange(len(idf) + 1))
        # Terms that a quarter of the entries have are added up faster as whole rows.
        self.rows = {}
        for t in np.flatnonzero(np.diff(self.lists) * 4 > len(sizes)):
            at = slice(self.lists[t], self.lists[t + 1])
            self.rows[int(t)] = np.bincount(self.entry[at], self.weight[at], len(sizes))
        self.scale = (0.0, 1.0)
        total, pos = self.empty
        self.rate = (pos + 0.5) / (total + 2) if total else 0.0

    def weights(self, terms, counts) -> np.ndarray:
        w = (1 + np.log(np.asarray(counts, float))) * self.idf[np.asarray(terms, int)]
        norm = np.sqrt((w * w).sum())
        return w / norm if norm else w

    def nearest(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        """The K nearest entries and their cosines, exact; ties go to the first entry."""
        terms = np.asarray(terms, int)
        lengths = self.runs[terms + 1] - self.runs[terms]
        weights = self.weights(terms, counts)
        runs, w = ranges(self.runs[terms], lengths), np.repeat(weights, lengths)
        block = self.block[runs]
        bounds = np.bincount(block, w * self.maximum[runs], self.blocks) + 1e-9
        open_ = bounds >= (np.partition(bounds, -FIRST)[-FIRST] if self.blocks > FIRST else 0)
        found = self._best(*self._scores(runs[open_[block]], w[open_[block]]))
        left = ~open_ & (bounds >= (found[1][-1] if len(found[0]) == K else 0))
        if left.sum() * 16 > self.blocks:  # many blocks: whole lists are read faster than runs
            return self._best(*self._all_scores(terms, weights))
        rest = self._scores(runs[left[block]], w[left[block]])
        return self._best(*map(np.concatenate, zip(found, rest)))

    def _scores(self, runs, w) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the runs and their cosines."""
        places = ranges(self.start[runs], self.length[runs])
        scores = np.bincount(self.entry[places], np.repeat(w, self.length[runs]) * self.weight[places])
        found = np.flatnonzero(scores)
        return found, scores[found]

    def _all_scores(self, terms, w) -> tuple[np.ndarray, np.ndarray]:
        """All entries that share a term, and their cosines."""
        scores = np.zeros(len(self.vectors))
        for t, x in zip(terms.tolist(), w.tolist()):
            if t in self.rows:
                scores += x * self.rows[t]
            else:
                at = slice(self.lists[t], self.lists[t + 1])
                scores[self.entry[at]] += x * self.weight[at]
        found = np.flatnonzero(scores)
        return found, scores[found]

    @staticmethod
    def _best(ids, cos) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) > K:
            reach = cos >= np.partition(cos, -K)[-K]
            ids, cos = ids[reach], cos[reach]
        order = np.lexsort((ids, -cos))[:K]
        return ids[order], cos[order]

    def vote(self, ids, cos, n, pos) -> float:
        w = cos**SHARPNESS
        prior = (self.pos.sum() + self.empty[1] + 1) / (self.n.sum() + self.empty[0] + 2)
        return float((w @ pos + prior) / (w @ n + 1))

    def left_out(self, k: int) -> list[tuple[float, float, float]]:
        """(vote, label, number) of entry k's labels, each voted on by all labels but one of its kind."""
        ids, cos = self.nearest(*self.vectors[k])
        own = ids == k
        return [
            (self.vote(ids, cos, self.n[ids] - own, self.pos[ids] - own * label), label, float(size))
            for label, size in ((1, self.pos[k]), (0, self.n[k] - self.pos[k])) if size
        ]

    def calibrate(self, votes: list[tuple[float, float, float]]) -> None:
        """Fit the scale to left-out votes."""
        votes, labels, sizes = [list(c) for c in zip(*votes)] or [[], [], []]
        if len(set(labels)) < 2:
            return
        x, y, s = self._logit(np.array(votes)), np.array(labels, float), np.array(sizes)
        a, b = 0.0, 1.0
        for _ in range(30):  # Newton's method with a slight pull to the identity
            p = 1 / (1 + np.exp(-(a + b * x)))
            g = np.array([(s * (y - p)).sum() - a, (s * (y - p) * x).sum() - (b - 1)])
            v = s * p * (1 - p)
            h = np.array([[v.sum() + 1, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-6:
                break
        if np.isfinite(a) and b > 0:
            self.scale = (float(a), float(b))

    @staticmethod
    def _logit(p):
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def score(self, terms, counts) -> tuple[float, list[dict]]:
        """The calibrated score and the three nearest entries."""
        if not len(terms):
            return self.rate, []
        ids, cos = self.nearest(terms, counts)
        if not len(ids):
            return self.rate, []
        a, b = self.scale
        p = 1 / (1 + np.exp(-(a + b * self._logit(self.vote(ids, cos, self.n[ids], self.pos[ids])))))
        near = [{"example": self.key[k], "cosine": float(c), "n": int(self.n[k]), "n_toxic": int(self.pos[k])} for k, c in zip(ids[:3], cos[:3])]
        return float(p), near


EVIDENCE = "array<struct<example:long,cosine:double,n:long,n_toxic:long>>"


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, predicted and evidence for every document.

    labels: (doc_id, toxic) of the rows to learn from; rows with null labels are left out.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    # Of the texts only those with a label are shuffled; labels grow with the texts and are never broadcast.
    labelled = sieve(docs, "doc_id", known.select("doc_id")).join(known.hint("merge"), "doc_id")
    terms = choose_terms(labelled.select("hash", "text", "toxic"))
    shared = spark.sparkContext.broadcast(lookups(terms))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [vector(text, tables) for text in part.column(2).to_pylist()]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([[t for t, _ in v] for v in found], ints), pa.array([[n for _, n in v] for v in found], ints)],
                    ["doc_id", "hash", "terms", "counts"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    made = materialise(map_batches(docs, vectors, f"doc_id {key}, hash long, terms array<int>, counts array<int>"), "vectors")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row per term and task; the last one counts documents.
        counts = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            counts[:-1] += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(terms))
            counts[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], ["term", "n"])

    counted = map_batches(made.select("terms"), frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = dict(zip(*(c.to_pylist() for c in counted.toArrow().columns)))  # one row per kept term
    total = df.get(len(terms), 0)
    idf = np.array([np.log(1 + total / max(df.get(k, 0), 1)) for k in range(len(terms))])
    # Copies of a text have the same vector: grouped before the sample, and both labels of a text enter together.
    votes = made.select("doc_id", "hash").join(known, "doc_id").groupBy("hash").agg(
        F.min(F.col("doc_id").cast("long")).alias("key"), F.count("*").alias("n"), F.sum("toxic").alias("pos")
    ).orderBy("hash").limit(MAX_EXAMPLES)
    sample = votes.join(made.select("hash", "terms", "counts"), "hash").dropDuplicates(["hash"]).orderBy("hash").toArrow().to_pylist()
    sides = [(r, toxic, size) for r in sample for toxic, size in ((1, r["pos"]), (0, r["n"] - r["pos"])) if size]
    index = Index(idf, [(r["terms"], r["counts"], toxic, r["key"] or 0, size) for r, toxic, size in sides])
    held = spark.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [v for k in batch.column(0).to_pylist() for v in held.value.left_out(k)]
            yield pa.RecordBatch.from_pylist([dict(zip(("vote", "label", "size"), v)) for v in votes], pa.schema([(c, pa.float64()) for c in ("vote", "label", "size")]))

    if index.vectors:  # at most two rows per entry of the index come back
        entries = spark.range(0, len(index.vectors), 1, max(len(index.vectors) // 250, 1))
        votes = map_batches(entries, left_out, "vote double, label double, size double").toArrow()
        index.calibrate(sorted(zip(*(c.to_pylist() for c in votes.columns))))
    scale, rate = index.scale, index.rate

    def judge(rows):
        index = held.value
        index.scale = scale
        for row in rows:
            p, near = index.score(row["terms"], row["counts"])
            yield {"terms": row["terms"], "counts": row["counts"], "score": p, "evidence": near}

    # Each distinct vector is scored once, over all tasks; a frequent one is one row on its side of the join.
    full = made.where("size(terms) > 0").select("doc_id", "terms", "counts")
    scored = map_rows(full.select("terms", "counts").distinct(), judge, f"terms array<int>, counts array<int>, score double, evidence {EVIDENCE}")
    found = full.join(scored.hint("merge"), ["terms", "counts"]).select("doc_id", "score", "evidence")
    bare = made.where("size(terms) = 0").select("doc_id", F.lit(rate).alias("score"), F.array().cast(EVIDENCE).alias("evidence"))
    out = found.unionByName(bare)
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
