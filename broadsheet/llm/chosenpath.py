"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct word shingles. Documents with equal sets
share a class, and the join runs between classes. Each set has SIZE minwise
tokens. In every tree a document descends: at a node some token places are
drawn (one over the threshold in expectation, the same places for all
documents of the node), and each drawn place leads the document to the child
named by its token there. Nodes of at most LEAF classes are compared
exhaustively by sketch and size; larger ones branch on, DEPTH levels at most.
Independent trees repeat this to raise recall: a pair at the threshold t
meets in a leaf of depth d in at least t**d of the trees.

Candidates are confirmed on the full sets: texts go once to the home of their
pair. First each node's strongest candidates that connect it are confirmed;
then, with components known, texts go to the leaves that still hold two, once
per member with a candidate there, and all pairs of two components meet in the
task. Pairs inside one component add nothing and pairs are never rows, so a
group of copies, or of texts just below the threshold, costs in proportion to
its size. A node that stays large at
the last level (a group of near copies of any size) is compared with leaders
drawn per tree, which links almost all of it at linear cost. What remains outside the
largest component is compared with all members of other components, in whole:
nodes that have members in common are one family, blocks of a family meet in
tasks, and there an exact join on the rarest shingles (prefix and size filter)
finds what to compare.

Homes are salted: at most SHARE partners to a task group. Components are
found by rounds of large-star and small-star over links, written to the
shared folder in between; nothing is gathered on the driver.

A text with fewer words than a shingle has one, its whole sequence; without
words (or null) the set is empty, linked with nothing. doc_id is a number (a text
that is none fails the job). Rows without doc_id
are their own: component null, kept. Rows that repeat a doc_id must repeat
its text. Extra columns are ignored. Ties go to the smallest doc_id.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions.sieve import sieve
from broadsheet.llm.common import map_batches, words_of
from broadsheet.llm.recompression import mix
from broadsheet.session import materialise

SIZE, TREES, DEPTH, LEAF, SHARE = 64, 10, 3, 200, 256

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(F.translate(text, ASCII_UPPER, ASCII_LOWER)), lambda w: F.xxhash64(w))


def shingle_sets(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of several documents: hashes and offsets, sorted within each document.

    offsets: of the documents' words in values. Hashes are 64 bits wide.
    """
    sizes = np.diff(offsets)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    own = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[:-1][own] + np.arange(len(own)) - first
    out = np.zeros(len(own), np.uint64)
    left = sizes[own]
    for k in range(width):  # a short text's shingle is its whole sequence, told apart by its length
        has = k < left
        out[has] = mix(out[has] * np.uint64(31) + values[at[has] + k] + np.uint64(k + 1))
    order = np.lexsort((out, own))
    out, own = out[order], own[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
    out, own = out[new], own[new]
    return out, np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(sizes)))))


def tokens_of(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SIZE minwise tokens per document, 32 bits each: one permutation, a bin per place, empty bins filled from others."""
    n = len(offsets) - 1
    own = np.repeat(np.arange(n), np.diff(offsets))
    x = mix(sets + np.uint64(0x51ED270B))
    bins = (x >> np.uint64(58)).astype(np.int64)
    empty = np.iinfo(np.uint32).max
    out = np.full(n * SIZE, empty, np.uint32)
    np.minimum.at(out, own * SIZE + bins, ((x >> np.uint64(20)) & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    out = out.reshape(n, SIZE)
    missing = out == empty
    original, had = out, ~missing
    for turn in range(64):
        if not missing.any():
            break
        # Every place borrows from a place drawn for it, the same for all documents.
        source = (mix(np.arange(SIZE, dtype=np.uint64) + np.uint64(1000 * (turn + 1))) % np.uint64(SIZE)).astype(np.int64)
        # Only tokens of the set itself are lent, so that a loan means the same everywhere.
        usable = missing & had[:, source]
        out = np.where(usable, original[:, source] + np.uint32(turn + 1), out)
        missing &= ~usable
    return out


def _slices(batch: pa.RecordBatch, column: str, words: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    lists = batch.column(batch.schema.get_field_index(column))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy().view(np.uint64)
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + words, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield row, end, values[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _describe(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, values, offsets in _slices(batch, "words"):
            sets, at = shingle_sets(values, offsets, width)
            n = np.diff(at)
            padded = np.append(sets, np.uint64(0))
            prints = []
            for seed in (1, 2):  # the set's name: two sums over its elements
                sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A5 * seed)), dtype=np.uint64)))
                prints.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
            tokens = tokens_of(padded[:-1], at)
            blob, low = tokens.astype("<u4").tobytes(), tokens.astype(np.uint8).tobytes()
            cut = lambda x, step: pa.array([x[k * step : (k + 1) * step] for k in range(end - row)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, end - row), pa.array(n, pa.int64()), pa.array(prints[0], pa.int64()), pa.array(prints[1], pa.int64()),
                    cut(blob, 4 * SIZE), cut(low, SIZE),
                ],
                ["doc_id", "n", "f1", "f2", "tokens", "sketch"],
            )


def _tokens(batch: pa.RecordBatch) -> np.ndarray:
    blobs = batch.column(batch.schema.get_field_index("tokens")).to_pylist()
    return np.frombuffer(b"".join(blobs), "<u4").reshape(-1, SIZE)


def _chosen(node: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and token places drawn at each row's node: one place, and a second one often enough for 1/threshold in expectation."""
    first = mix(node + np.uint64(11)) % np.uint64(SIZE)
    yield np.arange(len(node)), first.astype(np.int64)
    more = 1 / threshold - 1
    again = np.flatnonzero((mix(node + np.uint64(22)) >> np.uint64(11)).astype(float) / (1 << 53) < more)
    yield again, ((mix(node[again] + np.uint64(33)) % np.uint64(SIZE - 1) + first[again] + np.uint64(1)) % np.uint64(SIZE)).astype(np.int64)


def _branch(batches: Iterator[pa.RecordBatch], threshold: float, trees: int | None) -> Iterator[pa.RecordBatch]:
    """Children of each row's node; the roots of all trees where `trees` is given."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            rep, tokens = part.column(0).to_numpy(), _tokens(part)
            nodes = [part.column(1).to_numpy().view(np.uint64)] if trees is None else [np.full(len(rep), mix(np.array([t + 1], np.uint64))[0]) for t in range(trees)]
            for node in nodes:
                for rows, places in _chosen(node, threshold):
                    child = mix(mix(node[rows] + places.astype(np.uint64)) ^ tokens[rows, places].astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(rep[rows], pa.int64()), pa.array(child.view(np.int64), pa.int64())], ["rep", "node"])


def _nodes(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rep, node) of the leaves, equal leaves once, and of the nodes too large at the last level."""
    rows = map_batches(sets.select("rep", "tokens"), partial(_branch, threshold=threshold, trees=TREES), "rep long, node long")
    levels = None
    for depth in range(DEPTH):
        rows = materialise(rows, "level")
        met = materialise(rows.groupBy("node").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("m > 1"), "nodes")
        # One of the leaves that hold the same classes is enough.
        small = met.where(F.col("m") <= LEAF).groupBy("m", "who").agg(F.min("node").alias("node")).select("node", F.lit(False).alias("large"))
        marks = small.unionByName(met.where(F.col("m") > LEAF).select("node", F.lit(True).alias("large")))
        if depth == DEPTH - 1:  # nobody branches further: nodes that hold the same classes are one
            large = met.where(F.col("m") > LEAF).groupBy("m", "who").agg(F.min("node").alias("node"))
            marks = small.unionByName(large.select("node", F.lit(True).alias("large")))
        marked = materialise(rows.join(marks, "node").select("rep", "node", "large"), "marked")
        leaf, large = marked.where("NOT large").select("rep", "node"), marked.where("large").select("rep", "node")
        levels = leaf if levels is None else levels.unionByName(leaf)
        if depth == DEPTH - 1 or large.isEmpty():
            break
        below = large.join(sets.select("rep", "tokens"), "rep").select("rep", "node", "tokens")
        rows = map_batches(below, partial(_branch, threshold=threshold, trees=None), "rep long, node long").distinct()
    return levels, large


def _alike(members: list[dict], percent: int) -> tuple[list[int], list[tuple[float, int, int]]]:
    """Sorted documents of a leaf, and its pairs of two components that pass size and sketch: (-likeness, place, place)."""
    share = percent / 100
    need = share - 4 * (share * (1 - share) / SIZE) ** 0.5  # four standard deviations below
    members.sort(key=lambda x: x["rep"])
    rep = [x["rep"] for x in members]
    n = np.array([x["n"] for x in members], np.int64)
    comp = np.array([x["comp"] for x in members], np.int64)
    sketch = np.frombuffer(b"".join(x["sketch"] for x in members), np.uint8).reshape(len(rep), SIZE)
    found = []
    for k in range(len(rep) - 1):
        rest = slice(k + 1, None)
        fits = (100 * np.minimum(n[k], n[rest]) >= percent * np.maximum(n[k], n[rest])) & (comp[k] != comp[rest])
        if fits.any():
            alike = (sketch[k] == sketch[rest]).mean(1)
            found += [(-alike[j], k, k + 1 + int(j)) for j in np.flatnonzero(fits & (alike >= need))]
    return rep, found


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(node, members) of some leaves at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))


def _connect(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The strongest candidate pairs that connect each leaf: fewer than it has members."""
    for leaves in _leaves(batches):
        left, right = [], []
        for _, members in leaves:
            rep, found = _alike(members, percent)
            group = list(range(len(rep)))

            def root(x):
                while group[x] != x:
                    group[x] = group[group[x]]
                    x = group[x]
                return x

            for _, k, j in sorted(found):
                a, b = root(k), root(j)
                if a != b:
                    group[max(a, b)] = min(a, b)
                    left.append(rep[k])
                    right.append(rep[j])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _doubtful(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The members of each leaf that are in a candidate pair, and into how many blocks of shingles these are cut."""
    for leaves in _leaves(batches):
        out = [[], [], [], []]
        for node, members in leaves:
            _, found = _alike(members, percent)
            some = sorted({k for pair in found for k in pair[1:]})
            parts = -(-sum(members[k]["n"] for k in some) // BLOCK)
            for k in some:
                for column, value in zip(out, (node, members[k]["rep"], members[k]["comp"], parts)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in out], ["node", "rep", "comp", "parts"])


def _leaf_groups(leaves: DataFrame) -> DataFrame:
    """leaves: node, rep, n, sketch, comp. A leaf holds at most LEAF rows, so gathering it is bounded."""
    return leaves.groupBy("node").agg(F.collect_list(F.struct("rep", "n", "sketch", "comp")).alias("members"))


def _shared(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a leaf's sets; the incidence is multiplied `width` shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    place, owner = (np.cumsum(often) - 1)[place[often[place]]], owner[often[place]]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(often.sum()), width):
        here = slice(*np.searchsorted(place, [low, low + width]))
        holds = np.zeros((len(sets), width), np.float32)
        holds[owner[here], place[here] - low] = 1
        out += (holds @ holds.T).astype(np.int64)
    return out


def _within(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each pair of blocks of a leaf, between two components. Rows come pair by pair."""

    def links(held):
        shared = _shared([x for *_, x in held])
        part, rep, comp = (np.array([x[c] for x in held], np.int64) for c in range(3))
        sizes = np.array([len(x) for *_, x in held])
        across = len(set(part.tolist())) > 1  # pairs of one block meet where it meets itself
        for k, (*_, mine) in enumerate(held):
            both = shared[k]
            near = (100 * both >= percent * (sizes + len(mine) - both)) & (rep > rep[k]) & (comp != comp[k])
            yield from ((int(rep[k]), int(rep[j])) for j in np.flatnonzero(near & (part != part[k]) if across else near))

    group, held, schema = None, [], pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
        rows = list(zip(*(batch.column(c).to_pylist() for c in range(3, 6))))
        found = []
        for row, end, values, offsets in _slices(batch, "words"):
            sets, at = shingle_sets(values, offsets, width)
            for k in range(row, end):
                if keys[k] != group:
                    found += links(held) if held else []
                    group, held = keys[k], []
                held.append((*rows[k], sets[at[k - row] : at[k - row + 1]].copy()))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 2, schema=schema)
    if held:
        found = list(links(held))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 2, schema=schema)


def _leaf_links(leaves: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the components of each leaf.

    Texts go to the leaf, once per member that has a candidate there, and
    meet in the task: what is shuffled grows with the members, not with their
    pairs. Long texts are dealt into blocks of about BLOCK shingles, and blocks
    meet in pairs, each also itself.
    """
    some = map_batches(_leaf_groups(leaves), partial(_doubtful, percent=percent), "node long, rep long, comp long, parts long")
    part, other = F.pmod(F.xxhash64("rep"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = some.select("node", "rep", "comp", part.alias("part"), other.alias("other"))
    met = dealt.select("node", F.least("part", "other").alias("u"), F.greatest("part", "other").alias("v"), "part", "rep", "comp")
    spread = met.join(texts, "rep").repartition("node", "u", "v").sortWithinPartitions("node", "u", "v")
    hashed = spread.select("node", "u", "v", "part", "rep", "comp", word_hashes(F.col("text")).alias("words"))
    return map_batches(hashed, partial(_within, width=width, percent=percent), "a long, b long").distinct()


def _crowd_pairs(rows: DataFrame, percent: int, seeds: range) -> DataFrame:
    """Members of a node with its leaders, one drawn for each seed, where they lie in two components and sizes allow.

    rows: node, rep, n, comp.
    """
    draw = lambda seed: F.min_by(F.struct("rep", "n", "comp"), F.xxhash64("rep", "node", F.lit(seed)))
    leaders = rows.groupBy("node").agg(F.array(*[draw(seed) for seed in seeds]).alias("leaders"))
    led = F.filter("leaders", lambda x: (F.col("comp") != x.comp) & (100 * F.least("n", x.n) >= percent * F.greatest("n", x.n)))
    pairs = rows.join(leaders, "node").select("rep", F.explode(led).alias("leader"))
    return pairs.select(F.col("leader.rep").alias("a"), F.col("rep").alias("b")).distinct()


class _Inverted:
    """Which of several sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        hashes = np.concatenate(sets)
        order = np.argsort(hashes, kind="stable")
        self.owner = np.repeat(np.arange(self.n), [len(x) for x in sets])[order]
        self.hashes, self.start = np.unique(hashes[order], return_index=True)
        self.length = np.diff(self.start, append=len(hashes))

    def held(self, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the index has the given shingles, and which of them it has."""
        at = np.minimum(np.searchsorted(self.hashes, mine), len(self.hashes) - 1)
        return at, self.hashes[at] == mine

    def shared(self, mine: np.ndarray) -> np.ndarray:
        """How many of the given shingles each set holds."""
        at, has = self.held(mine)
        at = at[has]
        take = self.length[at]
        places = np.repeat(self.start[at] - np.cumsum(take) + take, take) + np.arange(int(take.sum()))
        return np.bincount(self.owner[places], minlength=self.n)


def rarest(mine: np.ndarray, percent: int, index: _Inverted) -> np.ndarray:
    """The rarest shingles of a set, as many as two similar sets must share one of.

    Sets of sizes x and y that are similar enough share at least percent of x;
    under one order of all shingles they then share one of the first
    x - ceil(percent * x) + 1 of x, and of as many of y. The order is by the
    number of sets in the index: what a whole group has in common comes last.
    """
    at, has = index.held(mine)
    order = np.lexsort((mine, index.length[at] * has))
    return mine[order[: len(mine) - (percent * len(mine) + 99) // 100 + 1]]


def _meet(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks, one link of each row apart with each component it is linked with. Rows apart come first."""
    group, apart, met, index, firsts = None, [], None, None, None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
        member, rep, comp = (batch.column(c).to_pylist() for c in range(3, 6))
        left, right = [], []
        for row, end, values, offsets in _slices(batch, "words"):
            sets, at = shingle_sets(values, offsets, width)
            for k in range(row, end):
                mine = sets[at[k - row] : at[k - row + 1]]
                if keys[k] != group:
                    group, apart, met, index = keys[k], [], set(), None
                if not member[k]:
                    apart.append((rep[k], comp[k], mine.copy()))
                    continue
                if not apart:
                    continue
                if index is None:
                    index = _Inverted([x for _, _, x in apart])
                    firsts = _Inverted([rarest(x, percent, index) for _, _, x in apart])
                    sizes, comps = np.array([len(x) for _, _, x in apart]), np.array([c for _, c, _ in apart])
                    reps = np.array([r for r, _, _ in apart])
                near = np.flatnonzero(
                    (firsts.shared(rarest(mine, percent, index)) > 0) & (comps != comp[k])
                    & (100 * np.minimum(sizes, len(mine)) >= percent * np.maximum(sizes, len(mine)))
                )
                if len(near) < 32:
                    both = np.array([len(np.intersect1d(apart[j][2], mine, assume_unique=True)) for j in near], np.int64)
                else:
                    both = index.shared(mine)[near]
                for j in near[100 * both >= percent * (sizes[near] + len(mine) - both)].tolist():
                    if (j, comp[k]) not in met:
                        met.add((j, comp[k]))
                        left.append(int(reps[j]))
                        right.append(rep[k])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


#: Shingles of the rows of a block.
BLOCK = 4_000_000


def _apart_links(crowds: DataFrame, comps: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of the members outside their family's largest component with members of other components.

    A family is what nodes too large to compare have in common, through any
    tree; a document is in one family, once. Its rows apart and its members are
    dealt into blocks of about BLOCK shingles, and blocks meet in pairs, where
    an exact join on the rarest shingles of both finds what to compare.
    """
    least = crowds.groupBy("node").agg(F.min("rep").alias("a"))
    family = components(crowds.join(least, "node").select("a", F.col("rep").alias("b")))
    own = F.coalesce("component", "rep").alias("family")
    members = crowds.select("rep").distinct().join(family.withColumnRenamed("node", "rep"), "rep", "left").select("rep", own)
    members = materialise(members.join(comps, "rep").join(sketches.select("rep", "n"), "rep"), "members")
    sizes = members.groupBy("family", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    families = sizes.groupBy("family").agg(F.max(F.struct("m", "comp", "n")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda n: F.ceil(n / BLOCK)
    families = families.select("family", F.col("top.comp").alias("main"), blocks(F.col("n")).alias("ms"), blocks(F.col("n") - F.col("top.n")).alias("us"))
    rows = materialise(members.join(families, "family"), "families")
    part = lambda parts: F.pmod(F.xxhash64("rep"), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    apart = rows.where("comp <> main").select("family", part("us").alias("u"), each("ms").alias("v"), F.lit(False).alias("member"), "rep", "comp")
    others = rows.select("family", each("us").alias("u"), part("ms").alias("v"), F.lit(True).alias("member"), "rep", "comp")
    spread = apart.unionByName(others).join(texts, "rep").repartition("family", "u", "v").sortWithinPartitions("family", "u", "v", "member")
    hashed = spread.select("family", "u", "v", "member", "rep", "comp", word_hashes(F.col("text")).alias("words"))
    return map_batches(hashed, partial(_meet, width=width, percent=percent), "a long, b long").distinct()


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each home with its partners. Rows come home first, then partners, group by group."""
    home, salt, own = None, None, None
    for batch in batches:
        hubs, salts, reps = (batch.column(c).to_numpy() for c in range(3))
        left, right = [], []
        for row, end, values, offsets in _slices(batch, "words"):
            sets, at = shingle_sets(values, offsets, width)
            for k in range(row, end):
                mine = sets[at[k - row] : at[k - row + 1]]
                if (hubs[k], salts[k]) != (home, salt):
                    home, salt, own = hubs[k], salts[k], None
                if reps[k] == home:
                    own = mine.copy()
                elif own is not None:
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(mine) - both):
                        left.append(home)
                        right.append(reps[k])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = materialise(pairs, "pairs")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("parts"))
    placed = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"), F.col("b").alias("rep"))
    homes = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.col("a").alias("rep"))
    rows = placed.unionByName(homes).join(texts, "rep").withColumn("far", F.col("rep") != F.col("a"))
    spread = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "far")
    return map_batches(spread.select("a", "salt", "rep", word_hashes(F.col("text")).alias("words")), partial(_confirm, width=width, percent=percent), "a long, b long")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link (a, b), by alternating stars.

    With `rounds`, what so many rounds have found: a component may still be in several parts.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    state, turn = None, 0
    while rounds is None or turn < rounds:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: neighbours above u point to the least of u and its neighbours.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialise(large, "large-star")
        # Small star: u and its neighbours below point to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u > v").distinct(), "small-star")
        if turn == rounds:
            break
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id, n_links (links of the class that were confirmed)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("words"))
    described = materialise(map_batches(hashed, partial(_describe, width=width), "doc_id long, n long, f1 long, f2 long, tokens binary, sketch binary"), "sets")
    known = described.where("n > 0 AND doc_id IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").alias("rep"), "n", "tokens", "sketch")).alias("least")
    sets = materialise(known.groupBy("f1", "f2").agg(least).select("f1", "f2", "least.*"), "classes")
    leaves, crowds = _nodes(sets, percent / 100)

    sketches = sets.select("rep", "n", "sketch")
    alone = F.col("rep").alias("comp")
    crowded = materialise(crowds.join(sketches.select("rep", "n"), "rep").select("node", "rep", "n"), "crowded")
    groups = _leaf_groups(leaves.join(sketches, "rep").select("node", "rep", "n", "sketch", alone))
    first = map_batches(groups, partial(_connect, percent=percent), "a long, b long")
    first = materialise(first.unionByName(_crowd_pairs(crowded.select("node", "rep", "n", alone), percent, range(1))).distinct(), "first")
    # Texts are read once more, only of documents with a candidate.
    active = materialise(first.select(F.explode(F.array("a", "b")).alias("rep")).union(crowds.select("rep")).distinct(), "active")
    some = sieve(docs, "doc_id", active)
    texts = materialise(some.join(active, some["doc_id"] == active["rep"], "left_semi").select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep"]), "texts")
    links = materialise(_confirmed(first, texts, width, percent), "confirmed")

    def labels(links: DataFrame) -> DataFrame:
        found = components(links, 2).withColumnRenamed("node", "rep")
        return materialise(active.join(found, "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp")), "comps")

    # What still lies in two components is compared in whole: leaves of one component are done.
    comps = labels(links)
    placed = materialise(leaves.join(comps, "rep").select("node", "rep", "comp"), "placed")
    mixed = placed.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("node")
    mixed = placed.join(mixed, "node").join(sketches, "rep").select("node", "rep", "n", "sketch", "comp")
    more = materialise(_leaf_links(mixed, texts, width, percent), "confirmed")
    again = materialise(crowded.join(comps, "rep").select("node", "rep", "n", "comp"), "crowded")
    second = _crowd_pairs(again, percent, range(1, 4)).join(first, ["a", "b"], "left_anti")
    led = materialise(_confirmed(second, texts, width, percent), "confirmed")
    links = materialise(links.unionByName(more).unionByName(led).distinct(), "confirmed")
    if not crowds.isEmpty():
        links = links.unionByName(materialise(_apart_links(crowds, labels(links), sketches, texts, width, percent), "met"))
    found = materialise(components(links), "components")

    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    resolved = sets.select("f1", "f2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").join(ends, "rep", "left")
    out = described.drop("tokens", "sketch").join(resolved, ["f1", "f2"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
        F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
