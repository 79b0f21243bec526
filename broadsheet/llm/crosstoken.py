"""Alignment of two tokenizers over the same bytes, by sparse matrix products.

Both tokenizations of a text cover the same bytes. A and B are incidence
matrices in compressed sparse rows, one row per token and one column per byte.
The product A·Bᵀ, row by row (Gustavson: a row of the product adds up the rows
of Bᵀ that its entries name), has an entry for every pair of tokens that share
bytes, whose value is the number of bytes: the overlap links. Byte offsets where tokens
of both end cut the tokens into groups; with one column per group instead of
per byte the same product gives the shared-group links.

Neither tokenizer joins anything across a white space that follows another
character, so a text is cut there into units, and each distinct unit is
tokenized and multiplied once per worker (a bounded cache); punctuation after a
word is a unit of its own where no piece of B joins the two. Where a vocabulary
or a text does not allow these cuts, the whole text is one unit.

Corpus-wide counts of linked id pairs are taken without a row per document and
pair: documents are gathered into blocks of bounded size, a block lists its
distinct pairs once with the number of its documents, blocks' lists are added
up by pair, and each block gets back the counts of its own pairs.

Texts that are null, empty, or whose tokens' bytes do not join to a space and
the text have no tokens. A very long text is one block of its own if need be,
and is multiplied in slices of rows. Rows that repeat a doc_id count as a document each, so an
id pair's count is one of rows. Columns but doc_id and text are ignored.
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.bpe import byte_symbols
from broadsheet.llm.common import Kept, map_batches
from broadsheet.session import materialise


@dataclass
class Csr:
    """A sparse matrix by rows: row r has columns[starts[r]:starts[r + 1]] with values beside them."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @staticmethod
    def runs(sizes: np.ndarray) -> "Csr":
        """Row r has ones in the next sizes[r] columns: tokens over their bytes."""
        starts = np.concatenate([[0], np.cumsum(sizes, dtype="i8")])
        total = int(starts[-1])
        return Csr(starts, np.arange(total), np.ones(total, "i8"), total)

    @staticmethod
    def single(columns: np.ndarray, width: int) -> "Csr":
        """Row r has a one in columns[r]: tokens over their groups."""
        return Csr(np.arange(len(columns) + 1), columns, np.ones(len(columns), "i8"), width)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> "Csr":
        rows = np.repeat(np.arange(self.height), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(starts, rows[order], self.values[order], self.height)

    def rows(self, a: int, b: int) -> "Csr":
        x, y = self.starts[a], self.starts[b]
        return Csr(self.starts[a : b + 1] - x, self.columns[x:y], self.values[x:y], self.width)

    def reach(self, other: "Csr") -> np.ndarray:
        """Entries of other's rows that each row of the product adds up."""
        take = np.diff(other.starts)[self.columns]
        return np.add.reduceat(np.append(take, 0), self.starts[:-1]) * (np.diff(self.starts) > 0) if self.height else take[:0]

    def times(self, other: "Csr") -> "Csr":
        """Row r of the product is the sum of other's rows named by row r's entries."""
        take = np.diff(other.starts)[self.columns]
        before = np.cumsum(take) - take
        at = np.repeat(other.starts[:-1][self.columns] - before, take) + np.arange(int(take.sum()))
        rows = np.repeat(np.repeat(np.arange(self.height), np.diff(self.starts)), take)
        columns, values = other.columns[at], np.repeat(self.values, take) * other.values[at]
        key = rows * max(other.width, 1) + columns
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        if not len(key):
            return Csr(np.zeros(self.height + 1, "i8"), key, values, other.width)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, values = key[first], np.add.reduceat(values, first)
        rows, columns = np.divmod(key, max(other.width, 1))
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=self.height))]), columns, values, other.width)


#: Entries of a product held at once.
HELD = 1 << 21


def product_slices(a: Csr, bt: Csr) -> Iterator[tuple[int, Csr]]:
    """(first row, product of a slice of rows), each slice of about HELD entries at most: one row at least."""
    if not a.height:
        return
    ends = np.cumsum(a.reach(bt))
    at = 0
    while at < a.height:
        done = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, done + HELD, "right")), at + 1)
        yield at, a.rows(at, to).times(bt)
        at = to


class ByteBpe:
    """A byte-level vocabulary file (tokenizers): ids of texts, bytes of ids."""

    def __init__(self, spec: bytes):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec.decode())
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        data = json.loads(spec)
        back = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes = [b""] * self.library.get_vocab_size()
        for token, i in data["model"]["vocab"].items():
            self.bytes[i] = bytes(map(back.__getitem__, token)) if all(c in back for c in token) else token.encode()
        for extra in data.get("added_tokens", []):
            self.bytes[extra["id"]] = extra["content"].encode()
        step = data.get("pre_tokenizer") or {}
        #: The public split ends a piece wherever white space follows another character.
        self.cuts = data.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


class PieceBpe:
    """A sentencepiece model with byte fallback, which puts a space before each text."""

    SPACE = "▁"

    def __init__(self, spec: bytes):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=spec)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(self.SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = m.piece_to_id(self.SPACE)
        long = [p for i, p in enumerate(pieces) if len(p) > 1 and not m.is_byte(i)]
        #: White space that some piece joins to other characters: texts are not cut before it.
        self.joined = {c for p in long for c in p if c.isspace()}
        #: A line feed stands alone, so that what follows it is tokenized as inside a text.
        self.lead = m.encode("\n")
        self.cuts = all(self.SPACE not in p.lstrip(self.SPACE) for p in long) and "\n" not in self.joined and self.lead[:1] == [self.space]
        #: Punctuation that no piece joins to a letter before it.
        after = {b for p in long for a, b in zip(p, p[1:]) if a.isalpha()}
        self.apart = "".join(c for c in ",.;:!?" if c not in after)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts as they stand: those with a space in front without it, since the model puts one there, others behind a line feed."""
        spaced = [t[:1] == " " for t in texts]
        found = self.model.encode([t[1:] if s else "\n" + t for t, s in zip(texts, spaced)], num_threads=1) if texts else []
        for k, (text, s) in enumerate(zip(texts, spaced)):
            if s and len(text) == 1:
                found[k] = [self.space]
            elif not s:
                found[k] = found[k][len(self.lead) :]
        return found


#: What the tokens of a piece of text add to its document: tokens of A and B, groups, shared-group links, links as id pairs, groups as text.
Unit = tuple[int, int, int, int, bytes, str]
WRONG: Unit = (-1, -1, 0, 0, b"", "")


class Aligner:
    """Both tokenizers, and the units already aligned."""

    #: Letters both libraries and Python agree on.
    LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteBpe(a), PieceBpe(b)
        self.size = [np.array([len(t) for t in side.bytes], "i8") for side in (self.a, self.b)]
        self.wide = len(self.b.bytes)
        kept = "".join(sorted(self.b.joined))
        more = f"(?:[{re.escape(kept)}]\\s*\\S+)*" if kept else ""
        word = rf"\s*[{self.LETTERS}]+(?=[{self.b.apart}]+(?:[ \n]|\Z))|(?<=[{self.LETTERS}])[{self.b.apart}]+(?=[ \n]|\Z)|" if self.b.apart and " " not in kept else ""
        self.cut = re.compile(rf"{word}\s*\S+{more}") if self.a.cuts and self.b.cuts else None
        # Python's white space that the pattern of the public split does not take for such, and the reverse.
        self.odd = re.compile("[\x1c-\x1f᠎]")
        # Strings of ids with the mark that may follow, in the order of both vocabularies: inside a run, at its end.
        ids = [*map(str, range(len(self.a.bytes))), *map(str, range(self.wide))]
        marks = ["|"] * len(self.a.bytes) + [";"] * self.wide
        self.shown = [i + "," for i in ids] + [i + m for i, m in zip(ids, marks)]
        self.units = Kept(200_000)

    def pieces(self, text: str) -> list[str]:
        """The units of a text with a space in front of it."""
        text = " " + text
        if self.cut is None or self.odd.search(text):
            return [text]
        core = text.rstrip()
        found = self.cut.findall(core)
        if not found:
            return [text]
        found[-1] += text[len(core) :]
        return found

    def documents(self, texts: list[str | None]) -> list[list[Unit]]:
        """The units of each text; none where it has no tokens."""
        cut = [self.pieces(t) if t else [] for t in texts]
        have: dict[str, Unit | None] = dict.fromkeys({u for units in cut for u in units})
        new = []
        for unit in have:
            have[unit] = known = self.units.get(unit)
            if known is None:
                new.append(unit)
        for at in range(0, len(new), 1024):
            for unit, made in zip(new[at : at + 1024], self.aligned(new[at : at + 1024])):
                have[unit] = made
                if len(unit) <= 64:
                    self.units.put(unit, made)
        wrong = {unit for unit, made in have.items() if made[0] < 0}
        out = []
        for text, units in zip(texts, cut):
            found = list(map(have.__getitem__, units))
            if wrong and not wrong.isdisjoint(units):  # not the same bytes: the text as a whole decides
                whole = self.aligned([" " + text])[0] if len(units) > 1 else WRONG
                found = [] if whole is WRONG else [whole]
            out.append(found)
        return out

    def aligned(self, units: list[str]) -> list[Unit]:
        """The units, all in one product: no token reaches into the next unit."""
        tokens = [self.a.encode(units), self.b.encode(units)]
        raw = [u.encode() for u in units]
        ends = np.cumsum([len(r) for r in raw])
        if not all(self.spells(side, of, b"".join(raw), ends) for side, of in zip((self.a, self.b), tokens)):
            if len(units) == 1:
                return [WRONG]
            # Some unit is not spelt by its tokens: the others are aligned without it.
            right = [all(b"".join(map(side.bytes.__getitem__, of[k])) == raw[k] for side, of in zip((self.a, self.b), tokens)) for k in range(len(units))]
            rest = iter(self.aligned([u for u, r in zip(units, right) if r]) if any(right) else [])
            return [next(rest) if r else WRONG for r in right]
        first = [np.concatenate([[0], np.cumsum([len(x) for x in of])]).tolist() for of in tokens]
        ids = [np.array([i for x in of for i in x], "i8") for of in tokens]
        m = [Csr.runs(size[i]) for size, i in zip(self.size, ids)]
        cuts = np.intersect1d(m[0].starts[1:], m[1].starts[1:], assume_unique=True)
        group = [np.searchsorted(cuts, x.starts[1:]) for x in m]
        shared = Csr.single(group[0], len(cuts)).reach(Csr.single(group[1], len(cuts)).transposed())
        shared = np.concatenate([[0], np.cumsum(shared)])[first[0]]
        bt = m[1].transposed()
        codes, per = [], np.zeros(len(ids[0]), "i8")
        for at, part in product_slices(m[0], bt):
            n = np.diff(part.starts)
            per[at : at + len(n)] = n
            codes.append(np.repeat(ids[0][at : at + len(n)], n) * self.wide + ids[1][part.columns])
        codes = np.concatenate([per[:0], *codes]).tobytes()
        linked = (8 * np.concatenate([[0], np.cumsum(per)])[first[0]]).tolist()
        # Groups in order, A's tokens before B's: a token's place is its own number and that of the other side's before it.
        last = [np.append(g[1:] != g[:-1], True) for g in group]
        place = [np.arange(len(ids[0])) + np.searchsorted(group[1], group[0]), np.arange(len(ids[1])) + np.searchsorted(group[0], group[1], "right")]
        show = np.empty(len(ids[0]) + len(ids[1]), "i8")
        for side, shift in ((0, 0), (1, len(self.a.bytes))):
            show[place[side]] = ids[side] + shift + last[side] * (len(self.shown) // 2)
        shown = list(map(self.shown.__getitem__, show.tolist()))
        groups = np.diff(np.concatenate([[0], np.cumsum(last[0])])[first[0]]).tolist()
        return [
            (a1 - a0, b1 - b0, g, n, codes[x:y], "".join(shown[a0 + b0 : a1 + b1]))
            for a0, a1, b0, b1, g, n, x, y in zip(first[0], first[0][1:], first[1], first[1][1:], groups, np.diff(shared).tolist(), linked, linked[1:])
        ]

    @staticmethod
    def spells(side, tokens: list[list[int]], raw: bytes, ends: np.ndarray) -> bool:
        """Whether the bytes of all tokens join to raw, and no token reaches over an end."""
        if b"".join([side.bytes[i] for x in tokens for i in x]) != raw:
            return False
        sizes = np.array([len(side.bytes[i]) for x in tokens for i in x], "i8")
        mine = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(x) for x in tokens])]
        return bool((mine == ends).all())


_aligners: dict[tuple, Aligner] = {}


class _Files:
    """Both vocabulary files, broadcast: their size is that of the files, whatever the data."""

    def __init__(self, df: DataFrame, a_path: str, b_path: str):
        raw = []
        for path in (a_path, b_path):
            with open(path, "rb") as file:
                raw.append(file.read())
        self.key = tuple(hashlib.sha256(r).hexdigest() for r in raw)
        self.raw = df.sparkSession.sparkContext.broadcast(raw)

    def aligner(self) -> Aligner:
        if self.key not in _aligners:
            _aligners.clear()
            _aligners[self.key] = Aligner(*self.raw.value)
        return _aligners[self.key]


def _slices(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def links(docs: DataFrame, a_path: str, b_path: str, shared: bool = False) -> DataFrame:
    """doc_id, a_place, b_place, a_id, b_id, weight: one row per link of token occurrences.

    Overlap links weigh the bytes they share. With `shared`, links of tokens in
    the same group, each of weight 1.
    """
    files = _Files(docs, a_path, b_path)
    names = ["a_place", "b_place", "a_id", "b_id", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            align = files.aligner()
            for doc, text in zip(rows.column(0), rows.column(1).to_pylist()):
                raw = " " + text if text else ""
                if not align.documents([text])[0]:
                    continue
                ids = [np.array([i for u in pieces for i in u], "i8") for pieces in (align.a.encode([raw]), align.b.encode([raw]))]
                a, b = (Csr.runs(size[i]) for size, i in zip(align.size, ids))
                if shared:
                    cuts = np.intersect1d(a.starts[1:], b.starts[1:], assume_unique=True)
                    a, b = (Csr.single(np.searchsorted(cuts, m.starts[1:]), len(cuts)) for m in (a, b))
                for at, part in product_slices(a, b.transposed()):
                    n = np.diff(part.starts)
                    places = np.repeat(np.arange(at, at + len(n)), n)
                    columns = [places, part.columns, ids[0][places], ids[1][part.columns], part.values]
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(places), doc.type), *map(pa.array, columns)], ["doc_id", *names])

    key = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {key}, " + ", ".join(f"{n} long" for n in names))


#: Distinct pairs of documents in a block, added up: a block of this many fits a task many times over.
BLOCK = 2_000_000


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, count: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, count * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def align(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """One row per document and one per block of documents, for `scored`.

    Documents: counts, groups_sha256, and their distinct pairs as places in the
    block's list (`pairs`, steps between them) with how often each is linked
    (`times`). Blocks (doc_id null, `is_doc` false): the list itself (`pairs`,
    a_id * vocabulary of B + b_id) with the number of documents (`times`).
    """
    files = _Files(docs, a_path, b_path)
    kind = docs.schema["doc_id"].dataType
    schema = (
        f"block long, is_doc boolean, doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_shared long, "
        "groups_sha256 string, n_pairs long, pairs binary, times binary"
    )
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def close(number: int, held: list[tuple], codes: list[np.ndarray], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        listed, places = np.unique(np.concatenate(codes), return_inverse=True)
        ends = np.cumsum([0] + [len(c) for c in codes])
        rows = []
        for (doc, times, *facts), a, b in zip(held, ends, ends[1:]):
            steps = np.diff(places[a:b], prepend=0).astype("<u4")
            rows.append((number, True, doc, *facts, int(b - a), _packed(steps), times))
        docs_of = np.bincount(places, minlength=len(listed)).astype("<i8")
        rows.append((number, False, None, 0, 0, 0, 0, 0, "", len(listed), _packed(listed.astype("<i8")), _packed(docs_of)))
        types = [pa.int64(), pa.bool_(), id_type, *[pa.int64()] * 5, pa.string(), pa.int64(), pa.binary(), pa.binary()]
        for at in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1024]), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, codes, total, id_type = TaskContext.get().partitionId() << 32, [], [], 0, pa.int64()
        for rows in _slices(batches):
            id_type = rows.column(0).type
            for doc, units in zip(rows.column(0).to_pylist(), files.aligner().documents(rows.column(1).to_pylist())):
                a, b, groups, shared, linked, shown = zip(*units) if units else ((),) * 6
                linked = np.frombuffer(b"".join(linked), "i8")
                pairs, times = np.unique(linked, return_counts=True)
                sha = hashlib.sha256("".join(shown)[:-1].encode()).hexdigest() if units else ""
                facts = [sum(a), sum(b), sum(groups), len(linked), sum(shared), sha]
                held.append((doc, _packed(times.astype("<u4")), *facts))
                codes.append(pairs)
                total += len(pairs) + 1
                if total >= block:
                    yield from close(number, held, codes, id_type)
                    number, held, codes, total = number + 1, [], [], 0
        if held:
            yield from close(number, held, codes, id_type)

    return map_batches(docs.select("doc_id", "text"), run, schema)


def block_pairs(aligned: DataFrame) -> DataFrame:
    """block, pair, docs: every block's list of pairs as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, 1):
            block, n, pairs, docs = (c[0].as_py() for c in rows.columns)
            listed, counts = _unpacked(pairs, n, "<i8"), _unpacked(docs, n, "<i8")
            for at in range(0, n, 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(listed[part]), block)), pa.array(listed[part]), pa.array(counts[part])], ["block", "pair", "docs"]
                )

    return map_batches(aligned.where("NOT is_doc").select("block", "n_pairs", "pairs", "times"), run, "block long, pair long, docs long")


def pair_counts(listed: DataFrame, width: int) -> DataFrame:
    """pair, count, best: documents that hold each pair linked, and whether no pair of the same A id has more."""
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a_id", F.floor(F.col("pair") / width).cast("long"))
    top = counts.groupBy("a_id").agg(F.max("count").alias("top"))
    return counts.join(top, "a_id").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def link_scores(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared.

    n_best counts the links whose id pair is in as many documents as any pair
    of its A id; count_sum adds up the counts of the pairs of all links.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    aligned = materialise(align(docs, a_path, b_path, block), "aligned")
    listed = materialise(block_pairs(aligned), "pairs")
    answers = listed.select("block", "pair").join(pair_counts(listed, width), "pair")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("pair").to_numpy())
        count, best = found.column("count").to_numpy()[order], found.column("best").to_numpy(zero_copy_only=False)[order]
        n_best, sums = [], []
        for n, pairs, times in zip(*(rows.column(c).to_pylist() for c in ("n_pairs", "pairs", "times"))):
            places, often = np.cumsum(_unpacked(pairs, n, "<u4"), dtype="i8"), _unpacked(times, n, "<u4").astype("i8")
            n_best.append(int((often * best[places]).sum()))
            sums.append(int((often * count[places]).sum()))
        out = [*(rows.column(c) for c in names[:5]), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), rows.column(names[7]), rows.column(names[8])]
        return pa.Table.from_arrays(out, names)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_shared long"
    return aligned.where("is_doc").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
