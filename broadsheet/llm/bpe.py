"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts as one state with a loop for every base
symbol. The merges then act on it one after the other, each by a gadget: for
u + v, the state reached by u is split so that v no longer follows, and a new
arc labelled uv is laid wherever u could be read, ending where v ended. What
is left accepts exactly the token sequences BPE produces, one per word.

All arcs of one label end in the same state, so a state is named by the label
that leads to it, and a split state is kept as a version: "what followed the
right half of this label when its merge came, without what later merges took
away". `follows` reads an arc from these versions; arcs once read stay in a
bounded table. Reading a word is then a walk through the table, longest label
first, that steps back where no arc leads on. Decoding emits the arc labels.

Null text counts as empty, and an empty text has no tokens. A very long word
costs time in proportion to its length (positions without a way on are
remembered). Repeated rows are encoded each; extra columns are ignored by
`token_digests` and kept by `encode` and `decode`.
"""

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from broadsheet.llm.common import map_batches

END = "\x00"  # stands for the mark of a word's end; byte-level texts never hold it
BASE = -1


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte (the public byte-level alphabet)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class Automaton:
    """The compiled merges: one gadget per merge, in order of priority."""

    #: Arcs kept once read.
    MOST = 300_000

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], mark: str = "</w>"):
        def name(token: str) -> str:
            return token[: -len(mark)] + END if mark and token.endswith(mark) else token

        self.labels = [""] * (max(vocab.values(), default=-1) + 1)
        self.ids: dict[str, int] = {}
        for token, i in vocab.items():
            self.labels[i] = token
            self.ids[name(token)] = i
        n = len(self.labels)
        self.left, self.right, self.rank = array("i", [-1] * n), array("i", [-1] * n), array("i", [BASE] * n)
        self.blocked: dict[int, int] = {}  # (u, v) -> when v was taken from the state after u
        self.longest: dict[str, int] = {}  # first three symbols -> length of the longest label
        self.arcs: dict[int, bool] = {}
        for when, (u, v) in enumerate(merges):
            self.gadget(when, self.ids[name(u)], self.ids[name(v)], self.ids[name(u) + name(v)])
        for token in self.ids:
            if len(token) > 2:
                self.longest[token[:3]] = max(self.longest.get(token[:3], 2), len(token))

    def gadget(self, when: int, u: int, v: int, uv: int) -> None:
        """Lay the arc uv beside u and split the state after u: v does not follow from now on."""
        self.left[uv], self.right[uv], self.rank[uv] = u, v, when
        self.blocked[u << 32 | v] = when

    def follows(self, x: int, t: int) -> bool:
        """Whether the state after label x has an arc t."""
        key = x << 32 | t
        found = self.arcs.get(key)
        if found is None:
            found = self._read(x, t)
            if len(self.arcs) >= self.MOST:
                self.arcs.clear()
            self.arcs[key] = found
        return found

    def _read(self, x: int, t: int) -> bool:
        rank, left, right, blocked = self.rank, self.left, self.right, self.blocked
        before = len(rank)
        while True:
            when = blocked.get(x << 32 | t)
            if when is not None and when < before:
                return False
            if rank[x] > rank[t]:  # the state is a copy of the one after its right half, made at its merge
                before, x = rank[x], right[x]
            elif rank[t] != BASE:  # the arc was laid beside its left half, at its merge
                before, t = rank[t] + 1, left[t]
            else:
                return True

    def walk(self, word: str) -> list[int]:
        """Labels of the one path that spells the word."""
        find, longest, arcs, follows = self.ids.get, self.longest.get, self.arcs, self.follows
        n, at, last, cap = len(word), 0, -1, len(word)
        path: list[int] = []
        sizes: list[int] = []
        dead: set[int] = set()
        while at < n:
            size = min(longest(word[at : at + 3], 2), cap, n - at)
            while size:
                t = find(word[at : at + size])
                if t is not None and (last < 0 or (arcs.get(last << 32 | t) if last << 32 | t in arcs else follows(last, t))) and at + size not in dead:
                    break
                size -= 1
            if size:
                path.append(t)
                sizes.append(size)
                at, last, cap = at + size, t, n
            else:
                if not path:
                    raise ValueError(f"no path spells {word!r}")
                dead.add(at)
                path.pop()
                size = sizes.pop()
                at, cap, last = at - size, size - 1, path[-1] if path else -1
        return path


class Tokenizer:
    """Pre-splitting, cached words and the automaton of one vocabulary file."""

    #: Words kept per generation of the cache; frequent ones move on to the next.
    KEPT = 150_000

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.mark = END if model.get("end_of_word_suffix") else ""
        self.labels = list(self.automaton.labels)
        self.special = {}
        for extra in data["added_tokens"]:
            self.labels += [""] * (extra["id"] + 1 - len(self.labels))
            self.labels[extra["id"]] = extra["content"]
            self.special[extra["content"]] = extra["id"]
        self.symbols = byte_symbols()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # White space never stands inside a chunk, so the classes below need not name it.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.gap = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-split word, as 32-bit integers."""
        symbols = piece if piece.isascii() and piece.isprintable() else "".join(map(self.symbols.__getitem__, piece.encode()))
        return array("I", self.automaton.walk(symbols + self.mark)).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space: from the cache, or piece by piece."""
        ids = self.new.get(chunk)
        if ids is not None:
            return ids
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha() or len(chunk) == 1:
                ids = self.piece(chunk)
            elif chunk[:-1].isalpha() and chunk[-1] in ",.;:!?":
                ids = self.chunk(chunk[:-1]) + self.chunk(chunk[-1])
            else:
                ids = b"".join(map(self.piece, self.pieces.findall(chunk)))
        if len(self.new) >= self.KEPT:
            self.old, self.new = self.new, {}
        if len(chunk) <= 64:
            self.new[chunk] = ids
        return ids

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma in lower case, wherever it stands
        text = text.lower()
        chunks = [c for c in self.gap.split(text) if c] if self.odd.search(text) else text.split()
        found = list(map(self.new.get, chunks))
        if None in found:
            found = [self.chunk(c) if f is None else f for f, c in zip(found, chunks)]
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(
            array("I", [self.special[part]]).tobytes() if part in self.special else self.plain(part)
            for part in self.cut.split(text)
        )

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, joined as a tokenizer without a decoder joins them."""
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I")))


_compiled: dict[int, Tokenizer] = {}


def _tokenizer(spec) -> Tokenizer:
    """One automaton per worker process and vocabulary."""
    if spec.id not in _compiled:
        _compiled.clear()
        _compiled[spec.id] = Tokenizer(spec.value)
    return _compiled[spec.id]


class _Spec:
    """The vocabulary file's text, broadcast: its size is that of the file, whatever the data."""

    def __init__(self, id: int, broadcast):
        self.id, self.broadcast = id, broadcast

    @property
    def value(self) -> str:
        return self.broadcast.value


def _shared(df: DataFrame, path: str) -> _Spec:
    with open(path, encoding="utf-8") as file:
        text = file.read()
    return _Spec(hash(text), df.sparkSession.sparkContext.broadcast(text))


def _rows(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, part.column(part.schema.get_field_index(column)).to_pylist()


def _added(df: DataFrame, column: str, name: str, kind: str, make, arrow) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"the frame already has a column {name}")

    def run(batches):
        for part, values in _rows(batches, column):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(make(values), arrow)], [*part.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(df, run, f"{fields}, `{name}` {kind}")


def encode(df: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """The frame with the token ids of its texts, as array<int>."""
    spec = _shared(df, path)

    def make(values):
        tokenizer = _tokenizer(spec)
        return [list(memoryview(tokenizer.encode(v)).cast("I")) if v else [] for v in values]

    return _added(df, text, name, "array<int>", make, pa.list_(pa.int32()))


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The frame with the texts of its token ids; null ids count as none."""
    spec = _shared(df, path)

    def make(values):
        tokenizer = _tokenizer(spec)
        return [tokenizer.decode(array("I", v or []).tobytes()) for v in values]

    return _added(df, ids, name, "string", make, pa.string())


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode every whole text in one pass."""
    spec = _shared(docs, path)

    def run(batches):
        for part, texts in _rows(batches, "text"):
            tokenizer = _tokenizer(spec)
            counts, ids_sha, text_sha = [], [], []
            for text in texts:
                ids = tokenizer.encode(text)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(tokenizer.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")
