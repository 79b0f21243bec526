"""Token ids as Parquet files that can be read in part.

A table of token files holds one row per document: its id, how many ids it has,
how many ids of the same part come before it, the ids as a list column, and
whatever metadata columns were asked for. Rows lie in ascending order of
doc_id, over the parts and inside each, so the row groups' statistics and the
page indexes lead a filter on doc_id to a few pages, and a read of metadata
never touches the ids. A second small table has one row per part: its place in
the order, its number of documents and ids, and how many ids come before it.

The ids are written by Spark's own Parquet writer, either with a dictionary per
row group (ids repeat; a vocabulary fits a dictionary page) or delta-packed
(DELTA_BINARY_PACKED, for ids without many repeats); row groups and pages have
the sizes a caller names.

Null texts count as empty; every document ends with the end id, so an empty one
has that alone. Rows without doc_id come first. Rows that repeat a doc_id are
each written, next to each other, in the order of their texts' hashes; they are
dealt over parts by that hash as well, so one id on a third of all rows does
not land in one task. Other columns are dropped unless named; those called like
a column of the files are refused. Empty tables give empty files.
"""

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from broadsheet.llm.common import map_batches
from broadsheet.session import shared_dir

OWN = ["part", "first", "n_tokens", "ids", "start"]


@dataclass(frozen=True)
class Layout:
    """How the files are laid out."""

    encoding: str = "dictionary"  # or "delta"
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2_000
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"unknown encoding {self.encoding}")
        return {
            "compression": self.compression,
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.dictionary.page.size": str(4 << 20),
            # Version 2 pages delta-pack integers that have no dictionary.
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#ids.list.element": str(self.encoding == "dictionary").lower(),
            "parquet.enable.dictionary#doc_id": "false",
            "parquet.enable.dictionary#first": "false",
        }


class Encoder:
    """The public library's ids of whole texts; words seen before come from a bounded cache.

    A vocabulary that drops white space and never joins across it encodes a
    text as its runs without white space, one after the other. Texts in which
    that could differ (special strings, separators on whose class the library
    and Python disagree) go to the library whole, as all do with another kind
    of vocabulary.
    """

    #: Python's white space that the library's is not, and the reverse.
    ODD = "\x1c\x1d\x1e\x1f\u180e"
    #: Words kept; beyond that only those of the last texts are.
    KEPT = 650_000
    #: Punctuation that is cut from a word's end, so that the word is looked for by itself.
    TAIL = ",.;:!?"
    AZ = staticmethod(re.compile("[a-z]+").fullmatch)
    LETTERS = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+$"

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        data = json.loads(spec)
        steps = (data.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.drops_space = any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") for s in steps)
        self.whole = "|".join([re.escape(t["content"]) for t in data["added_tokens"]] + list(self.ODD))
        #: Whether letters A-Z count as those in lower case; others follow rules of their own.
        self.lowers = "Lowercase" in [n.get("type") for n in (data.get("normalizer") or {}).get("normalizers", [])]
        suffix = data["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for token, i in data["model"]["vocab"].items() if suffix and token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        # Words of a-z alone pass the file's normaliser and splitter as they are, where these treat a sample so.
        bare = data | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare)) if self.drops_space else self.library
        sample = [w for w in (t.removesuffix(suffix or "") for t in data["model"]["vocab"]) if self.AZ(w)][::50]
        if self._ids(self.bare, sample) != self._ids(self.library, sample):
            self.bare = self.library

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.drops_space:
            found = self._each(texts.to_pylist())
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], "i8")
        whole = pc.match_substring_regex(texts, self.whole)
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        runs = pc.utf8_split_whitespace(pc.if_else(whole, "", texts) if len(alone) else texts)
        coded = runs.flatten().dictionary_encode()
        values, starts, sizes, parts = self.found(coded.dictionary)
        # The ids of each run are copied from where its two parts have them.
        at = parts[coded.indices.to_numpy()].ravel()
        take = sizes[at]
        ends = np.cumsum(take)
        out = values[np.repeat(starts[at] - ends + take, take) + np.arange(ends[-1] if len(ends) else 0)]
        ends = ends[1::2]
        offsets = runs.offsets.to_numpy() - runs.offsets[0].as_py()
        counts = np.diff(np.concatenate([[0], ends])[offsets])
        if len(alone):
            found = self._each(texts.take(pa.array(alone)).to_pylist())
            pieces = np.split(out, np.cumsum(counts)[:-1])
            for k, raw in zip(alone.tolist(), found):
                pieces[k] = np.frombuffer(raw, "<u4")
                counts[k] = len(pieces[k])
            out = np.concatenate(pieces)
        return out, counts

    def found(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts of runs without white space, where each part's begin, how many they are, and both parts of each run.

        A word of letters and the punctuation after it are looked for by themselves.
        """
        if self.lowers:
            runs = pc.if_else(pc.string_is_ascii(runs), pc.ascii_lower(runs), runs)
        words = pc.utf8_rtrim(runs, self.TAIL)
        cut = pc.and_(pc.match_substring_regex(words, self.LETTERS), pc.less(pc.binary_length(words), pc.binary_length(runs)))
        heads = pc.if_else(cut, words, runs).dictionary_encode()
        tails = pc.if_else(cut, pc.replace_substring_regex(runs, f"^.*[^{self.TAIL}]", ""), "").dictionary_encode()
        listed = [p for part in (heads, tails) for p in part.dictionary.to_numpy(zero_copy_only=False).tolist()]
        known = self.known
        self.learn({p for p in listed if p not in known})
        ids = list(map(known.__getitem__, listed))
        if len(known) > self.KEPT:
            self.known = dict(zip(listed, ids))
        sizes = np.array(list(map(len, ids)), "i8") // 4
        both = np.stack([heads.indices.to_numpy(), tails.indices.to_numpy() + len(heads.dictionary)], 1)
        return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, sizes, both

    def learn(self, parts: set[str]) -> None:
        known = self.known
        plain = [p for p in parts if self.AZ(p)] if self.ends.any() else []
        other = [p for p in parts if p.isalpha() and not self.AZ(p)] if self.ends.any() else []
        for library, words in ((self.bare, plain), (self.library, other)):
            for at in range(0, len(words), 1000):
                some = words[at : at + 1000]
                known.update(zip(some, self._words(library, some)))
        rest = [p for p in parts if p not in known]
        known.update(zip(rest, self._each(rest)))

    @staticmethod
    def _ids(library, words: list[str]) -> list[int]:
        return library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids

    def _words(self, library, words: list[str]) -> list[bytes]:
        """Ids of words, read off one text by the marks of their ends: a word has one at least, so as many marks as words means one each."""
        ids = np.array(self._ids(library, words), "<u4")
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(ends) != len(words):
            return self._each(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


_encoders: dict[int, Encoder] = {}


def _encoder(key: int, spec: str) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


#: Rows and bytes of text encoded at once.
ROWS, BYTES = 4096, 6 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ROWS rows, and of about BYTES in a text column (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, done + BYTES, "right")), at + 1), at + ROWS)
        yield batch.slice(at, to - at)
        at = to


def write_tokens(
    docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 1,
    keep: tuple[str, ...] = (), layout: Layout = Layout(),
) -> str:
    """Write the ids of every document below `path` (a new shared folder by default), and say where."""
    spark = docs.sparkSession
    if clash := set(keep) & {*OWN, "doc_id", "text"}:
        raise ValueError(f"names of the files' own columns: {sorted(clash)}")
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    with open(vocabulary, encoding="utf-8") as file:
        text = file.read()
    spec, key = spark.sparkContext.broadcast(text), hash(text)  # the size of the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = _encoder(key, spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, 1):
                ids, sizes = encoder.encode(rows.column(1))
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                values = np.full(int(ends[-1]), end_id, "<u4")
                values[np.delete(np.arange(len(values)), ends - 1)] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(sizes), part), pa.int32()), pa.array(first + ends - sizes), pa.array(sizes), lists, *rows.columns[2:]],
                    ["doc_id", "part", "first", "n_tokens", "ids", *keep],
                )
                first += int(ends[-1])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    kept = "".join(f", `{c}` {kinds[c]}" for c in keep)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = docs.select("doc_id", "text", *keep).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = map_batches(placed, run, f"doc_id {kinds['doc_id']}, part int, first long, n_tokens long, ids array<int>{kept}")
    rows.write.options(**layout.options()).parquet(f"{path}/tokens")
    # Parts are range partitions: few rows, from metadata columns alone.
    parts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))).write.parquet(f"{path}/parts")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents with `start`, the number of ids of all documents before them.

    Columns that are not used are not read; a filter on doc_id reaches row
    groups and pages.
    """
    tokens, parts = spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/parts").select("part", "base")
    # One row per range partition of the write.
    return tokens.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("first")).drop("base", "first", "part")


def token_range(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """doc_id, start, ids of the corpus's ids at places lo to hi (excluded), cut at both ends; other parts are skipped in the scan."""
    parts = spark.read.parquet(f"{path}/parts").where((F.col("base") < hi) & (F.col("base") + F.col("n_ids") > lo))
    tokens = spark.read.parquet(f"{path}/tokens")
    # Two numbers, known before the scan starts: statistics of row groups then rule out all other parts.
    near = tokens.where((F.col("part") >= parts.agg(F.min("part")).scalar()) & (F.col("part") <= parts.agg(F.max("part")).scalar()))
    rows = near.join(F.broadcast(parts.select("part", "base")), "part").withColumn("start", F.col("base") + F.col("first"))
    rows = rows.where((F.col("start") < hi) & (F.col("start") + F.col("n_tokens") > lo))
    skip = F.greatest(F.lit(lo) - F.col("start"), F.lit(0))
    take = F.least(F.lit(hi) - F.col("start"), F.col("n_tokens")) - skip
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), take.cast("int")).alias("ids"))


def id_checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the ids read; crc32 is unsigned, over little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy().tolist()
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(lists.offsets.to_numpy()), pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    key = tokens.schema["doc_id"].dataType.simpleString()
    return map_batches(tokens.select("doc_id", "start", "ids"), run, f"doc_id {key}, start long, n_tokens long, ids_crc32 long")
