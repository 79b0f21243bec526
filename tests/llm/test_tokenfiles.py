"""Token files: the public library as the brute-force version, layout on disk, selective reads, odd rows."""

import glob
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from broadsheet.llm import tokenfiles
from broadsheet.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def expected(library, docs):
    """doc_id, start, n_tokens, crc of every document, in ascending order."""
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.fixture
def scattered(spark):
    """Many range partitions, as on a cluster."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@needs
def test_query_against_the_library(scattered, library):
    docs = [tuple(r) for r in scattered.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_token_files"](scattered, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected(library, docs)


HOSTILE = [
    (1, "a\x1cb \x1d c"), (2, "<|endoftext|> x<|startoftext|>"), (3, "éte ́   x᠎y"), (4, "\x85 ΑΣ ΣΑΣ İ"),
    (5, None), (6, ""), (7, " \n"), (8, "x" * 5000), (9, "🙂🙂 don't I'LL 1234,5"), (10, "\x00 �"),
]


def test_hostile_texts_against_the_library(spark, library, tmp_path):
    path = tokenfiles.write_tokens(spark.createDataFrame(HOSTILE, "doc_id long, text string"), PATH, str(tmp_path / "t"))
    got = tokenfiles.id_checksums(tokenfiles.read_tokens(spark, path)).collect()
    assert sorted(map(tuple, got)) == expected(library, HOSTILE)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """4000 documents by both encodings, with small pages and row groups."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 40 + id % 50), x -> concat('w', x * id % 997))) AS text", "concat('s', id % 3) AS source")
    out = {}
    for encoding in ("dictionary", "delta"):
        layout = tokenfiles.Layout(encoding, row_group_bytes=100_000, page_bytes=8_000, page_rows=500)
        out[encoding] = tokenfiles.write_tokens(docs, PATH, str(tmp_path_factory.mktemp(encoding) / "t"), keep=("source",), layout=layout)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_layout_on_disk(written, encoding):
    files = sorted(glob.glob(f"{written[encoding]}/tokens/*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in files for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > len(files)
    last = -1
    for group in groups:
        columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
        ids = columns["ids.list.element"]
        assert ("RLE_DICTIONARY" in ids.encodings) == (encoding == "dictionary")
        assert ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta")
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())
        assert columns["doc_id"].statistics.min > last
        last = columns["doc_id"].statistics.max


def test_both_encodings_hold_the_same(spark, written):
    rows = [sorted(map(str, tokenfiles.read_tokens(spark, p).collect())) for p in written.values()]
    assert rows[0] == rows[1] and len(rows[0]) == 4000


def test_selective_reads(spark, written, plan):
    tokens = tokenfiles.read_tokens(spark, written["dictionary"])
    assert "ids" not in plan(tokens.select("doc_id", "n_tokens", "source")).split("ReadSchema: ")[1].split("\n")[0]
    assert "GreaterThan(doc_id,3900)" in plan(tokens.where("doc_id > 3900"))
    assert tokens.where("doc_id > 3900").count() == 99


def test_token_range_is_a_slice_of_the_corpus(spark, written):
    path = written["delta"]
    rows = sorted(tokenfiles.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    corpus = [i for r in rows for i in r["ids"]]
    for lo, hi in ((0, 10), (1000, 1500), (len(corpus) - 7, len(corpus) + 99), (5, 5)):
        got = sorted(tokenfiles.token_range(spark, path, lo, hi).collect(), key=lambda r: r["start"])
        assert [i for r in got for i in r["ids"]] == corpus[lo:hi]
        assert not got or got[0]["start"] == lo


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, part string, ids string"
    odd = [(None, None), (None, "b a"), (2, ""), (2, "x y"), (2, "x y"), (3, "z")]
    path = tokenfiles.write_tokens(spark.createDataFrame([(*r, "", "") for r in odd], schema), PATH, str(tmp_path / "a"))
    got = sorted(tokenfiles.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 2, 2, 2, 3]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(6)]
    empty = tokenfiles.write_tokens(spark.createDataFrame([], schema), PATH, str(tmp_path / "b"))
    assert tokenfiles.id_checksums(tokenfiles.read_tokens(spark, empty)).collect() == []
    assert tokenfiles.token_range(spark, empty, 0, 9).collect() == []
    with pytest.raises(ValueError):
        tokenfiles.write_tokens(spark.createDataFrame([], schema), PATH, keep=("ids",))
