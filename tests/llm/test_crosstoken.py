"""Cross-tokenizer alignment against plain loops over byte ranges, with the public libraries on whole texts."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from broadsheet.llm import crosstoken
from broadsheet.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WIDTH = 32_000


class Plain:
    """Whole texts through the libraries, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def tokens(self, text):
        """[(id, first byte, end)] of A and B; none where the bytes differ."""
        if not text:
            return [], []
        want, out = (" " + text).encode(), []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        for side in (a, b):
            if b"".join(t for _, t in side) != want:
                return [], []
            at, spans = 0, []
            for i, raw in side:
                spans.append((i, at, at + len(raw)))
                at += len(raw)
            out.append(spans)
        return out

    def aligned(self, text):
        a, b = self.tokens(text)
        links, j = [], 0
        for i, lo, hi in a:
            while b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((i, b[k][0], min(hi, b[k][2]) - max(lo, b[k][1])))
                k += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, lo = [], 0
        for cut in cuts:
            groups.append(([i for i, _, e in a if lo < e <= cut], [i for i, _, e in b if lo < e <= cut]) if len(a) < 3000 else None)
            lo = cut
        return a, b, links, groups


def brute(docs):
    plain, rows, count = Plain(), [], Counter()
    for doc, text in docs:
        a, b, links, groups = plain.aligned(text)
        rows.append((doc, a, b, links, groups))
        count.update({(x, y) for x, y, _ in links})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for doc, a, b, links, groups in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups) if None not in groups else None
        sha = hashlib.sha256(text.encode()).hexdigest() if a and text is not None else ""
        out.append((
            doc, len(a), len(b), len(groups), len(links), sum(count[x, y] == top[x] for x, y, _ in links), sum(count[x, y] for x, y, _ in links),
            sha, sum(len(g) * len(h) for g, h in groups) if None not in groups else None,
        ))
    return out


def same(got, want):
    got = {r[0]: tuple(r) for r in got}
    for row in want:
        mine = got.pop(row[0])
        assert mine[:7] == row[:7]
        if row[8] is not None:
            assert mine[7:] == row[7:]
    assert not got


@needs
def test_query_against_plain_loops(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(QUERIES["op11_cross_tokens"](spark, SF).collect(), brute(docs))


HOSTILE = [
    "", None, " ", "  ", "\n", "a", " a ", "a  b   c\n\n d \n", "\r\n x;\r\n}\r\n\r y\t \tz", "<|endoftext|> <s></s><unk> <0x0A>", "a▁b", "▁", "\x1c a\x1d\x1eb \x1f",
    "é é café Ὀδυσσεύς", "日本語のテキスト、空白なし。" * 5, "🙂👩‍👩‍👧 👍🏽", "　a　 b　", "\xa0x\xa0 y\x85z", "don't I'LL we'd 12345 3.14", "x" * 700, "\x00\x01 \x00",
    "a᠎ b", "a   b ", "tab\tand\x0bvt\x0cff", "ﬁ ﬀ ½ Å", "trailing   ", "\n\n\n", "// code {\r\n    return (x);\r\n}\r\n", "﻿bom", "…" * 30,
]


def test_hostile_texts_and_small_blocks(spark):
    rng = random.Random(4)
    mixed = ["".join(rng.choices("ab \n\t\r é▁.'s1  \x1c　", k=rng.randint(1, 60))) for _ in range(300)]
    docs = list(enumerate([*HOSTILE, *mixed, *mixed[:5], None]))
    frame = spark.createDataFrame([(*d, "", "") for d in docs], "doc_id long, text string, block string, pairs string").repartition(3)
    for block in (50, crosstoken.BLOCK):
        same(crosstoken.link_scores(frame, A, B, block).collect(), brute(docs))


def test_links_and_shared_groups(spark):
    plain, docs = Plain(), [(k, t) for k, t in enumerate(HOSTILE) if t and len(t) < 200]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    overlap, shared = defaultdict(list), defaultdict(list)
    for out, flag in ((overlap, False), (shared, True)):
        for r in crosstoken.links(frame, A, B, flag).collect():
            out[r["doc_id"]].append((r["a_place"], r["b_place"], r["a_id"], r["b_id"], r["weight"]))
    for doc, text in docs:
        a, b, links, groups = plain.aligned(text)
        assert [(x, y, w) for _, _, x, y, w in sorted(overlap[doc])] == links
        want, p, q = [], 0, 0
        for g, h in groups:
            want += [(p + i, q + j, x, y, 1) for i, x in enumerate(g) for j, y in enumerate(h)]
            p, q = p + len(g), q + len(h)
        assert sorted(shared[doc]) == sorted(want)


def test_products_against_dense(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(30):
        x, y = (rng.integers(0, 3, (rng.integers(1, 9), 7)) * (rng.random((1, 7)) < 0.7) for _ in range(2))
        a, b = (crosstoken.Csr(np.concatenate([[0], np.cumsum((m > 0).sum(1))]), np.nonzero(m)[1], m[m > 0], 7) for m in (x, y))

        def dense(m):
            out = np.zeros((m.height, m.width), "i8")
            out[np.repeat(np.arange(m.height), np.diff(m.starts)), m.columns] = m.values
            return out

        assert (dense(a.times(b.transposed())) == x @ y.T).all()
        assert (a.reach(b.transposed()) == ((x > 0).astype(int) @ (y > 0).T.astype(int)).sum(1)).all()
        monkeypatch.setattr(crosstoken, "HELD", 3)
        assert (np.concatenate([dense(p) for _, p in crosstoken.product_slices(a, b.transposed())]) == x @ y.T).all()


def test_odd_rows(spark):
    schema = "doc_id long, text string, block string, pair string"
    assert crosstoken.link_scores(spark.createDataFrame([], schema), A, B).collect() == []
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    rows = [(None, None), (None, "some words"), (1, "some words"), (1, "some words"), (2, long), (3, "z" * 50_000)]
    got = crosstoken.link_scores(spark.createDataFrame([(*r, "", "") for r in rows], schema), A, B).collect()
    assert len(got) == 6
    some = [r for r in got if r["n_a"] == 2]
    assert len(some) == 3 and all(r["count_sum"] == 3 * r["n_links"] and r["n_best"] == r["n_links"] for r in some)
    assert {r["doc_id"] for r in got if r["n_a"] > 10_000} == {2} or any(r["doc_id"] == 3 and r["n_groups"] > 0 for r in got)
