"""Language identification by mixture inference.

A text is taken as drawn from several languages at once: each of its n-grams
comes from language l with probability share(l) * p(n-gram | l).
Expectation-maximisation finds the shares. Then languages are dropped, the
least share first, as long as the penalised likelihood (BIC: half a log of
the number of n-grams per language) does not get worse. The prediction is the
language with the largest share; its share is the score.

The model is the n-gram counts of all training texts, added up by Spark; what
comes to the driver and is broadcast is at most BUCKETS counts per language,
however many texts there are. n-grams are hashed to BUCKETS classes by a
fixed rule, and are taken from whole texts in slices of bounded size.

Null texts and texts without a letter are `und` with score 0; so is every
text if nothing was learned. Null languages are not learned from. Repeated
rows count each; extra columns are ignored. Equal shares go to the language
that sorts first.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.llm.common import map_batches, map_rows

BUCKETS = 1 << 15
ROUNDS = 12
#: Code points of a text handled at once; a longer text is counted slice by slice.
SLICE = 1 << 20
UNKNOWN = "und"

_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Per code point: 0 for anything but a letter, else its lower case."""
    global _FOLD
    if _FOLD is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low[0])
        _FOLD = table
    return _FOLD


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-grams of letters, words padded by a gap, and their counts."""
    total = None
    for at in range(0, len(text), SLICE):
        part = " " + text[max(0, at - 2) : at + SLICE] + " "
        x = _fold()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        a, b, c = x[:-2], x[1:-1], x[2:]
        codes = ((a * np.uint32(0x9E3779B1) + b) * np.uint32(0x85EBCA77) + c) * np.uint32(0xC2B2AE3D) >> np.uint32(17)
        counts = np.bincount(codes[b != 0], minlength=BUCKETS)
        total = counts if total is None else total + counts
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = np.flatnonzero(total)
    return found, total[found]


def held_out(key: Column) -> Column:
    """Rows no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log p(n-gram | language), n-grams by languages, from every row with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                found, n = grams(text)
                sums[lang][found] += n
        for lang, total in sums.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(total[found], pa.int64())],
                ["lang", "gram", "n"],
            )

    known = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = map_batches(known, count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((len(names), BUCKETS))
    place = {name: k for k, name in enumerate(names)}
    rows = np.array([place[x] for x in counts.column("lang").to_pylist()], np.int64)
    table[rows, counts.column("gram").to_numpy()] = counts.column("n").to_numpy()
    # A little of the pooled counts keeps unseen n-grams possible.
    pooled = table.sum(0) + 0.01
    table += pooled / pooled.sum() * 0.02 * (table.sum(1, keepdims=True) + 1)
    return names, np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32)


def _shares(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """EM over p (n-grams by languages) from a start; the shares and the log likelihood they reach."""
    total = n.sum()
    for _ in range(ROUNDS if len(share) > 1 else 0):
        new = share * ((n / (p @ share)) @ p) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    return share, float(n @ np.log(p @ share))


def infer(text: str, logp: np.ndarray) -> np.ndarray | None:
    """Shares by language, 0 for those not in the chosen set; None for no letter."""
    found, n = grams(text)
    if not len(found) or not logp.shape[1]:
        return None
    part = logp[found].astype(np.float64)
    p = np.exp(part - part.max(1, keepdims=True)) + 1e-300
    n = n.astype(np.float64)
    chosen = np.arange(p.shape[1])
    alone = n @ part
    share, reached = _shares(p, n, np.full(len(chosen), 1 / len(chosen)))
    penalty = 0.5 * np.log(n.sum() + 1)
    best = int(np.argmax(alone))
    out = np.zeros(p.shape[1])
    if reached - float(n @ np.log(p[:, best])) <= penalty:  # no set gains enough over one language
        out[best] = 1.0
        return out
    while len(chosen) > 1:
        keep = np.arange(len(chosen)) != np.argmin(share)
        start = share[keep] + 1e-9
        fewer, worse = _shares(p[:, chosen[keep]], n, start / start.sum())
        if reached - worse > penalty:
            break
        chosen, share, reached = chosen[keep], fewer, worse
    out[chosen] = share
    return out


def identify(docs: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score and `langs`: the chosen set with its shares."""
    model = docs.sparkSession.sparkContext.broadcast((names, logp))

    def work(rows):
        names, logp = model.value
        for row in rows:
            text = row["text"]
            share = infer(text, logp) if text else None
            if share is None:
                yield {"doc_id": row["doc_id"], "lang_pred": UNKNOWN, "score": 0.0, "langs": []}
                continue
            best = int(np.argmax(share))
            chosen = [{"lang": names[k], "share": float(share[k])} for k in np.argsort(-share, kind="stable") if share[k] > 0]
            yield {"doc_id": row["doc_id"], "lang_pred": names[best], "score": min(1.0, float(share[best])), "langs": chosen}

    key = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(
        docs.select("doc_id", "text"), work,
        f"doc_id {key}, lang_pred string, score double, langs array<struct<lang:string,share:double>>",
    )
