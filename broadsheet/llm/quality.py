"""Quality rules as a bitmask ledger.

`measure` takes every measurement of a text once. `ledger` evaluates every
rule once over the measurements and stores the outcome as bits. Policies are
versioned masks over those bits, applied later and as often as wanted without
reading a text again; `ablations` says what each rule of a policy removes, in
total and alone, by bit tests over the counts per bit pattern.

Null and empty texts measure as zero words and fail the first rule. Repeated
rows are judged each. Extra columns, whatever their names, are ignored.
Only DataFrame functions are used; a row's arrays are bounded by its text.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.llm.common import SPACE, let, words_of

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, SQL over the measurements, is true."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is kept if none of these rules failed."""

    version: int
    rules: tuple[str, ...]


#: A rule's place is its bit; append, never reorder, so stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines > 0 AND 2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
)
BASE = Policy(1, ("few_words", "repeated_windows"))
STANDARD = Policy(2, ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "few_letters"))


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {rule.name: 1 << k for k, rule in enumerate(rules)}
    return sum(bits[name] for name in set(policy.rules))


def _pairs(hashes: Column, apart: int) -> Column:
    """Hash of each element with the one `apart` places on; shorter by `apart`."""
    keep = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), keep), F.slice(hashes, F.lit(apart + 1), keep), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, given all windows in order."""

    def count(found: Column) -> Column:
        # found: (hash, place), sorted; neighbours of equal hash are the repeats
        places = F.sort_array(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size(found) - 1),
                    lambda i: (F.get(found, i - 1)["h"] == found[i]["h"]) | (F.get(found, i + 1)["h"] == found[i]["h"]),
                ),
                lambda i: found[i]["at"],
            )
        )
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), count)
    )


def _repeat_words(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        let(hashes, lambda h: let(_pairs(h, 1), lambda h2: let(_pairs(h2, 2), lambda h4: let(_pairs(h4, 4), _covered))))
    )


def _lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))


def measure(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: its key and every measurement, as long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    dense = docs.select(
        key,
        F.regexp_replace(text, SPACE, "").alias("dense"),
        let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("again"))).alias("w"),
        _lines(text).alias("l"),
    )
    return dense.select(
        key,
        F.col("w.n").cast("long").alias("n_words"),
        F.length("dense").cast("long").alias("word_chars"),
        (F.length("dense") - F.length(F.regexp_replace("dense", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.col("l.again").cast("long").alias("n_dup_lines"),
        F.col("w.again").cast("long").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("dense", r"\P{L}+", "")).cast("long").alias("n_letters"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """The measurements and `fail_bits`, one bit per rule."""
    measured = measure(docs, key)
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledgered: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with `policy` (the version) and `kept`."""
    return ledgered.withColumns(
        {"policy": F.lit(policy.version), "kept": F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules))) == 0}
    )


def ablations(ledgered: DataFrame, policies: tuple[Policy, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents the rule fails, fails alone, and the policy removes.

    Counts per bit pattern come first, so what is shuffled is bounded by the
    number of patterns and not by the number of documents.
    """
    bits = {rule.name: 1 << k for k, rule in enumerate(rules)}
    tested = [
        F.struct(F.lit(p.version).alias("policy"), F.lit(mask(p, rules)).alias("mask"), F.lit(name).alias("rule"), F.lit(bits[name]).alias("bit"))
        for p in policies
        for name in sorted(set(p.rules))
    ]
    patterns = ledgered.groupBy("fail_bits").agg(F.count("*").alias("n"))
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    return (
        patterns.withColumn("t", F.explode(F.array(*tested)))
        .select("fail_bits", "n", "t.*")
        .groupBy("policy", "rule")
        .agg(
            total(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            total(failed == F.col("bit")).alias("n_failed_alone"),
            total(failed != 0).alias("n_removed"),
        )
    )
