"""Resolve curator values to stored articles without comparing every pair.

Values are source urls, site anchors or bare text. Equality and prefix rules
become equi-joins on exploded keys. "Is contained in" becomes an equi-join on
character grams, verified on the full text: a value is keyed by one gram of
2^k characters, the largest power of two that fits, and an article emits the
grams of exactly those lengths that occur among the values.
"""

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions.keys import host_of, removal_key
from broadsheet.functions.sieve import sieve
from broadsheet.functions.text import SLUG_LIMIT, once, slug
from broadsheet.session import materialise

GRAM_LENGTHS = [2**k for k in range(7)]
IS_URL = r"^(?i:https?)://"


def classify_values(values: DataFrame, site_host: str) -> DataFrame:
    """Distinct values with their kind (source, anchor, bare) and search keys."""
    fragment = F.when(
        F.col("value").contains("#"), F.regexp_extract("value", "#(.*)$", 1)
    ).otherwise("")
    is_url = F.col("value").rlike(IS_URL)
    return (
        values.select("value")
        .filter("value is not null and trim(value) <> ''")
        .distinct()
        .withColumn(
            "kind",
            F.when(is_url & host_of("value").eqNullSafe(F.lit(site_host.lower())), "anchor")
            .when(is_url, "source")
            .otherwise("bare"),
        )
        .withColumn("fragment", F.when(F.col("kind") == "anchor", fragment))
        .withColumn(
            "needle",
            F.when(F.col("kind") == "source", removal_key("value"))
            .when(F.col("kind") == "bare", F.lower("value")),
        )
    )


def _gram_length(text: Column) -> Column:
    size = F.length(text)
    length = F.lit(1)
    for n in GRAM_LENGTHS:
        length = F.when(size >= n, F.lit(n)).otherwise(length)
    return length


def _grams(text: Column, n: int) -> Column:
    """Overlapping grams of one length, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _rarest_gram(needles: DataFrame) -> DataFrame:
    """Key each needle by the gram of its length class that fewest needles hold.

    Values often share long endings (tracking parameters); a shared gram as
    key would meet every article that has it once per value.
    """
    own = F.lit(None)
    for n in GRAM_LENGTHS:
        own = F.when(F.col("n") == n, F.array_distinct(_grams(F.col("needle"), n))).otherwise(own)
    grams = needles.select("value", "needle", _gram_length(F.col("needle")).alias("n")).select(
        "value", "needle", "n", F.explode(own).alias("gram")
    )
    spread = grams.groupBy("n", "gram").agg(F.count("*").alias("holders"))
    return (
        grams.join(spread, ["n", "gram"])
        .groupBy("value", "needle", "n")
        .agg(F.min(F.struct("holders", "gram")).alias("best"))
        .select("value", "needle", "n", "best.gram")
    )


def _contained(needles: DataFrame, articles: DataFrame, text: Column) -> DataFrame:
    """(url, value) where the needle occurs in the article's text.

    An article's grams go on only if the sieve of the needles' grams lets them
    pass, before anything is shuffled; they then meet the needles by a join,
    and the text follows to the candidates only.
    """
    texts = articles.select("url", text.alias("text"))
    keyed = materialise(_rarest_gram(needles), "keyed")
    # At most seven lengths exist, so this collects at most seven numbers.
    lengths = sorted(r.n for r in keyed.select("n").distinct().collect())
    if not lengths:
        return texts.select("url", F.col("url").alias("value")).limit(0)
    grams = F.concat(*[_grams(F.col("text"), n) for n in lengths])
    # Few grams pass the sieve, so repeats of one are cheaper to drop behind it.
    met = sieve(texts.select("url", F.explode(grams).alias("gram")), "gram", keyed.select("gram")).distinct()
    # A gram's length is that of its needle's class, so the gram alone is the key.
    candidates = met.join(keyed.select("value", "needle", "gram"), "gram").join(texts, "url")
    return candidates.filter(F.contains(F.col("text"), F.col("needle"))).select("url", "value")


def _hits(pairs: DataFrame) -> DataFrame:
    """Reduce (url, value) to the distinct urls and the distinct values hit.

    Pairs are folded before any shuffle; they are never kept or sent as pairs.
    """
    return pairs.select(F.expr("stack(2, 'url', url, 'value', value) as (side, key)")).distinct()


def resolve_values(values: DataFrame, articles: DataFrame, site_host: str) -> DataFrame:
    """One row per outcome: (outcome, key).

    matched     url of an article named by some value
    preemptive  key of a source url that no article matches: block it anyway
    warning     anchor without fragment, or bare text, that led to nothing

    A source url matches equal urls; only if there is none, urls containing
    it. An anchor matches a slug equal to its fragment or followed in it by
    '-'. Bare text matches if url, title, source or slug contain it, or if it
    contains the slug.
    """
    kinds = materialise(classify_values(values, site_host), "values")
    source = kinds.filter("kind = 'source'")
    anchor = kinds.filter("kind = 'anchor' and fragment <> ''")
    bare = kinds.filter("kind = 'bare'")

    urls = articles.select("url", F.rtrim(F.col("url"), F.lit("/")).alias("needle"))
    exact = urls.join(source.select("needle").distinct(), "needle", "left_semi")
    exact = materialise(exact, "exact")
    unmatched = source.join(exact.select("needle").distinct(), "needle", "left_anti")
    by_part = _hits(_contained(unmatched, articles, F.lower("url")))

    slugged = articles.select("url", slug("title", "url").alias("slug"))
    # Every prefix of the fragment that ends before a '-', and the fragment itself,
    # as far as a slug is long.
    cuts = F.filter(
        F.sequence(F.lit(1), F.least(F.lit(SLUG_LIMIT), F.length("fragment"))),
        lambda i: (i == F.length("fragment")) | (F.substr("fragment", i + 1, F.lit(1)) == "-"),
    )
    prefixes = anchor.select(
        F.explode(F.transform(cuts, lambda i: F.left(F.col("fragment"), i))).alias("slug")
    ).distinct()
    by_anchor = slugged.join(prefixes, "slug", "left_semi").select("url")

    # The four searched texts are separated by a character no value contains.
    gap = F.lit("\x00")
    haystack = F.concat(
        F.lower("url"), gap, F.lower(F.coalesce("title", F.lit(""))), gap,
        F.lower(F.coalesce("source", F.lit(""))), gap, slug("title", "url"),
    )
    by_text = _contained(bare, articles, haystack)
    # Slugs inside the value: the value's own substrings, within runs of slug characters.
    runs = bare.select("value", F.explode(F.regexp_extract_all("needle", F.lit("[a-z0-9-]+"), F.lit(0))).alias("run"))
    pieces = (
        runs.select("value", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
        .select(
            "value", "run", "at",
            F.explode(
                F.sequence(F.lit(1), F.least(F.lit(SLUG_LIMIT), F.length("run") - F.col("at") + 1))
            ).alias("n"),
        )
        .select("value", F.expr("substr(run, at, n)").alias("slug"))
        .distinct()
    )
    # Two semi-joins: a slug shared by many articles and many values makes no pairs.
    slug_urls = slugged.join(pieces.select("slug").distinct(), "slug", "left_semi")
    slug_values = pieces.join(slugged.select("slug").distinct(), "slug", "left_semi")
    by_bare = (
        _hits(by_text)
        .unionByName(slug_urls.select(F.lit("url").alias("side"), F.col("url").alias("key")))
        .unionByName(slug_values.select(F.lit("value").alias("side"), F.col("value").alias("key")))
    )

    hits = materialise(
        by_part.withColumn("leg", F.lit("source")).unionByName(by_bare.withColumn("leg", F.lit("bare"))),
        "hits",
    )
    matched = (
        exact.select("url")
        .unionByName(by_anchor)
        .unionByName(hits.filter("side = 'url'").select(F.col("key").alias("url")))
        .distinct()
    )
    hit_values = hits.filter("side = 'value'").select(F.col("key").alias("value"), "leg")
    preemptive = unmatched.join(
        hit_values.filter("leg = 'source'"), "value", "left_anti"
    ).select("needle").distinct()
    silent = bare.join(hit_values.filter("leg = 'bare'"), "value", "left_anti").select("value")
    warnings = silent.unionByName(kinds.filter("kind = 'anchor' and fragment = ''").select("value"))

    def outcome(df: DataFrame, label: str) -> DataFrame:
        return df.select(F.lit(label).alias("outcome"), F.col(df.columns[0]).alias("key"))

    return (
        outcome(matched, "matched")
        .unionByName(outcome(preemptive, "preemptive"))
        .unionByName(outcome(warnings, "warning"))
    )


def removal_set(resolved: DataFrame) -> DataFrame:
    """Urls to remove and block: matched articles and pre-emptive keys."""
    return (
        resolved.filter("outcome in ('matched', 'preemptive')")
        .select(F.col("key").alias("url"))
        .distinct()
    )
