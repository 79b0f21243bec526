"""Text expressions used when publishing and parsing."""

from pyspark.sql import Column, functions as F

SLUG_LIMIT = 60


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """Evaluate `value` once and hand it to a lambda.

    A column used inside a higher-order lambda would otherwise be recomputed
    for every element after projections are merged.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_ws(c) -> Column:
    """Remove all white space at both ends, tabs and line ends included."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def slug(title, url) -> Column:
    """Anchor-safe slug of a title; a short url hash where the title has no letters."""
    words = F.regexp_replace(F.lower(F.coalesce(_col(title), F.lit(""))), "[^a-z0-9]+", "-")
    base = F.btrim(words, F.lit("-"))

    def finish(base: Column) -> Column:
        cut = F.regexp_replace(F.left(base, F.lit(SLUG_LIMIT)), "-[^-]*$", "")
        hashed = F.left(F.sha1(F.coalesce(_col(url), F.lit(""))), F.lit(8))
        return F.when(base == "", hashed).when(F.length(base) > SLUG_LIMIT, cut).otherwise(base)

    return once(base, finish)


def html_escape(c) -> Column:
    """Escape the five characters that are special in HTML text and attributes."""
    out = _col(c)
    # Character and entity, the ampersand first.
    for char, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    ):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def script_safe(c) -> Column:
    """Keep JSON from closing the script element it is embedded in."""
    return F.replace(_col(c), F.lit("</"), F.lit("<\\/"))


def contains_any(c, terms) -> Column:
    """True where the text contains one of the terms (a short configured list)."""
    terms = clean_terms(terms)
    hit = F.lit(False)
    for term in terms:
        hit = hit | _col(c).contains(term)
    return hit


def clean_terms(terms) -> list[str]:
    """Lowercase and trim configured terms; a blank term would match every row."""
    if isinstance(terms, str):
        terms = terms.split(",")
    return list(dict.fromkeys(t.strip().lower() for t in terms or () if t.strip()))
