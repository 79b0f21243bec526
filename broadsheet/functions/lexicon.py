"""Tiered keyword lexicons and the expressions that match them.

A lexicon is a list of (keyword, weight) or (keyword, weight, tier); without a
tier, a weight is a tier of its own. It is configuration: driver-side constants
that fold into the plan. A lexicon held as a table is scored by
operators.relevance.score_by_table, with the same result.
"""

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Keywords and tier weights of the default topic.
PRIMARY_WEIGHT = 3.0
PRIMARY = (
    "trump", "donald", "maga", "presidency", "president", "administration",
    "white house", "republican", "gop", "election", "campaign", "rally",
    "rallies", "impeachment", "january 6", "mar-a-lago", "truth social",
)
SECONDARY_WEIGHT = 2.0
SECONDARY = (
    "biden", "harris", "pence", "desantis", "musk", "endorsement",
    "endorsements", "primary", "primaries", "convention", "debate", "debates",
    "transition", "appointment", "appointments", "nominee", "candidates",
    "nomination",
)
POLICY_WEIGHT = 1.0
POLICY = (
    "immigration", "border", "wall", "mexico", "china", "trade", "tariffs",
    "supreme court", "judges", "foreign policy", "iran", "israel", "covid-19",
    "pandemic", "tax", "taxes", "classified documents", "indictment",
    "investigation", "fraud", "conviction", "lawsuit", "legal", "georgia",
    "new york", "florida",
)

Lexicon = list[tuple]

DEFAULT_LEXICON: Lexicon = [
    *((k, PRIMARY_WEIGHT) for k in PRIMARY),
    *((k, SECONDARY_WEIGHT) for k in SECONDARY),
    *((k, POLICY_WEIGHT) for k in POLICY),
]

WORD = r"\p{L}\p{N}_"


def keyword_pattern(keyword: str) -> str:
    """Whole-word pattern; letters of every script count as word characters."""
    literal = re.sub(r"([^\w\s])", r"\\\1", keyword.lower())
    return f"(^|[^{WORD}]){literal}($|[^{WORD}])"


def has_word(keyword: str) -> bool:
    """Whether a keyword has a word character; one without is in no text as a whole word."""
    return re.search(r"\w", keyword) is not None


def is_single_word(keyword: str) -> bool:
    return re.fullmatch(r"\w+", keyword) is not None


def topic_text() -> Column:
    """Lowercased title, description, source and author, joined by spaces."""
    fields = ("title", "description", "source", "author")
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))


def listed(keywords: Iterable[str]) -> list[str]:
    """Lowercased keywords that can be in a text, each once."""
    return list(dict.fromkeys(k.lower() for k in keywords if has_word(k)))


def guard(keyword: str) -> str | None:
    """The longest word of a keyword: a text that has the keyword as a whole has this word.

    None where no character is plainly a letter, a number or an underscore.
    """
    marked = "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in keyword)
    return max(marked.split(), key=len, default=None)


def listed_words(text: Column, keywords: list[str]) -> Column:
    """Those words of a lowercased text that are keywords or guards of one.

    The text is cut into words once and intersected with the list, so the cost
    does not grow with the lexicon.
    """
    wanted = dict.fromkeys(k if is_single_word(k) else guard(k) for k in keywords)
    wanted.pop(None, None)
    if not wanted:
        return F.array().cast("array<string>")
    return F.array_intersect(F.split(text, f"[^{WORD}]+"), F.array(*[F.lit(w) for w in wanted]))


def matched_keywords(text: Column, words: Column, keywords: list[str]) -> Column:
    """Distinct keywords present in a lowercased text, whose listed words are given.

    Phrases and hyphenated keywords: the text is searched only if it has the
    guard, by a plain substring test before the regular expression.
    """
    single = [k for k in keywords if is_single_word(k)]
    other = [k for k in keywords if not is_single_word(k)]
    found = F.array().cast("array<string>")
    if single:
        found = F.array_intersect(words, F.array(*[F.lit(k) for k in single]))
    if other:
        def present(keyword: str) -> Column:
            inside = text.contains(keyword) & text.rlike(keyword_pattern(keyword))
            word = guard(keyword)
            return inside if word is None else F.array_contains(words, word) & inside

        hits = [F.when(present(k), F.lit(k)) for k in other]
        found = F.concat(found, F.array_compact(F.array(*hits)))
    return found


def weight_sum(matched: Column, lexicon: Lexicon) -> Column:
    """Sum of weights of the matched keywords; one that stands in two tiers counts in both."""
    entries = {(k.lower(), float(w), *(tier or [str(float(w))])) for k, w, *tier in lexicon}
    weights: dict[str, float] = {}
    for keyword, weight, _ in sorted(entries):
        weights[keyword] = weights.get(keyword, 0.0) + weight
    by_weight: dict[float, list[str]] = {}
    for keyword, weight in weights.items():
        by_weight.setdefault(weight, []).append(keyword)
    total = F.lit(0.0)
    for weight, keywords in by_weight.items():
        tier = F.array(*[F.lit(k) for k in keywords])
        total = total + F.size(F.array_intersect(matched, tier)) * F.lit(weight)
    return total
