"""Reading markup that is not well formed: entities, character data, tags and their attributes, embedded JSON.

Everything is column expressions. Tags are read left to right with quoted
values taken whole, so a `>` or another attribute's name inside a value
ends nothing. A quote that is never closed spoils its own tag alone.
"""

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from broadsheet.functions.text import once

#: Inside a tag: runs without quotes, and quoted values.
INSIDE = r"""(?:[^"'<>]+|"[^"]*"|'[^']*')*+"""
_ATTRIBUTE = r"""[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+)"""
_PIECES = r"(?s)&(?:#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});|[^&]+|&"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named_entities() -> dict[str, str]:
    """Entity names and their characters: those of HTML 4, and the one that XML adds."""
    return {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def decode_entities(c) -> Column:
    """Named and numbered entities as their characters, each once; what names no character stays as it is."""
    # One literal that the optimizer turns into a map, where a map of literals would be hundreds of nodes per use.
    table = F.str_to_map(F.lit("\x02".join(f"{name}\x01{char}" for name, char in named_entities().items())), F.lit("\x02"), F.lit("\x01"))

    def one(piece: Column) -> Column:
        base16 = F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        base10 = F.regexp_extract(piece, "^&#([0-9]{1,7});$", 1)
        code = F.when(base16 != "", F.conv(base16, 16, 10).cast("int")).when(base10 != "", base10.try_cast("int"))
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        numbered = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        named = F.try_element_at(table, F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*);$", 1))
        return F.when(F.startswith(piece, F.lit("&")), F.coalesce(numbered, named, piece)).otherwise(piece)

    c = _col(c)
    pieces = F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def _literal(c: Column) -> Column:
    """Text that markup reads as itself."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def without_sections(c) -> Column:
    """The document with CDATA sections as escaped text and without comments; a section that is not closed runs to the end."""

    def section(piece: Column) -> Column:
        at = F.locate("]]>", piece)
        inner = F.when(at > 0, F.substring(piece, F.lit(1), at - 1)).otherwise(piece)
        rest = F.when(at > 0, F.substring(piece, at + 3, F.length(piece))).otherwise("")
        return F.concat(_literal(inner), rest)

    def joined(pieces: Column) -> Column:
        after = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), section)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(after, ""))

    plain = once(F.split(_col(c), r"<!\[CDATA\["), joined)
    return F.regexp_replace(plain, r"(?s)<!--.*?-->", "")


def tags(c, name: str) -> Column:
    """The insides of all start tags of a name (a pattern), in order."""
    return F.regexp_extract_all(_col(c), F.lit(rf"(?is)<{name}(?=[\s/>])({INSIDE})>"), F.lit(1))


def attributes(inside: Column) -> Column:
    """A tag's inside as array<struct<name, value>>: names in lower case, values without quotes and entities."""

    def one(text: Column) -> Column:
        raw = F.regexp_replace(text, r"(?s)^[^=]*=\s*", "")
        quoted = F.left(raw, F.lit(1)).isin('"', "'")
        value = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.struct(F.lower(F.regexp_extract(text, r"^[^\s=]+", 0)).alias("name"), decode_entities(value).alias("value"))

    return F.transform(F.regexp_extract_all(inside, F.lit(rf"(?s){_ATTRIBUTE}"), F.lit(0)), one)


def attribute(given: Column, name: str) -> Column:
    """The value of the first attribute of a name, from `attributes`; null without one."""
    return F.get(F.filter(given, lambda a: a["name"] == name), F.lit(0))["value"]


def elements(c, name: str) -> Column:
    """The insides of all closed elements of a name (a pattern), in order; elements do not nest in their like."""
    return F.regexp_extract_all(_col(c), F.lit(rf"(?is)<{name}(?=[\s/>]){INSIDE}(?<!/)>(.*?)</{name}\s*>"), F.lit(1))


def element(c, name: str) -> Column:
    """The inside of the first closed element of a name, null without one."""
    return F.get(elements(c, name), F.lit(0))
