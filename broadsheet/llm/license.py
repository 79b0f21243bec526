"""Licence scans by sentence rules.

A text is cut into sentences (at line ends and after closing punctuation), and
each is normalised: lower case, letters and digits only, one space between
words. A normalised sentence that matches a known licence sentence becomes
that sentence's identifier; the text becomes its sequence of identifiers.
Licence rules are ordered sequences of identifiers; unknown sentences may
stand between, up to GAP of them, since headers are broken by comments and
addresses. Rules are tried in order at each place, the longest first, and what
one has taken no other takes; known sentences no rule takes are reported too.

Null and empty texts have no licence. Very long texts cost in proportion to
their length; texts without one of the words every known sentence has are
passed over after one search. Repeated rows are scanned each, repeated
licences in a text reported once per place. Extra columns are ignored.
"""

import re
from functools import cache

from pyspark.sql import DataFrame

from broadsheet.llm.common import map_rows

#: Unknown sentences that may stand between two of a rule.
GAP = 6

# Known licence sentences, as patterns over normalised text, tried in this order.
# Each pattern names one of TRIGGERS literally; tests hold them to it.
SENTENCES = [
    ("spdx", r"spdx license identifier (?P<arg>[a-z0-9 ]+?)"),
    ("copyright", r"(?:c )?copyright (?:c )?.*"),
    ("rights-reserved", r"all rights reserved"),
    ("apache-2-header", r"(?:this .{0,60} is )?licensed under the apache license,? version 2(?: 0)?(?: the license)?"),
    ("apache-1-1", r"the apache software license version 1 1"),
    ("apache-use", r"you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at.*"),
    ("apache-as-is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit-name", r"(?:.{0,60} )?(?:released|licensed|distributed|available) under the (?:terms of the )?mit license"),
    ("mit-title", r"(?:the )?mit license(?: mit)?"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("mit-notice", r"the above copyright notice and this permission notice.* shall be included in all copies or substantial portions of the software"),
    ("as-is", r"(?:the|this) software is provided (?:by .{0,80} )?as is.*without warranty.*|(?:the|this) software is provided by .{0,120}as is and any express or implied warranties.*"),
    ("liability", r"in no event shall .* be liable for any .*"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("bsd-name", r"(?:.{0,60} )?(?:released|licensed|distributed|available) under the (?:terms of the )?(?P<arg>2|3|4)? ?(?:clause )?bsd (?:(?:2|3|4) clause )?license"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("bsd-source", r"(?:1 )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r"(?:2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-endorse", r"(?:3 )?neither the name of .* nor the names of .* without specific prior written permission"),
    ("bsd-advert", r"(?:3 )?all advertising materials mentioning features or use of this software must display the following acknowledgement.*copyright.*|(?:3 )?all advertising materials .* this software .* license.*"),
    ("gpl-name", r"(?:.{0,60} )?(?:licensed|released|distributed) under the (?:terms of the )?gnu (?P<arg>lesser |library |affero )?general public license,?(?: as published by the free software foundation)?,?(?: (?:version|v) ?(?P<version>[123](?: [01])?))?"),
    ("gpl-free", r".* is free software you can redistribute it and or modify it under the terms of the gnu (?P<arg>lesser |library |affero )?general public license as published by the free software foundation.*?(?:version (?P<version>[123](?: [01])?).*)?"),
    ("gpl-hope", r".* is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl-copy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license.*"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license v 2 0|(?:.{0,60} )?licensed under the mozilla public license,?(?: version| v)? ?(?P<version>[0-9 ]+)?"),
    ("cc", r"(?:.{0,60} )?(?:licensed|released|available) under (?:the |a )?(?:cc|creative commons)(?: attribution)? ?(?P<arg>by(?: nc)?(?: sa| nd)?|0|zero|noncommercial|sharealike|non commercial|share alike)?(?: license)?(?: (?P<version>[1-4] 0))?(?: international)?(?: license)?"),
    ("public-domain", r".*(?:released|placed|dedicated) (?:in|into|to) the public domain.*|this is free and unencumbered software released into the public domain"),
    ("unlicense", r".*(?:released|licensed) under the unlicense"),
    ("proprietary", r".*proprietary and confidential.*|unauthorized copying .* is strictly prohibited.*|.*may not be (?:copied|reproduced|redistributed) without .*permission.*"),
    ("named-license", r"(?:.{0,60} )?licensed under (?:the )?(?P<arg>.{2,60})"),
]
TRIGGERS = ("licen", "copyright", "reserved", "permission", "liable", "redistribution", "gnu", "warrant", "domain", "proprietary", "unauthorized")
#: Creative Commons is named without any of them.
_COMMONS = re.compile(r"creative[\W_]+commons|under[\W_]+(?:(?:the|a)[\W_]+)?cc", re.IGNORECASE)

# Licence rules, ordered sequences of sentence identifiers; `{arg}` and `{version}` come from the first sentence that has them.
RULES = [
    ("Apache-2.0", ("apache-2-header", "apache-use", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-2-header", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-2-header",)),
    ("Apache-1.1", ("apache-1-1",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "as-is", "liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "as-is", "liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-title",)),
    ("ISC", ("isc-grant", "as-is", "liability")),
    ("ISC", ("isc-grant",)),
    ("GPL", ("gpl-free", "gpl-hope", "gpl-copy")),
    ("GPL", ("gpl-free",)),
    ("GPL", ("gpl-name",)),
    ("MPL", ("mpl",)),
    ("CC", ("cc",)),
    ("BSD", ("bsd-name",)),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public-domain",)),
    ("SPDX", ("spdx",)),
    ("Proprietary", ("proprietary",)),
    ("All-Rights-Reserved", ("copyright", "rights-reserved")),
    ("All-Rights-Reserved", ("rights-reserved",)),
    ("Other", ("named-license",)),
]

_CUT = re.compile(r"\n+|(?<=[.!?:])(?<!dentifier:)\s+")
_NOISE = re.compile(r"[^\w]+|_+")


@cache
def _patterns() -> list[tuple[str, re.Pattern]]:
    return [(name, re.compile(f"(?:{pattern})")) for name, pattern in SENTENCES]


def _telling(text: str) -> bool:
    low = text.lower()
    return any(t in low for t in TRIGGERS) or _COMMONS.search(text) is not None


def normalise(sentence: str) -> str:
    return _NOISE.sub(" ", sentence.lower()).strip()


@cache
def _known(sentence: str) -> tuple[str, str | None, str | None] | None:
    for name, pattern in _patterns():
        match = pattern.fullmatch(sentence)
        if match:
            groups = match.groupdict()
            return name, groups.get("arg"), groups.get("version")
    return None


def identify(sentence: str) -> tuple[str, str | None, str | None] | None:
    """Identifier, argument and version of a known licence sentence."""
    if len(sentence) > 2000:  # matched like the others, but not worth a place in memory
        return _known.__wrapped__(sentence)
    if _known.cache_info().currsize > 100_000:
        _known.cache_clear()
    return _known(sentence)


def _spelled(licence: str, arg: str | None, version: str | None) -> str:
    arg, version = (arg or "").strip(), (version or "").strip().replace(" ", ".")
    if licence == "GPL":
        family = {"lesser": "LGPL", "library": "LGPL", "affero": "AGPL"}.get(arg, "GPL")
        return f"{family}-{version if '.' in version else version + '.0'}" if version else family
    if licence == "CC":
        words = {"0": "0", "zero": "0", "noncommercial": "BY-NC", "non commercial": "BY-NC", "sharealike": "BY-SA", "share alike": "BY-SA"}
        kind = words.get(arg, arg.replace(" ", "-").upper())
        return ("CC0" if kind == "0" else f"CC-{kind}" if kind else "CC") + (f"-{version}" if version else "")
    if licence == "MPL":
        return f"MPL-{version or '2.0'}"
    if licence == "BSD":
        return f"BSD-{arg}-Clause" if arg else "BSD"
    if licence == "SPDX":
        return "SPDX:" + arg.replace(" ", "-")
    if licence == "Other":
        return "Other:" + arg
    return licence


def scan(text: str | None) -> list[dict]:
    """Licences of a text in order: licence, first and last sentence, and the sentence identifiers taken."""
    if not text or not _telling(text):
        return []
    sequence = []  # (sentence number, identifier, argument, version)
    for k, sentence in enumerate(x for x in _CUT.split(text) if x.strip()):
        if _telling(sentence):
            found = identify(normalise(sentence))
            if found:
                sequence.append((k, *found))
    out, taken = [], set()
    for at in range(len(sequence)):
        if at in taken:
            continue
        best: list[int] = []
        licence = ""
        for name, rule in RULES:
            if len(rule) <= len(best) or rule[0] != sequence[at][1]:
                continue
            places = [at]
            for want in rule[1:]:
                nxt = next(
                    (j for j in range(places[-1] + 1, len(sequence)) if j not in taken and sequence[j][1] == want and sequence[j][0] - sequence[places[-1]][0] <= GAP + 1),
                    None,
                )
                if nxt is None:
                    break
                places.append(nxt)
            if len(places) == len(rule):
                best, licence = places, name
        if best:
            taken.update(best)
            chosen = [sequence[j] for j in best]
            arg = next((c[2] for c in chosen if c[2]), None)
            version = next((c[3] for c in chosen if c[3]), None)
            out.append({"licence": _spelled(licence, arg, version), "first": chosen[0][0], "last": chosen[-1][0], "sentences": [c[1] for c in chosen]})
        else:
            out.append({"licence": None, "first": sequence[at][0], "last": sequence[at][0], "sentences": [sequence[at][1]]})
    return out


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, licences (distinct, sorted) and matches for every document; matches without a licence are known sentences alone."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def work(rows):
        for row in rows:
            found = scan(row["text"])
            yield {"doc_id": row["doc_id"], "licences": sorted({m["licence"] for m in found if m["licence"]}), "matches": found}

    kind = "array<struct<licence:string,first:int,last:int,sentences:array<string>>>"
    return map_rows(docs.select("doc_id", "text"), work, f"doc_id {key}, licences array<string>, matches {kind}")
