"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and read as words of letters, digits and all beyond ASCII, joined by single spaces.  Rules are
regexes over those words, written per license and per way of naming it: its SPDX tag, its full name, its name in a grant,
its link, its conditions.  Each rule names a keyword that any match contains; one pass of an Aho-Corasick automaton over
the text finds which keywords occur, and only their rules run.  Matches that lie within a match of a rule of higher or
equal priority are dropped (of equal intervals the higher priority stays, then the earlier rule), so that a version's own
rule hides the general name within it, and an exception hides the license that it modifies.

Base places (``PHRASES``) are reported as they are, whatever the rules suppress.

Null counts as empty.  An empty text has no places, no labels and score 0.  Rows are scanned one by one, so ties,
repeated rows and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: Bytes that belong to words: digits, a-z and all beyond ASCII.
_SEPARATORS = bytes(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))

#: label | keyword | version forms (after "version" or "v") | name as a regex over words.
FAMILIES = """
mit|mit||mit
mit-0|mit||mit (?:no attribution|0)
apache|apache|1 0;1 1;2 0|apache
gpl|general public|1;2;3|(?:gnu )?general public
lgpl|lesser|2;2 1;3|(?:gnu )?lesser general public
lgpl|library general|2;2 1;3|(?:gnu )?library general public
agpl|affero|1;3|(?:gnu )?affero general public
fdl|documentation|1 1;1 2;1 3|(?:gnu )?free documentation
mpl|mozilla|1 0;1 1;2 0|mozilla public
epl|eclipse|1 0;2 0|eclipse public
edl|eclipse|1 0|eclipse distribution
cddl|common development|1 0;1 1|common development and distribution
cpl|common public|1 0|common public
cpal|attribution|1 0|common public attribution
eupl|european|1 0;1 1;1 2|european union public
osl|open software|1 0;2 0;2 1;3 0|open software
afl|academic|1 1;2 0;2 1;3 0|academic free
artistic|artistic|1 0;2 0|artistic
bsl|boost|1 0|boost software
busl|business|1 0;1 1|business source
sspl|server side|1|server side public
bsd|bsd||bsd
bsd-2-clause|bsd||(?:(?:simplified|freebsd) bsd|bsd 2 clause|2 clause bsd|two clause bsd)
bsd-3-clause|bsd||(?:(?:new|revised|modified) bsd|bsd 3 clause|3 clause bsd|three clause bsd)
bsd-4-clause|bsd||(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)
isc|isc||isc
zlib|zlib||zlib(?: libpng)?
unlicense|unlicense||unlicense
wtfpl|what the|1;2|do what the \\w+ you want to public
ofl|open font|1 0;1 1|(?:sil )?open font
psf|python|2|python software foundation
python|python|2 0|python
php|php|3 0;3 01|php
ruby|ruby||ruby
postgresql|postgresql||postgresql
openssl|openssl||openssl
ncsa|illinois||university of illinois(?: ncsa)?(?: open source)?
upl|universal permissive|1 0|universal permissive
ms-pl|microsoft||microsoft public
ms-rl|microsoft||microsoft reciprocal
apsl|apple|1 0;1 1;2 0|apple public source
qpl|q public|1 0|q public
zpl|zope|1 1;2 0;2 1|zope public
w3c|w3c||w3c(?: software)?(?: notice and)?
odbl|open database|1 0|open database
odc-by|open data|1 0|open data commons attribution
pddl|public domain|1 0|public domain dedication and
vim|vim||vim
xfree86|xfree86|1 0;1 1|xfree86
x11|x11||x11
curl|curl||curl
icu|icu||icu
ecl|educational|1 0;2 0|educational community
cecill|cecill|1 0;2 0;2 1|cecill(?: free software)?
mulan|mulan|1;2|mulan (?:psl|permissive software)
"""

#: label | words after "cc" | regex of the words after "creative commons".
COMMONS = """
cc-by|by|attribution
cc-by-sa|by sa|attribution share ?alike
cc-by-nd|by nd|attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-nc|by nc|attribution non ?commercial
cc-by-nc-sa|by nc sa|attribution non ?commercial share ?alike
cc-by-nc-nd|by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc0|0|zero
"""
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: priority | label | keyword | regex: texts of licenses, and rights without one.
CLAUSES = r"""
70|mit|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy
60|mit|without restriction|deal in the software without restriction
60|isc|permission to use|permission to use copy modify and or distribute this software for any purpose
70|bsd|redistribution and use|redistribution and use in source and binary forms with or without modification are permitted
60|bsd-3-clause|neither the name|neither the names? of (?:\w+ ){1,12}nor the names? of
60|bsd-4-clause|all advertising materials|all advertising materials mentioning features or use of this software
70|apache|you may not use this file|you may not use this file except in compliance with the license
65|gpl|redistribute it|you can redistribute it and or modify it under the terms of the gnu general public license
65|lgpl|redistribute it|you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
65|agpl|redistribute it|you can redistribute it and or modify it under the terms of the gnu affero general public license
70|gpl-exception|exception|general public license(?: \w+){0,6} with (?:the )?(?:classpath|linking|runtime library|autoconf|bison|font) exception
70|apache-llvm-exception|llvm exception|apache license(?: \w+){0,4} with llvm exceptions?
65|mpl|source code form|this source code form is subject to the terms of the mozilla public license
65|bsl|boost software|distributed under the boost software license
65|unlicense|free and unencumbered|this is free and unencumbered software released into the public domain
60|zlib|altered source versions|altered source versions must be plainly marked as such
60|wtfpl|do what the|you just do what the \w+ you want to
50|public-domain|public domain|(?:in|into|to) the public domain
40|all-rights-reserved|all rights reserved|all rights reserved
30|copyright|copyright|copyright (?:c )?(?:19|20)\d\d
45|commercial|commercial license|(?:a|the|your|valid) commercial license
40|proprietary|proprietary|(?:proprietary and confidential|confidential and proprietary)
40|non-commercial|non commercial|for non commercial use only
40|research-only|research purposes|for (?:academic |non commercial )?research purposes only
40|no-redistribution|redistribut|(?:redistribution is|may not be redistributed|no redistribution)
"""

#: Priority -> score: what a rule of that priority says on its own.
TOP = 100


@dataclass(frozen=True)
class Rule:
    place: int
    priority: int
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]


def _lines(table: str, columns: int) -> list[list[str]]:
    """Rows of a table above; the last column is a regex and may have bars."""
    return [line.split("|", columns - 1) for line in table.strip().splitlines()]


def build_rules() -> list[Rule]:
    """All rules in order; several per license and version."""
    found: list[tuple[int, str, str, str]] = []
    for label, keyword, versions, name in _lines(FAMILIES, 4):
        tag = label.replace("-", " ")
        found.append((100, label, "spdx license", rf"spdx license identifier {tag}(?: \d+)*(?: only| or later)?"))
        for version in filter(None, versions.split(";")):
            dotted = f"{label}-{version.replace(' ', '.')}"
            found.append((95, dotted, keyword, rf"{name} license (?:as published by the free software foundation )?(?:either )?(?:version |v){version}(?: 0)?(?: or (?:any )?later(?: version)?)?"))
            found.append((95, dotted, keyword, rf"{name} {version} license"))
            found.append((90, dotted, tag.split()[0], rf"(?:licensed|released|distributed|available) under (?:the )?{tag} ?v?{version}"))
        found.append((85, label, keyword, rf"(?:licensed|released|distributed|available|published|covered) (?:\w+ ){{0,2}}(?:under|by) (?:the )?(?:terms of )?(?:the )?{name} license"))
        found.append((80, label, keyword, rf"{name} license"))
        found.append((75, label, "opensource org", rf"opensource org licenses? {tag}"))
        found.append((75, label, tag.split()[0], rf"license {tag}(?: license)?\b"))
    for label, short, words in _lines(COMMONS, 3):
        for version in COMMONS_VERSIONS:
            dotted = f"{label}-{version.replace(' ', '.')}"
            found.append((95, dotted, "creative commons", rf"creative commons (?:license )?{words}(?: license)? {version}(?: international| unported)?(?: license)?"))
            found.append((90, dotted, "cc", rf"cc ?{short} {version}"))
        found.append((85, label, "creative commons", rf"creative commons (?:license )?{words}"))
        found.append((85, label, "creativecommons", rf"creativecommons org (?:licenses|publicdomain) {short}"))
        found.append((80, label, "cc", rf"cc ?{short}"))
        found.append((100, label, "spdx license", rf"spdx license identifier cc {short}(?: \d+)*"))
    found += [(int(priority), label, keyword, pattern) for priority, label, keyword, pattern in _lines(CLAUSES, 4)]
    return [
        Rule(i, p, label, keyword.encode(), re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])"))
        for i, (p, label, keyword, pattern) in enumerate(found)
    ]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_TO_SPACE).split()


def suppress(matches: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Matches (start, end, rule) that lie in no match of higher or equal priority."""
    ranked = sorted(matches, key=lambda m: (-m[2].priority, -(m[1] - m[0]), m[2].place, m[0]))
    kept: list[tuple[int, int, Rule]] = []
    reach: list[tuple[int, int]] = []  # kept intervals, none within another, by start and so by end
    for start, end, rule in ranked:
        at = _last_at(reach, start)
        if at >= 0 and reach[at][1] >= end:
            continue
        kept.append((start, end, rule))
        first = at if at >= 0 and reach[at][0] == start else at + 1
        last = first
        while last < len(reach) and reach[last][1] <= end:
            last += 1
        reach[first:last] = [(start, end)]
    return kept


def _last_at(reach: list[tuple[int, int]], start: int) -> int:
    low, high = 0, len(reach)
    while low < high:
        middle = (low + high) // 2
        if reach[middle][0] <= start:
            low = middle + 1
        else:
            high = middle
    return low - 1


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        self.rules = build_rules() if rules is None else rules
        self.by_keyword: dict[bytes, list[Rule]] = {}
        for rule in self.rules:
            self.by_keyword.setdefault(rule.keyword, []).append(rule)
        self.keywords = ahocorasick.Automaton()
        for keyword in [*self.by_keyword, *PHRASES]:
            self.keywords.add_word(keyword.decode(), keyword)
        self.keywords.make_automaton()

    def matches(self, joined: bytes) -> list[tuple[int, int, Rule]]:
        """All rules' matches before suppression, as byte intervals of ``joined``."""
        there = {k for _, k in self.keywords.iter(joined.decode())}
        active = (rule for keyword, rules in self.by_keyword.items() if keyword in there for rule in rules)
        return [(m.start(), m.end(), rule) for rule in active for m in rule.pattern.finditer(joined)]

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        joined = b" ".join(words)
        kept = suppress(self.matches(joined))
        starts, base = [], set()
        padded = b" " + joined + b" "
        for phrase, label in PHRASES.items():
            needle = b" " + phrase + b" "
            at = padded.find(needle)
            while at >= 0:
                starts.append(at)
                base.add(label)
                at = padded.find(needle, at + 1)
        starts.sort()
        index = [0] * len(starts)
        at = seen = 0
        for i, start in enumerate(starts):  # words before a place are the spaces before it
            seen += padded.count(b" ", at, start)
            at, index[i] = start, seen
        found = sorted({rule.label for _, _, rule in kept} | base)
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": index[0] if index else None,
            "last_word": index[-1] if index else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(found),
            "score": max([rule.priority / TOP for _, _, rule in kept] + [0.8] * bool(base), default=0.0),
        }


_scanners: list[Scanner] = []
COLUMNS = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _scanners:
        _scanners.append(Scanner())
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for batch in batches:
        found = [_scanners[0].scan(t.as_py()) for t in batch.column("_llm_text")]
        arrays = [pa.array([f[name] for f in found], kind) for name, kind in zip(names, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Places and labels of the license notices in each row of ``docs``."""
    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").alias("_llm_text"))
    return slim.mapInArrow(_scan, "doc_id bigint, " + COLUMNS)
