"""Licences by sentence rules.

A text is cut into sentences, which may go on over line ends with comment leaders but not over blank lines; sentences with a cue word are normalised (lower case, words and version numbers
only) and looked up among known licence sentences. What is left of a text is a sequence of sentence
identifiers with their places, and ordered rules are matched against it: at each identifier the first rule whose
sequence follows, with at most ``MOST_BETWEEN`` unknown sentences between two of its sentences, is the finding,
and its sentences are used up. Longer rules stand before shorter ones that they contain.

Defined cases: a null text counts as the empty one, without findings; repeated rows are scanned one by one; a
column named like the output is replaced; an empty table stays empty; a text of any length is scanned whole. Offsets
count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.runtime import text_of

MOST_BETWEEN = 2
#: Words of which every known sentence has one.
CUES = ("licen", "copyright", "permission", "permitted", "redistribut", "warrant", "liable", "public domain", "free software", "endorse")
#: Known sentences, normalised; ``*`` stands for any words.
SENTENCES = {
    "copyright": ["copyright *", "c copyright *", "portions copyright *"],
    "rights-reserved": ["all rights reserved under this license", "all rights reserved under copyright"],
    "apache-2-name": [
        "licensed under the apache license version 2.0",
        "* is licensed under the apache license version 2.0",
        "released under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license",
    ],
    "apache-2-compliance": ["you may not use this file except in compliance with the license"],
    "apache-2-copy": ["you may obtain a copy of the license at *"],
    "apache-2-basis": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied"
    ],
    "apache-2-limits": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-name": ["released under the mit license", "licensed under the mit license", "* is released under the mit license", "* is licensed under the mit license", "license mit"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction *"
    ],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied *"],
    "no-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability *"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted *"],
    "isc-disclaimer": ["the software is provided as is and the author disclaims all warranties *"],
    "bsd-grant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    ],
    "bsd-source": ["* redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["* redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer *"],
    "bsd-names": ["* neither the name of * may be used to endorse or promote products derived from this software *"],
    "bsd-name": ["licensed under the bsd license", "released under the bsd license", "license bsd"],
    "gpl-3-name": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
    ],
    "gpl-2-name": ["licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "gpl-3-notice": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version"
    ],
    "gpl-2-notice": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 2 of the license or at your option any later version"
    ],
    "gpl-warranty": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose"
    ],
    "agpl-3-name": ["licensed under the gnu affero general public license version 3", "released under the gnu affero general public license version 3"],
    "agpl-3-notice": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version"
    ],
    "lgpl-name": ["licensed under the gnu lesser general public license *", "released under the gnu lesser general public license *"],
    "mpl-2-name": [
        "this source code form is subject to the terms of the mozilla public license v. 2.0",
        "licensed under the mozilla public license version 2.0",
    ],
    "cc-by-name": ["* licensed under cc by 4.0", "licensed under cc by 4.0", "* licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-name": ["* licensed under cc by-sa 4.0", "licensed under cc by-sa 4.0"],
    "cc-by-nc-name": ["* licensed under cc by-nc 4.0", "licensed under cc by-nc 4.0"],
    "public-domain": ["* released into the public domain", "* is in the public domain", "released into the public domain"],
}
#: Ordered rules: the licence, and the sentences that make it up.
RULES = [
    ("Apache-2.0", ("apache-2-name", "apache-2-compliance", "apache-2-copy", "apache-2-basis", "apache-2-limits")),
    ("Apache-2.0", ("apache-2-name", "apache-2-compliance")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "isc-disclaimer")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("AGPL-3.0-or-later", ("agpl-3-notice", "gpl-warranty")),
    ("AGPL-3.0-or-later", ("agpl-3-notice",)),
    ("AGPL-3.0", ("agpl-3-name",)),
    ("GPL-3.0-or-later", ("gpl-3-notice", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-3-notice",)),
    ("GPL-2.0-or-later", ("gpl-2-notice", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-2-notice",)),
    ("Apache-2.0", ("apache-2-name",)),
    ("MIT", ("mit-name",)),
    ("BSD", ("bsd-name",)),
    ("GPL-3.0", ("gpl-3-name",)),
    ("GPL-2.0", ("gpl-2-name",)),
    ("LGPL", ("lgpl-name",)),
    ("MPL-2.0", ("mpl-2-name",)),
    ("CC-BY-4.0", ("cc-by-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-name",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-name",)),
    ("public-domain", ("public-domain",)),
]
_SENTENCE = re.compile(r"(?:[^.;:?\n]|[.;:?](?![\s]|\Z))+[.;:?]?")
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*\.?(?=[^a-z.]|\Z)|[a-z]+|[0-9]+(?:\.[0-9]+)*")
#: A line without words ends a paragraph; other line ends are spaces.
_BLANK = re.compile(r"\n[^\w\n]*\n")
#: Sentences that go on to the end of their line only.
ONE_LINE = ("copyright", "rights-reserved")


def normalised(sentence: str) -> str:
    words = _WORD.findall(sentence.lower())
    return " ".join(w if w == "v." else w.rstrip(".") for w in words)


def _lookup() -> tuple[dict[str, str], list[tuple[str, list[str]]], dict[str, list[tuple[str, list[list[str]]]]]]:
    """Sentences without open words by their text, the parts of the others, and the words of all by their first one."""
    exact, open_, starts = {}, [], {}
    for name, forms in SENTENCES.items():
        for form in forms:
            parts = [part.strip() for part in form.split("*")]
            if len(parts) == 1:
                exact[form] = name
            else:
                open_.append((name, [f" {part} " if part else "" for part in parts]))
            # a sentence of several lines begins with its first known word
            parts = parts if parts[0] else parts[1:]
            if name not in ONE_LINE:
                starts.setdefault(parts[0].split()[0], []).append((name, [part.split() for part in parts]))
    for forms in starts.values():
        forms.sort(key=lambda f: -sum(map(len, f[1])))
    return exact, open_, starts


_EXACT, _OPEN, _STARTS = _lookup()


def holds(text: str, parts: list[str]) -> bool:
    """Whether a padded text begins and ends with the outer parts and has the others in order between them."""
    first, *middle, last = parts
    if not (text.startswith(first) and text.endswith(last)):
        return False
    # neighbouring parts may share the space between them
    at, end = max(0, len(first) - 1), len(text) - max(0, len(last) - 1)
    for part in middle:
        if (found := text.find(part, at, end)) < 0:
            return False
        at = found + len(part) - 1
    return at <= end


def identify(sentence: str) -> str | None:
    """The identifier of a known sentence."""
    text = normalised(sentence)
    if text in _EXACT:
        return _EXACT[text]
    return next((name for name, parts in _OPEN if holds(f" {text} ", parts)), None)


def wrapped(pieces: list[tuple[int, int]], text: str, k: int, paragraph: int) -> tuple[str, int] | None:
    """The known sentence that begins with piece ``k`` and goes on in further lines, and the piece after it."""
    first = normalised(text[slice(*pieces[k])]).split()
    if not first or first[0] not in _STARTS:
        return None
    for name, parts in _STARTS[first[0]]:
        head, fixed = parts[0], sum(map(len, parts))
        if first[: len(head)] != head[: len(first)]:
            continue
        words, at = list(first), k + 1
        while at < paragraph and words[: len(head)] == head[: len(words)] and (len(words) < fixed or len(parts) > 1 and text[pieces[at - 1][1] - 1] not in ".;:?"):
            words += normalised(text[slice(*pieces[at])]).split()
            at += 1
        joined = " ".join(words)
        if joined == " ".join(head) if len(parts) == 1 else holds(f" {joined} ", [f" {' '.join(p)} " if p else "" for p in parts]):
            return name, at
    return None


def known_sentences(text: str) -> list[tuple[str, int, int, int]]:
    """Identifier, number, start and end of each known sentence; sentences of several lines come before those of one."""
    low = text.lower()
    if not any(cue in low for cue in CUES):
        return []
    pieces = [m.span() for m in _SENTENCE.finditer(text)]
    breaks = [m.start() for m in _BLANK.finditer(text)]
    found, k, number, b, paragraph = [], 0, 0, 0, 0
    while k < len(pieces):
        if k >= paragraph:
            # pieces up to the next blank line
            while b < len(breaks) and breaks[b] < pieces[k][1]:
                b += 1
            limit = breaks[b] if b < len(breaks) else len(text)
            paragraph = k + 1
            while paragraph < len(pieces) and pieces[paragraph][0] <= limit:
                paragraph += 1
        start, end = pieces[k]
        piece, after = text[start:end], k + 1
        if several := wrapped(pieces, text, k, paragraph):
            name, after = several
        else:
            name = identify(piece) if any(cue in piece.lower() for cue in CUES) else None
        if name:
            found.append((name, number, start + len(piece) - len(piece.lstrip()), pieces[after - 1][1]))
        # the lines of one unknown sentence count once
        number += bool(name) or after == paragraph or piece[-1] in ".;:?"
        k = after
    return found


def match_rules(sentences: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int]]:
    """Licence, start and end of each finding in order."""
    found, at = [], 0
    while at < len(sentences):
        for licence, names in RULES:
            part = sentences[at : at + len(names)]
            near = all(b[1] - a[1] <= MOST_BETWEEN + 1 for a, b in zip(part, part[1:]))
            if near and tuple(s[0] for s in part) == names:
                found.append((licence, part[0][2], part[-1][3]))
                at += len(names)
                break
        else:
            at += 1
    return found


def find_licenses(docs: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` with the array ``out`` of findings."""

    @F.pandas_udf("array<struct<license: string, start: int, end: int>>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = [match_rules(known_sentences(t)) for t in batch]
            yield pd.Series([[{"license": n, "start": a, "end": b} for n, a, b in x] for x in found])

    return docs.withColumn(out, scan(text_of(text)))
