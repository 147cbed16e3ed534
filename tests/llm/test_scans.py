"""Spans found in texts, against the plain grammars."""

import hashlib
import random
import re

import numpy as np
import pytest

from tapewatch.llm import catalogue, license_scan, personal_data, secret_scan
from tests.llm.conftest import FOLDER, LONG


def check_digit(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        value = int(c) << (k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def plain_personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and check_digit(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return ordered(text, kinds)


#: The model of words without counted texts.
NO_PAIRS = secret_scan.word_model(np.zeros(729, dtype=np.int64)).tolist()


def plain_secrets(text):
    kinds = [
        ("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None),
        ("access", r"AKIA[A-Z0-9]+", lambda s: len(s) >= 20),
        ("hex", r"[0-9a-f]+", lambda s: len(s) >= 24),
    ]
    return ordered(text, kinds)


def ordered(text, kinds):
    found = []
    for k, (kind, pattern, keep) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            if len(m[1]) >= 6 if keep is None else keep(m[0]):
                found.append((m.start(), k, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def test_personal_data_is_what_the_grammars_find():
    pieces = ["a", "b.c", "@", "@", ".", ".", "1", "23", "255", "256", "4952935900253052", "-", " ", "+", "+1", "(", ")", "974", "é", "%", "\n", "192.168.0.1", "555-3436", "٣"]
    draw = random.Random(3)
    for _ in range(4000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 16)))
        assert [s for s in personal_data.spans_of(text) if s[0] in personal_data.BASE_KINDS] == plain_personal(text), text


#: Ordinary forms of addresses and identifiers in four languages.
ADDRESSES = [
    "12 Main St", "5 Oak Ave", "9 Hill Rd", "77 Sunset Blvd", "42 Old Oak Street", "120 W 42nd St", "1 Martin Luther King Drive", "Hauptstraße 12", "Berliner Straße 5a", "Goethestr. 7", "Lindenweg 3",
    "3 rue de la Paix", "12 Avenue Foch", "7 bis, rue Victor Hugo", "12 rue d'Alésia", "Calle Mayor 5", "Avenida de la Constitución, 12", "C/ Alcalá 7", "Paseo del Prado 8",
    "9 " + "Verylongname" * 20 + " Road",
]
ACCOUNTS = [
    ("Account Number: ", "12345678"), ("Social Security Number ", "123-45-6789"), ("Routing Number ", "021000021"), ("PASSPORT NO. ", "C01234567"), ("Tax ID: ", "12-3456789"), ("Konto-Nr. ", "12345678"),
    ("Kontonummer lautet ", "12345678"), ("Numéro de compte : ", "123456789"), ("Número de cuenta: ", "123456789"), ("DNI ", "12345678Z"),
]
CLEAN = [
    "On 12 May Dr. Smith came by.", "auf Platz 3 der Liste", "Geh den Weg 3 mal", "He took place 4 of 12 places.", "ISSN 12345678", "The street was long, 5 drive by.", "La calle era larga y 5 coches", "account number unknown",
    "Chapter 3 Street lights", "5 rue", "calle 5", "İİ and nothing else",
]


@pytest.mark.parametrize("before", ["", "İ lives at ", "seen: (", "\n"])
def test_ordinary_forms_of_personal_data(before):
    for address in ADDRESSES:
        text = f"{before}{address}, or so"
        assert [text[a:b] for kind, a, b in personal_data.spans_of(text) if kind == "address"] == [address], text
        assert [kind for kind, _, _ in personal_data.spans_of(before + address)] == ["address"]
    for cue, number in ACCOUNTS:
        text = f"{before}{cue}{number}, or so"
        assert [text[a:b] for kind, a, b in personal_data.spans_of(text) if kind == "account"] == [number], text
    for text in CLEAN:
        assert personal_data.spans_of(before + text) == [], text


def test_added_personal_data():
    text = "He lives at 42 Old Oak Street, IBAN: DE89 3704 0044 0532 0130 00, see http://bob:pw@x.com/ and SSN 123-45-6789."
    found = {kind: text[a:b] for kind, a, b in personal_data.spans_of(text)}
    assert found["address"] == "42 Old Oak Street" and found["login"] == "bob:pw" and "123-45-6789" in text[slice(*personal_data.spans_of(text)[-1][1:])]
    assert not [s for s in personal_data.spans_of("IBAN: DE88 3704 0044 0532 0130 00") if s[0] == "account"]
    assert personal_data.spans_of(LONG) == []


def test_masked(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now")], "doc_id long, text string")
    found = personal_data.find_personal_data(docs)
    assert found.select(personal_data.masked(found["text"], found["personal"])).first()[0] == "mail [email] now"


def test_secrets_are_what_the_grammars_find():
    pieces = ["token", "Secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdef", "a1", "AKIA", "ABCDEFGH", "12345678", "deadbeef", "0123456789abcdef", "ſ", "K", "_", "-", "."]
    draw = random.Random(4)
    for _ in range(4000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 14)))
        assert secret_scan.search(text, NO_PAIRS)[0] == plain_secrets(text), text


def test_tests_of_randomness_keep_their_level():
    draw = random.Random(5)
    for name in ("hex", "base62"):
        p = [secret_scan.p_value("".join(draw.choices(secret_scan.ENCODINGS[name], k=64))) for _ in range(600)]
        assert np.mean(np.array(p) <= 0.05) < 0.09
    assert secret_scan.p_value("0123456789abcdef" * 3) < 1e-3 and secret_scan.p_value("aaaaaaaaaaaaaaaaaaaaaaaaaaaa11") < 1e-6


def test_random_strings_are_added_and_even_ones_are_not(spark):
    draw = random.Random(6)
    strings = ["".join(draw.choices(secret_scan.ENCODINGS["base62"], k=40)) for _ in range(30)] + [f"abcabcabc{k:02d}" * 4 for k in range(30)]
    docs = spark.createDataFrame([(k, f"see {s} there") for k, s in enumerate(strings)], "doc_id long, text string")
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.find_secrets(docs).collect()}
    assert sum("random" in found[k] for k in range(30)) >= 26 and not any("random" in found[k] for k in range(30, 60))


def step_up(values, level):
    """The indexes that the procedure of Benjamini and Hochberg rejects; values are powers of ten, taken negative."""
    order = sorted(range(len(values)), key=lambda k: -values[k])
    last = max((rank for rank, k in enumerate(order, 1) if 10 ** -values[k] <= level * rank / len(values)), default=0)
    return {k for k in range(len(values)) if last and values[k] >= values[order[last - 1]]}


def test_reported_strings_by_length(spark, texts):
    """Planted random strings are found at every length, identifiers made of words are not; the whole set equals a plain computation."""
    draw = random.Random(8)
    words = [w for t in list(texts.values())[:50] for w in re.findall("[a-z]{3,}", t)]
    rows, planted = [(k, t) for k, t in enumerate(texts.values())], {}

    def plant(string, what):
        planted[10_000 + len(planted)] = (what, string)
        rows.append((9_999 + len(planted), f"see {string} there"))

    for size in (16, 20, 24, 32):
        for name in ("base62", "base64", "base32", "base36"):
            for _ in range(100):
                plant("".join(draw.choices(secret_scan.ENCODINGS[name], k=size)), (name, size))
        for k in range(200):
            parts = [draw.choice(words) for _ in range(size)]
            joined = "".join(map(str.capitalize, parts)) if k % 2 else "_".join(parts)
            plant(joined[: size - 2] + f"{draw.randrange(100):02d}", ("words", size))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random"] for r in secret_scan.find_secrets(docs).collect()}

    share = {}
    for key, (what, string) in planted.items():
        hit = (4, 4 + len(string)) in found[key]
        share.setdefault(what, []).append(hit)
    for (name, size), hits in share.items():
        assert np.mean(hits) <= 0.01 if name == "words" else np.mean(hits) >= 0.9, (name, size, np.mean(hits))
    reported = sum(map(len, found.values()))
    wrong = reported - sum(sum(hits) for (name, _), hits in share.items() if name != "words")
    assert wrong <= 0.05 * reported

    model = secret_scan.word_model(sum(secret_scan.letter_pairs(t) for _, t in rows)).tolist()
    by_class = {}
    for key, text in rows:
        for start, end, size, not_words, even in secret_scan.search(text, model)[1]:
            by_class.setdefault(size, []).append((key, start, end, not_words / secret_scan.STEPS, even / secret_scan.STEPS))
    plain = set()
    for strings in by_class.values():
        told = step_up([s[3] for s in strings], secret_scan.FALSE_REPORTS)
        likelier = [k for k, s in enumerate(strings) if s[3] > 0]
        uneven = {likelier[k] for k in step_up([strings[k][4] for k in likelier], secret_scan.FALSE_REJECTIONS)}
        plain |= {strings[k][:3] for k in told - uneven}
    assert plain == {(key, a, b) for key, spans in found.items() for a, b in spans}


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op1_personal_data", plain_personal, personal_data.BASE_KINDS), ("op7_secret_scan", plain_secrets, secret_scan.BASE_KINDS)])
def test_query(spark, texts, name, plain, kinds):
    rows = {r["doc_id"]: r for r in catalogue.QUERIES[name](spark, FOLDER).collect()}
    assert rows.keys() == texts.keys()
    for key, text in texts.items():
        spans = plain(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert rows[key]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[key][f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        assert set(filter(None, joined.split(","))) <= set(rows[key]["spans"].split(","))


def test_licences(texts):
    mit = (
        "Copyright (c) 2020 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including.\nThe above copyright notice and this permission notice shall be included in all '
        'copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, AND.'
    )
    scan = lambda t: license_scan.match_rules(license_scan.known_sentences(t))
    assert [x[0] for x in scan(mit)] == ["MIT"]
    assert [x[0] for x in scan("Released under the MIT License.\nLicensed under CC BY-NC 4.0.")] == ["MIT", "CC-BY-NC-4.0"]
    assert scan("My license was lost. The permission came late.") == [] and scan("") == []
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    for text in texts.values():
        expected = sorted((m.start(), lines[m[0]], m.end()) for line in lines for m in re.finditer(re.escape(line), text))
        assert [(a, name, b) for name, a, b in scan(text)] == expected


def test_wrapped_licences():
    mit = """Copyright (c) 2020 Jane Doe
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution."""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    scan = lambda t: license_scan.match_rules(license_scan.known_sentences(t))
    for text, name in ((mit, "MIT"), (bsd, "BSD-2-Clause"), (apache, "Apache-2.0"), (gpl, "GPL-3.0-or-later"), (gpl.replace("GNU", "GNU Affero"), "AGPL-3.0-or-later")):
        for leader in ("", "# ", " * ", "// "):
            body = "\n".join((leader + line).rstrip() for line in text.split("\n"))
            found = scan(body)
            assert [x[0] for x in found] == [name], (leader, found)
            assert found[0][2] == len(body)
    assert [x[0] for x in scan("word " * 900 + "is licensed under CC BY 4.0")] == ["CC-BY-4.0"]


def test_odd_rows(odd, empty, odd_rows):
    n = len(odd_rows)
    for find, out in ((personal_data.find_personal_data, "personal"), (license_scan.find_licenses, "licenses")):
        rows = find(odd).collect()
        assert len(rows) == n and all(r[out] is not None for r in rows)
        assert find(empty).count() == 0
    found = secret_scan.find_secrets(odd).collect()
    assert len(found) == n and [s["kind"] for r in found if r["doc_id"] is None for s in r["spans"]] == ["assign"]
    assert secret_scan.find_secrets(empty).count() == 0
    personal = [r for r in personal_data.find_personal_data(odd).collect() if r["doc_id"] is None and r["text"]]
    assert [s["kind"] for s in personal[0]["personal"]] == ["email", "phone"]
