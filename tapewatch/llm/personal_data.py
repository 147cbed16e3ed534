"""Personal data by anchor expansion.

One Aho-Corasick pass over a text, in lower case, finds at-signs, plus signs, digits, schemes and cue words. Small
deterministic parsers then expand each anchor in the text as written, to the left and right as far as its grammar
allows, and validate what they find. Places without an anchor are never looked at again.

Base kinds follow fixed grammars, leftmost and without overlap within a kind: ``email``, ``ip``, ``card``
(14 to 19 digits with a valid check digit), ``phone`` (10 to 15 digits). Added kinds: ``login`` (user part of
a URL), ``account`` (an identifier after a cue in any case, check digits verified where the format has them) and
``address`` in the orders of four languages: ``12 Main St``, ``Hauptstraße 12``, ``3 rue de la Paix``, ``Calle Mayor 5``.
Addresses that overlap an earlier one are left out.

Defined cases: a null text counts as the empty one, without spans; rows are searched one by one, so
repeated ones give equal spans; a column named like the output is replaced; an empty table stays empty; a
text of any length is searched whole. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.runtime import text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account", "address")
#: Cue words before an identifier. Short ones must begin a word.
ACCOUNT_CUES = (
    "iban", "account no", "account number", "acct", "routing no", "routing number", "sort code", "ssn", "social security no", "social security number",
    "passport no", "passport number", "tax id", "taxpayer id",
    "konto-nr", "konto nr", "kontonummer", "steuernummer", "steuer-nr", "steuer-id", "passnummer", "pass-nr", "ausweisnummer", "sozialversicherungsnummer",
    "numéro de compte", "n° de compte", "numéro de sécurité sociale", "n° de sécurité sociale", "numéro de passeport", "numéro fiscal",
    "número de cuenta", "nº de cuenta", "n.º de cuenta", "número de la seguridad social", "número de seguridad social", "número de pasaporte", "dni", "nif",
)
SHORT_CUE = 4
#: Words that end a street after its house number, their abbreviations, and what may follow those.
STREET_WORDS = ("street", "avenue", "boulevard", "road", "lane", "drive", "court", "square", "terrace", "parkway", "highway", "straße", "strasse")
STREET_SHORT = ("st", "ave", "blvd", "rd", "ln", "dr", "ct", "sq", "pkwy", "hwy")
STREET_STOPS = " .,;:)\n\r\t"
#: Ends of a street's name before its house number.
STREET_ENDS = ("straße", "strasse", "str.", "str", "weg", "platz", "allee", "gasse", "ufer", "damm")
#: Street words between house number and name, and what may stand between number and word.
WAYS_AFTER = ("rue", "avenue", "boulevard", "bd", "place", "chemin", "impasse", "quai", "allée", "route")
HOUSE_ENDS = (*"0123456789", *(f"{d}," for d in "0123456789"), " bis", " ter", " bis,", " ter,")
#: Street words before name and house number.
WAYS_BEFORE = ("calle", "c/", "avenida", "avda.", "paseo", "plaza", "camino")
#: A day and a month are no house number and street.
MONTHS = "January February March April May June July August September October November December".split()
#: Characters of the grammars.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IDENTIFIER = re.compile(r"[\x20:#.]{0,3}(?:(?i:is|ist|lautet|est|es|no|nr)[.:]?\x20)?([A-Z]{0,2}[0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
_HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?")
#: A word of a street's name: capitalised, or an ordinal.
_NAME = re.compile(r"[^\W\d_a-zß-öø-ÿ][\w'’.-]*|[0-9]+(?:st|nd|rd|th)")
_PARTS = r"(?:(?:de\x20la|de\x20los|de\x20las|de\x20l['’]|de|del|des|du|d['’]|la|le|les|el)(?:\x20|(?<=['’])))?"
_NAMES = r"[^\W\d_a-zß-öø-ÿ][\w'’-]*(?:\x20(?:de\x20(?:la\x20|l['’])?|du\x20|del\x20|des\x20)?[^\W\d_a-zß-öø-ÿ][\w'’-]*){0,3}"
_AFTER = re.compile(_PARTS + _NAMES)
_BEFORE = re.compile(rf"\x20?{_PARTS}{_NAMES},?\x20(?:n[.º°]*\x20?)?[0-9]{{1,4}}(?![\w])")
_NUMBER = re.compile(r"[0-9]{1,4}[a-z]?(?![\w])")
#: Words of a street's name between house number and street word.
MOST_NAMES = 4
DIGITS = "0123456789"


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+":
        found.add_word(sign, (sign, 1))
    for digit in DIGITS:
        found.add_word(digit, ("digit", 1))
    found.add_word("://", ("scheme", 3))
    for cue in ACCOUNT_CUES:
        found.add_word(cue, ("cue", len(cue)))
    for word in STREET_WORDS:
        found.add_word(" " + word, ("street", len(word)))
    for word in STREET_SHORT:
        for stop in STREET_STOPS:
            found.add_word(f" {word}{stop}", ("short", len(word) + 1))
    for word in STREET_ENDS:
        for digit in DIGITS:
            found.add_word(f"{word} {digit}", ("before_house", len(word) + 2))
    for word in WAYS_AFTER:
        for head in HOUSE_ENDS:
            found.add_word(f"{head} {word} ", ("after_house", len(head) + len(word) + 2))
    for word in WAYS_BEFORE:
        found.add_word(word, ("way", len(word)))
    found.make_automaton()
    return found


def check_digit_holds(digits: str) -> bool:
    """The check of card numbers: every second digit from the right counts double."""
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def bank_check_holds(identifier: str) -> bool:
    """The check of international bank numbers: moved and spelled in digits, the rest by 97 is 1."""
    turned = identifier[4:] + identifier[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str, signs: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for at in signs:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done


def chains(runs: list[tuple[int, int]], text: str, joints: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of digits that follow each other with one joint in between, as long as possible."""
    chain: list[tuple[int, int]] = []
    for run in runs:
        if chain and not (run[0] == chain[-1][1] + 1 and text[chain[-1][1]] in joints):
            yield chain
            chain = []
        chain.append(run)
    if chain:
        yield chain


def addresses_of_hosts(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for chain in chains(runs, text, "."):
        for k in range(0, len(chain) - 3, 4):
            parts = [text[a:b].lstrip("0") for a, b in chain[k : k + 4]]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                yield chain[k][0], chain[k + 3][1]


def cards(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for chain in chains(runs, text, " -"):
        if 14 <= sum(b - a for a, b in chain) <= 19 and check_digit_holds("".join(text[a:b] for a, b in chain)):
            yield chain[0][0], chain[-1][1]


def phones(text: str, signs: list[int]) -> Iterator[tuple[int, int]]:
    for at in signs:
        found = _PHONE.match(text, at)
        if found and 10 <= sum(c in DIGITS for c in found[0]) <= 15:
            yield found.span()


def logins(text: str, schemes: list[int]) -> Iterator[tuple[int, int]]:
    for end in schemes:
        stop = end
        while stop < len(text) and (text[stop] in _LOCAL or text[stop] == ":"):
            stop += 1
        if end < stop < len(text) and text[stop] == "@" and ":" in text[end:stop]:
            yield end, stop


def accounts(text: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    done = 0
    for start, end in cues:
        if end - start <= SHORT_CUE and start and text[start - 1].isalnum():
            continue
        found = _IDENTIFIER.match(text, end)
        if found and found.start(1) >= done:
            bare = re.sub(r"[\x20-]", "", found[1])
            wrong = re.match(r"[A-Z]{2}[0-9]{2}", bare) and not (15 <= len(bare) <= 34 and bank_check_holds(bare))
            if sum(c in DIGITS for c in bare) >= 6 and not wrong:
                done = found.end(1)
                yield found.span(1)


def word_before(text: str, end: int) -> int:
    """Where the word that ends at ``end`` begins."""
    space = max(0, text.rfind(" ", 0, end) + 1)
    return max(space, text.rfind("\n", space, end) + 1)


def streets(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """House number, one to four words of a name and a street word."""
    for at, end in words:
        if not text[at].isupper() or (end < len(text) and text[end].isalnum()):
            continue
        names = []
        stop = at - 1
        while stop > 0 and text[stop] == " " and len(names) <= MOST_NAMES:
            begin = word_before(text, stop)
            house = text[begin:stop].lstrip("(\"'")
            if names and _HOUSE.fullmatch(house):
                if len(names) > 1 or names[0] not in MONTHS:
                    yield stop - len(house), end
                break
            if not _NAME.fullmatch(text, begin, stop):
                break
            names.append(text[begin:stop])
            stop = begin - 1


def streets_before_number(text: str, ends: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """A name that ends in a street word, or a capitalised word and a street word, and the house number."""
    for at, end in ends:
        begin = word_before(text, at) if at and text[at - 1] not in " \n" else at
        while begin < at and not text[begin].isalpha():
            begin += 1
        if begin == at:
            first = word_before(text, at - 1) if at > 1 and text[at - 1] == " " else at
            while first < at - 1 and not text[first].isalpha():
                first += 1
            if first == at or not _NAME.fullmatch(text, first, at - 1):
                continue
            begin, named = first, text[at].isupper()
        else:
            named = text[begin].isupper() and all(c.isalpha() or c in "-." for c in text[begin:at])
        number = _NUMBER.match(text, end - 1)
        if named and number:
            yield begin, number.end()


def streets_after_number(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """House number, street word and a name."""
    for at, end in words:
        stop = at
        while stop < end and text[stop] in DIGITS:
            stop += 1
        begin = stop
        while begin > 0 and begin > stop - 6 and text[begin - 1] in DIGITS:
            begin -= 1
        whole = 1 <= stop - begin <= 5 and not (begin and (text[begin - 1].isalnum() or text[begin - 1] in ".,-"))
        if whole and (name := _AFTER.match(text, end)):
            yield begin, name.end()


def ways(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Street word, a name and the house number."""
    for at, end in words:
        if not (at and text[at - 1].isalnum()) and (found := _BEFORE.match(text, end)) and (text[end - 1] == "/" or text[end] == " "):
            yield at, found.end()


def apart(spans: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Leftmost spans, the longest of those that begin together, without overlap."""
    done = 0
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= done:
            done = end
            yield start, end


def lowered(text: str) -> str:
    """Lower case with the offsets of ``text``: one capital has a longer small form."""
    return text.replace("İ", "I").lower()


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    places: dict[str, list] = {"@": [], "+": [], "scheme": [], "cue": [], "street": [], "before_house": [], "after_house": [], "way": []}
    runs: list[tuple[int, int]] = []
    first = last = -1
    # an abbreviation at the very end has its stop as well
    for end, (what, size) in anchors().iter(lowered(text) + "\n"):
        if what == "digit":
            if end == last + 1 and first >= 0:
                last = end
            else:
                if first >= 0:
                    runs.append((first, last + 1))
                first = last = end
        elif what == "short":
            places["street"].append((end + 1 - size, end))
        elif size == 1:
            places[what].append(end)
        elif what == "scheme":
            places[what].append(end + 1)
        else:
            places[what].append((end + 1 - size, end + 1))
    if first >= 0:
        runs.append((first, last + 1))
    found = {
        "email": emails(text, places["@"]),
        "ip": addresses_of_hosts(text, runs),
        "card": cards(text, runs),
        "phone": phones(text, places["+"]),
        "login": logins(text, places["scheme"]),
        "account": accounts(text, places["cue"]),
        "address": apart(
            span
            for parser, kind in ((streets, "street"), (streets_before_number, "before_house"), (streets_after_number, "after_house"), (ways, "way"))
            for span in parser(text, places[kind])
        ),
    }
    spans = [(start, order, end) for order, kind in enumerate(KINDS) for start, end in found[kind]]
    return [(KINDS[order], start, end) for start, order, end in sorted(spans)]


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find_personal_data(docs: DataFrame, text: str = "text", out: str = "personal") -> DataFrame:
    """``docs`` with the array ``out`` of spans."""

    @F.pandas_udf(SPANS)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] for t in batch])

    return docs.withColumn(out, search(text_of(text)))


def masked(text: Column, spans: Column, mask: str = "[{}]") -> Column:
    """The text with every span replaced by its kind; of overlapping spans the first stands for both."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, span: Column) -> Column:
        before, after = mask.split("{}")
        kept = F.concat(acc["done"], F.substring(text, acc["at"] + 1, span["start"] - acc["at"]), F.lit(before), span["kind"], F.lit(after))
        return F.when(span["start"] < acc["at"], F.struct(F.greatest(acc["at"], span["end"]).alias("at"), acc["done"].alias("done"))).otherwise(
            F.struct(span["end"].alias("at"), kept.alias("done"))
        )

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
