"""Secrets by fixed grammars and by a battery of randomness tests.

Base kinds follow fixed grammars, leftmost and without overlap within a kind: ``assign``, ``access``, ``hex``.
Added kind: ``random``, strings of ``LEAST`` and more characters outside base spans that are told from words and that no
test tells from random ones. Every string of that grammar is judged, whatever characters it has.

**Words.** Letter pairs of all texts are counted first (729 numbers). A string is read as words in any case, numbers and
separators run together; how much likelier its encoding makes it than these words do is an e-value, whose inverse is a p-value.
**Randomness.** For the alphabet of the narrowest encoding that holds a string (hexadecimal, base 32, base 36, base 64) three
tests are made: chi-squared uniformity of the symbols, number of runs above and below the middle of the
alphabet, and correlation of neighbours. The smallest of the three p-values, times three, is the string's.

Short strings give weak tests and long ones strong tests, so strings are compared within a length class only, over the whole
corpus, by the step-up procedure of Benjamini and Hochberg. Applied to words it bounds the share of words among the strings
*reported* by ``FALSE_REPORTS`` (as far as pairs describe words); applied to randomness, over the strings that are likelier random than words,
it bounds the share of random strings among those *left out* as uneven by ``FALSE_REJECTIONS``. p-values are counted in fixed steps of their
logarithm, so each procedure takes one small aggregate, whatever the number of strings.

Defined cases: a null text counts as the empty one, without spans; repeated rows are searched one by one and
their strings are counted as often as they occur; an empty table stays empty; a text of any length is
searched whole; other columns are not used. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.runtime import text_of
from tapewatch.session import staged

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
#: Share of random strings among those rejected, at most, in expectation.
FALSE_REJECTIONS = 0.05
#: Share of words among the strings reported, at most, in expectation.
FALSE_REPORTS = 0.05
#: Least characters of a string that is judged.
LEAST = 16
#: Chance that a word or number ends after a character of a string.
BREAK = 1 / 8
#: Text whose letter pairs stand beside those counted, so that a few short texts have some.
PROSE = (
    "the quick answer to this question was written down in another book by the same author and was found later on a shelf with many other things "
    "der schnelle bericht über diese frage wurde in einem anderen buch von der gleichen verfasserin geschrieben und später mit vielen dingen gefunden "
    "la réponse à cette question se trouve dans un autre livre que le même auteur avait écrit pour les enfants de la maison avec beaucoup de choses "
    "la respuesta a esta pregunta se encuentra en otro libro que el mismo autor había escrito para los niños de la casa con muchas cosas más "
    "get user name set value from list index key config file path read write data type class method server client request response token count error"
)
#: Steps of p-values for each power of ten.
STEPS = 200
#: The grammars.
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_STRING = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
#: Encodings by growing alphabet, in the order of their symbols.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_LETTERS = 27
_PLACE = np.zeros(256, dtype=np.int64)
for _k, _c in enumerate(_LOWER):
    _PLACE[ord(_c)] = _PLACE[ord(_c.upper())] = _k + 1
_RANKS = {name: {c: k for k, c in enumerate(symbols)} for name, symbols in ENCODINGS.items()}


def encoding_of(string: str) -> str | None:
    """The narrowest encoding whose alphabet holds all characters; none where encodings are mixed."""
    used = set(string.rstrip("="))
    return next((name for name, ranks in _RANKS.items() if used <= ranks.keys()), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(values: np.ndarray, symbols: int) -> float:
    """Upper tail of the chi-squared statistic, by the cube-root approximation."""
    freedom = symbols - 1
    expected = len(values) / symbols
    statistic = float(((np.bincount(values, minlength=symbols) - expected) ** 2).sum() / expected)
    spread = 2 / (9 * freedom)
    return 0.5 * math.erfc(((statistic / freedom) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))


def runs(values: np.ndarray, symbols: int) -> float:
    above = values >= symbols / 2
    n, high = len(values), int(above.sum())
    low = n - high
    if not high or not low:
        return 2.0 ** (1 - n)
    mean = 2 * high * low / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided((1 + np.count_nonzero(above[1:] != above[:-1]) - mean) / math.sqrt(spread)) if spread > 0 else 1.0


def neighbours(values: np.ndarray) -> float:
    centred = values - values.mean()
    total = float((centred**2).sum())
    if total == 0:
        return 0.0
    n = len(values)
    return _two_sided((float((centred[1:] * centred[:-1]).sum()) / total + 1 / n) * math.sqrt(n))


def p_value(string: str) -> float:
    """How likely a random string of the encoding looks at least as uneven."""
    name = encoding_of(string)
    if name is None:
        return 0.0
    ranks = _RANKS[name]
    values = np.array([ranks[c] for c in string.rstrip("=")])
    symbols = len(ranks)
    return min(1.0, 3 * min(uniformity(values, symbols), runs(values, symbols), neighbours(values)))


def letter_pairs(text: str) -> np.ndarray:
    """Neighbouring letters of a text by their 729 places, others than letters as 0; strings that are judged are left out."""
    codes = _PLACE[np.frombuffer(b" " + _STRING.sub(" ", text).encode("ascii", "replace") + b" ", dtype=np.uint8)]
    return np.bincount(_LETTERS * codes[:-1] + codes[1:], minlength=_LETTERS**2)


def word_model(pairs: np.ndarray) -> np.ndarray:
    """Logarithms of the chance of a letter after a letter of its word, or after 0 at the start of a word."""
    counts = (pairs + letter_pairs(PROSE)).reshape(_LETTERS, _LETTERS)[:, 1:] + 0.1
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def likelier_than_words(string: str, model: list[list[float]]) -> float:
    """Logarithm of how much likelier a string is random, in an encoding of equal chance, than made of words."""
    name = encoding_of(string)
    if name is None:
        return 0.0
    goes_on, ends = math.log(1 - BREAK), math.log(BREAK / 3)
    bare = string.rstrip("=")
    total, kind, size, last = 0.0, "", 0, 0
    for c in bare:
        now = "d" if c in _DIGITS else "u" if c in _UPPER else "l" if c in _LOWER else "s"
        # a word goes on in its case, or in lower case after one capital
        same = now != "s" and (now == kind or (kind == "u" and now == "l" and size == 1))
        total += goes_on if same else ends if kind else 0.0
        if now in "ul":
            place = int(_PLACE[ord(c)])
            total += model[last if same else 0][place - 1] - (0.0 if same else math.log(2))
            last = place
        else:
            total -= math.log(10 if now == "d" else 4)
        kind, size = now, size + 1 if same else 1
    return -len(bare) * math.log(len(_RANKS[name])) - math.log(len(ENCODINGS)) - total


def length_class(size: int) -> int:
    """Half powers of two."""
    return int(2 * math.log2(size))


def steps(power: float) -> int:
    """The step of a p-value of ``10 ** -power``."""
    return int(STEPS * min(300.0, max(0.0, power)))


def search(text: str, model: list[list[float]]) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int, int, int]]]:
    """Base spans, and the strings outside them: start, end, length class, steps of the p-values of words and of randomness."""
    found = {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if len(m[1]) >= 6],
        "access": [m.span() for m in _ACCESS.finditer(text)],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }
    base = sorted((start, order, end) for order, kind in enumerate(BASE_KINDS) for start, end in found[kind])
    strings, k, reach = [], 0, 0
    for m in _STRING.finditer(text):
        start, end = m.span()
        while k < len(base) and base[k][0] < end:
            reach, k = max(reach, base[k][2]), k + 1
        if reach <= start:
            words = steps(likelier_than_words(m[0], model) / math.log(10))
            even = steps(-math.log10(max(p_value(m[0]), 1e-300))) if words else 0
            strings.append((start, end, length_class(end - start), words, even))
    return [(BASE_KINDS[order], start, end) for start, order, end in base], strings


FOUND = (
    "base array<struct<kind: string, start: int, end: int>>, "
    "strings array<struct<start: int, end: int, class: int, words: int, even: int>>"
)


def pair_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Letter pairs of all texts; each task gives 729 rows at most, and so does the whole."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_LETTERS**2, dtype=np.int64)
        for batch in batches:
            for body in batch["body"]:
                total += letter_pairs(body)
        places = np.flatnonzero(total)
        yield pd.DataFrame({"place": places, "n": total[places]})

    counted = docs.select(text_of(text).alias("body")).mapInPandas(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    pairs = np.zeros(_LETTERS**2, dtype=np.int64)
    for row in counted.collect():
        pairs[row["place"]] = row["n"]
    return pairs


def thresholds(strings: DataFrame, level: float) -> DataFrame:
    """For each length class the smallest step of p-values that is rejected, if any is."""
    counted = strings.groupBy("class", "step").agg(F.count(F.lit(1)).alias("n"))
    # one row per class and step, at most 300 * STEPS in a class
    smaller = Window.partitionBy("class").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("rank", F.sum("n").over(smaller)).withColumn("m", F.sum("n").over(Window.partitionBy("class")))
    rejected = F.pow(F.lit(10.0), -F.col("step") / STEPS) <= F.lit(level) * F.col("rank") / F.col("m")
    return ranked.where(rejected).groupBy("class").agg(F.min("step").alias("from_step"))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the array ``spans`` of each row.

    What a search finds is small beside the text and is written once; the thresholds of all classes, of
    which there are at most two for each doubling of a length, come back as two small maps.
    """
    model = word_model(pair_counts(docs, text)).tolist()

    @F.pandas_udf(FOUND)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            both = [search(t, model) for t in batch]
            base = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x, _ in both]
            strings = [[{"start": a, "end": b, "class": c, "words": w, "even": e} for a, b, c, w, e in x] for _, x in both]
            yield pd.DataFrame({"base": base, "strings": strings})

    found = staged(docs.select(F.col(key), scan(text_of(text)).alias("found")))
    strings = found.select(F.explode("found.strings").alias("s")).select("s.*")
    never = F.lit(301 * STEPS)

    def limits(of: DataFrame, level: float):
        rows = thresholds(of, level).collect()
        by_class = F.create_map(*[F.lit(v) for row in rows for v in (row["class"], row["from_step"])]) if rows else None
        return lambda s: F.coalesce(by_class[s["class"]], never) if rows else never

    not_words = limits(strings.select("class", F.col("words").alias("step")), FALSE_REPORTS)
    uneven = limits(strings.where("words > 0").select("class", F.col("even").alias("step")), FALSE_REJECTIONS)

    def random(s: Column) -> Column:
        return (s["words"] >= not_words(s)) & (s["even"] < uneven(s))

    def order(kind: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, KINDS)), kind)

    added = F.transform(F.filter("found.strings", random), lambda s: F.struct(F.lit("random").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.transform(F.concat("found.base", added), lambda s: F.struct(s["start"].alias("start"), order(s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.sort_array(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(F.col(key), spans.alias("spans"))
