"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once for a text. The ledger holds the measurements and one bit per failed
rule, so a policy is a mask, changing a policy reads no text again, and an ablation is a count over
distinct bit patterns.

Defined cases: a null text counts as the empty one, which fails ``too_few_words``; an empty table gives
an empty ledger; repeated rows are measured one by one; a column named like the output is replaced;
a text of any length is measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.runtime import let, text_of, words_of

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: The bit of each rule; a bit never gets another meaning, new rules take new bits.
RULE_BITS = {"too_few_words": 0, "repeated_windows": 1, "repeated_lines": 2, "symbols": 3, "capitals": 4, "word_length": 5}
#: Rules that a policy contains, by version.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "2026-01": ("too_few_words", "repeated_windows", "repeated_lines", "symbols"),
    "2026-02": ("too_few_words", "repeated_windows", "repeated_lines", "symbols", "capitals", "word_length"),
}
CURRENT = "2026-02"


@dataclass(frozen=True)
class Limits:
    """A rule fails beyond these values; shares are whole percents, so that no rounding decides."""

    min_words: int = 50
    repeated_window_percent: int = 50
    repeated_line_percent: int = 50
    symbol_percent: int = 10
    capital_percent: int = 40
    min_mean_chars: int = 2
    max_mean_chars: int = 15


def mask_of(policy: str) -> int:
    return sum(1 << RULE_BITS[rule] for rule in POLICIES[policy])


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that the text holds twice or more, each word once.

    The windows are sorted with their places, so equal ones become neighbours; the places of repeated
    ones are sorted again and their union is measured from left to right.
    """

    def repeated(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        same = lambda a, b: ordered[a]["window"] == ordered[b]["window"]
        keep = lambda x, i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < last) & same(i, F.least(i + 1, last)))
        return F.transform(F.filter(ordered, keep), lambda x: x["place"])

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, p: F.struct((acc["n"] + p + size - F.greatest(p, acc["end"])).alias("n"), (p + size).alias("end"))
        return F.aggregate(F.sort_array(places), start, step, lambda acc: acc["n"])

    def of_words(w: Column) -> Column:
        window = lambda i: F.concat_ws(" ", *[w[i + k] for k in range(size)])
        placed = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.struct(window(i).alias("window"), i.alias("place")))
        return F.when(F.size(w) > size, let(F.sort_array(placed), lambda s: covered(repeated(s)))).otherwise(F.lit(0))

    return let(words, of_words)


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct of longs."""

    def of_lines(lines: Column) -> list[Column]:
        return [F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines")]

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    parts = let(
        F.struct(words_of(text).alias("words"), lines.alias("lines"), bare.alias("bare")),
        lambda p: F.struct(
            F.size(p["words"]).alias("n_words"),
            F.length(p["bare"]).alias("word_chars"),
            (F.length(p["bare"]) - F.length(F.translate(p["bare"], SYMBOLS, ""))).alias("n_symbols"),
            *of_lines(p["lines"]),
            repeated_window_words(p["words"]).alias("n_repeat_words"),
            F.length(F.regexp_replace(p["bare"], r"\P{Lu}+", "")).alias("n_capitals"),
        ),
    )
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")
    return let(parts, lambda m: F.struct(*[m[n].cast("long").alias(n) for n in names]))


def failure_bits(m: Column, limits: Limits) -> Column:
    failed = {
        "too_few_words": m["n_words"] < limits.min_words,
        "repeated_windows": 100 * m["n_repeat_words"] > limits.repeated_window_percent * m["n_words"],
        "repeated_lines": 100 * m["n_dup_lines"] > limits.repeated_line_percent * m["n_lines"],
        "symbols": 100 * m["n_symbols"] > limits.symbol_percent * m["n_words"],
        "capitals": 100 * m["n_capitals"] > limits.capital_percent * m["word_chars"],
        "word_length": (m["word_chars"] < limits.min_mean_chars * m["n_words"])
        | (m["word_chars"] > limits.max_mean_chars * m["n_words"]),
    }
    bits = F.lit(0).cast("long")
    for rule, bit in RULE_BITS.items():
        bits = bits + F.when(failed[rule], F.lit(1 << bit)).otherwise(F.lit(0))
    return bits


def rule_ledger(docs: DataFrame, text: str = "text", out: str = "ledger", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with the struct ``out``: the measurements, and ``bits`` with one bit per failed rule."""
    measured = let(
        measurements(text_of(text)),
        lambda m: F.struct(m.alias("measured"), failure_bits(m, limits).alias("bits")),
    )
    return docs.withColumn(out, measured)


def verdict(bits: Column, policy: str = CURRENT) -> Column:
    """Whether a policy keeps the document: none of its rules failed."""
    return bits.bitwiseAND(F.lit(mask_of(policy))) == 0


def apply_policy(ledger: DataFrame, policy: str = CURRENT, out: str = "ledger") -> DataFrame:
    """The rows that a policy keeps, without reading their texts again."""
    return ledger.where(verdict(F.col(out)["bits"], policy))


def ablations(ledger: DataFrame, out: str = "ledger") -> DataFrame:
    """For every policy and rule of it: documents failing the rule, and those that only this rule rejects.

    Documents are first counted by bit pattern, of which there are at most two to the number of rules.
    """
    counted = ledger.groupBy(F.col(out)["bits"].alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(
        *[
            F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(1 << RULE_BITS[r]).cast("long").alias("bit"), F.lit(mask_of(p)).cast("long").alias("mask"))
            for p, rules in POLICIES.items()
            for r in rules
        ]
    )
    rows = counted.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    masked = F.col("bits").bitwiseAND(F.col("mask"))
    return rows.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(masked.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(masked == F.col("bit")).alias("n_only_this_rule"),
    )
