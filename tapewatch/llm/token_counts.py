"""Token counts of every prefix of a text.

For byte-pair merges the ids of a prefix follow from those of a shorter one: the last token of a prefix is
the one token that may stand after the last token of what precedes it. That dynamic programme gives the
exact count at every prefix of a piece in one walk. The table of a text holds one signed byte per
character, the step of the count, so truncation and budget questions are sums over the table and the text
is not encoded again.

Defined cases: a null text counts as the empty one with no token; repeated rows are counted one by one; a
column named like the output is replaced; an empty table stays empty; special strings inside a text are one
token, as the library does by default; a text of any length is counted whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.runtime import text_of
from tapewatch.llm.tokenizing import WHITE, Remembered, byte_alphabet, load, one_piece, units

TOKENIZER = "byte_bpe_50k.json"
#: Token pairs whose compatibility one Python worker remembers.
REMEMBERED_PAIRS = 500_000
#: Pieces that are cut differently while only their first two characters are there.
LATE_PIECES = ("'re", "'ve", "'ll")



class PrefixCounter:
    """Steps of the token count, one signed byte per character, for whole texts."""

    def __init__(self, name: str):
        self.tokenizer = load(name)
        self.vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.longest = max(map(len, self.vocabulary))
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memory = Remembered(lambda new: [array("b", map(sub, counts := self.unit(u), [0, *counts])).tobytes() for u in new])

    def steps(self, texts: list[str]) -> list[bytes]:
        return list(map(self.memory.joined, texts))

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are when merged side by side."""
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        found = [t.value for t in self.tokenizer.model.tokenize(left + right)] == [left, right]
        self.pairs[left, right] = found
        return found

    def piece(self, piece: str) -> list[int]:
        """The count after each character of one piece."""
        raw = piece.encode()
        mapped = raw.decode("latin-1").translate(self.alphabet)
        vocabulary, pairs, longest = self.vocabulary, self.pairs, self.longest
        counts, last = [0], [""]
        for end in range(1, len(mapped) + 1):
            for start in range(max(0, end - longest), end):
                token = mapped[start:end]
                if token in vocabulary:
                    if not start:
                        break
                    fits = pairs.get((last[start], token))
                    if fits or (fits is None and self.may_follow(last[start], token)):
                        break
            counts.append(counts[start] + 1)
            last.append(token)
        if len(raw) == len(piece):
            return counts[1:]
        return [counts[e] for e in accumulate(len(c.encode()) for c in piece)]

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def unit(self, unit: str) -> list[int]:
        """The count after each character of a unit."""
        if one_piece(unit):
            return self.piece(unit)
        special = min((s for s in self.specials if s in unit), key=unit.index, default=None)
        if special is not None:
            return self.with_special(unit, special)
        spaces = len(unit) - len(unit.lstrip(WHITE))
        # while nothing but white space is there, it is one piece
        counts = self.piece(unit[:spaces]) if spaces else []
        base = 0
        for piece, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit):
            own = self.piece(unit[start:end])
            if unit[start:end] in LATE_PIECES:
                own[1] = own[0] + self.piece(unit[start + 1])[0]
            counts += [base + c for c in own[max(0, spaces - start) :]]
            base += own[-1]
        return counts

    def with_special(self, unit: str, special: str) -> list[int]:
        head, _, rest = unit.partition(special)
        counts = self.several(head)
        counts += [self.whole(head + special[:k]) for k in range(1, len(special))]
        counts.append(self.whole(head) + 1)
        return counts + [counts[-1] + c for c in self.several(rest)]

    def several(self, text: str) -> list[int]:
        counts: list[int] = []
        for unit in units(text):
            base = counts[-1] if counts else 0
            counts += [base + c for c in self.unit(unit)]
        return counts


@lru_cache(maxsize=2)
def prefix_counter(name: str) -> PrefixCounter:
    return PrefixCounter(name)


def prefix_counts(docs: DataFrame, text: str = "text", out: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with the struct ``out``: ``n_bytes``, ``n_tokens`` and the table ``steps``."""

    @F.pandas_udf("n_tokens long, steps binary")
    def table(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = prefix_counter(tokenizer)
        for batch in texts:
            steps = counter.steps(batch.tolist())
            totals = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            yield pd.DataFrame({"n_tokens": totals, "steps": steps})

    counted = docs.withColumn(out, table(text_of(text)))
    return counted.withColumn(out, F.struct(F.octet_length(text_of(text)).cast("long").alias("n_bytes"), F.col(f"{out}.n_tokens"), F.col(f"{out}.steps")))


def tokens_of_prefix(steps: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, from the table; a longer prefix is the whole text."""

    @F.pandas_udf("long")
    def answer(tables: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(t, np.int8)[: max(0, k)].sum(dtype=np.int64)) for t, k in zip(tables, sizes)], dtype="int64")

    return answer(steps, n_chars)


def longest_prefix(steps: Column, budget: Column) -> Column:
    """The largest number of characters whose prefix needs at most ``budget`` tokens."""

    @F.pandas_udf("long")
    def answer(tables: pd.Series, budgets: pd.Series) -> pd.Series:
        fit = []
        for t, budget in zip(tables, budgets):
            within = np.flatnonzero(np.cumsum(np.frombuffer(t, np.int8), dtype=np.int64) <= budget)
            fit.append(int(within[-1]) + 1 if len(within) else 0)
        return pd.Series(fit, dtype="int64")

    return answer(steps, budget)
