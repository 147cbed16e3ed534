"""SimHash fingerprints and their near-duplicates by pigeonring filtering.

The 64 bits of a fingerprint are ``SEGMENTS`` segments on a ring. If two fingerprints differ in at most ``t``
bits, some chain of consecutive segments starts so that its first ``l`` segments differ in at most
``l * t / SEGMENTS`` bits together, for every ``l``. The segments in which such a chain may differ are
therefore few, and all others are equal: each fingerprint is filed under the equal segments of every such
pattern, fingerprints filed together are tested against the cumulative budgets along their chain, and then the
full distance is taken. Fingerprints filed together differ in the bits of the open segments only, so their
number is bounded whatever the data, and links are found by flipping open bits, not by comparing pairs.
A group reports its members with their smallest one, so many copies give few links.

Equal fingerprints are one node. Components come from all links.

Defined cases: words are separated by ASCII white space, A to Z are lower-cased; a text with fewer words than a
shingle has is one shingle; a null or empty text or one of white space has fingerprint zero and is linked like any
other; repeated rows are nodes of the same component; a null key is never the smallest; an empty table gives an
empty result; a text of any length is hashed whole; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.components import connected, groups_of
from tapewatch.llm.runtime import text_of
from tapewatch.session import staged

SEED = 42
SEGMENTS = 8
WIDTH = 64 // SEGMENTS
MAX_BITS = 2
#: Rows that a task links at a time; a group that goes on is carried over.
LINKED_ROWS = 100_000
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 16


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """The hash of every shingle of ``size`` words, in order; none of a text without words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    count = max(1, len(words) - size + 1)
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, count)


def fingerprint(text: str, size: int) -> int:
    """Bits set in over half of the shingles' hashes, as a signed 64-bit integer."""
    hashes = shingle_hashes(text, size)
    count = len(hashes)
    if not count:
        return 0
    sums = np.zeros(64, np.int64)
    for k in range(0, count, COUNTED):
        bits = np.unpackbits(hashes[k : k + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * sums > count, bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", size: int = 5) -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint ``out`` of word shingles of ``size`` words."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return docs.withColumn(out, of(text_of(text)))


def open_patterns(max_bits: int) -> list[tuple[int, ...]]:
    """Segments in which a chain may differ, as steps from its start.

    The ``k``-th differing bit needs a budget of ``k``, so it lies in no earlier segment than the one where
    ``l * max_bits / SEGMENTS`` reaches ``k``.
    """
    first = [-(-k * SEGMENTS // max_bits) - 1 for k in range(1, max_bits + 1)]
    patterns = combinations(range(SEGMENTS), max_bits)
    return [p for p in patterns if all(at >= least for at, least in zip(p, first))]


def filings(max_bits: int) -> list[tuple[tuple[int, ...], int]]:
    """For each start and pattern: the open segments along the chain, and the mask of the equal bits."""
    whole = (1 << 64) - 1
    found = []
    for start, pattern in product(range(SEGMENTS), open_patterns(max_bits)):
        segments = tuple((start + step) % SEGMENTS for step in pattern)
        free = sum(((1 << WIDTH) - 1) << (WIDTH * s) for s in segments)
        found.append((segments, whole ^ free))
    return found


def flips(max_bits: int) -> np.ndarray:
    """Differences within the budgets, over the open bits side by side in the order of the chain."""
    found = []
    for n in range(1, max_bits + 1):
        for bits in combinations(range(WIDTH * max_bits), n):
            # the k-th open segment is reached with k differences at most
            if all(sum(b // WIDTH <= k for b in bits) <= k + 1 for k in range(max_bits)):
                found.append(sum(1 << b for b in bits))
    return np.array(found, np.int64)


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a``, ``b`` that join all distinct ``fingerprint`` values at ``max_bits`` or fewer differences."""
    filed_under = filings(max_bits)
    masks, moves = [np.uint64(m) for _, m in filed_under], flips(max_bits)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fingerprint"].to_numpy(np.int64).view(np.uint64)
            for k, mask in enumerate(masks):
                yield pd.DataFrame({"filing": np.int16(k), "fixed": (values & mask).view(np.int64), "fingerprint": batch["fingerprint"]})

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        filing, fixed = rows["filing"].to_numpy(), rows["fixed"].to_numpy()
        new = np.r_[True, (filing[1:] != filing[:-1]) | (fixed[1:] != fixed[:-1])]
        group = np.cumsum(new) - 1
        shared = np.bincount(group)[group] > 1
        filing, group, values = filing[shared], group[shared], rows["fingerprint"].to_numpy(np.int64)[shared]
        if not len(values):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        bare, free = values.view(np.uint64), np.zeros(len(values), np.int64)
        for k in np.unique(filing):
            own = filing == k
            for place, segment in enumerate(filed_under[k][0]):
                part = (bare[own] >> np.uint64(WIDTH * segment)) & np.uint64((1 << WIDTH) - 1)
                free[own] |= part.astype(np.int64) << (WIDTH * place)
        code = (group << (WIDTH * max_bits)) | free
        order = np.argsort(code)
        code, values = code[order], values[order]
        at, to = [], []
        for move in moves:
            wanted = code ^ move
            place = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
            hit = np.flatnonzero(code[place] == wanted)
            at.append(hit)
            to.append(place[hit])
        low = groups_of(np.concatenate(at), np.concatenate(to), len(code))
        member = low != np.arange(len(low))
        return pd.DataFrame({"a": values[low[member]], "b": values[member]}).drop_duplicates()

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= LINKED_ROWS:
                rows = pd.concat(held, ignore_index=True)
                last = rows.iloc[-1]
                goes_on = (rows["filing"] == last["filing"]) & (rows["fixed"] == last["fixed"])
                if not goes_on.all():
                    yield linked(rows[~goes_on])
                held = [rows[goes_on]]
        if sum(map(len, held)):
            yield linked(pd.concat(held, ignore_index=True))

    filed = prints.select("fingerprint").mapInPandas(file, "filing short, fixed long, fingerprint long")
    dealt = filed.repartition("filing", "fixed").sortWithinPartitions("filing", "fixed")
    return dealt.mapInPandas(link, "a long, b long")


def near_duplicates(prints: DataFrame, key: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``prints`` with ``root``, the fingerprint that names its component, and ``component_id``, the smallest ``key`` in it."""
    nodes = prints.groupBy("fingerprint").agg(F.min(key).alias("smallest"))
    nodes = staged(nodes)
    found = connected(links(nodes, max_bits))
    rooted = nodes.join(found, nodes["fingerprint"] == found["node"], "left").select(
        "fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root")
    )
    of_root = rooted.where("root <> fingerprint").groupBy("root").agg(F.min("smallest").alias("of_others"))
    firsts = rooted.where("root = fingerprint").join(of_root, "root", "left").select("root", F.least("smallest", "of_others").alias("component_id"))
    named = rooted.select("fingerprint", "root").join(firsts, "root").select("fingerprint", "root", "component_id")
    return prints.join(named, "fingerprint")
