"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell: source, language and topic. The counts are raked: in turn each of the three
marginals is scaled to its target shares, until all three hold together. The factor that a cell has gathered says
how much more or less of it is wanted; divided by the largest it is the probability with which a document of the
cell is taken, so no document is wanted more than once. The draw is a hash of the document's key: a rerun or a
lost task takes the same documents.

Divided by the largest factor of all, one scarce cell would set how much of the corpus stays. Where a share
``scarce`` is given, the total is the largest that the targets allow on cells of at least that share of all
tokens; smaller cells are taken whole where they are wanted more than once, and all others are raked again to what is
left of the targets, until the marginals are within ``TOLERANCE`` of them or come no nearer.

Cells are few beside documents and are the only thing that the rounds touch.

Defined cases: a null source, language or topic is a value of its own; a null text has no tokens; a marginal value
without tokens keeps the factor 1; a value missing from given targets has target 0; rows with one key share
their draw; an empty table gives an empty result; columns named like the outputs are replaced.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.runtime import text_of, words_of
from tapewatch.operators.ordered import small_side
from tapewatch.session import staged

log = logging.getLogger(__name__)

ROUNDS = 6
#: Rounds between two writes of the cells.
STAGED_ROUNDS = 2
#: Cells below this share of all tokens do not set the total.
SCARCE = 0.001
#: Error of the marginals that ends the fitting: tokens that would have to move, of all that are taken.
TOLERANCE = 0.001
#: Rounds after which the fitting ends if it still comes nearer.
MOST_ROUNDS = 40
#: The default targets: shares to these powers, so that rare values gain and common ones lose.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Hexadecimal digits of a draw; a double holds them exactly.
DRAW_DIGITS = 13
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """The form of a text, for tables without a topic of their own: table, short, medium or long."""
    n = F.size(words_of(text))
    bars = F.length(text) - F.length(F.translate(text, "|", ""))
    return F.when(10 * bars > n, "table").when(n < 128, "short").when(n < 1024, "medium").otherwise("long")


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``topic`` and ``n_tokens``, words by white space, where the table has none."""
    body = text_of(text)
    for name, value in (("topic", topic_of(body)), ("n_tokens", F.size(words_of(body)).cast("long"))):
        if name not in docs.columns:
            docs = docs.withColumn(name, value)
    return docs


def label(dimension: str) -> Column:
    return F.coalesce(F.col(dimension).cast("string"), F.lit(NONE)).alias(dimension)


def cells_of(docs: DataFrame, dimensions: tuple[str, ...], tokens: str = "n_tokens") -> DataFrame:
    return docs.groupBy(*[label(d) for d in dimensions]).agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("double").alias("n_tokens"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of a marginal from its observed ones."""
    sums = cells.groupBy(dimension).agg(F.sum("n_tokens").alias("n")).where("n > 0")
    total = sums.agg(F.sum(F.pow("n", F.lit(power))).alias("total"))
    return sums.select(dimension, (F.pow("n", F.lit(power)) / total.scalar()).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``factor``: each target is (``dimension``, ``share``) for its dimension."""
    raked = cells.withColumn("factor", F.lit(1.0))
    for d, target in targets.items():
        shares = target.select(F.col(d), F.col("share").alias(f"share_{d}"))
        raked = raked.join(shares, d, "left").fillna({f"share_{d}": 0.0})
    total = cells.agg(F.coalesce(F.sum("n_tokens"), F.lit(0.0)).alias("total")).scalar()
    raked = raked.withColumn("total", total)
    for done in range(1, rounds + 1):
        for d in targets:
            # cells of one marginal value, not documents
            now = F.sum(F.col("n_tokens") * F.col("factor")).over(Window.partitionBy(d))
            step = F.when(now > 0, F.col(f"share_{d}") * F.col("total") / now).otherwise(F.lit(1.0))
            raked = raked.withColumn("factor", F.col("factor") * step)
        if done % STAGED_ROUNDS == 0 or done == rounds:
            raked = staged(raked)
    return raked.select(*cells.columns, "factor")


def probabilities(raked: DataFrame) -> DataFrame:
    """``probability`` of each cell: its factor over the largest one of a cell with tokens."""
    largest = raked.where("n_tokens > 0").agg(F.coalesce(F.max("factor"), F.lit(1.0)).alias("largest")).scalar()
    return raked.withColumn("probability", F.least(F.col("factor") / largest, F.lit(1.0)))


def expected_error(chances: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest distance of a marginal of the tokens taken from its target: the share that would have to move."""
    taken = F.coalesce(F.sum(F.col("n_tokens") * F.col("probability")), F.lit(0.0))
    total = chances.agg(taken.alias("total")).scalar()
    found = [
        chances.groupBy(d).agg(taken.alias("n")).join(target.select(d, "share"), d, "full").agg(
            (F.coalesce(F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce(F.try_divide("n", total), F.lit(0.0)))), F.lit(0.0)) / 2).alias("error")
        )
        for d, target in targets.items()
    ]
    return reduce(DataFrame.unionByName, found).agg(F.max("error")).first()[0]


def fitted(cells: DataFrame, targets: dict[str, DataFrame], scarce: float = SCARCE) -> tuple[DataFrame, float]:
    """``cells`` with ``probability``, and the error of the marginals that they lead to."""
    total = cells.agg(F.coalesce(F.sum("n_tokens"), F.lit(0.0)).alias("total")).scalar()
    raked = rake(cells, targets)
    # without a cell of that share all cells count
    plenty = F.coalesce(F.max(F.when((F.col("n_tokens") > 0) & (F.col("n_tokens") >= scarce * total), F.col("factor"))), F.max(F.when(F.col("n_tokens") > 0, F.col("factor"))), F.lit(1.0))
    scale = raked.agg(plenty.alias("scale")).scalar()
    chances = raked.withColumn("probability", F.least(F.try_divide("factor", scale), F.lit(1.0))).withColumn("wanted", F.try_divide(total, scale))
    chances = chances.fillna(0.0, ["probability"]).withColumn("whole", (F.col("n_tokens") < scarce * total) & (F.col("probability") >= 1))
    for d, target in targets.items():
        chances = chances.join(target.select(d, F.col("share").alias(f"share_{d}")), d, "left").fillna({f"share_{d}": 0.0})
    chances = staged(chances)
    error = expected_error(chances, targets)
    for _ in range(MOST_ROUNDS // STAGED_ROUNDS):
        if error <= TOLERANCE:
            break
        tried = chances
        for _ in range(STAGED_ROUNDS):
            for d in targets:
                # cells of one marginal value, not documents; scarce cells stay whole
                taken, over = F.col("n_tokens") * F.col("probability"), Window.partitionBy(d)
                whole, others = (F.sum(F.when(F.col("whole") == flag, taken).otherwise(0.0)).over(over) for flag in (True, False))
                step = F.try_divide(F.greatest(F.col(f"share_{d}") * F.col("wanted") - whole, F.lit(0.0)), others)
                raised = F.least(F.col("probability") * F.coalesce(step, F.lit(1.0)), F.lit(1.0))
                tried = tried.withColumn("probability", F.when(F.col("whole"), F.lit(1.0)).otherwise(raised))
        tried = staged(tried)
        before, error = error, expected_error(tried, targets)
        if error >= before:
            error = before
            break
        chances = tried
        if before - error < TOLERANCE / 10:
            break
    return chances.select(*cells.columns, "probability"), error


def draw(key: Column) -> Column:
    """A number from 0 up to 1 that depends on the key alone."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def mixed(
    docs: DataFrame, key: str = "doc_id", powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None, scarce: float | None = None
) -> DataFrame:
    """``docs`` with ``probability`` and ``kept``; with a share ``scarce``, smaller cells do not set the total."""
    dimensions = tuple(targets or powers)
    cells = staged(cells_of(docs, dimensions))
    targets = targets or {d: tempered(cells, d, power) for d, power in powers.items()}
    if scarce is None:
        chances = small_side(probabilities(rake(cells, targets)))
    else:
        found, error = fitted(cells, targets, scarce)
        log.info("error of the marginals: %.4f", error)
        chances = small_side(found)
    columns = [c for c in docs.columns if c not in ("probability", "kept")]
    left = docs.select(*columns).alias("doc")
    on = [F.coalesce(F.col(f"doc.{d}").cast("string"), F.lit(NONE)) == F.col(f"chance.{d}") for d in dimensions]
    joined = left.join(chances.alias("chance"), reduce(lambda a, b: a & b, on))
    chance = F.col("chance.probability")
    return joined.select("doc.*", chance.alias("probability"), (draw(F.col(f"doc.{key}")) < chance).alias("kept"))
