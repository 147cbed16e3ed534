"""Exact evaluation of scores, distributed.

Rows are first reduced to one row per distinct score, the only thing ranking metrics depend on. All
functions take ``groups``: the metric is computed per combination, or overall when empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.operators.ordered import exact_quantiles, join_on, running_totals, small_side

# Shares of the precision-at-top-k report, its variants, and the threshold sweep.
TOP_SHARES = (0.001, 0.005, 0.01, 0.05)
WIDE_TOP_SHARES = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1)
SWEEP_FROM, SWEEP_TO, SWEEP_STEPS = -6.0, -1.0, 100

SCORE, LABEL = "predicted_proba", "y_label"


def _scoped(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant group when none is asked for, so that overall and grouped runs share one way."""
    return (df, list(groups)) if groups else (df.withColumn("_all", F.lit(0)), ["_all"])


def score_steps(df: DataFrame, groups: Sequence[str] = (), score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Per distinct score, best first: its rows and positives, running totals, and group totals."""
    scoped, keys = _scoped(df, groups)
    is_positive = F.when(F.col(label) == 1, 1).otherwise(0)
    counted = (
        scoped.where(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(is_positive).alias("positives"))
    )
    return with_running_totals(counted, keys)


def with_running_totals(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` and ``positives`` per score with their running and group totals."""
    return running_totals(
        counted,
        keys,
        [F.col("score").desc()],
        {"rows_upto": F.col("rows"), "positives_upto": F.col("positives")},
        {"all_rows": "rows_upto", "all_positives": "positives_upto"},
    )


def ranking_quality(df: DataFrame, groups: Sequence[str] = (), score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Average precision and area under the ROC curve (ties count half) per group."""
    keys = list(groups) or ["_all"]
    return quality_of_steps(score_steps(df, groups, score, label), keys).drop("_all")


def quality_of_steps(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    negatives = F.col("rows") - F.col("positives")
    precision = F.col("positives_upto") / F.col("rows_upto")
    ahead = F.col("positives_upto") - F.col("positives") / 2
    # pairs of a positive and a negative row are more than a long holds
    pairs = F.max("all_positives").cast("double") * (F.max("all_rows") - F.max("all_positives"))
    return steps.groupBy(*keys).agg(
        F.max("all_rows").alias("samples"),
        F.max("all_positives").alias("positives"),
        F.try_divide(F.sum(F.col("positives") * precision), F.max("all_positives")).alias("pr_auc"),
        F.try_divide(F.sum(negatives * ahead), pairs).alias("roc_auc"),
    )


def top_share_precision(
    df: DataFrame,
    ids: Sequence[str],
    shares: Sequence[float] = TOP_SHARES,
    groups: Sequence[str] = (),
    score: str = SCORE,
    label: str = LABEL,
) -> DataFrame:
    """Precision among the k best-scored rows for every share at once, its ceiling and achievement.

    k is the share of rows, at least 1. Rows tied at the last score are taken in order of ``ids``;
    only those tied rows are looked at individually.
    """
    steps = score_steps(df, groups, score, label)
    keys = list(groups) or ["_all"]
    k_of = F.array(*[F.struct(F.lit(s).alias("share"), F.greatest(F.lit(1), F.floor(F.col("all_rows") * s)).alias("k")) for s in shares])
    edges = (
        steps.withColumn("_k", F.explode(k_of))
        .select("*", "_k.share", F.col("_k.k").alias("k"))
        .where((F.col("rows_upto") >= F.col("k")) & (F.col("rows_upto") - F.col("rows") < F.col("k")))
        .select(
            *keys,
            "share",
            "k",
            "score",
            "all_positives",
            (F.col("k") - F.col("rows_upto") + F.col("rows")).alias("take"),
            (F.col("positives_upto") - F.col("positives")).alias("hits_before"),
        )
    )
    edges = small_side(edges)
    scoped, _ = _scoped(df, groups)
    cuts = small_side(edges.select(*keys, "score").distinct())
    tied = join_on(
        scoped.select(*keys, F.col(score).alias("score"), *ids, F.when(F.col(label) == 1, 1).otherwise(0).alias("_hit")),
        cuts,
        [*keys, "score"],
        "left_semi",
    )
    placed = running_totals(
        tied, [*keys, "score"], [F.col(c) for c in ids], {"_place": F.lit(1), "_hits": F.col("_hit")}
    )
    last = join_on(
        placed.select(*keys, "score", F.col("_place").alias("take"), "_hits"), edges, [*keys, "score", "take"], "inner"
    )
    precision = (F.col("hits_before") + F.col("_hits")) / F.col("k")
    ceiling = F.least(F.col("all_positives") / F.col("k"), F.lit(1.0))
    achievement = F.coalesce(F.try_divide(precision, ceiling), F.lit(0.0))
    return last.select(
        *groups,
        "share",
        "k",
        F.col("score").alias("score_at_k"),
        precision.alias("precision"),
        ceiling.alias("ceiling"),
        achievement.alias("achievement"),
    )


def curve_points(df: DataFrame, groups: Sequence[str] = (), score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Precision-recall and ROC points, one per distinct score, and the rate of positives.

    The end point of the precision-recall curve, recall 0 at precision 1, has no threshold.
    """
    steps = score_steps(df, groups, score, label)
    false_upto = F.col("rows_upto") - F.col("positives_upto")
    points = steps.select(
        *groups,
        F.col("score").alias("threshold"),
        (F.col("positives_upto") / F.col("rows_upto")).alias("precision"),
        F.try_divide(F.col("positives_upto"), F.col("all_positives")).alias("recall"),
        F.try_divide(false_upto, F.col("all_rows") - F.col("all_positives")).alias("false_positive_rate"),
        (F.col("all_positives") / F.col("all_rows")).alias("baseline"),
    )
    ends = points.groupBy(*groups).agg(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(0.0).alias("false_positive_rate"),
        F.max("baseline").alias("baseline"),
    )
    return points.unionByName(ends)


def sweep_thresholds() -> list[float]:
    step = (SWEEP_TO - SWEEP_FROM) / (SWEEP_STEPS - 1)
    return [10.0 ** (SWEEP_FROM + i * step) for i in range(SWEEP_STEPS)]


def _thresholds_met(score: Column, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds a score reaches, by halving the list."""

    def reached(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(score >= thresholds[middle], reached(middle + 1, high)).otherwise(reached(low, middle))

    return reached(0, len(thresholds))


def threshold_sweep(
    df: DataFrame, thresholds: Sequence[float] | None = None, score: str = SCORE, label: str = LABEL
) -> DataFrame:
    """Confusion counts, precision, recall and F1 at every threshold; ``is_best`` marks the best F1.

    Each row is counted once, under the number of thresholds it meets; the counts per threshold are
    sums over that table of at most one row more than there are thresholds.
    """
    cuts = list(thresholds or sweep_thresholds())
    is_positive = F.when(F.col(label) == 1, 1).otherwise(0)
    met = small_side(
        df.where(F.col(score).isNotNull()).groupBy(_thresholds_met(F.col(score), cuts).alias("met")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(is_positive).alias("positives")
        )
    )
    grid = df.sparkSession.createDataFrame(list(enumerate(cuts)), "step int, threshold double")
    counted = met.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))))
    predicted = F.col("met") > F.col("step")
    at_step = counted.groupBy("step").agg(
        F.sum(F.when(predicted, F.col("positives")).otherwise(0)).alias("tp"),
        F.sum(F.when(predicted, F.col("rows") - F.col("positives")).otherwise(0)).alias("fp"),
        F.sum(F.when(predicted, 0).otherwise(F.col("positives"))).alias("fn"),
        F.sum(F.when(predicted, 0).otherwise(F.col("rows") - F.col("positives"))).alias("tn"),
    )
    rates = with_rates(at_step)
    best = rates.agg(F.min_by("step", F.struct(-F.col("f1"), F.col("step"))).alias("_best"))
    marked = rates.join(F.broadcast(best), F.col("step") == F.col("_best"), "left")
    return (
        marked.join(F.broadcast(grid), "step")
        .withColumn("is_best", F.when(F.col("_best").isNotNull(), 1).otherwise(0))
        .drop("_best")
    )


def with_rates(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp and fn; 0 where undefined."""
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero)
    rated = df.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero
    )
    return rated.withColumn("f1", f1)


def confusion(
    df: DataFrame, threshold: float = 0.5, group: str | None = None, score: str = SCORE, label: str = LABEL
) -> DataFrame:
    """Confusion counts per group and overall in one pass; ``scope`` tells the total from a null group.

    Rows without a score are no prediction and are not counted, here and in the threshold sweep.
    """
    predicted, actual = F.col(score) > threshold, F.col(label) == 1
    counts = [
        F.count_if(~predicted & ~actual).alias("tn"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(predicted & actual).alias("tp"),
    ]
    scored = df.where(F.col(score).isNotNull())
    if not group:
        return scored.agg(*counts)
    return scored.rollup(group).agg(scope_of(group), *counts)


def scope_of(group: str) -> Column:
    return F.when(F.grouping(group) == 1, "total").otherwise(group).alias("scope")


def classification_report(df: DataFrame, threshold: float = 0.5, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted rows."""
    one = confusion(df, threshold, None, score, label)
    per_class = F.array(
        F.struct(F.lit("0").alias("class"), F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("fp").alias("fn")),
        F.struct(F.lit("1").alias("class"), F.col("tp").alias("tp"), F.col("fp").alias("fp"), F.col("fn").alias("fn")),
    )
    classes = with_rates(one.select(F.explode(per_class).alias("c")).select("c.*"))
    classes = classes.withColumn("support", F.col("tp") + F.col("fn"))
    measures = ["precision", "recall", "f1"]
    weight = F.col("support")
    # each class stands in its own row and in the three summaries: one pass over one evaluation
    summaries = ("accuracy", "macro avg", "weighted avg")
    rows = classes.withColumn("class", F.explode(F.array("class", *[F.lit(name) for name in summaries])))
    share = F.try_divide(F.sum("tp"), F.sum("support"))

    def of(measure: str) -> Column:
        weighted = F.try_divide(F.sum(F.col(measure) * weight), F.sum(weight))
        return F.when(F.col("class") == summaries[0], share).when(F.col("class") == summaries[2], weighted).otherwise(F.avg(measure)).alias(measure)

    return rows.groupBy("class").agg(*[of(m) for m in measures], F.sum("support").alias("support"))


def top_share_rows(
    df: DataFrame, share: float, groups: Sequence[str] = ("ticker", "trade_date"), score: str = SCORE
) -> DataFrame:
    """Rows scoring at or above the (1 - share) quantile of their group."""
    scoped, keys = _scoped(df, groups)
    cut = exact_quantiles(scoped, keys, score, {"_cut": 1 - share})
    kept = join_on(scoped, small_side(cut), keys, "inner").where(F.col(score) >= F.col("_cut"))
    return kept.select(*df.columns)


def score_ecdf(df: DataFrame, ids: Sequence[str], score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Empirical distribution of scores per class: the i-th smallest of n rows has y = i / n."""
    rows = df.where(F.col(score).isNotNull()).select(label, score, *ids)
    placed = running_totals(rows, [label], [F.col(score), *[F.col(c) for c in ids]], {"_place": F.lit(1)})
    size = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    sized = join_on(placed, small_side(size), [label], "inner")
    return sized.withColumn("ecdf", F.col("_place") / F.col("_size")).drop("_place", "_size")


def best_ranked(df: DataFrame, ids: Sequence[str], n: int = 5000, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """The n best-scored rows with their rank from 0 (the report's scatter of top scores)."""
    order = [F.col(score).desc(), *[F.col(c) for c in ids]]
    top = df.select(*ids, score, label).orderBy(*order).limit(n)
    return running_totals(top, [], order, {"_place": F.lit(1)}).withColumn("rank", F.col("_place") - 1).drop("_place")


def score_histogram(df: DataFrame, bins: int = 50, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Equal-width histogram of scores per class over the class's own range, with densities.

    The last bin includes its right edge; a class with a single value gets a range of width 1 around it.
    """
    ends = df.where(F.col(score).isNotNull()).groupBy(label).agg(
        F.min(score).alias("_low"), F.max(score).alias("_high"), F.count(score).alias("_size")
    )
    flat = F.col("_low") == F.col("_high")
    ends = ends.withColumns(
        {
            "_from": F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low")),
            "_width": F.when(flat, F.lit(1.0)).otherwise(F.col("_high") - F.col("_low")) / bins,
        }
    )
    placed = join_on(df.where(F.col(score).isNotNull()).select(label, score), small_side(ends), [label], "inner")
    index = F.least(F.lit(bins - 1), F.floor((F.col(score) - F.col("_from")) / F.col("_width"))).cast("int")
    counted = placed.groupBy(label, index.alias("bin"), "_from", "_width", "_size").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return counted.select(
        label,
        "bin",
        (F.col("_from") + F.col("bin") * F.col("_width")).alias("bin_from"),
        "rows",
        (F.col("rows") / (F.col("_size") * F.col("_width"))).alias("density"),
    )


def score_box(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Quartiles and whiskers (most extreme values within 1.5 interquartile ranges) per class."""
    quartiles = exact_quantiles(df, [label], score, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    placed = join_on(df.select(label, score), small_side(quartiles), [label], "inner")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    value = F.col(score)
    return placed.groupBy(label, "q1", "median", "q3").agg(
        F.min(F.when(value >= F.col("q1") - reach, value)).alias("whisker_low"),
        F.max(F.when(value <= F.col("q3") + reach, value)).alias("whisker_high"),
    )


def evaluation(
    df: DataFrame, ids: Sequence[str], groups: Sequence[str] = (), shares: Sequence[float] = TOP_SHARES
) -> DataFrame:
    """All ranking metrics as a tall table: (group columns, metric, value).

    Groups without a positive row are left out, overall metrics are always given.
    """
    quality = ranking_quality(df, groups)
    if groups:
        quality = quality.where(F.col("positives") > 0)
    tall = quality.select(
        *groups,
        F.explode(
            F.create_map(
                F.lit("PR-AUC"), F.col("pr_auc"),
                F.lit("ROC-AUC"), F.col("roc_auc"),
                F.lit("samples"), F.col("samples").cast("double"),
                F.lit("positives"), F.col("positives").cast("double"),
            )
        ).alias("metric", "value"),
    )
    top = top_share_precision(df, ids, shares, groups)
    if groups:
        top = join_on(top, small_side(quality.select(*groups)), list(groups), "left_semi")
    name = F.concat(F.lit("Precision@"), F.format_string("%.1f", F.col("share") * 100), F.lit("%"))
    top_tall = top.select(
        *groups,
        F.explode(
            F.create_map(
                name, F.col("precision"),
                F.concat(name, F.lit("_max")), F.col("ceiling"),
                F.concat(name, F.lit("_achievement")), F.col("achievement"),
            )
        ).alias("metric", "value"),
    )
    return tall.unionByName(top_tall)
