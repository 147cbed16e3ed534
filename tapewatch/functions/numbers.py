"""Numeric helpers: results are SQL NULL where undefined, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(col: Column) -> Column:
    """Text or number as double; null when it is not a number."""
    return col.try_cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def log_of(col: Column) -> Column:
    return F.log1p(zero_if_null(col))


def finite(col: Column) -> Column:
    """NaN and infinities, as found in imported files, become null."""
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def decision(probability: Column, threshold: float = 0.5) -> Column:
    return F.when(probability > threshold, 1).otherwise(0)


# Fixed value: keeps logarithms of probabilities finite.
LOG_FLOOR = 1e-8


def focal_terms(score: Column, label: Column, alpha: float, gamma: float) -> dict[str, Column]:
    """Focal-loss quantities of one raw score, for reporting the mean loss of a model."""
    p = sigmoid(score)
    is_positive = label == 1
    p_true = F.when(is_positive, p).otherwise(1 - p)
    side_weight = F.when(is_positive, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    weight = side_weight * F.pow(1 - p_true, F.lit(gamma))
    cross_entropy = -F.when(is_positive, F.ln(p + LOG_FLOOR)).otherwise(F.ln(1 - p + LOG_FLOOR))
    return {
        "focal_weight": weight,
        "focal_loss": weight * cross_entropy,
        "focal_gradient": weight * (p - label),
        "focal_hessian": weight * p * (1 - p) * (F.lit(gamma) * (label - p) + 1),
    }
