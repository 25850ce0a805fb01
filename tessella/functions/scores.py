"""Score algebra over array<double> columns and scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the score algebra (fixed values).
EPS = 1e-6
LEAST_NORM = 1e-12
LEAST_MAD = 1e-5
ANCHOR_WEIGHT = 0.35
RESIDUAL_GAIN = 0.075


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column, eps: float = LEAST_NORM) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column, eps: float = LEAST_NORM) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def calibrated(cos: Column, scale: Column, bias: Column) -> Column:
    """exp(min(scale, ln 100)) * cos + bias."""
    return F.exp(F.least(scale, F.lit(math.log(100)))) * cos + bias


def normalise_row(scores: Column, method: str, eps: float = EPS) -> Column:
    """none, row_l2 or row_zscore (with the sample deviation) of an array; a row of one score has no deviation and gives NaN."""
    if method == "none":
        return scores
    if method == "row_l2":
        return l2_normalise(scores, eps)
    if method == "row_zscore":
        n = F.size(scores)
        mean = total(scores) / n
        spread = F.when(n > 1, F.sqrt(total(F.transform(scores, lambda x: (x - mean) * (x - mean))) / F.greatest(n - 1, F.lit(1)))).otherwise(F.lit(float("nan")))
        return F.transform(scores, lambda x: (x - mean) / F.greatest(spread, F.lit(eps)))
    raise ValueError(f"unknown normalisation {method}")


def anchor_fusion(a: Column, b: Column, weight: float = ANCHOR_WEIGHT, method: str = "row_zscore") -> Column:
    """(1 - weight) * norm(a) + weight * norm(b)."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("weight must be in [0, 1]")
    return F.zip_with(normalise_row(a, method), normalise_row(b, method), lambda x, y: F.lit(1.0 - weight) * x + F.lit(weight) * y)


def residual_gain(observed: Column, zero: Column, gain: float = RESIDUAL_GAIN) -> Column:
    return observed + F.lit(gain) * (observed - zero)


def robust_tail(hr: Column, lr: Column, hr_mad: Column, lr_median: Column, lr_mad: Column, positive: float, negative: float, threshold: float) -> Column:
    """hr plus what lies in the tails of lr: z beyond the threshold on either side, in units of hr_mad."""
    if min(positive, negative, threshold) < 0:
        raise ValueError("weights and threshold must not be negative")
    z = (lr - lr_median) / F.greatest(lr_mad, F.lit(LEAST_MAD))
    above, below = F.greatest(z - threshold, F.lit(0.0)), F.greatest(-z - threshold, F.lit(0.0))
    return hr + hr_mad * (positive * above - negative * below)
