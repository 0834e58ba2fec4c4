"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_WEIGHTS = (0.52, 0.38, 0.10)
FEATURE_WEIGHTS = (0.0, 0.90, 0.10)


def clipped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def calibrated(x: Column, floor: float = 0.15, span: float = 0.20) -> Column:
    return clipped((x - floor) / span)


def mixed(dense: Column, sparse: Column, weight: float = 0.65) -> Column:
    return weight * dense + (1 - weight) * sparse


def noisy_or(text: Column, image: Column, context: Column, weights: tuple[float, float, float] = TEXT_WEIGHTS) -> Column:
    """1 - product of (1 - weight * score): agreement adds up, and no modality erases another."""
    a, b, c = (1 - clipped(w * s) for w, s in zip(weights, (text, image, context), strict=True))
    return 1 - a * b * c


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
