"""Interval metrics as aggregate builders over consecutive interval pairs.

Input rows: ``isi`` (interval ending at an event) and ``nxt`` (the following interval of the same window,
NULL for the last one). ``size`` names the input whose count gates the metric: pairs or single intervals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import correlation, ratio

# Fixed value: refractoriness constant of LvR, in seconds.
REFRACTORY_S = 0.005


def _pairs_only(c: Column) -> Column:
    return F.when(F.col("nxt").isNotNull(), c)


def burstiness(x: str = "isi") -> Column:
    """(sd - mean) / (sd + mean) with the population sd."""
    sd, mu = F.stddev_pop(x), F.avg(x)
    return ratio(sd - mu, sd + mu)


def memory() -> Column:
    """Pearson correlation of consecutive intervals."""
    return correlation("isi", "nxt")


def local_variation() -> Column:
    d, s = F.col("isi") - F.col("nxt"), F.col("isi") + F.col("nxt")
    return 3 * F.avg(_pairs_only(F.pow(ratio(d, s), 2)))


def local_variation_refractory(r: float = REFRACTORY_S) -> Column:
    a, b = F.col("isi"), F.col("nxt")
    s = a + b
    shape = F.lit(1.0) - ratio(4 * a * b, s * s)
    return 3 * F.avg(_pairs_only(shape * (F.lit(1.0) + ratio(F.lit(4.0 * r), s))))


def cv2() -> Column:
    d, s = F.col("nxt") - F.col("isi"), F.col("nxt") + F.col("isi")
    return 2 * F.avg(_pairs_only(ratio(F.abs(d), F.abs(s))))


def log_ratio() -> Column:
    """Mean absolute log ratio of consecutive intervals."""
    return F.avg(_pairs_only(F.abs(F.ln(ratio("nxt", "isi")))))


def gamma_log_shape(x: str = "isi") -> Column:
    """ln of the two-parameter gamma shape, closed form from mean(x) and mean(ln x)."""
    s = F.ln(F.avg(x)) - F.avg(F.ln(x))
    k = ratio((F.lit(3.0) - s) + F.sqrt(F.pow(s - 3, 2) + 24 * s), 12 * s)
    return F.ln(k)


# name -> (aggregate builder, gating input). Order-based metrics (rho, rate) are built in operators.trains.
INTERVAL_METRICS: dict[str, tuple[Callable[[], Column], str]] = {
    "m": (memory, "nxt"),
    "b": (burstiness, "isi"),
    "lv": (local_variation, "nxt"),
    "lvr": (local_variation_refractory, "nxt"),
    "cv2": (cv2, "nxt"),
    "ir": (log_ratio, "nxt"),
    "lkappa": (gamma_log_shape, "isi"),
}


def gated(name: str, min_n: int) -> Column:
    """The metric, NULL unless its gating input has at least ``min_n`` values."""
    build, size = INTERVAL_METRICS[name]
    return F.when(F.count(size) >= min_n, build())
