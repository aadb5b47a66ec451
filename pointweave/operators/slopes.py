"""The median of all pairwise slopes by randomised selection over inversions."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import magnitude_chunk, percentile_columns, running_rank, scan

SAMPLE = 1 << 16  # slopes a round draws; they are the driver's whole state
STRETCH = 4096  # partners one exploded array holds at most


def theil_sen(df: DataFrame, x: str, y: str, few: int | None = None) -> DataFrame:
    """One row: the median of all pairwise slopes and the intercept median(y) - slope median(x).

    Slopes below s are the inversions between the order by x and the order by ``y - s x``, slopes from lo to hi those
    between two such orders. Each round draws real slopes from the interval that holds the median, takes two of them
    four standard errors around it, counts below both, and so shrinks the interval about 64 times. Once at most
    ``few`` (2 ** 20 + 64 n) pairs are left they are listed and the middle ones read off: n log n rows, exact slopes.

    Rows with a NULL or NaN in either column, and infinite values, are left out. Repeated points count as often as they
    occur, pairs of equal x have no slope. Without any slope both results are NULL. Where more pairs than are listed
    share one slope to within rounding, that slope is the result.
    """
    ends = [F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")]
    real = df.select(*ends).where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    pts = real.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    pts = cut_lineage(scan(pts, [], ["x", "y"], magnitude_chunk("x"), r="row"))
    same = pts.groupBy("x").agg(F.sum("w").alias("c"), F.count(F.lit(1)).alias("d"))
    half = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    head = same.agg(half("c").alias("ties"), F.sum("c").alias("n"), half("d").alias("level"), F.sum("d").alias("m")).first()
    n = head["n"] or 0
    pairs = n * (n - 1) / 2 - (head["ties"] or 0.0)
    if pairs == 0:
        return df.sparkSession.createDataFrame([(None, None)], "slope double, intercept double")
    bits = int(n).bit_length()
    ranks = ((pairs - 1) // 2, pairs // 2)
    lo = hi = None
    # pairs of rows below the interval and below its end; the same in pairs of different points, among which is drawn
    below, upto, slack = 0.0, pairs, 1e-15
    drop, rise = 0.0, head["m"] * (head["m"] - 1) / 2 - head["level"]
    few = (1 << 20) + 64 * n if few is None else few
    while upto - below > few:
        slopes, weights = _drawn(pts, lo, hi, bits, rise - drop)
        part = np.cumsum(weights) / weights.sum()
        spots = [(k - below) / (upto - below) for k in ranks]
        error = 4 * sqrt(max(spots[0] * (1 - spots[0]), 1 / len(part)) / len(part))
        pick = lambda q: float(slopes[min(int(np.searchsorted(part, q)), len(part) - 1)])
        low, middle, high = pick(max(spots[0] - error, 0.0)), pick(spots[0]), pick(min(spots[1] + error, 1.0))
        gap = slack * max(abs(middle), 1.0)
        if low == high and lo is not None and hi is not None and hi - lo <= 2.5 * gap:
            return _with_intercept(real, middle)
        tries = {low, high} if low < middle < high else {low, high, middle - gap, middle + gap}
        counts = _counts(pts, sorted(tries), bits)
        was = upto - below
        fits_low = [s for s in counts if counts[s][0] <= ranks[0] and (lo is None or s > lo)]
        fits_high = [s for s in counts if counts[s][0] > ranks[1] and (hi is None or s < hi)]
        if fits_low:
            lo = max(fits_low)
            below, drop = counts[lo]
        if fits_high:
            hi = min(fits_high)
            upto, rise = counts[hi]
        if upto - below > was / 2:
            slack *= 16  # ties wider than the gap: rounding moved some of them across
    listed = running_rank(_slopes(pts, _tree(_orders(pts, lo, hi), [], bits)), [], "s", weight="w")
    spots = [k - below for k in ranks]
    holds = [(F.col("below") <= k) & (F.col("below") + F.col("n") > k) for k in spots]
    first, second = listed.agg(*[F.max(F.when(h, F.col("s"))) for h in holds]).first()
    return _with_intercept(real, first + (second - first) / 2)


def _with_intercept(real: DataFrame, slope: float) -> DataFrame:
    both = real.select(F.explode(F.array(
        F.struct(F.lit("x").alias("side"), F.col("x").alias("v")), F.struct(F.lit("y").alias("side"), F.col("y").alias("v")))).alias("p")).select("p.*")
    mid = percentile_columns(both, "side", "v", {"m": 0.5})
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("m")))
    return mid.agg(F.lit(slope).alias("slope"), (of("y") - F.lit(slope) * of("x")).alias("intercept"))


def _height(s: Column | float) -> Column:
    return F.col("y") - s * F.col("x")


def _orders(pts: DataFrame, lo: float | None, hi: float | None) -> DataFrame:
    """Both orders as ranks ``r1`` and ``r2``; equal heights stand as in the order before, so only strict turns are inversions."""
    if lo is None:
        first = pts.withColumn("r1", F.col("r"))
    else:
        first = scan(pts.withColumn("z", _height(F.lit(lo))), [], ["z", "r"], magnitude_chunk("z"), r1="row")
    if hi is None:  # beyond every slope: larger x is lower, equal x keep their order
        back = first.withColumn("z", -F.col("x"))
    else:
        back = first.withColumn("z", _height(F.lit(hi)))
    return scan(back, [], ["z", "r1"], magnitude_chunk("z"), r2="row")


def _tree(ranked: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """One row per point and bit level: ``one`` (its bit of ``r2``), ``place`` (ones up to it in its node along ``r1``) and
    ``mass`` (their weight). Two points part at one level; there a zero is inverted with the ``place`` ones before it."""
    lv = ranked.select(*keys, "r", "w", "r1", "r2", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("l"))
    lv = lv.withColumn("node", F.expr("shiftright(r2, l + 1)")).withColumn("one", F.expr("shiftright(r2, l) & 1")).drop("r2")
    return scan(lv, [*keys, "l", "node"], "r1", F.floor(F.col("r1") / 65536), place=("sum", "one"), mass=("sum", F.col("one") * F.col("w")))


def _counts(pts: DataFrame, slopes: list[float], bits: int) -> dict[float, tuple[float, float]]:
    """Pairs of rows, and pairs of different points, with a slope below each of ``slopes``."""
    at = pts.withColumn("s", F.explode(F.array(*[F.lit(s) for s in slopes]))).withColumn("z", _height(F.col("s"))).withColumn("r1", F.col("r"))
    tree = _tree(scan(at, ["s"], ["z", "r"], magnitude_chunk("z"), r2="row"), ["s"], bits)
    found = tree.where("one = 0").groupBy("s").agg(
        F.sum(F.col("w").cast("double") * F.col("mass")).alias("c"), F.sum(F.col("place").cast("double")).alias("p"))
    return dict.fromkeys(slopes, (0.0, 0.0)) | {r["s"]: (r["c"], r["p"]) for r in found.collect()}


def _slopes(pts: DataFrame, tree: DataFrame, share: float | None = None) -> DataFrame:
    """``(s, w)`` of the inverted pairs in ``tree``: all of them, or draws of an even ``share``."""
    zeros = tree.where("one = 0 AND place > 0").select("l", "node", F.col("r").alias("rb"), F.col("w").alias("wb"), "place")
    if share is None:
        parts = zeros.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("place") - 1) / STRETCH))))
        at = F.explode(F.sequence(F.col("_b") * STRETCH + 1, F.least(F.col("place"), (F.col("_b") + 1) * STRETCH)))
    else:
        chance = F.pmod(F.xxhash64("l", "rb", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
        parts = zeros.withColumn("_n", F.floor(F.col("place") * share + chance)).where("_n > 0").withColumn("_b", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        at = F.pmod(F.xxhash64("l", "rb", "_b"), F.col("place")) + 1
    asked = parts.select("l", "node", "rb", "wb", at.alias("place"))
    ones = tree.where("one = 1").select("l", "node", "place", F.col("r").alias("ra"), F.col("w").alias("wa"))
    met = asked.join(ones, ["l", "node", "place"])
    spot = lambda side: pts.select(F.col("r").alias(f"r{side}"), F.col("x").alias(f"x{side}"), F.col("y").alias(f"y{side}"))
    met = met.join(spot("a"), "ra").join(spot("b"), "rb").where("xa != xb")
    return met.select(((F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).alias("s"), (F.col("wa") * F.col("wb")).alias("w"))


def _drawn(pts: DataFrame, lo: float | None, hi: float | None, bits: int, inside: float) -> tuple[np.ndarray, np.ndarray]:
    drawn = _slopes(pts, _tree(_orders(pts, lo, hi), [], bits), SAMPLE / inside).toPandas().sort_values("s")
    return drawn["s"].to_numpy(), drawn["w"].to_numpy(dtype=float)
