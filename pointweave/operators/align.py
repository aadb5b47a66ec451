"""Trigger-aligned histograms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import names, ratio
from .trains import raster_events
from .scan import join_null_safe


def gauss_kernel(sigma_bins: float, span: float = 4.0) -> list[float]:
    """Unit-sum Gaussian weights on whole bins within ``span`` sigma."""
    half = int(span * sigma_bins)
    x = np.arange(-half, half + 1)
    k = np.exp(-0.5 * (x / sigma_bins) ** 2)
    return [float(v) for v in k / k.sum()]


def binned_raster(raster: DataFrame, keys: Sequence[str] | str, start: float, width: float, n_bins: int) -> DataFrame:
    """Summed event counts per entity and bin (only filled bins)."""
    b = F.floor((F.col("rel_t") - F.lit(start)) / F.lit(width))
    return raster.groupBy(*names(keys), b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).where((F.col("bin") >= 0) & (F.col("bin") < n_bins))


def psth(
    ev: DataFrame, trg: DataFrame, start: float, stop: float, width: float, sigma: float | None = None,
    recid: str = "recid", uid: str = "uid",
) -> DataFrame:
    """``(recid, uid, bin, n, rate)``: counts summed over all triggers, optionally Gaussian smoothed, as a rate.

    Filled bins are spread over the kernel taps and summed map-side ('same' convolution); the dense
    entity x bin grid only appears as the result.
    """
    n_bins = int(round((stop - start) / width))
    keys = [recid, uid]
    counts = binned_raster(raster_events(ev, trg, start, stop, recid), keys, start, width, n_bins)
    taps = gauss_kernel(sigma / width) if sigma else [1.0]
    half = len(taps) // 2
    kernel = F.array(*[F.struct(F.lit(k - half).alias("o"), F.lit(w).alias("w")) for k, w in enumerate(taps)])
    spread = counts.select(*keys, "bin", "n", F.explode(kernel).alias("k")).groupBy(*keys, (F.col("bin") + F.col("k.o")).alias("bin")).agg(
        F.sum(F.col("n") * F.col("k.w")).alias("s"), F.sum(F.when(F.col("k.o") == 0, F.col("n"))).alias("n"))
    n_trg = trg.groupBy(recid).agg(F.count(F.lit(1)).alias("_k"))
    entities = join_null_safe(ev.select(*keys).distinct(), n_trg, [recid])
    grid = entities.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint"))))
    return join_null_safe(grid, spread, keys + ["bin"], "left").select(
        *keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("s", F.lit(0.0)) / F.col("_k") / F.lit(width)).alias("rate"))


def psth_zscore(p: DataFrame, keys: Sequence[str] | str, start: float, stop: float, width: float, min_rate: float) -> DataFrame:
    """Baseline z-score: bins that end at or before the trigger give mean and sd; quiet entities are dropped."""
    keys = names(keys)
    pre = F.col("bin") < int(round(-start / width))
    m = p.groupBy(*keys).agg(
        F.avg(F.when(pre, F.col("rate"))).alias("_mu"), F.stddev_pop(F.when(pre, F.col("rate"))).alias("_sd"),
        (F.sum(F.when(pre, F.col("n"))) / F.lit(-start)).alias("_rp"), (F.sum("n") / F.lit(stop - start)).alias("_r"))
    keep = m.where((F.col("_rp") > min_rate) & (F.col("_r") > min_rate))
    return join_null_safe(p, keep, keys).select(*keys, "bin", ratio(F.col("rate") - F.col("_mu"), "_sd").alias("z"))
