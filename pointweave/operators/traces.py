"""Evenly indexed traces ``(keys, i, v)``: neighbourhood operators on overlapping frames.

A trace is cut into frames of ``FRAME`` samples; each sample is also copied into the neighbouring frame
when it lies within ``halo`` of the cut. Windows then run per (key, frame), so a long trace spreads over
many tasks with one shuffle, and the copies are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalars import finite, names, ratio
from .scan import join_null_safe, percentile_columns, scan

FRAME = 65536


def index_chunk(i: str = "i") -> Column:
    return F.floor(F.col(i) / F.lit(FRAME))


def index_grid(spans: DataFrame, keys: list[str], n: Column, out: str) -> DataFrame:
    """``n`` consecutive indices per row of ``spans``, made frame by frame so that a long span uses many tasks."""
    frames = spans.where(n > 0).withColumn("_fr", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / FRAME))))
    spread = frames.withColumn("_n", n).select(*keys, "_fr", "_n").repartition(*keys, "_fr")
    first = F.col("_fr") * FRAME
    return spread.select(*keys, F.explode(F.sequence(first, F.least(first + FRAME, F.col("_n")) - 1)).alias(out))


def neighbourhood(
    tr: DataFrame, keys: Sequence[str] | str, halo: int, build: Callable[[WindowSpec], dict[str, Column]], i: str = "i"
) -> DataFrame:
    """Add the columns ``build(window)`` makes from a window ordered by ``i`` that sees ``halo`` rows around."""
    keys = names(keys)
    if halo >= FRAME:
        raise ValueError("halo must be smaller than a frame")
    own = F.floor(F.col(i) / F.lit(FRAME))
    seen = F.array_distinct(F.array(own, F.floor((F.col(i) - halo) / F.lit(FRAME)), F.floor((F.col(i) + halo) / F.lit(FRAME))))
    framed = tr.withColumn("_fr", F.explode(seen))
    w = Window.partitionBy(*keys, "_fr").orderBy(i)
    return framed.withColumns(build(w)).where(F.col("_fr") == own).drop("_fr")


def local_extrema(tr: DataFrame, keys: Sequence[str] | str, mode: str = "max", value: str = "v") -> DataFrame:
    """Samples strictly above (below) both neighbours; the ends never qualify."""
    t = neighbourhood(tr, keys, 1, lambda w: {"_p": F.lag(value).over(w), "_q": F.lead(value).over(w)})
    v = F.col(value)
    keep = (v > F.col("_p")) & (v > F.col("_q")) if mode == "max" else (v < F.col("_p")) & (v < F.col("_q"))
    return t.where(keep).drop("_p", "_q")


def zscored(tr: DataFrame, keys: Sequence[str] | str, value: str = "v", out: str = "z") -> DataFrame:
    keys = names(keys)
    m = tr.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    return join_null_safe(tr, m, keys).withColumn(out, ratio(F.col(value) - F.col("_mu"), "_sd")).drop("_mu", "_sd")


def signed_peaks(tr: DataFrame, keys: Sequence[str] | str, z_thr: float, value: str = "v") -> DataFrame:
    """Maxima of the absolute trace whose z-score is beyond ``z_thr``, with the sign of the trace there."""
    z = zscored(tr, keys, value).withColumn("_a", F.abs(value))
    peaks = local_extrema(z, keys, "max", "_a")
    return peaks.where((F.abs("z") > z_thr) & (F.col(value) != 0)).withColumn("sign", F.signum(value).cast("bigint")).drop("_a")


def exceedance_curve(amps: DataFrame, key: str, amp: str, thresholds: Sequence[float]) -> DataFrame:
    """``(key, thr, n)``: how many amplitudes of a channel reach each threshold, from one aggregation."""
    wide = amps.groupBy(key).agg(*[F.count(F.when(F.col(amp) >= t, 1)).alias(f"_t{k}") for k, t in enumerate(thresholds)])
    cells = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("thr"), F.col(f"_t{k}").alias("n")) for k, t in enumerate(thresholds)]))
    return wide.select(key, cells.alias("c")).select(key, "c.thr", "c.n")


def threshold_from_fraction(curve: DataFrame, frac: float) -> DataFrame:
    """Threshold at which the channel-averaged, max-normalised curve is nearest to ``1 - frac``."""
    avg = curve.groupBy("thr").agg(F.avg("n").alias("a"))
    top = avg.agg(F.max("a")).scalar()
    return avg.agg(F.min_by("thr", F.struct(F.abs(ratio(F.col("a"), top) - (1 - frac)), F.col("thr"))).alias("thr"))


def _crossings(tr: DataFrame, keys: list[str], value: str, level: Column | float) -> DataFrame:
    """Add ``_cross``: sign of the step over ``level`` from this sample to the next (-1 down, 1 up, NULL none)."""
    s = F.signum(F.col(value) - (F.lit(level) if isinstance(level, (int, float)) else level))
    t = neighbourhood(tr.withColumn("_s", s), keys, 1, lambda w: {"_n": F.lead("_s").over(w)})
    step = F.col("_n") - F.col("_s")
    return t.withColumn("_cross", F.when(step < 0, -1).when(step > 0, 1)).drop("_s", "_n")


def halfwaves(
    tr: DataFrame, keys: Sequence[str] | str, roll: Column | float, peak: Column | float, min_dur: int = 0, mode: str = "trough",
    value: str = "v",
) -> DataFrame:
    """Complete excursions below (above) ``roll`` that reach ``peak`` and last longer than ``min_dur``.

    ``[i0, i1)`` runs from the last sample before the crossing to the last sample inside. An excursion that
    is open at either end of the trace is left out. ``roll`` and ``peak`` may be columns of the trace.
    """
    keys = names(keys)
    enter, leave = (-1, 1) if mode == "trough" else (1, -1)
    t = _crossings(tr, keys, value, roll).withColumn("_peak", F.lit(peak) if isinstance(peak, (int, float)) else peak)
    run = scan(
        t, keys, "i", index_chunk(), _kind=("last", "_cross"),
        i0=("last", F.when(F.col("_cross") == enter, F.col("i"))), i1=("follow", F.when(F.col("_cross") == leave, F.col("i"))))
    agg = F.min if mode == "trough" else F.max
    g = run.where((F.col("_kind") == enter) & F.col("i1").isNotNull()).groupBy(*keys, "i0").agg(
        F.min("i1").alias("i1"), agg(value).alias("peak"), F.first("_peak").alias("_peak"))
    reached = F.col("peak") <= F.col("_peak") if mode == "trough" else F.col("peak") >= F.col("_peak")
    return g.where(reached & (F.col("i1") - F.col("i0") > min_dur)).select(*keys, "i0", "i1", "peak")


def interpolate(points: DataFrame, knots: DataFrame, keys: Sequence[str] | str, out: str, x: str = "i") -> DataFrame:
    """Linear interpolation of ``knots (keys, x, y)`` at ``points``, extrapolated by the end segments."""
    keys = names(keys)
    seg = scan(knots, keys, "x", F.floor(F.col("x") / F.lit(FRAME)), _x2=("lead", "x"), _y2=("lead", "y")).where("_x2 IS NOT NULL")
    s = seg.select(*keys, F.col("x").cast("double").alias("_pos"), F.lit(0).alias("_side"),
                   F.struct("x", "y", "_x2", "_y2").alias("_seg"))
    p = points.select(*keys, F.col(x).cast("double").alias("_pos"), F.lit(1).alias("_side"),
                      F.lit(None).cast(s.schema["_seg"].dataType).alias("_seg"), F.struct(*points.columns).alias("_row"))
    both = p.unionByName(s.withColumn("_row", F.lit(None).cast(p.schema["_row"].dataType)))
    run = scan(both, keys, ["_pos", "_side"], F.floor(F.col("_pos") / F.lit(FRAME)), _a=("last", "_seg"), _b=("next", "_seg"))
    g = F.coalesce("_a", "_b")
    slope = (g["_y2"] - g["y"]) / (g["_x2"] - g["x"])
    return run.where("_side = 1").select("_row.*", (g["y"] + slope * (F.col("_pos") - g["x"])).alias(out))


def halfcycle_rms(tr: DataFrame, keys: Sequence[str] | str, value: str = "v", out: str = "rms") -> DataFrame:
    """Root mean square between consecutive zero crossings, put at the midpoints and interpolated at every sample."""
    keys = names(keys)
    t = _crossings(tr, keys, value, 0.0)
    at = F.when(F.col("_cross").isNotNull(), F.col("i"))
    run = scan(t, keys, "i", index_chunk(), _z1=("last", at), _z2=("follow", at)).where("_z1 IS NOT NULL AND _z2 IS NOT NULL")
    knots = run.groupBy(*keys, "_z1").agg(F.min("_z2").alias("_z2"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("y")).select(
        *keys, F.floor(F.col("_z1") + (F.col("_z2") - F.col("_z1")) / 2).alias("x"), "y")
    return interpolate(tr, knots, keys, out)


def linear_envelope(tr: DataFrame, keys: Sequence[str] | str, value: str = "v", out: str = "env") -> DataFrame:
    """Peak-to-peak envelope: the two ends and all local maxima joined by straight lines."""
    keys = names(keys)
    peaks = local_extrema(tr, keys, "max", value).select(*keys, F.col("i").alias("x"), F.col(value).alias("y"))
    ends = tr.groupBy(*keys).agg(
        F.struct(F.min("i").alias("x"), F.min_by(value, "i").alias("y")).alias("a"),
        F.struct(F.max("i").alias("x"), F.max_by(value, "i").alias("y")).alias("b"))
    ends = ends.select(*keys, F.explode(F.array("a", "b")).alias("e")).select(*keys, "e.x", "e.y")
    return interpolate(tr, peaks.unionByName(ends), keys, out)


def moving_average(tr: DataFrame, keys: Sequence[str] | str, n: int, value: str = "v", out: str = "avg") -> DataFrame:
    """Mean over samples ``i .. i + n - 1``, complete windows only."""
    def build(w: WindowSpec) -> dict[str, Column]:
        fw = w.rowsBetween(0, n - 1)
        return {out: F.avg(value).over(fw), "_k": F.count(F.lit(1)).over(fw)}
    return neighbourhood(tr, keys, n, build).where(F.col("_k") == n).drop("_k")


def savgol_weights(width: int, order: int) -> list[float]:
    """Least-squares smoothing weights of a local polynomial (a ``width`` x ``order + 1`` system)."""
    half = width // 2
    design = np.vander(np.arange(-half, half + 1, dtype=float), order + 1, increasing=True)
    return [float(x) for x in np.linalg.pinv(design)[0]]


def savgol(tr: DataFrame, keys: Sequence[str] | str, width: int = 11, order: int = 3, value: str = "v", out: str = "smooth", floor: float | None = 0.0) -> DataFrame:
    """Polynomial smoothing as a fixed convolution; ends are mirrored through the end values."""
    keys, half, weights = names(keys), width // 2, savgol_weights(width, order)
    ends = tr.groupBy(*keys).agg(F.min_by(value, "i").alias("_y0"), F.max_by(value, "i").alias("_y1"), F.max("i").alias("_n"))
    body = tr.select(*keys, "i", F.col(value).alias("_v"))
    edge = join_null_safe(body, ends, keys)
    left = edge.where((F.col("i") >= 1) & (F.col("i") <= half)).select(
        *keys, (-F.col("i")).alias("i"), (F.col("_y0") - F.abs(F.col("_v") - F.col("_y0"))).alias("_v"))
    right = edge.where((F.col("i") >= F.col("_n") - half) & (F.col("i") < F.col("_n"))).select(
        *keys, (2 * F.col("_n") - F.col("i")).alias("i"), (F.col("_y1") + F.abs(F.col("_v") - F.col("_y1"))).alias("_v"))

    def build(w: WindowSpec) -> dict[str, Column]:
        near = F.collect_list("_v").over(w.rowsBetween(-half, half))
        taps = F.array(*[F.lit(x) for x in weights])
        return {out: F.aggregate(F.zip_with(near, taps, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x), "_k": F.size(near)}

    y = neighbourhood(body.unionByName(left).unionByName(right), keys, half, build).where(F.col("_k") == width).drop("_k")
    col = F.col(out) if floor is None else F.greatest(F.col(out), F.lit(floor))
    return y.select(*keys, "i", F.col("_v").alias(value), col.alias(out))


def rolling_median(tr: DataFrame, keys: Sequence[str] | str, value: str = "v", out: str = "med") -> DataFrame:
    """Median of three neighbouring samples, zeros beyond the ends."""
    zero = F.lit(0.0)
    return neighbourhood(tr, keys, 1, lambda w: {
        out: F.array_sort(F.array(F.coalesce(F.lag(value).over(w), zero), F.col(value), F.coalesce(F.lead(value).over(w), zero)))[1]})


def resample_linear(tr: DataFrame, keys: Sequence[str] | str, sr_old: float, sr_new: float, value: str = "v") -> DataFrame:
    """Linear resampling onto ``int(n * sr_new / sr_old)`` points that span the same first and last sample.

    New point j sits at old index j (n-1)/(m-1); each old sample makes the points up to the next one.
    """
    keys = names(keys)
    size = tr.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn(
        "_m", F.floor(F.col("_n") * F.lit(sr_new) / F.lit(sr_old)).cast("bigint")).where("_m > 1")
    t = join_null_safe(neighbourhood(tr.select(*keys, "i", value), keys, 1, lambda w: {"_q": F.lead(value).over(w)}), size, keys)
    n1, m1, i = F.col("_n") - 1, F.col("_m") - 1, F.col("i")
    up = lambda k: F.floor((k * m1 + n1 - 1) / n1).cast("bigint")  # noqa: E731  ceil(k m1 / n1)
    js = F.when(F.col("_q").isNull(), F.array(m1)).when(up(i) <= up(i + 1) - 1, F.sequence(up(i), up(i + 1) - 1)).otherwise(F.array().cast("array<bigint>"))
    pos = F.col("j") * n1 / m1 - i
    return t.withColumn("j", F.explode(js)).select(
        *keys, "j", (F.col(value) + F.coalesce((F.col("_q") - F.col(value)) * pos, F.lit(0.0))).alias(value))


def _lagged_sums(x: np.ndarray, y: np.ndarray, max_lag: int) -> np.ndarray:
    """sum over i of x[i + lag] y[i] for lag = -max_lag .. max_lag, zeros beyond the ends."""
    if len(x) * (2 * max_lag + 1) <= 1 << 20:
        wide = np.concatenate([np.zeros(max_lag), x, np.zeros(max_lag)])
        return np.correlate(wide, y, "valid")
    size = 1 << int(len(x) + max_lag).bit_length()  # room for every lag, so that none wraps around
    c = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
    return np.concatenate([c[size - max_lag:], c[:max_lag + 1]]) if max_lag else c[:1]


def _present(c: np.ndarray | None, n: int) -> np.ndarray:
    out = np.zeros(n) if c is None else c
    return np.where(np.isfinite(out), out, 0.0)


def _correlate_frames(keys: list[str], max_lag: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):  # one frame a row; the work of a row is numpy's
                s = batch.column("_s")[r].values
                at = s.field("i").to_numpy(zero_copy_only=False)
                at = (at - at.min()).astype(np.int64)
                own = s.field("own").to_numpy(zero_copy_only=False).astype(bool)
                vals = [s.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")]
                n = int(at.max()) + 1
                dense = lambda w, to: np.bincount(to, w, n)
                x, y = _present(vals[0], len(at)), _present(np.where(own, vals[1], 0.0), len(at))
                c = _lagged_sums(dense(x, at), dense(y, at), max_lag)
                met = _lagged_sums(dense(np.ones(len(at)), at), dense(own.astype(float), at), max_lag)
                full = [np.isfinite(v) for v in vals]
                both = met if all(f.all() for f in full) else _lagged_sums(
                    dense(full[0].astype(float), at), dense((full[1] & own).astype(float), at), max_lag)
                cells = [pa.array(np.arange(-max_lag, max_lag + 1)), pa.array(c), pa.array(np.rint(met).astype(np.int64)), pa.array(np.rint(both).astype(np.int64))]
                sums = [pa.array(np.full(len(c), v)) for v in ((x * x)[own].sum(), (y * y).sum())]
                same = pa.array(np.full(len(c), r, dtype=np.int64))
                seen = np.rint(met).astype(np.int64) > 0
                out = pa.RecordBatch.from_arrays(
                    [batch.column(k).take(same) for k in keys] + cells + sums, [*keys, "lag", "_c", "_met", "_both", "_xx", "_yy"])
                yield out.filter(pa.array(seen | (np.arange(len(c)) == max_lag)))
    return run


def xcorr(xy: DataFrame, keys: Sequence[str] | str, max_lag: int, x: str = "x", y: str = "y") -> DataFrame:
    """``(keys, lag, c)``: sum of x(i + lag) y(i) over the norms of x and y, for |lag| <= ``max_lag``.

    A trace is cut into frames; a frame, with ``max_lag`` samples around it, is one row and is transformed as a whole
    (Fourier transforms where that pays), and the lags of all frames are added up. Memory of a row is three frames at most,
    and a frame is as long as the lags if they are longer than ``FRAME``. NULL and non-finite samples are missing: their
    products do not count, and a lag with missing products only has ``c`` NULL. NULL keys are keys like others.
    """
    keys = names(keys)
    frame = max(FRAME, max_lag)
    own = F.floor(F.col("i") / F.lit(frame))
    near = F.array_distinct(F.array(own, F.floor((F.col("i") - max_lag) / F.lit(frame)), F.floor((F.col("i") + max_lag) / F.lit(frame))))
    rows = xy.select(*keys, F.col("i").cast("bigint").alias("i"), finite(x).alias("x"), finite(y).alias("y"), F.explode(near).alias("_fr"))
    sample = F.struct("i", "x", "y", (F.col("_fr") == F.floor(F.col("i") / F.lit(frame))).alias("own"))
    frames = rows.groupBy(*keys, "_fr").agg(F.collect_list(sample).alias("_s")).where(F.exists("_s", lambda s: s["own"]))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in xy.select(*keys).schema.fields)
    sums = frames.select(*keys, "_s").mapInArrow(
        _correlate_frames(keys, max_lag), f"{kept}, lag bigint, _c double, _met bigint, _both bigint, _xx double, _yy double")
    # the norms are those of lag 0, which every frame has
    c = sums.groupBy(*keys, "lag").agg(*[F.sum(s).alias(s) for s in ("_c", "_met", "_both")], F.sum("_xx").alias("_xx"), F.sum("_yy").alias("_yy"))
    norm = c.where("lag = 0").select(*keys, F.sqrt(F.col("_xx") * F.col("_yy")).alias("_n"))
    c = c.where("_met > 0").select(*keys, "lag", F.when(F.col("_both") > 0, F.col("_c")).alias("_c"))
    return join_null_safe(c, norm, keys).select(*keys, "lag", ratio("_c", "_n").alias("c"))


def best_shift(corr: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Lag of the correlation maximum nearest to lag 0 and its absolute height."""
    keys = names(keys)
    w = Window.partitionBy(*keys).orderBy("lag")  # 2 max_lag + 1 rows
    peaks = corr.withColumns({"_p": F.lag("c").over(w), "_q": F.lead("c").over(w)}).where("c > _p AND c > _q")
    near = F.struct(F.abs("lag"), "lag")
    return peaks.groupBy(*keys).agg(F.min_by("lag", near).alias("shift"), F.abs(F.min_by("c", near)).alias("amp"))


def window_samples(tr: DataFrame, win: DataFrame, keys: Sequence[str] | str, w0: str = "w0", w1: str = "w1", id_col: str = "win") -> DataFrame:
    """Samples of each index window ``[w0, w1)`` re-indexed from 0, one row per (window, sample)."""
    keys = names(keys)
    bk = F.floor(F.col("i") / F.lit(1024))
    w = win.select(*keys, id_col, w0, w1).withColumn("_bk", F.explode(F.sequence(F.floor(F.col(w0) / 1024), F.floor((F.col(w1) - 1) / 1024))))
    return tr.withColumn("_bk", bk).join(w, keys + ["_bk"]).where((F.col("i") >= F.col(w0)) & (F.col("i") < F.col(w1))).withColumn(
        "i", F.col("i") - F.col(w0)).drop("_bk", w0, w1)


def regular_events(
    tr: DataFrame, win: DataFrame, keys: Sequence[str] | str, max_lag: int, lag_lo: int, lag_hi: int, min_peaks: int, share: float,
    height: float = 0.1, value: str = "v",
) -> DataFrame:
    """Index windows whose autocorrelation peaks are regularly spaced.

    Needs ``min_peaks`` peaks of at least ``height``, and among their spacings at least ``min_peaks - 1`` and a
    share ``share`` inside ``[lag_lo, lag_hi]``.
    """
    keys = names(keys) + ["win"]
    s = window_samples(tr, win, names(keys[:-1])).select(*keys, "i", F.col(value).alias("x"), F.col(value).alias("y"))
    w = Window.partitionBy(*keys).orderBy("lag")  # 2 max_lag + 1 rows
    c = xcorr(s, keys, max_lag).withColumns({"_p": F.lag("c").over(w), "_q": F.lead("c").over(w)})
    peaks = c.where((F.col("c") > F.col("_p")) & (F.col("c") > F.col("_q")) & (F.col("c") >= height))
    gap = peaks.withColumn("_g", F.col("lag") - F.lag("lag").over(w))
    stat = gap.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_peaks"), F.count("_g").alias("n_gaps"), F.count(F.when(F.col("_g").between(lag_lo, lag_hi), 1)).alias("n_good"))
    return stat.where((F.col("n_peaks") >= min_peaks) & (F.col("n_good") >= min_peaks - 1) & (F.col("n_good") >= F.col("n_gaps") * share))


def event_shape(tr: DataFrame, win: DataFrame, keys: Sequence[str] | str, sr: float, value: str = "v") -> DataFrame:
    """Area (sum over samples / rate) and peak of each index window ``[w0, w1)``."""
    s = window_samples(tr, win, keys)
    return s.groupBy(*names(keys), "win").agg((F.sum(value) / sr).alias("area"), F.max(value).alias("peak"))


def adaptive_area_threshold(shapes: DataFrame, key: str, width: float, hi: float, n_sd: float = 4.0) -> DataFrame:
    """Per key an area threshold from the histogram of areas (bins of ``width`` from the smallest area to ``hi``).

    When the first bin stands out (count > mean + ``n_sd`` sd over all bins), the threshold is the upper edge of
    its first contiguous run of such bins; if no later run exists, of the first bin. Else the smallest area.
    """
    lo = shapes.groupBy(key).agg(F.min("area").alias("lo")).withColumn("n_bins", F.floor((F.lit(hi) - F.col("lo")) / width).cast("bigint"))
    binned = join_null_safe(shapes, lo, [key]).withColumn("k", F.floor((F.col("area") - F.col("lo")) / width)).where("k < n_bins")
    counts = binned.groupBy(key, "k").agg(F.count(F.lit(1)).alias("n"))
    # empty bins enter the moments through n_bins; only filled bins are rows
    mom = join_null_safe(counts.groupBy(key).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")), lo, [key])
    mean = F.col("s") / F.col("n_bins")
    thr = mom.select(key, "lo", "n_bins", (mean + n_sd * F.sqrt(F.greatest(F.col("q") / F.col("n_bins") - mean * mean, F.lit(0.0)))).alias("cut"))
    over = join_null_safe(counts, thr, [key]).where("n > cut")
    w = Window.partitionBy(key).orderBy("k")  # bounded by the bin count
    runs = over.withColumn("_r", F.col("k") - F.row_number().over(w))
    first = runs.groupBy(key).agg(
        F.min("k").alias("k0"), F.max(F.when(F.col("_r") == -1, F.col("k"))).alias("k_end"), F.max("k").alias("k_last"))
    j = join_null_safe(lo, first, [key], "left")
    idx = F.when(F.col("k_last") > F.col("k_end"), F.col("k_end")).otherwise(F.lit(0))
    return j.select(key, F.when(F.col("k0") == 0, F.col("lo") + (idx + 1) * F.lit(width)).otherwise(F.col("lo")).alias("thr"))


def rate_histogram(ev: DataFrame, spans: DataFrame, keys: Sequence[str] | str, width: float, n_units: int = 1) -> DataFrame:
    """``(keys, bin, rate)``: events per bin / width / units over each span, empty bins included."""
    keys = names(keys)
    n_bins = F.floor((F.col("hi") - F.col("lo")) / F.lit(width))
    grid = index_grid(spans, keys, n_bins, "bin")
    j = join_null_safe(ev, spans, keys)
    k = F.floor((F.col("t") - F.col("lo")) / F.lit(width))
    counts = j.where((F.col("t") >= F.col("lo")) & (k < n_bins)).groupBy(*keys, k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return join_null_safe(grid, counts, keys + ["bin"], "left").select(
        *keys, "bin", (F.coalesce("n", F.lit(0)) / F.lit(width * n_units)).alias("rate"))


def geometric_mean_level(rate: DataFrame, keys: Sequence[str] | str, value: str = "rate", out: str = "gmean") -> DataFrame:
    return rate.groupBy(*names(keys)).agg(F.exp(F.avg(F.when(F.col(value) > 0, F.ln(value)))).alias(out))


def channel_consensus(
    det: DataFrame, stim: DataFrame, keys: Sequence[str] | str, n_sd: float, stim_lo: int, stim_hi: int, i: str = "i", chan: str = "chan"
) -> DataFrame:
    """``(keys, i, pct)``: percent of kept channels with a detection at sample i, outside stimulus ranges.

    Channels whose detection count is off the mean by more than ``n_sd`` population sd are left out.
    """
    keys = names(keys)
    n = det.groupBy(*keys, chan).agg(F.count(F.lit(1)).alias("_n"))
    lim = n.groupBy(*keys).agg(F.avg("_n").alias("_mu"), F.stddev_pop("_n").alias("_sd"))
    kept = join_null_safe(n, lim, keys).where(F.abs(F.col("_n") - F.col("_mu")) <= n_sd * F.col("_sd")).select(*keys, chan)
    size = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    hits = join_null_safe(det, kept, keys + [chan]).groupBy(*keys, i).agg(F.count(F.lit(1)).alias("_h"))
    blocked = stim.select(*keys, F.explode(F.sequence(F.col("i") + stim_lo, F.col("i") + (stim_hi - 1))).alias(i)).distinct()
    return join_null_safe(join_null_safe(hits, size, keys), blocked, keys + [i], "left_anti").select(*keys, i, (F.col("_h") / F.col("_k") * 100).alias("pct"))


def hist2d(df: DataFrame, x: str, y: str, x_edges: tuple[float, float, int], y_edges: tuple[float, float, int], keys: Sequence[str] = ()) -> DataFrame:
    """Counts on a regular grid ``(lo, hi, bins)`` per axis with marginals (NULL bin); the last bin is closed."""
    def bin_of(c: str, e: tuple[float, float, int]) -> Column:
        lo, hi, n = e
        k = F.floor((F.col(c) - lo) * n / (hi - lo))
        return F.when((F.col(c) >= lo) & (F.col(c) < hi), F.least(k, F.lit(n - 1))).when(F.col(c) == hi, F.lit(n - 1)).cast("bigint")
    b = df.select(*keys, bin_of(x, x_edges).alias("bin_x"), bin_of(y, y_edges).alias("bin_y")).where("bin_x IS NOT NULL AND bin_y IS NOT NULL")
    cells = b.groupBy(*keys, "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("bigint")
    views = F.array(*[F.struct(px.alias("bin_x"), py.alias("bin_y")) for px, py in (
        (F.col("bin_x"), F.col("bin_y")), (F.col("bin_x"), none), (none, F.col("bin_y")))])
    return cells.select(*keys, "n", F.explode(views).alias("b")).groupBy(
        *keys, F.col("b.bin_x").alias("bin_x"), F.col("b.bin_y").alias("bin_y")).agg(F.sum("n").alias("n"))


def window_amplitude(samples: DataFrame, keys: Sequence[str] | str, value: str = "v") -> DataFrame:
    return samples.groupBy(*names(keys)).agg(F.avg(F.abs(value)).alias("mean"), F.stddev_pop(F.abs(value)).alias("std"))


def density_hist(df: DataFrame, key: str, value: str, upper: float = 0.975) -> DataFrame:
    """Per category: ``int(sqrt(n)) - 1`` equal bins from 0 to the ``upper`` percentile; count, prob, prob per width."""
    top = percentile_columns(df, key, value, {"_top": upper})
    n = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.floor(F.sqrt(F.count(F.lit(1)))).cast("bigint").alias("_e"))
    grid = join_null_safe(n, top, [key]).where("_e > 1").withColumns({"n_bins": F.col("_e") - 1, "bw": F.col("_top") / (F.col("_e") - 1)})
    k = F.floor(ratio(value, "bw"))
    j = join_null_safe(df, grid, [key]).where((F.col(value) >= 0) & (F.col(value) <= F.col("_top")))
    counts = j.groupBy(key, F.least(k, F.col("n_bins") - 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = grid.select(key, "bw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bins") - 1)).alias("bin"))
    c = join_null_safe(full, counts, [key, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tot = counts.groupBy(key).agg(F.sum("n").alias("_s"))
    return join_null_safe(c, tot, [key]).select(key, "bin", "n", ratio("n", "_s").alias("prob"), ratio(F.col("n"), F.col("_s") * F.col("bw")).alias("density"))
