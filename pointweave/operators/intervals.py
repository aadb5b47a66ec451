"""Interval algebra on ``(keys, t0, t1)`` tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, names, ratio
from .ranges import count_in_windows
from .scan import join_null_safe, linked, scan, time_chunk

DAY = 86400.0


def islands(
    df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str, chunk: Column, new: Column, out: str = "island",
) -> DataFrame:
    """Running count of ``new`` flags: the island number of each row."""
    return scan(df.withColumn("_new", new.cast("bigint")), keys, order, chunk, **{out: ("sum", "_new")}).drop("_new")


def merge_intervals(
    win: DataFrame, keys: Sequence[str] | str, lo: float | None = None, hi: float | None = None,
    gap: float | None = None, chunk_s: float = DAY,
) -> DataFrame:
    """Merge overlapping or touching windows; with ``gap`` also neighbours closer than it (strict).

    Windows are clipped to ``[lo, hi]`` and empty ones dropped. Returns ``(keys, t0, t1, n)``.
    """
    keys = names(keys)
    w = win.select(*keys, clip("t0", lo, hi).alias("t0"), clip("t1", lo, hi).alias("t1"))
    if gap is None:
        w = w.where("t1 > t0")
    w = w.groupBy(*keys, "t0", "t1").agg(F.count(F.lit(1)).alias("n"))
    apart = lambda lo, r: lo > r if gap is None else lo - r >= F.lit(gap)
    return linked(w, keys, ["t0", "t1"], time_chunk("t0", chunk_s), "t0", "t1", apart).groupBy(*keys, "_start").agg(
        F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n")).drop("_start")


def free_intervals(
    win: DataFrame, bounds: DataFrame, keys: Sequence[str] | str, chunk_s: float = DAY
) -> DataFrame:
    """Complement of the windows inside each key's ``[lo, hi]`` of ``bounds``; no windows: the whole range."""
    keys = names(keys)
    clipped = join_null_safe(win, bounds, keys).select(
        *keys, F.greatest("t0", "lo").alias("t0"), F.least("t1", "hi").alias("t1")).where("t1 > t0")
    # a zero-width end marker per bound makes the stretch before, between and after windows one rule
    ends = bounds.select(*keys, F.col("lo").alias("t0"), F.col("lo").alias("t1")).unionByName(
        bounds.select(*keys, F.col("hi").alias("t0"), F.col("hi").alias("t1")))
    m = clipped.unionByName(ends).dropDuplicates(keys + ["t0", "t1"])
    chunk = time_chunk("t0", chunk_s)
    prev = scan(m, keys, ["t0", "t1"], chunk, _reach=("reach", "t1"))
    return prev.where("t0 > _reach").select(*keys, F.col("_reach").alias("t0"), F.col("t0").alias("t1"))


def pad_windows(win: DataFrame, pre: float, post: float) -> DataFrame:
    return win.withColumns({"t0": F.col("t0") - pre, "t1": F.col("t1") + post})


def free_after_buffer(
    win: DataFrame, bounds: DataFrame, keys: Sequence[str] | str, pre: float, post: float, min_dur: float,
    chunk_s: float = DAY,
) -> DataFrame:
    """Complement of the padded windows, only stretches strictly longer than ``min_dur``."""
    return free_intervals(pad_windows(win, pre, post), bounds, keys, chunk_s).where(F.col("t1") - F.col("t0") > min_dur)


def baseline_intervals(
    artifacts: DataFrame, trials: DataFrame, short_frees: DataFrame, bounds: DataFrame, keys: Sequence[str] | str,
    pre: float, post: float, chunk_s: float = DAY,
) -> DataFrame:
    """What is left of the recording outside artifacts, padded trials and too short free stretches."""
    cols = names(keys) + ["t0", "t1"]
    blocked = artifacts.select(cols).unionByName(pad_windows(trials, pre, post).select(cols)).unionByName(short_frees.select(cols))
    return free_intervals(blocked, bounds, keys, chunk_s)


def merge_by_gap(win: DataFrame, keys: Sequence[str] | str, max_gap: float, chunk_s: float = DAY) -> DataFrame:
    return merge_intervals(win, keys, gap=max_gap, chunk_s=chunk_s)


def members_per_merge(merged: DataFrame, win: DataFrame, keys: Sequence[str] | str, out: str = "n_members", chunk_s: float = DAY) -> DataFrame:
    """Number of windows overlapping each window of a disjoint merged set.

    Overlapping = started by the end, minus ended before the start: two cumulative counts, no pairs.
    """
    keys = names(keys)
    m = merged.select(*keys, "t0", "t1")
    started = count_in_windows(
        m.select(*keys, F.col("t0").alias("m0"), F.col("t1").alias("m1"), F.lit(-1e300).alias("t0"), F.col("t1")).select(
            *keys, "m0", "m1", "t0", "t1"),
        win.select(*keys, F.col("t0").alias("t")), keys, "_s", chunk_s)
    ended = count_in_windows(
        m.select(*keys, F.col("t0").alias("m0"), F.col("t1").alias("m1"), F.lit(-1e300).alias("t0"), F.col("t0").alias("t1")),
        win.select(*keys, F.col("t1").alias("t")), keys, "_e", chunk_s, closed=False)
    return join_null_safe(started.select(*keys, "m0", "m1", "_s"), ended.select(*keys, "m0", "m1", "_e"), keys + ["m0", "m1"]).select(
        *keys, F.col("m0").alias("t0"), F.col("m1").alias("t1"), (F.col("_s") - F.col("_e")).alias(out))


def border_intervals(
    merged: DataFrame, n_col: str, bounds: DataFrame, keys: Sequence[str] | str, n_min: int, wide: float, narrow: float,
    min_free: float, chunk_s: float = DAY,
) -> DataFrame:
    """Give windows with enough members a wide margin, others a narrow one; absorb free stretches that are
    not longer than ``min_free``: the result is the complement of the long free stretches."""
    margin = F.when(F.col(n_col) >= n_min, F.lit(wide)).otherwise(F.lit(narrow))
    padded = merged.select(*names(keys), (F.col("t0") - margin).alias("t0"), (F.col("t1") + margin).alias("t1"))
    long_free = free_intervals(padded, bounds, keys, chunk_s).where(F.col("t1") - F.col("t0") > min_free)
    return free_intervals(long_free, bounds, keys, chunk_s)


def extend_borders(
    merged: DataFrame, borders: DataFrame, keys: Sequence[str] | str, pad: float, min_dur: float
) -> DataFrame:
    """Extend a start (stop) by ``pad`` when it is also a start (stop) in ``borders``; keep long enough windows."""
    keys = names(keys)
    starts = borders.select(*keys, "t0", F.lit(True).alias("_s")).distinct()
    stops = borders.select(*keys, "t1", F.lit(True).alias("_e")).distinct()
    j = join_null_safe(join_null_safe(merged, starts, keys + ["t0"], "left"), stops, keys + ["t1"], "left")
    return j.select(
        *keys, (F.col("t0") - F.when(F.col("_s"), F.lit(pad)).otherwise(0.0)).alias("t0"),
        (F.col("t1") + F.when(F.col("_e"), F.lit(pad)).otherwise(0.0)).alias("t1")).where(F.col("t1") - F.col("t0") >= min_dur)


def gap_windows(win: DataFrame, bounds: DataFrame, keys: Sequence[str] | str, chunk_s: float = DAY) -> DataFrame:
    """Stretches between consecutive windows, including before the first and after the last."""
    keys = names(keys)
    chunk = time_chunk("t0", chunk_s)
    seq = scan(win.select(*keys, "t0", "t1"), keys, ["t0", "t1"], chunk, _pt1=("lag", "t1"), _nt0=("lead", "t0"))
    j = join_null_safe(seq, bounds, keys)
    before = j.select(*keys, F.coalesce("_pt1", "lo").alias("t0"), F.col("t0").alias("t1"))
    after = j.where("_nt0 IS NULL").select(*keys, F.col("t1").alias("t0"), F.col("hi").alias("t1"))
    return before.unionByName(after)


def windows_around(trg: DataFrame, pre: float, post: float) -> DataFrame:
    return trg.withColumns({"t0": F.col("t") - pre, "t1": F.col("t") + post})


def tile_windows(spans: DataFrame, keys: Sequence[str] | str, width: float) -> DataFrame:
    """Cut ``[t0, t1]`` into tiles of ``width``; the first and last tile are dropped."""
    keys = names(keys)
    k = F.ceil((F.col("t1") - F.col("t0")) / F.lit(width))
    return spans.where(k >= 3).select(
        *keys, "t0", F.explode(F.sequence(F.lit(1).cast("bigint"), k - 2)).alias("tile")).select(
        *keys, "tile", (F.col("t0") + F.col("tile") * width).alias("t0"), (F.col("t0") + (F.col("tile") + 1) * width).alias("t1"))


def sliding_windows(spans: DataFrame, keys: Sequence[str] | str, width: int, overlap: int, start: str = "i0", stop: str = "i1") -> DataFrame:
    """Overlapping windows of ``width`` over ``[i0, i1)``; the last one is right-aligned to the end."""
    keys = names(keys)
    step = width - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than width")
    n = F.col(stop) - F.col(start)
    count = F.ceil(F.greatest(n - width, F.lit(0)) / F.lit(step)) + 1
    return spans.where(n >= width).select(
        *keys, start, stop, F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("win")).select(
        *keys, "win", F.least(F.col(start) + F.col("win") * step, F.col(stop) - width).alias("w0")).withColumn(
        "w1", F.col("w0") + width)


def mask_samples(tr: DataFrame, win: DataFrame, keys: Sequence[str] | str, chunk_s: float, x: str = "t", value: str = "v") -> DataFrame:
    """Blank the samples strictly inside any window.

    Strictly inside one of the windows = inside the open union; a running maximum of window ends decides.
    """
    keys = names(keys)
    s = tr.select(*keys, F.struct(*tr.columns).alias("_row"), F.col(x).alias("_pos"), F.lit(0).alias("_side"), F.lit(None).cast("double").alias("_end"))
    w = win.where("t1 > t0").groupBy(*keys, "t0").agg(F.max("t1").alias("_end")).select(
        *keys, F.lit(None).cast(s.schema["_row"].dataType).alias("_row"), F.col("t0").alias("_pos"), F.lit(1).alias("_side"), "_end")
    both = s.unionByName(w).withColumn("_n", F.xxhash64("_row"))
    run = scan(both, keys, ["_pos", "_side", "_n"], time_chunk("_pos", chunk_s), _reach=("max", "_end"))
    hidden = F.coalesce(F.col("_reach") > F.col("_pos"), F.lit(False))
    return run.where("_side = 0").select("_row.*", hidden.alias("masked")).withColumn(
        value, F.when(~F.col("masked"), F.col(value)))


def time_fractions(win_by_kind: DataFrame, bounds: DataFrame, keys: Sequence[str] | str, kinds: Sequence[str], artifact: str) -> DataFrame:
    """Share of usable time (duration minus artifact) spent in each kind of window."""
    keys = names(keys)
    dur = F.col("t1") - F.col("t0")
    sums = win_by_kind.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("kind") == k, dur)).alias(f"_{k}") for k in [*kinds, artifact]])
    j = join_null_safe(bounds, sums, keys, "left")
    usable = F.col("hi") - F.col("lo") - F.coalesce(F.col(f"_{artifact}"), F.lit(0.0))
    return j.select(*keys, usable.alias("usable"), *[
        ratio(F.coalesce(F.col(f"_{k}"), F.lit(0.0)), usable).alias(f"frac_{k}") for k in kinds])


