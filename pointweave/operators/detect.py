"""Runs, bursts and change points of ordered events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import names, sq_distance
from .intervals import islands, merge_by_gap
from .ranges import points_in_windows
from .scan import join_null_safe, linked, range_chunks, scan, time_chunk

DAY = 86400.0


def _gap_islands(
    ev: DataFrame, keys: list[str], order: list[str], x: str, apart, chunk: Column, out: str
) -> DataFrame:
    """Island number of each row: a new one starts where ``apart(gap to the previous row)``."""
    lagged = scan(ev, keys, order, chunk, _px=("lag", x))
    gap = F.col(x) - F.col("_px")
    return islands(lagged, keys, order, chunk, gap.isNull() | apart(gap), out).drop("_px")


def bursts(ev: DataFrame, keys: Sequence[str] | str, max_dist: float, order: Sequence[str] = ("t",), chunk_s: float = DAY) -> DataFrame:
    """Maximal runs of intervals shorter than ``max_dist``: ``(keys, t0, t1, n)`` with n events (n >= 2)."""
    keys = names(keys)
    isl = linked(ev, keys, list(order), time_chunk("t", chunk_s), "t", "t", lambda t, before: t - before >= max_dist, "_b")
    return isl.groupBy(*keys, "_b").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("_b")


def bursts_merged(ev: DataFrame, keys: Sequence[str] | str, max_dist: float, max_gap: float, order: Sequence[str] = ("t",)) -> DataFrame:
    """Bursts joined when the gap between them is below ``max_gap``; ``n`` counts the bursts joined."""
    return merge_by_gap(bursts(ev, keys, max_dist, order), keys, max_gap)


def segments(ev: DataFrame, keys: Sequence[str] | str, max_diff: float, n_min: int, order: Sequence[str] = ("t",), chunk_s: float = DAY) -> DataFrame:
    """Runs without a gap above ``max_diff`` that hold at least ``n_min`` events."""
    keys = names(keys)
    isl = linked(ev, keys, list(order), time_chunk("t", chunk_s), "t", "t", lambda t, before: t - before > max_diff, "_b")
    return isl.groupBy(*keys, "_b").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= n_min).drop("_b")


def burst_ids(ev: DataFrame, keys: Sequence[str] | str, max_dist: float, order: Sequence[str] = ("t",), chunk_s: float = DAY) -> DataFrame:
    """Events with the number of the run they belong to (runs of one event included)."""
    return _gap_islands(ev, names(keys), list(order), "t", lambda g: g >= max_dist, time_chunk("t", chunk_s), "burst")


def burst_patches(events: DataFrame, keys: Sequence[str] | str, chan: str, max_chan_diff: float, n_min: int, tie: str) -> DataFrame:
    """Split each burst where neighbouring channels are more than ``max_chan_diff`` apart; keep big patches."""
    keys = names(keys)
    isl = _gap_islands(events, keys, [chan, tie], chan, lambda g: g > max_chan_diff, F.floor(F.col(chan) / 1024), "patch")
    return isl.groupBy(*keys, "patch").agg(
        F.min(chan).alias("chan_lo"), F.max(chan).alias("chan_hi"), F.count(F.lit(1)).alias("n"),
        F.min("t").alias("t0"), F.max("t").alias("t1")).where(F.col("n") >= n_min)


def network_bursts(events: DataFrame, keys: Sequence[str] | str, chan: str, d_chan: float, min_pop: int, max_gap: int) -> DataFrame:
    """Channels of each burst that hang together around a dense core.

    A core has at least ``min_pop`` events within ``max_gap * d_chan``; channels no farther than that from a
    kept one are added until none is left, i.e. every chain of channels without a larger gap that holds a
    core is kept. Works on the per-channel histogram of a burst, whose size is the number of channels.
    """
    keys = names(keys)
    reach = int(max_gap * d_chan)
    per_chan = events.groupBy(*keys, chan).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(chan)
    pop = per_chan.withColumns({
        "_pop": F.sum("n").over(w.rangeBetween(-reach, reach)),
        "_new": F.coalesce((F.col(chan) - F.lag(chan).over(w) > reach).cast("int"), F.lit(1))})
    chain = pop.withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = chain.groupBy(*keys, "_chain").agg(F.max("_pop").alias("_core")).where(F.col("_core") >= min_pop)
    return join_null_safe(chain, keep, keys + ["_chain"], "left_semi").select(*keys, chan, "n")


def run_length(df: DataFrame, keys: Sequence[str] | str, order: str, label: str, chunk: Column | None = None) -> DataFrame:
    """Runs of equal labels in order: ``(keys, run, label, n, i0, mid)``; mid = start + n // 2, from 0."""
    keys = names(keys)
    chunk = F.floor(F.col(order) / 4096) if chunk is None else chunk
    b = change_blocks(df, keys, order, label, "run", chunk)
    r = scan(b, keys, order, chunk, _i="row")
    return r.groupBy(*keys, "run").agg(
        F.min_by(label, order).alias(label), F.count(F.lit(1)).alias("n"), (F.min("_i") - 1).alias("i0")).withColumn(
        "mid", F.col("i0") + F.floor(F.col("n") / 2))


def change_blocks(df: DataFrame, keys: Sequence[str] | str, order: str, value: str, out: str = "block_id", chunk: Column | None = None) -> DataFrame:
    """Block number (from 1) that rises by one whenever ``value`` changes along ``order``."""
    keys = names(keys)
    chunk = F.floor(F.col(order) / 4096) if chunk is None else chunk
    p = scan(df, keys, order, chunk, _pv=("lag", F.struct(F.col(value).alias("x"))))
    new = F.col("_pv").isNull() | ~F.col("_pv.x").eqNullSafe(F.col(value))
    return islands(p, keys, order, chunk, new, out).drop("_pv")


def block_extents(trials: DataFrame, keys: Sequence[str] | str, block: str, exclude_zero: bool = True) -> DataFrame:
    """First start and last stop of every block id; id 0 may be left out."""
    src = trials.where(F.col(block) > 0) if exclude_zero else trials
    return src.groupBy(*names(keys), block).agg(F.min_by("t0", "t0").alias("t0"), F.max_by("t1", "t0").alias("t1"))


def label_blocks(blocks: DataFrame, stim: DataFrame, keys: Sequence[str] | str, block: str, stim_keys: Sequence[str], bucket: float) -> DataFrame:
    """Name each block by the last of ``stim_keys`` that has a stimulus inside it ('' if none)."""
    keys = names(keys)
    prio = F.lit(None).cast("int")
    for k, s in enumerate(stim_keys):
        prio = F.when(F.col("stim") == s, F.lit(k)).otherwise(prio)
    hits = points_in_windows(stim.withColumn("_p", prio).where("_p IS NOT NULL"), blocks, keys, bucket)
    best = hits.groupBy(*keys, block).agg(F.max("_p").alias("_p"))
    name = F.lit("")
    for k, s in enumerate(stim_keys):
        name = F.when(F.col("_p") == k, F.lit(s)).otherwise(name)
    return join_null_safe(blocks, best, keys + [block], "left").withColumn("name", name).drop("_p")


def jump_segments(points: DataFrame, order: str, coords: str, max_d: float, features: str, chunk: Column | None = None) -> DataFrame:
    """Ordered points cut where consecutive ``coords`` jump by more than ``max_d``.

    Gives the segment number and, inside a segment, the feature distance to the previous point.
    """
    if chunk is None:
        points, chunk = range_chunks(points, [order]), F.col("_range")
    p = scan(points, [], order, chunk, _pc=("lag", coords), _pf=("lag", features))
    step = F.sqrt(sq_distance(coords, "_pc"))
    new = F.col("_pc").isNull() | (step > max_d)
    seg = islands(p, [], order, chunk, new, "segment")
    return seg.withColumn("dist", F.when(~new, F.sqrt(sq_distance(features, "_pf")))).drop("_pc", "_pf", "_range")


def peaked_crossings(
    crossings: DataFrame, peaks: DataFrame, keys: Sequence[str] | str, min_peaks: int, max_gap: float, min_dur: float, bucket: float = 1024.0
) -> DataFrame:
    """Crossings ``[i0, i1]`` with enough peaks inside, merged over gaps up to ``max_gap``, longer than ``min_dur``."""
    keys = names(keys)
    win = crossings.select(*keys, F.col("i0").cast("double").alias("t0"), F.col("i1").cast("double").alias("t1"))
    pts = peaks.select(*keys, F.col("i").cast("double").alias("t"))
    good = points_in_windows(pts, win, keys, bucket).groupBy(*keys, "t0", "t1").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= min_peaks).select(*keys, "t0", "t1")
    # gaps are whole samples: "at most max_gap" is "below max_gap + 1"
    return merge_by_gap(good, keys, max_gap + 1, chunk_s=4096.0).where(F.col("t1") - F.col("t0") > min_dur)
