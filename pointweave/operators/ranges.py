"""Range joins on time: equi join on key and time bucket, then the exact comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import names
from .scan import join_null_safe, scan, time_chunk


def _buckets(lo: str, hi: str, width: float):
    first, last = F.floor(F.col(lo) / float(width)), F.floor(F.col(hi) / float(width))
    return F.sequence(first, F.greatest(first, last))


def points_in_windows(
    points: DataFrame, windows: DataFrame, keys: Sequence[str] | str, bucket: float,
    t: str = "t", t0: str = "t0", t1: str = "t1", closed: bool = True,
) -> DataFrame:
    """Every (point, window) pair with the point inside the window.

    A point has one bucket, a window one row per bucket it touches, so a pair meets exactly once. Pick
    ``bucket`` near the usual window length: a hot key is spread over its buckets.
    """
    keys = names(keys)
    p = points.withColumn("_bk", F.floor(F.col(t) / float(bucket)))
    w = windows.withColumn("_bk", F.explode(_buckets(t0, t1, bucket)))
    inside = (F.col(t) >= F.col(t0)) & (F.col(t) <= F.col(t1)) if closed else (
        (F.col(t) > F.col(t0)) & (F.col(t) < F.col(t1)))
    return join_null_safe(p, w, keys + ["_bk"]).where(inside).drop("_bk")


def window_pairs(
    a: DataFrame, b: DataFrame, keys: Sequence[str] | str, bucket: float,
    a0: str = "t0", a1: str = "t1", b0: str = "b0", b1: str = "b1",
) -> DataFrame:
    """Every overlapping (closed) pair of windows; kept only in the first bucket both touch."""
    keys = names(keys)
    left = a.withColumn("_bk", F.explode(_buckets(a0, a1, bucket)))
    right = b.withColumn("_bk", F.explode(_buckets(b0, b1, bucket)))
    first = F.greatest(F.floor(F.col(a0) / float(bucket)), F.floor(F.col(b0) / float(bucket)))
    overlap = (F.col(a0) <= F.col(b1)) & (F.col(a1) >= F.col(b0))
    return join_null_safe(left, right, keys + ["_bk"]).where(overlap & (F.col("_bk") == first)).drop("_bk")


def overlap_flag(
    windows: DataFrame, others: DataFrame, keys: Sequence[str] | str, out: str, chunk_s: float,
    pad: float = 0.0,
) -> DataFrame:
    """Add ``out`` = does the window, widened by ``pad`` on both sides, overlap any other window.

    No pairs are built: a window overlaps something iff the largest end among the windows that begin
    no later than its own end reaches its start. One running maximum over both tables answers that.
    """
    keys = names(keys)
    cols = windows.columns
    q = windows.select(
        *keys, F.struct(*cols).alias("_row"), (F.col("t1") + pad).alias("_pos"), F.lit(1).alias("_side"),
        F.lit(None).cast("double").alias("_end"), F.xxhash64(*cols).alias("_n"))
    o = others.select(
        *keys, F.lit(None).cast(q.schema["_row"].dataType).alias("_row"), F.col("t0").alias("_pos"),
        F.lit(0).alias("_side"), F.col("t1").alias("_end"), F.xxhash64("t0", "t1").alias("_n"))
    both = scan(q.unionByName(o), keys, ["_pos", "_side", "_n"], time_chunk("_pos", chunk_s), _reach=("max", "_end"))
    hit = F.coalesce(F.col("_reach") >= F.col("_row.t0") - F.lit(pad), F.lit(False))
    return both.where("_side = 1").select("_row.*", hit.alias(out))


def count_in_windows(
    windows: DataFrame, points: DataFrame, keys: Sequence[str] | str, out: str, chunk_s: float,
    closed: bool = True,
) -> DataFrame:
    """Add ``out`` = number of points of the key inside each window, from cumulative counts (no pairs)."""
    keys, shown = names(keys), windows.columns
    # equal windows are counted once and unfolded at the end
    windows = windows.groupBy(*shown).agg(F.count(F.lit(1)).alias("_copies"))
    ids = F.xxhash64(*windows.columns)
    lo_side, hi_side = (-1, 1) if closed else (1, -1)
    ends = windows.select(
        *keys, F.struct(*windows.columns).alias("_row"), ids.alias("_n"),
        F.explode(F.array(
            F.struct(F.col("t0").alias("p"), F.lit(lo_side).alias("s"), F.lit(-1).alias("g")),
            F.struct(F.col("t1").alias("p"), F.lit(hi_side).alias("s"), F.lit(1).alias("g")))).alias("_e"),
    ).select(*keys, "_row", "_n", F.col("_e.p").alias("_pos"), F.col("_e.s").alias("_side"),
             F.col("_e.g").alias("_sign"), F.lit(0).alias("_one"))
    per_t = points.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("_one"))
    pts = per_t.select(
        *keys, F.lit(None).cast(ends.schema["_row"].dataType).alias("_row"), F.lit(0).cast("bigint").alias("_n"),
        F.col("t").alias("_pos"), F.lit(0).alias("_side"), F.lit(0).alias("_sign"), F.col("_one"))
    both = scan(
        ends.unionByName(pts), keys, ["_pos", "_side", "_n", "_sign"], time_chunk("_pos", chunk_s),
        _cum=("sum", "_one"))
    counted = both.where("_sign <> 0").groupBy("_row").agg(
        F.sum(F.col("_sign") * F.col("_cum")).cast("bigint").alias(out))
    each = counted.select("_row.*", out).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    return each.select(*shown, out)
