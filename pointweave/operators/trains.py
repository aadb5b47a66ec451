"""Event trains: intervals inside windows, per-window metrics, summaries over windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import INTERVAL_METRICS, gated
from ..functions.scalars import as_col, correlation, finite, names, ratio
from .ranges import points_in_windows
from .scan import average_rank, join_null_safe, percentile_columns, scan, time_chunk

DAY = 86400.0


def events_in_windows(ev: DataFrame, win: DataFrame, bucket: float, keys: Sequence[str] | str = "recid") -> DataFrame:
    """Events inside closed windows, one row per (event, window)."""
    return points_in_windows(ev, win, keys, bucket)


def raster_events(ev: DataFrame, trg: DataFrame, start: float, stop: float, keys: Sequence[str] | str = "recid") -> DataFrame:
    """Events strictly inside ``(t + start, t + stop)`` of a trigger, with times relative to it."""
    span = trg.select(*names(keys), "win_id", F.col("t").alias("t_trg"),
                      (F.col("t") + start).alias("t0"), (F.col("t") + stop).alias("t1"))
    hits = points_in_windows(ev, span, keys, max(stop - start, 1e-9), closed=False)
    return hits.withColumn("rel_t", F.col("t") - F.col("t_trg")).drop("t0", "t1")


def intervals(
    evw: DataFrame, keys: Sequence[str] | str, order: Sequence[str] = ("t",), chunk_s: float = DAY,
    keep_first: bool = False,
) -> DataFrame:
    """Intervals between consecutive events of a group, each with the interval that follows it.

    Gives one row per interval: ``isi`` ends at the row's event, ``nxt`` starts there (NULL for the last).
    ``keep_first`` also keeps the first event of a group with both NULL, so that one aggregation over the
    result can count events as well.
    """
    out = scan(evw, keys, list(order), time_chunk("t", chunk_s), _pt=("lag", "t"), _nt=("lead", "t"))
    isi = F.col("t") - F.col("_pt")
    out = out.withColumns({"isi": isi, "nxt": F.when(isi.isNotNull(), F.col("_nt") - F.col("t"))}).drop("_pt", "_nt")
    return out if keep_first else out.where("isi IS NOT NULL")


def interval_metrics(isi: DataFrame, keys: Sequence[str] | str, wanted: Sequence[str], min_n: int = 3) -> DataFrame:
    """Algebraic metrics per group in one aggregation (map-side combined), gated by input size."""
    return isi.groupBy(*names(keys)).agg(
        *[gated(m, min_n).alias(m) for m in wanted], F.count("isi").alias("n_isi"), F.count("nxt").alias("n_pairs"),
        F.count(F.lit(1)).alias("n_rows"))


def interval_rho(isi: DataFrame, keys: Sequence[str] | str, min_n: int = 3) -> DataFrame:
    """Spearman correlation of consecutive intervals per group."""
    keys = names(keys)
    pairs = isi.where("nxt IS NOT NULL")
    ranked = average_rank(average_rank(pairs, keys, "isi", "_ra"), keys, "nxt", "_rb")
    return ranked.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= min_n, correlation("_ra", "_rb")).alias("rho"))


def interval_rate(isi: DataFrame, keys: Sequence[str] | str, min_n: int = 1) -> DataFrame:
    """One over the median interval per group."""
    keys = names(keys)
    med = percentile_columns(isi, keys, "isi", {"_med": 0.5})
    n = isi.groupBy(*keys).agg(F.count("isi").alias("_n"))
    return join_null_safe(med, n, keys).select(*keys, F.when(F.col("_n") >= min_n, ratio(F.lit(1.0), "_med")).alias("isi_rate"))


def window_counts(ev: DataFrame, win: DataFrame, bucket: float, recid: str = "recid", uid: str = "uid") -> DataFrame:
    """Event count of every entity in every window of its recording, zeros included."""
    entities = ev.select(recid, uid).distinct()
    n = events_in_windows(ev, win, bucket, recid).groupBy(recid, uid, "win_id").agg(F.count(F.lit(1)).alias("n"))
    # entity x window of one recording is the shape of the result, not an intermediate product
    grid = join_null_safe(entities, win.select(recid, "win_id", "t0", "t1"), [recid])
    return join_null_safe(grid, n, [recid, uid, "win_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def log_rate(counts: DataFrame) -> DataFrame:
    """log10 of events per second in a window; no event or no duration gives NULL."""
    rate = ratio("n", F.col("t1") - F.col("t0"))
    return counts.withColumn("rate", F.when(rate > 0, F.log10(rate)))


def full_estimate(values: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Blank all metrics of a window as soon as one of them is missing."""
    complete = F.lit(True)
    for m in metrics:
        complete = complete & finite(m).isNotNull()
    return values.withColumns({m: F.when(complete, F.col(m)) for m in metrics})


def mean_std(values: DataFrame, keys: Sequence[str] | str, metrics: Sequence[str], n_min: int, count_as: str | None = None) -> DataFrame:
    """Mean and population sd over windows, NULL below ``n_min`` finite values."""
    aggs: list[Column] = [F.count(F.lit(1)).alias(count_as)] if count_as else []
    for m in metrics:
        x = finite(m)
        ok = F.count(x) >= n_min
        aggs += [F.when(ok, F.avg(x)).alias(f"{m}_mean"), F.when(ok, F.stddev_pop(x)).alias(f"{m}_std")]
    return values.groupBy(*names(keys)).agg(*aggs)


def whole_train_metric(isi: DataFrame, keys: Sequence[str] | str, metric: str, more_than: int = 5) -> DataFrame:
    """Metric over all intervals of an entity; needs strictly more than ``more_than`` inputs."""
    build, size = INTERVAL_METRICS[metric]
    return isi.groupBy(*names(keys)).agg(F.when(F.count(as_col(size)) > more_than, build()).alias(metric))
