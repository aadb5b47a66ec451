"""Ordering, capping, sampling and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_key, names
from .filters import dense_ids
from .scan import hash_chunk, join_null_safe, scan, time_chunk

DAY = 86400.0


def custom_order(df: DataFrame, col: str, order: Sequence[str], out: str = "pos") -> DataFrame:
    """Position of a value in a given order list; unlisted values follow with NULL, sorted after."""
    expr = F.lit(None).cast("bigint")
    for k, v in enumerate(order):
        expr = F.when(F.col(col) == F.lit(v), F.lit(k).cast("bigint")).otherwise(expr)
    return df.withColumn(out, expr).orderBy(F.col(out).asc_nulls_last(), col)


def cap_trials(trg: DataFrame, keys: Sequence[str] | str, n_min: int, cap: int | None, mode: str = "first", tie: str = "win_id", salt: str = "cap") -> DataFrame:
    """All triggers, or the first or a reproducible random ``cap`` of each key; none below ``n_min``.

    With exactly ``n_min`` triggers all are kept.
    """
    if cap is None:
        return trg
    keys = names(keys)
    if mode == "first":
        r = scan(trg, keys, ["t", tie], time_chunk("t", DAY), _r="row")
    elif mode == "random":
        r = scan(trg.withColumn("_h", hash_key(salt, tie)), keys, ["_h", tie], hash_chunk("_h"), _r="row").drop("_h")
    else:
        raise ValueError(f"unknown selection {mode!r}")
    n = trg.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n_min)
    return join_null_safe(r, n, keys).where((F.col("_n") == n_min) | (F.col("_r") <= cap)).drop("_r", "_n")


def sample_per_group(df: DataFrame, keys: Sequence[str] | str, n: int, entity: str, salt: str = "pick") -> DataFrame:
    """A reproducible random pick of up to ``n`` rows per group (smallest salted hashes)."""
    r = scan(df.withColumn("_h", hash_key(salt, entity)), keys, ["_h", entity], hash_chunk("_h"), _r="row")
    return r.where(F.col("_r") <= n).drop("_r", "_h")


def common_labels(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).intersect(b.select(col))


def all_labels(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).union(b.select(col)).distinct()


def unmatched_labels(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct labels of ``a`` that ``b`` does not have."""
    return a.select(col).distinct().exceptAll(b.select(col).distinct())


def union_windows(*wins: DataFrame, cols: Sequence[str] = ("recid", "t0", "t1")) -> DataFrame:
    out = wins[0].select(*cols)
    for w in wins[1:]:
        out = out.unionByName(w.select(*cols))
    return out


def trial_types(trials: DataFrame, params: Sequence[str], by: Sequence[str] = (), out: str = "type_id") -> DataFrame:
    """Dense id (from 0) of each distinct parameter row."""
    return dense_ids(trials, params, out, by)


def prior_same_type(trials: DataFrame, keys: Sequence[str] | str, order: Sequence[str], chunk: Column, out: str = "n_before") -> DataFrame:
    """Number of earlier trials of the same type."""
    return scan(trials, keys, list(order), chunk, _r="row").withColumn(out, F.col("_r") - 1).drop("_r")


def stim_by_amp(trg: DataFrame, stims: Sequence[str] | None = None, amps: Sequence[float] | None = None, where: Column | None = None) -> DataFrame:
    """Triggers of the named stimuli whose amplitude is listed or meets a predicate."""
    out = trg if stims is None else trg.where(F.col("stim").isin(list(stims)))
    out = out if amps is None else out.where(F.col("amp").isin(list(amps)))
    return out if where is None else out.where(where)
