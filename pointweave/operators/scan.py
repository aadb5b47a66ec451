"""Ordered scans that keep working when one key holds most of the rows.

A plain ``lag`` or running ``sum`` over ``partitionBy(key)`` puts a whole key into one task. Here every key is
cut into *chunks* along its sort order (a time slice, a value range, a hash prefix). The scan runs per (key,
chunk); a small table with one row per (key, chunk) carries the state between chunks and is joined back. The
only full shuffle is by (key, chunk). There is one path for all sizes, and NULL keys are keys like others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import as_col, names
from ..session import cut_lineage

CHUNK = "_chunk"
RANK_COLUMNS = ("n", "below", "total")  # output columns of running_rank


def time_chunk(t: str | Column, width: float) -> Column:
    return F.floor(as_col(t) / F.lit(float(width)))


def magnitude_chunk(col: str | Column, per_octave: int = 64) -> Column:
    """Chunk index of a number that follows its sort order: log-spaced bins of about 1 % relative width.

    Needs no look at the data, so every use of a table chunks alike. Values that crowd around a large
    offset (timestamps) want ``time_chunk`` instead.
    """
    v = as_col(col).cast("double")
    return F.signum(v) * F.floor(F.log2(F.lit(1.0) + F.abs(v) * 1e6) * per_octave)


def hash_chunk(h: str | Column, digits: int = 2) -> Column:
    """Leading hex digits of an md5 key: 16 ** ``digits`` equal chunks in key order."""
    return F.substring(as_col(h), 1, digits)


def range_chunks(df: DataFrame, cols: Sequence[str], out: str = "_range") -> DataFrame:
    """Add a chunk that follows the order of ``cols`` whatever their values: the number of the range partition.

    For orders without a natural chunk (labels, paths, ids) and for scans without a key: there are as many chunks as
    partitions, even in size unless rows are equal in all of ``cols``. The numbered rows are written once, so that every
    later reader sees the same numbers.
    """
    return cut_lineage(df.repartitionByRange(*[F.col(c) for c in cols]).withColumn(out, F.spark_partition_id()))


def null_safe(df: DataFrame, cols: Sequence[str], prefix: str) -> dict[str, Column]:
    """Columns to use as keys in place of ``cols``: never NULL, and equal where ``cols`` are equal or both NULL.

    Plain equality on them joins NULL keys, and windows and joins share one shuffle.
    """
    kinds, out, nulls = dict(df.dtypes), {}, F.lit(0)
    for i, c in enumerate(cols):
        kind = kinds[c]
        if kind == "string":
            out[f"{prefix}{i}"] = F.coalesce(F.col(c), F.lit(""))
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
            out[f"{prefix}{i}"] = F.coalesce(F.col(c), F.lit(0).cast(kind))
        else:
            out[f"{prefix}{i}"] = F.struct(c)
        nulls = nulls + F.when(F.col(c).isNull(), 1 << i).otherwise(0)
    return out | ({f"{prefix}n": nulls} if cols else {})


def join_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL meets NULL; the keys appear once, from ``a``."""
    right = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(right, cond, how).drop(*[f"_k_{k}" for k in keys])


def scan(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    chunk: Column,
    **outs: tuple[str, Column | str] | str,
) -> DataFrame:
    """Add ordered-scan columns to ``df``.

    ``outs`` maps an output name to ``(kind, column)``; kinds are ``lag``, ``lead``, ``sum``, ``max``,
    ``min``, ``reach`` (largest value *before* the row), ``last`` (latest non-NULL up to the row),
    ``next`` (earliest non-NULL from the row on), ``prior`` and ``follow`` (the same without the row),
    ``first``, ``total``, and the bare string ``"row"`` for a row number. ``order`` must give a strict
    order inside a key and ``chunk`` must not decrease along it (NULL first). NULL keys are a key of their own.
    """
    keys, order = names(keys), names(order)
    specs = {o: (s, F.lit(1)) if isinstance(s, str) else (s[0], as_col(s[1])) for o, s in outs.items()}
    base, whole, at = _chunked(df, keys, chunk)
    pkeys = whole + at
    frame, across, pos = _Frames(pkeys, order), _Frames(whole, at), F.struct(*order)
    local, edge, carry, final = {}, {}, {}, {}
    for out, (kind, c) in specs.items():
        lo, ca = F.col(f"_l_{out}"), F.col(f"_c_{out}")
        if kind not in ("first", "total"):
            boxed = F.struct(c.alias("v")) if kind in ("lag", "lead") else c
            local[f"_l_{out}"] = _local(kind, boxed, frame)
        edge[f"_e_{out}"] = _edge(kind, c, pos)
        carry[f"_c_{out}"] = _carry(kind, f"_e_{out}", across)
        final[out] = _combine(kind, lo, ca)
    edges = base.groupBy(*pkeys).agg(*[e.alias(n) for n, e in edge.items()])
    edges = edges.select(*pkeys, *[c.alias(n) for n, c in carry.items()])
    joined = (base.withColumns(local) if local else base).join(edges, pkeys, "left")
    return joined.select(*df.columns, *[c.alias(n) for n, c in final.items()])


def _chunked(df: DataFrame, keys: list[str], chunk: Column) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with never-NULL key columns and chunk columns, and the names of both."""
    base = df.withColumn(CHUNK, chunk)
    group, part = null_safe(base, keys, "_g"), null_safe(base, [CHUNK], "_p")
    base = base.withColumns(group | part)
    return base.withColumn("_pn", 1 - F.col("_pn")), list(group), ["_pn", "_p0"]  # NULL chunks carry 1 and come first


def linked(
    df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str, chunk: Column, lo: str, reach: str,
    apart: Callable[[Column, Column], Column], out: str = "_start",
) -> DataFrame:
    """Add ``out``: a struct that names the island of each row, with one pass over the chunks.

    A row opens an island when ``apart(lo, r)`` holds for the largest ``reach`` r before it; ``lo`` must not decrease
    along ``order`` and ``apart`` must not turn false again as ``lo`` grows. What a chunk does to the islands around it is
    then a small map: with the reach C carried in, exactly the rows whose ``lo`` is apart from C can open islands, and
    whether they do is known inside the chunk. The maps of a key are chained on the table of chunks.
    """
    keys, order = names(keys), names(order)
    base, whole, at = _chunked(df, keys, chunk)
    pkeys = whole + at
    frame, across = _Frames(pkeys, order), _Frames(whole, at)
    here = F.struct(F.col(lo).alias("lo"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    opens = lambda at_lo, r: r.isNull() | apart(at_lo, r)
    base = base.withColumn("_lr", F.max(reach).over(frame.before))
    base = base.withColumn("_ls", F.last(F.when(opens(F.col(lo), F.col("_lr")), here), ignorenulls=True).over(frame.upto))
    edges = base.groupBy(*pkeys).agg(F.max(reach).alias("_er"), F.max("_ls").alias("_es"))
    edges = edges.withColumn("_c", F.max("_er").over(across.before))
    own = F.when(opens(F.col("_es.lo"), F.col("_c")), F.col("_es"))
    edges = edges.select(*pkeys, "_c", F.last(own, ignorenulls=True).over(across.before).alias("_s"))
    start = F.when(opens(F.col("_ls.lo"), F.col("_c")), F.col("_ls")).otherwise(F.col("_s"))
    return base.join(edges, pkeys, "left").select(*df.columns, start.alias(out))


class _Frames:
    """The window frames of one ordered partition."""

    def __init__(self, keys: list[str], order: list[str]) -> None:
        self.w = Window.partitionBy(*keys).orderBy(*order)
        self.upto = self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.before = self.w.rowsBetween(Window.unboundedPreceding, -1)
        # rows from here on, as a growing frame of the reversed order (a shrinking frame costs rows squared)
        back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
        self.onward = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.after = back.rowsBetween(Window.unboundedPreceding, -1)
        self.all = self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _local(kind: str, c: Column, f: _Frames) -> Column:
    """The scan inside one chunk."""
    match kind:
        case "lag":
            return F.lag(c).over(f.w)
        case "lead":
            return F.lead(c).over(f.w)
        case "row":
            return F.row_number().over(f.w).cast("bigint")
        case "sum":
            return F.sum(c).over(f.upto)
        case "max":
            return F.max(c).over(f.upto)
        case "min":
            return F.min(c).over(f.upto)
        case "reach":
            return F.max(c).over(f.before)
        case "last":
            return F.last(c, ignorenulls=True).over(f.upto)
        case "prior":
            return F.last(c, ignorenulls=True).over(f.before)
        case "next":
            return F.last(c, ignorenulls=True).over(f.onward)
        case "follow":
            return F.last(c, ignorenulls=True).over(f.after)
    raise ValueError(f"unknown scan kind {kind!r}")


def _edge(kind: str, c: Column, pos: Column) -> Column:
    """What a chunk hands to the other chunks of its key."""
    match kind:
        case "lag":
            return F.max_by(F.struct(c.alias("v")), pos)
        case "lead":
            return F.min_by(F.struct(c.alias("v")), pos)
        case "row":
            return F.count(F.lit(1))
        case "sum" | "total":
            return F.sum(c)
        case "max" | "reach":
            return F.max(c)
        case "min":
            return F.min(c)
        case "last" | "prior":
            return F.max_by(c, F.when(c.isNotNull(), pos))
        case "next" | "follow":
            return F.min_by(c, F.when(c.isNotNull(), pos))
        case "first":
            return F.min_by(F.struct(c.alias("v")), pos)
    raise ValueError(f"unknown scan kind {kind!r}")


def _carry(kind: str, edge: str, f: _Frames) -> Column:
    """State entering a chunk from the earlier (or later) chunks of its key."""
    match kind:
        case "lag":
            return F.lag(edge).over(f.w)
        case "lead":
            return F.lead(edge).over(f.w)
        case "row" | "sum":
            return F.sum(edge).over(f.before)
        case "max" | "reach":
            return F.max(edge).over(f.before)
        case "min":
            return F.min(edge).over(f.before)
        case "last" | "prior":
            return F.last(edge, ignorenulls=True).over(f.before)
        case "next" | "follow":
            return F.last(edge, ignorenulls=True).over(f.after)
        case "total":
            return F.sum(edge).over(f.all)
        case "first":
            return F.first(edge).over(f.all)
    raise ValueError(f"unknown scan kind {kind!r}")


def _combine(kind: str, lo: Column, ca: Column) -> Column:
    match kind:
        case "lag" | "lead":
            return F.coalesce(lo, ca)["v"]
        case "row" | "sum":
            return F.when(lo.isNull(), ca).otherwise(lo + F.coalesce(ca, F.lit(0)))
        case "max" | "reach":
            return F.greatest(lo, ca)
        case "min":
            return F.least(lo, ca)
        case "first":
            return ca["v"]
        case "total":
            return ca
    return F.coalesce(lo, ca)


def running_rank(
    df: DataFrame, keys: Sequence[str] | str, value: str, weight: str | None = None, chunk: Column | None = None,
) -> DataFrame:
    """Per distinct (key, value): ``n`` rows, ``below`` = rows with a smaller value, ``total`` rows.

    Equal values are counted first (map-side), so ties never meet in one task; average rank is
    ``below + (n + 1) / 2``. NULL values are left out.
    """
    keys = names(keys)
    src = df.where(F.col(value).isNotNull())
    agg = F.sum(weight) if weight else F.count(F.lit(1))
    hist = src.groupBy(*keys, value).agg(agg.alias("n"))
    by = magnitude_chunk(value) if chunk is None else chunk
    ranked = scan(hist, keys, value, by, _upto=("sum", "n"), total=("total", "n"))
    return ranked.withColumn("below", F.col("_upto") - F.col("n")).drop("_upto")


def average_rank(
    df: DataFrame, keys: Sequence[str] | str, value: str, out: str, chunk: Column | None = None
) -> DataFrame:
    """Add the average (mid) rank of ``value`` inside each key."""
    keys = names(keys)
    if value in RANK_COLUMNS:
        return average_rank(df.withColumnRenamed(value, "_val"), keys, "_val", out, chunk).withColumnRenamed("_val", value)
    ranks = running_rank(df, keys, value, chunk=chunk).select(
        *keys, value, (F.col("below") + (F.col("n") + 1) / 2.0).alias(out)
    )
    return join_null_safe(df, ranks, keys + [value], "left")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str] | str, value: str, probs: Sequence[float], mode: str = "linear",
    chunk: Column | None = None,
) -> DataFrame:
    """Exact percentiles per key as rows ``(*keys, prob, value)``.

    They come from the histogram of distinct values with a chunked running count, so no group is gathered.
    ``mode`` is ``linear`` (interpolated) or ``lower`` (order statistic at floor(p(n-1))).
    """
    keys = names(keys)
    if value in RANK_COLUMNS:
        return exact_percentiles(df.withColumnRenamed(value, "_val"), keys, "_val", probs, mode, chunk).withColumnRenamed("_val", value)
    cum = running_rank(df, keys, value, chunk=chunk)
    probs_col = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    r = cum.select(*keys, F.col(value).alias("_v"), "n", "below", "total", probs_col)
    spot = F.col("prob") * (F.col("total") - 1)
    lo, hi = F.floor(spot), F.ceil(spot)
    inside = lambda p: (p >= F.col("below")) & (p < F.col("below") + F.col("n"))
    picked = r.where(inside(lo) | inside(hi)).groupBy(*keys, "prob").agg(
        F.max(F.when(inside(lo), F.col("_v"))).alias("_lo"),
        F.max(F.when(inside(hi), F.col("_v"))).alias("_hi"),
        F.max(spot - lo).alias("_f"),
    )
    val = F.col("_lo").cast("double")
    if mode == "linear":
        val = val + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    return picked.select(*keys, "prob", val.alias(value))


def percentile_columns(
    df: DataFrame, keys: Sequence[str] | str, value: str, outs: dict[str, float], mode: str = "linear",
    chunk: Column | None = None,
) -> DataFrame:
    """``exact_percentiles`` pivoted to one row per key and one column per requested percentile."""
    keys = names(keys)
    long = exact_percentiles(df, keys, value, sorted(set(outs.values())), mode, chunk)
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col(value))).alias(o) for o, p in outs.items()]
    )
