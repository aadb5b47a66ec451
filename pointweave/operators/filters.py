"""Projections, filters and recodings of attribute tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_col, finite
from .scan import range_chunks, scan

# Areas whose name ends in a digit that is not a layer.
DIGIT_AREAS = ("CA1", "CA2", "CA3")
NO_LAYER = "NA"


def filter_units(
    df: DataFrame, layer: str | None = None, layers: Sequence[str] = (), equal: Mapping[str, Sequence] | None = None,
    quality: Sequence[str] = (),
) -> DataFrame:
    """Keep units whose layer contains one of ``layers``, whose columns are in the given lists and whose
    quality flags are all 1."""
    cond = F.lit(True)
    if layer and layers:
        hit = F.lit(False)
        for part in layers:
            hit = hit | F.col(layer).contains(part)
        cond = cond & hit
    for col, allowed in (equal or {}).items():
        cond = cond & F.col(col).isin(list(allowed))
    for q in quality:
        cond = cond & (F.col(q) == 1)
    return df.where(cond)


def complete_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: finite(f) for f in features}).dropna(subset=list(features))


def physical_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Keep rows inside inclusive bounds; a missing feature or an absent column passes."""
    cond = F.lit(True)
    for f, (lo, hi) in bounds.items():
        if f in df.columns:
            cond = cond & F.coalesce(finite(f).between(lo, hi), F.lit(True))
    return df.where(cond)


def min_windows(df: DataFrame, win: DataFrame, key: str, n_min: int) -> DataFrame:
    """Drop recordings that have ``n_min`` windows or fewer."""
    enough = win.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n_min).select(key)
    return df.join(enough, key, "left_semi")


def trim_outliers(df: DataFrame, cols: Sequence[str], z_max: float) -> DataFrame:
    """Drop |z| > ``z_max`` column after column; each step takes mean and sd of the rows still there.

    Mean and sd are one-row aggregates attached by scalar subquery, so no row is moved.
    """
    for c in cols:
        m = df.agg(F.struct(F.avg(c).alias("mu"), F.stddev_pop(c).alias("sd")).alias("m")).scalar()
        df = df.where(F.abs(F.col(c) - m.getField("mu")) <= F.lit(z_max) * m.getField("sd"))
    return df


def decompose_region(df: DataFrame, region: str, area: str = "area", layer: str = "layer") -> DataFrame:
    """Split a region name at its first digit into area and layer; text after '|' is cut off."""
    name = F.substring_index(F.col(region), "|", 1)
    head = F.regexp_extract(name, r"^([^0-9]*)", 1)
    whole = name.isin(list(DIGIT_AREAS))
    tail = F.substring(name, F.length(head) + 1, F.length(name))
    return df.withColumns({
        area: F.when(whole, name).otherwise(head),
        layer: F.when(whole | (tail == ""), F.lit(NO_LAYER)).otherwise(tail)})


def parent_region(df: DataFrame, child: str, parents: DataFrame, default: str = "na") -> DataFrame:
    """Look up the parent of a region; the first match (lowest ``rank``) wins, none gives ``default``."""
    first = parents.groupBy(child).agg(F.min_by("parent", F.struct("rank", "parent")).alias("parent"))
    return df.join(first, child, "left").withColumn("parent", F.coalesce("parent", F.lit(default)))


def depth_group(layer: str | Column) -> Column:
    """'deep' when the layer text mentions 5 or 6, else 'sup'."""
    x = as_col(layer)
    return F.when(x.contains("5") | x.contains("6"), F.lit("deep")).otherwise(F.lit("sup"))


def composite_keys(df: DataFrame, area: str, layer: str, roi: str) -> DataFrame:
    digits = F.regexp_replace(F.col(layer), "[^0-9]", "")
    return df.withColumns({
        "area_layer": F.concat_ws("|", F.col(area), digits),
        "roi_layer": F.concat_ws("|", F.col(roi).cast("string"), digits),
        "depth": depth_group(layer),
        "roi_depth": F.concat_ws("|", F.col(roi).cast("string"), depth_group(layer))})


def recode_values(df: DataFrame, recodes: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Replace listed values of listed columns, others stay."""
    out = {}
    for col, mapping in recodes.items():
        expr = F.col(col)
        for old, new in mapping.items():
            expr = F.when(F.col(col) == F.lit(old), F.lit(new)).otherwise(expr)
        out[col] = expr
    return df.withColumns(out)


def bool_label(df: DataFrame, flags: Sequence[str], out: str, default: str = "na") -> DataFrame:
    """Name of the last flag that is true, else ``default``."""
    picks = [F.when(F.col(f), F.lit(f)) for f in reversed(list(flags))]
    return df.withColumn(out, F.coalesce(*picks, F.lit(default)))


def threshold_class(
    df: DataFrame, col: str, lo: float, hi: float, out: str, below: str = "narrow", above: str = "wide",
    between: str = "unclassified",
) -> DataFrame:
    return df.withColumn(out, F.when(F.col(col) < lo, below).when(F.col(col) > hi, above).otherwise(between))


def text_group(df: DataFrame, col: str, patterns: Mapping[str, str], out: str, default: str = "other") -> DataFrame:
    """First group whose pattern is found in the text."""
    expr = F.lit(default)
    for group, pattern in reversed(list(patterns.items())):
        expr = F.when(F.col(col).rlike(pattern), F.lit(group)).otherwise(expr)
    return df.withColumn(out, expr)


def param_profile(df: DataFrame, params: Sequence[str]) -> DataFrame:
    """Per parameter: is it boolean (only 0/1 and not all 1), number of distinct values, min and max.

    The values are unpivoted and grouped by (param, value) first, so distinct counting moves only values.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("param"), finite(p).alias("value")) for p in params])).alias("c")).select("c.*")
    per_value = long.groupBy("param", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    return per_value.groupBy("param").agg(
        (F.bool_and(F.col("value").isin(0.0, 1.0) & known) & ~F.bool_and(F.coalesce(F.col("value") == 1.0, F.lit(False)))).alias("is_bool"),
        F.count("value").alias("n_values"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def affine_coords(df: DataFrame, dataset: str, transforms: Mapping[str, Mapping[str, tuple[float, float]]], digits: int = 3) -> DataFrame:
    """Per data set ``round(scale * x + shift, digits)`` for each coordinate; unlisted data sets stay."""
    cols = sorted({c for t in transforms.values() for c in t})
    out = {}
    for c in cols:
        expr = F.col(c).cast("double")
        for ds, t in transforms.items():
            if c in t:
                scale, shift = t[c]
                expr = F.when(F.col(dataset) == ds, F.round(F.col(c) * scale + shift, digits)).otherwise(expr)
        out[c] = expr
    return df.withColumns(out)


def metric_filter(df: DataFrame, metrics: Sequence[str], rate: str, min_rate: float) -> DataFrame:
    """Keep rows with a finite value in every metric and a rate of at least ``min_rate``."""
    cond = F.col(rate) >= min_rate
    for m in metrics:
        cond = cond & finite(m).isNotNull()
    return df.where(cond)


def dense_ids(df: DataFrame, cols: Sequence[str], out: str, by: Sequence[str] = ()) -> DataFrame:
    """Dense id (from 0) of the distinct rows of ``cols`` inside ``by``.

    Only distinct combinations are numbered, in range partitions over all columns, so no single column has to spread
    them; the ids are joined back NULL-safely.
    """
    by, cols = list(by), list(cols)
    combos = range_chunks(df.select(*by, *cols).distinct(), by + cols)
    ids = scan(combos, by, cols, F.col("_range"), **{out: "row"}).withColumn(out, F.col(out) - 1)
    cond = F.lit(True)
    ids = ids.select(*[F.col(c).alias(f"_k_{c}") for c in by + cols], out)
    for c in by + cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(ids, cond, "left").drop(*[f"_k_{c}" for c in by + cols])
