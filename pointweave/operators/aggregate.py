"""Group summaries: crosstabs, shares, percentiles and category profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import finite, names, ratio
from .scan import exact_percentiles, join_null_safe, percentile_columns


def levels_grid(df: DataFrame, a1: str, a2: str, by: Sequence[str] = ()) -> DataFrame:
    """All level combinations of two categories (inside ``by``), NULL levels included: a zero-filled matrix.

    The result has one row per cell by definition; the levels themselves are joined, not gathered.
    """
    by = list(by)
    rows = df.select(*by, a1).distinct().withColumn("_one", F.lit(1))
    cols = df.select(*by, a2).distinct().withColumn("_one", F.lit(1))
    return join_null_safe(rows, cols, [*by, "_one"]).select(*by, a1, a2)


def crosstab(df: DataFrame, a1: str, a2: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, a1, a2, n)`` with zeros for combinations that do not occur."""
    keys = [*by, a1, a2]
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return join_null_safe(levels_grid(n, a1, a2, by), n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def crosstab_pairs(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Crosstabs of every attribute pair in one pass: ``(attr1, attr2, v1, v2, n, frac)``; no empty rows."""
    pairs = [F.struct(F.lit(a).alias("attr1"), F.lit(b).alias("attr2"), F.col(a).cast("string").alias("v1"), F.col(b).cast("string").alias("v2"))
             for i, a in enumerate(attrs) for b in attrs[i + 1:]]
    n = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy("attr1", "attr2", "v1", "v2").agg(F.count(F.lit(1)).alias("n"))
    return with_share(n, ["attr1", "attr2", "v1"], "n", "frac")


def with_share(counts: DataFrame, by: Sequence[str] | str, n: str = "n", out: str = "frac") -> DataFrame:
    """Share of each count in the total of its group (a count table, so the groups are level-sized)."""
    return counts.withColumn(out, ratio(n, F.sum(n).over(Window.partitionBy(*names(by)))))


def winner_category(counts: DataFrame, node: str, cat: str, norm: str = "row") -> DataFrame:
    """Category with the largest share per node; shares of the node's row or of the category's column."""
    s = with_share(counts, node if norm == "row" else cat)
    best = F.min_by(F.struct(F.col(cat).alias("winner"), F.col("frac").alias("share")), F.struct(-F.col("frac"), F.col(cat)))
    return s.where("n > 0").groupBy(node).agg(best.alias("b")).select(node, "b.winner", "b.share")


def counts_with_totals(df: DataFrame, a1: str, a2: str, total: str = "total") -> DataFrame:
    c = df.cube(a1, a2).agg(F.count(F.lit(1)).alias("n"), F.grouping(a1).alias("_g1"), F.grouping(a2).alias("_g2"))
    return c.select(
        F.when(F.col("_g1") == 1, F.lit(total)).otherwise(F.col(a1)).alias(a1),
        F.when(F.col("_g2") == 1, F.lit(total)).otherwise(F.col(a2)).alias(a2), "n")


def region_stats(df: DataFrame, region: str, recid: str, task: str, parent: str) -> DataFrame:
    """Members, recordings and tasks per region, and whether the region has one parent only.

    Rows are first counted per (region, recid, task, parent), so distinct counts see level combinations.
    """
    combos = df.groupBy(region, recid, task, parent).agg(F.count(F.lit(1)).alias("n"))
    return combos.groupBy(region).agg(
        F.sum("n").alias("n"), F.count_distinct(recid).alias("n_rec"), F.count_distinct(task).alias("n_task"),
        (F.count_distinct(parent) == 1).alias("one_parent"))


def region_layer_matrix(df: DataFrame, region: str, layer: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Counts per region in named layer groups; layers in no group go to 'rest'."""
    bucket = F.lit("rest")
    for name, members in groups.items():
        bucket = F.when(F.col(layer).isin(list(members)), F.lit(name)).otherwise(bucket)
    b = df.withColumn("_b", bucket)
    return b.groupBy(region).agg(*[F.count(F.when(F.col("_b") == g, 1)).alias(g) for g in [*groups, "rest"]])


def percentile_table(df: DataFrame, keys: Sequence[str] | str, value: str, probs: Sequence[float], mode: str = "linear") -> DataFrame:
    return exact_percentiles(df, keys, value, probs, mode)


def contrast_stats(df: DataFrame, keys: Sequence[str] | str, value: str) -> DataFrame:
    """N, mean, population sd, standard error (sample sd over root N) of finite values."""
    x = finite(value)
    return df.groupBy(*names(keys)).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        ratio(F.stddev_samp(x), F.sqrt(F.count(x))).alias("sem"))


def polarization(enrichment: DataFrame, cat: str, z: str, overall: str = "all") -> DataFrame:
    """Mean absolute enrichment and its variance, overall and per category; missing counts as 0."""
    x = F.coalesce(finite(z), F.lit(0.0))
    r = enrichment.withColumn("_x", x).rollup(cat).agg(
        F.avg(F.abs("_x")).alias("amp"), F.var_pop("_x").alias("var"), F.grouping(cat).alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit(overall)).otherwise(F.col(cat)).alias(cat), "amp", "var")


def aligned_percentiles(psth: DataFrame, cat: str, value: str) -> DataFrame:
    """Quartiles of the aligned response per category and bin."""
    return percentile_columns(psth.where(F.col(value).isNotNull()), [cat, "bin"], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def group_feature_mean(df: DataFrame, group: str, features: Sequence[str], where: Column | None = None) -> DataFrame:
    src = df if where is None else df.where(where)
    return src.groupBy(group).agg(*[F.avg(finite(f)).alias(f) for f in features])


def state_ratios(win: DataFrame, keys: Sequence[str] | str, state: str = "state") -> DataFrame:
    """Window counts per state and the ratios quiet/(active+uncertain) and quiet/(active+quiet)."""
    n = {s: F.count(F.when(F.col(state) == s, 1)) for s in ("active", "quiet", "uncertain")}
    c = win.groupBy(*names(keys)).agg(*[v.alias(f"n_{k}") for k, v in n.items()])
    return c.withColumns({
        "quiet_vs_rest": ratio("n_quiet", F.col("n_active") + F.col("n_uncertain")),
        "quiet_share": ratio("n_quiet", F.col("n_active") + F.col("n_quiet"))})


def roi_counts(df: DataFrame, roi: str, layer: str, layer_sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Members per ROI in each (possibly overlapping) set of layers."""
    return df.groupBy(roi).agg(*[F.count(F.when(F.col(layer).isin(list(m)), 1)).alias(s) for s, m in layer_sets.items()])


def membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key of either side labelled 'both', 'only_a' or 'only_b'."""
    x = a.select(key).distinct().withColumn("_a", F.lit(1)).unionByName(b.select(key).distinct().withColumn("_a", F.lit(2)))
    s = x.groupBy(key).agg(F.sum("_a").alias("_s"))
    return s.select(key, F.when(F.col("_s") == 3, "both").when(F.col("_s") == 1, "only_a").otherwise("only_b").alias("side"))


def share_change(df: DataFrame, group: str, cat: str) -> DataFrame:
    """Category share inside a group against the overall share, as change in percent."""
    n = df.groupBy(group, cat).agg(F.count(F.lit(1)).alias("n"))
    s = with_share(n, group, "n", "share")
    whole = with_share(n.groupBy(cat).agg(F.sum("n").alias("_n")).withColumn("_one", F.lit(1)), "_one", "_n", "overall")
    j = join_null_safe(s, whole.select(cat, "overall"), [cat])
    return j.select(group, cat, "n", "share", "overall", (ratio(F.col("share") - F.col("overall"), "overall") * 100).alias("change_pct"))


def group_mean_median(df: DataFrame, group: str, score: str) -> DataFrame:
    """Mean and median of a score per group label."""
    med = percentile_columns(df.where(F.col(score).isNotNull()), group, score, {"median": 0.5})
    return join_null_safe(df.groupBy(group).agg(F.avg(score).alias("mean"), F.count(score).alias("n")), med, names(group))


def category_profile(df: DataFrame, cat: str, features: Sequence[str]) -> DataFrame:
    """Count and 10/50/90 percentiles of every feature per category, as ``(cat, feature, n, p10, p50, p90)``."""
    long = df.select(cat, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), finite(f).alias("value")) for f in features])).alias("c")).select(cat, "c.*").where("value IS NOT NULL")
    n = long.groupBy(cat, "feature").agg(F.count("value").alias("n"))
    return n.join(percentile_columns(long, [cat, "feature"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), [cat, "feature"])


def signif_share(df: DataFrame, group: str, flag: str, n_min: int) -> DataFrame:
    """Share of true flags per group; NULL flags do not count; small groups are left out."""
    return df.groupBy(group).agg(F.count(flag).alias("n"), F.avg(F.col(flag).cast("int")).alias("share")).where(F.col("n") >= n_min)


def node_occupancy(df: DataFrame, node: str, recid: str) -> DataFrame:
    """Per node: members, recordings, members per recording, and each recording's share with its rank."""
    n = df.groupBy(node, recid).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(node)
    total, recs = F.sum("n").over(w), F.count(F.lit(1)).over(w)
    return n.select(
        node, recid, "n", recs.alias("n_rec"), ratio(total, recs).alias("per_rec"), ratio("n", total).alias("share"),
        F.row_number().over(w.orderBy(F.desc("n"), recid)).cast("bigint").alias("rank"))
