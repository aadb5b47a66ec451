"""Aggregation queries (A)."""

from pyspark.sql import functions as F

from ..operators import aggregate as ag
from ..operators.scan import average_rank, join_null_safe, percentile_columns, scan, time_chunk
from ..sources import tables as src
from .alignment import _PSTH, SIGMA, START, STOP, WIDTH, ZSCORE_SQL, _psth
from .joining import _PRE, _STATE, _prestim, _quiet
from .registry import query
from .sources_filters import units
from .sqltext import with_ctes


def _orders(spark, sf):
    return src.read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("a1"), F.col("o_orderstatus").alias("a2"),
        F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))


_GRID = "SELECT a.area, b.seg, count(u.uid) AS n FROM (SELECT DISTINCT area FROM u) a CROSS JOIN (SELECT DISTINCT seg FROM u) b LEFT JOIN u ON u.area = a.area AND u.seg = b.seg GROUP BY ALL"


@query("crosstab", "A1", "area:s seg:s n:i", with_ctes("units", _GRID, u="SELECT * FROM units"))
def crosstab(spark, sf):
    return ag.crosstab(units(spark, sf), "area", "seg")


_ATTRS = ("p_brand", "p_type", "p_size")


@query("crosstab_null_level", "A1", "area:s seg:s n:i", with_ctes(
    "", "SELECT l1.area, l2.seg, count(u.uid) AS n FROM (SELECT DISTINCT area FROM u) l1 CROSS JOIN (SELECT DISTINCT seg FROM u) l2 LEFT JOIN u ON u.area IS NOT DISTINCT FROM l1.area AND u.seg IS NOT DISTINCT FROM l2.seg GROUP BY ALL",
    u="SELECT c_custkey AS uid, nullif(c_mktsegment, 'BUILDING') AS seg, nullif(c_nationkey % 5, 2)::VARCHAR AS area FROM customer"))
def crosstab_null_level(spark, sf):
    c = src.read_table(spark, sf, "customer").select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.nullif(F.col("c_nationkey") % 5, F.lit(2)).cast("string").alias("area"))
    return ag.crosstab(c, "area", "seg")


@query("null_key_scan", "P9", "eid:i rk:f below_med:b prev:f", with_ctes(
    "ev", "SELECT eid, rank() OVER (PARTITION BY k ORDER BY value) + (count(*) OVER (PARTITION BY k, value) - 1) / 2 AS rk, value <= med AS below_med, lag(value) OVER (PARTITION BY k ORDER BY t, eid) AS prev "
    "FROM x JOIN (SELECT k AS km, quantile_cont(value, 0.5) AS med FROM x GROUP BY k) ON k IS NOT DISTINCT FROM km", x="SELECT nullif(recid, 3) AS k, eid, t, value FROM ev"))
def null_key_scan(spark, sf):
    """Ranks, percentiles and a lag where one key is NULL."""
    ev = src.event_rows(spark, sf).select(F.nullif("recid", F.lit(3)).alias("k"), "eid", "t", "value")
    ranked = average_rank(ev, "k", "value", "rk")
    lagged = scan(ranked, "k", ["t", "eid"], time_chunk("t", 86400.0), prev=("lag", "value"))
    med = percentile_columns(ev, "k", "value", {"med": 0.5})
    return join_null_safe(lagged, med, ["k"]).select("eid", "rk", (F.col("value") <= F.col("med")).alias("below_med"), "prev")


@query("crosstab_pairs", "A2", "attr1:s attr2:s v1:s v2:s n:i frac:f",
       "SELECT *, n / sum(n) OVER (PARTITION BY attr1, attr2, v1) AS frac FROM (" + " UNION ALL ".join(
           f"SELECT '{a}' AS attr1, '{b}' AS attr2, CAST({a} AS VARCHAR) AS v1, CAST({b} AS VARCHAR) AS v2, count(*) AS n FROM part GROUP BY ALL"
           for i, a in enumerate(_ATTRS) for b in _ATTRS[i + 1:]) + ")")
def crosstab_pairs(spark, sf):
    return ag.crosstab_pairs(src.read_table(spark, sf, "part"), _ATTRS)


@query("row_fraction", "A3", "a1:s a2:s n:i row_frac:f col_pct:f",
       "SELECT *, n / sum(n) OVER (PARTITION BY a1) AS row_frac, 100 * n / sum(n) OVER (PARTITION BY a2) AS col_pct FROM ("
       "SELECT o_orderpriority AS a1, o_orderstatus AS a2, count(*) AS n FROM orders GROUP BY ALL)")
def row_fraction(spark, sf):
    c = ag.with_share(ag.crosstab(_orders(spark, sf), "a1", "a2"), "a1", "n", "row_frac")
    return ag.with_share(c, "a2", "n", "col").withColumn("col_pct", 100 * F.col("col"))


@query("winner_category", "A4", "area:s row_winner:s row_share:f col_winner:s col_share:f", with_ctes(
    "units", "SELECT area, arg_min(seg, (-rf, seg)) AS row_winner, max(rf) AS row_share, arg_min(seg, (-cf, seg)) AS col_winner, max(cf) AS col_share FROM ("
    "SELECT area, seg, count(*) / sum(count(*)) OVER (PARTITION BY area) AS rf, count(*) / sum(count(*)) OVER (PARTITION BY seg) AS cf FROM units GROUP BY area, seg) GROUP BY area"))
def winner_category(spark, sf):
    c = ag.crosstab(units(spark, sf), "area", "seg")
    r = ag.winner_category(c, "area", "seg", "row").select("area", F.col("winner").alias("row_winner"), F.col("share").alias("row_share"))
    k = ag.winner_category(c, "area", "seg", "col").select("area", F.col("winner").alias("col_winner"), F.col("share").alias("col_share"))
    return r.join(k, "area")


@query("counts_with_totals", "A5", "region:s seg:s n:i", with_ctes(
    "units", "SELECT CASE WHEN grouping(region) = 1 THEN 'total' ELSE region END AS region, CASE WHEN grouping(seg) = 1 THEN 'total' ELSE seg END AS seg, count(*) AS n FROM units GROUP BY CUBE (region, seg)"))
def counts_with_totals(spark, sf):
    return ag.counts_with_totals(units(spark, sf), "region", "seg")


@query("region_stats", "A6", "area:s n:i n_rec:i n_task:i one_parent:b", with_ctes(
    "units", "SELECT area, count(*) AS n, count(DISTINCT uid % 10) AS n_rec, count(DISTINCT seg) AS n_task, count(DISTINCT region) = 1 AS one_parent FROM units GROUP BY area"))
def region_stats(spark, sf):
    return ag.region_stats(units(spark, sf).withColumn("rec", F.col("uid") % 10), "area", "rec", "seg", "region")


@query("region_layer_matrix", "A7", "p_type:s upper:i deep:i rest:i",
       "SELECT p_type, count(*) FILTER (WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')) AS upper, count(*) FILTER (WHERE p_brand IN ('Brand#5', 'Brand#6')) AS deep, "
       "count(*) FILTER (WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#5', 'Brand#6')) AS rest FROM part GROUP BY p_type")
def region_layer_matrix(spark, sf):
    return ag.region_layer_matrix(src.read_table(spark, sf, "part"), "p_type", "p_brand", {
        "upper": ["Brand#1", "Brand#2", "Brand#3"], "deep": ["Brand#5", "Brand#6"]})


_PROBS = (0.025, 0.25, 0.5, 0.75, 0.975)


@query("percentile_table", "A8", "a1:s prob:f linear:f lower:f",
       "SELECT a1, CAST(p AS DOUBLE) AS prob, list_sum([s[CAST(floor(h) AS BIGINT) + 1], (s[CAST(ceil(h) AS BIGINT) + 1] - s[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h))]) AS linear, "
       "s[CAST(floor(h) AS BIGINT) + 1] AS lower FROM (SELECT *, p * (len(s) - 1) AS h FROM (SELECT a1, s, unnest([" + ", ".join(f"{p}::DOUBLE" for p in _PROBS) + "]) AS p FROM ("
       "SELECT o_orderpriority AS a1, list_sort(list(o_totalprice)) AS s FROM orders GROUP BY 1)))")
def percentile_table(spark, sf):
    o = _orders(spark, sf)
    lin = ag.percentile_table(o, "a1", "price", _PROBS).withColumnRenamed("price", "linear")
    low = ag.percentile_table(o, "a1", "price", _PROBS, "lower").withColumnRenamed("price", "lower")
    return lin.join(low, ["a1", "prob"])


@query("contrast_stats", "A9", "kind:s recid:i n:i mean:f std:f sem:f", with_ctes(
    "ev", "SELECT kind, recid, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, stddev_samp(value) / sqrt(count(*)) AS sem FROM ev GROUP BY ALL"))
def contrast_stats(spark, sf):
    return ag.contrast_stats(src.event_rows(spark, sf), ["kind", "recid"], "value")


@query("psth_by_category", "A11", "cat:i bin:i q25:f q50:f q75:f", with_ctes(
    "ev trg", "SELECT uid % 3 AS cat, bin, quantile_cont(z, 0.25) AS q25, quantile_cont(z, 0.5) AS q50, quantile_cont(z, 0.75) AS q75 FROM zz WHERE z IS NOT NULL GROUP BY ALL",
    **_PSTH, zz=ZSCORE_SQL))
def psth_by_category(spark, sf):
    from ..operators.align import psth_zscore
    z = psth_zscore(_psth(spark, sf, SIGMA), ["recid", "uid"], START, STOP, WIDTH, 0.004)
    return ag.aligned_percentiles(z.withColumn("cat", F.col("uid") % 3), "cat", "z")


@query("group_feature_mean", "A12", "area:s bal:f nat:f", with_ctes(
    "units", "SELECT area, avg(bal) AS bal, avg(nat) AS nat FROM units WHERE seg IN ('BUILDING', 'MACHINERY') GROUP BY area"))
def group_feature_mean(spark, sf):
    return ag.group_feature_mean(units(spark, sf), "area", ["bal", "nat"], F.col("seg").isin("BUILDING", "MACHINERY"))


@query("state_ratios", "A13", "recid:i n_active:i n_quiet:i n_uncertain:i quiet_vs_rest:f quiet_share:f", with_ctes(
    "trg quiet", "SELECT *, n_quiet / nullif(n_active + n_uncertain, 0) AS quiet_vs_rest, n_quiet / nullif(n_active + n_quiet, 0) AS quiet_share FROM ("
    "SELECT recid, count(*) FILTER (WHERE state = 'active') AS n_active, count(*) FILTER (WHERE state = 'quiet') AS n_quiet, count(*) FILTER (WHERE state = 'uncertain') AS n_uncertain FROM st GROUP BY recid)",
    w=_PRE, st=_STATE.format(b=900)))
def state_ratios(spark, sf):
    from ..operators.joins import label_states
    return ag.state_ratios(label_states(_prestim(spark, sf), _quiet(spark, sf), "recid", active_buff=900.0), "recid")


@query("roi_counts", "A14", "p_size:i deep:i sup:i every:i",
       "SELECT p_size, count(*) FILTER (WHERE p_type IN ('ECONOMY', 'PROMO')) AS deep, count(*) FILTER (WHERE p_type IN ('SMALL', 'LARGE')) AS sup, "
       "count(*) FILTER (WHERE p_type IN ('ECONOMY', 'PROMO', 'SMALL', 'LARGE')) AS every FROM part GROUP BY p_size")
def roi_counts(spark, sf):
    return ag.roi_counts(src.read_table(spark, sf, "part"), "p_size", "p_type", {
        "deep": ["ECONOMY", "PROMO"], "sup": ["SMALL", "LARGE"], "every": ["ECONOMY", "PROMO", "SMALL", "LARGE"]})


@query("roi_membership", "A14", "user_id:i side:s",
       "SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'only_a' WHEN a.user_id IS NULL THEN 'only_b' ELSE 'both' END AS side FROM "
       "(SELECT DISTINCT user_id FROM events) a FULL JOIN (SELECT DISTINCT user_id + 40 AS user_id FROM events) b ON a.user_id = b.user_id")
def roi_membership(spark, sf):
    e = src.read_table(spark, sf, "events")
    return ag.membership(e, e.withColumn("user_id", F.col("user_id") + 40), "user_id")


@query("share_change", "A15", "a1:s a2:s n:i share:f overall:f change_pct:f",
       "SELECT a1, a2, n, share, overall, 100 * (share - overall) / overall AS change_pct FROM (SELECT a1, a2, n, n / sum(n) OVER (PARTITION BY a1) AS share, "
       "sum(n) OVER (PARTITION BY a2) / sum(n) OVER () AS overall FROM (SELECT o_orderpriority AS a1, o_orderstatus AS a2, count(*) AS n FROM orders GROUP BY ALL))")
def share_change(spark, sf):
    return ag.share_change(_orders(spark, sf), "a1", "a2")


@query("module_scores", "A16", "region:s mean:f n:i median:f", with_ctes(
    "units", "SELECT region, avg(bal) AS mean, count(*) AS n, quantile_cont(bal, 0.5) AS median FROM units GROUP BY region"))
def module_scores(spark, sf):
    return ag.group_mean_median(units(spark, sf), "region", "bal")


_FEATURES = ("l_quantity", "l_extendedprice", "l_discount")


@query("category_profile", "A17", "l_returnflag:s feature:s n:i p10:f p50:f p90:f", " UNION ALL ".join(
    f"SELECT l_returnflag, '{f}' AS feature, count({f}) AS n, quantile_cont({f}, 0.1) AS p10, quantile_cont({f}, 0.5) AS p50, quantile_cont({f}, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag"
    for f in _FEATURES))
def category_profile(spark, sf):
    return ag.category_profile(src.read_table(spark, sf, "lineitem"), "l_returnflag", _FEATURES)


@query("signif_share", "A18", "uid:i n:i share:f", with_ctes(
    "ev", "SELECT uid, count(f) AS n, avg(CAST(f AS INT)) AS share FROM (SELECT uid, CASE WHEN value >= 5 THEN value > 30 END AS f FROM ev) GROUP BY uid HAVING count(f) >= 45"))
def signif_share(spark, sf):
    ev = src.event_rows(spark, sf).withColumn("f", F.when(F.col("value") >= 5, F.col("value") > 30))
    return ag.signif_share(ev, "uid", "f", 45)


@query("node_occupancy", "A19", "a1:s rec:i n:i n_rec:i per_rec:f share:f rank:i",
       "SELECT a1, rec, n, count(*) OVER g AS n_rec, sum(n) OVER g / count(*) OVER g AS per_rec, n / sum(n) OVER g AS share, "
       "row_number() OVER (PARTITION BY a1 ORDER BY n DESC, rec) AS rank FROM (SELECT o_orderpriority AS a1, o_custkey % 7 AS rec, count(*) AS n FROM orders GROUP BY ALL) WINDOW g AS (PARTITION BY a1)")
def node_occupancy(spark, sf):
    return ag.node_occupancy(_orders(spark, sf).withColumn("rec", F.col("cust") % 7), "a1", "rec")
