"""Ordering, capping, sampling and set queries (L)."""

from pyspark.sql import functions as F

from ..operators import select as sl
from ..operators.scan import time_chunk
from ..sources import tables as src
from .registry import query
from .sources_filters import units
from .sqltext import with_ctes

_ORDER = ("MACHINERY", "BUILDING", "AUTOMOBILE")


@query("custom_order", "L1", "seg:s n:i pos:i", with_ctes(
    "units", "SELECT seg, count(*) AS n, CASE seg WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 END AS pos FROM units GROUP BY seg"))
def custom_order(spark, sf):
    return sl.custom_order(units(spark, sf).groupBy("seg").agg(F.count(F.lit(1)).alias("n")), "seg", _ORDER)


_CAP = ("SELECT recid, win_id FROM (SELECT *, count(*) OVER (PARTITION BY recid) AS n, row_number() OVER (PARTITION BY recid ORDER BY {o}) AS r FROM trg) "
        "WHERE n >= 20 AND (n = 20 OR r <= 50)")


@query("cap_trials", "L2", "recid:i win_id:i mode:s", with_ctes(
    "trg", "SELECT *, 'first' AS mode FROM (" + _CAP.format(o="t, win_id") + ") UNION ALL SELECT *, 'random' FROM (" + _CAP.format(o="md5('cap_' || win_id), win_id") + ")"))
def cap_trials(spark, sf):
    t = src.triggers(spark, sf)
    return sl.cap_trials(t, "recid", 20, 50, "first").withColumn("mode", F.lit("first")).unionByName(
        sl.cap_trials(t, "recid", 20, 50, "random").withColumn("mode", F.lit("random")))


@query("sample_per_group", "L3", "area:s uid:i", with_ctes(
    "units", "SELECT area, uid FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY md5('pick_' || uid), uid) AS r FROM units) WHERE r <= 5"))
def sample_per_group(spark, sf):
    return sl.sample_per_group(units(spark, sf), "area", 5, "uid")


@query("common_labels", "L4", "nat:i", "SELECT DISTINCT c_nationkey AS nat FROM customer WHERE c_nationkey IN (SELECT s_nationkey * 2 FROM supplier)")
def common_labels(spark, sf):
    c = src.read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nat"))
    s = src.read_table(spark, sf, "supplier").select((F.col("s_nationkey") * 2).alias("nat"))
    return sl.common_labels(c, s, "nat")


@query("all_labels", "L4", "nat:i", "SELECT c_nationkey AS nat FROM customer UNION SELECT s_nationkey * 2 FROM supplier")
def all_labels(spark, sf):
    c = src.read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nat"))
    s = src.read_table(spark, sf, "supplier").select((F.col("s_nationkey") * 2).alias("nat"))
    return sl.all_labels(c, s, "nat")


@query("unmatched_labels", "L5", "nat:i", "SELECT c_nationkey AS nat FROM customer EXCEPT SELECT s_nationkey * 2 FROM supplier")
def unmatched_labels(spark, sf):
    c = src.read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nat"))
    s = src.read_table(spark, sf, "supplier").select((F.col("s_nationkey") * 2).alias("nat"))
    return sl.unmatched_labels(c, s, "nat")


@query("union_windows", "L6", "recid:i t0:f t1:f", with_ctes(
    "art quiet", "SELECT recid, t0, t1 FROM art UNION ALL SELECT recid, t0, t1 FROM quiet"))
def union_windows(spark, sf):
    return sl.union_windows(src.event_windows(spark, sf, "error", 0.0, 1800.0), src.event_windows(spark, sf, "signup", 3600.0, 3600.0))


@query("trial_types", "L7", "eid:i type_id:i", with_ctes(
    "ev", "SELECT eid, dense_rank() OVER (PARTITION BY recid ORDER BY kind, uid) - 1 AS type_id FROM ev"))
def trial_types(spark, sf):
    return sl.trial_types(src.event_rows(spark, sf), ["kind", "uid"], ["recid"])


@query("prior_same_type", "L8", "eid:i n_before:i", with_ctes(
    "ev", "SELECT eid, row_number() OVER (PARTITION BY recid, kind ORDER BY t, eid) - 1 AS n_before FROM ev"))
def prior_same_type(spark, sf):
    return sl.prior_same_type(src.event_rows(spark, sf), ["recid", "kind"], ["t", "eid"], time_chunk("t", 86400.0))


@query("stim_by_amp", "L9", "eid:i stim:s amp:f", with_ctes(
    "ev", "SELECT eid, kind AS stim, value AS amp FROM ev WHERE kind IN ('purchase', 'signup') AND (value IN (1.5, 2.5, 10.25, 12.31) OR value > 40)"))
def stim_by_amp(spark, sf):
    t = src.event_rows(spark, sf).select("eid", F.col("kind").alias("stim"), F.col("value").alias("amp"))
    return sl.stim_by_amp(t, ["purchase", "signup"], None, F.col("amp").isin(1.5, 2.5, 10.25, 12.31) | (F.col("amp") > 40))
