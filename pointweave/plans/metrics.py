"""Point-process metric queries (P) and the flagship pipeline."""

from pyspark.sql import functions as F

from ..operators import joins, trains, windowed
from ..operators.stability import equal_parts
from ..sources import tables as src
from .registry import query
from .sqltext import TILE, with_ctes

G = ["recid", "uid", "win_id"]


def _isi(spark, sf):
    ev = src.event_rows(spark, sf)
    evw = trains.events_in_windows(ev, src.tiles(ev, TILE), bucket=TILE)
    return trains.intervals(evw, G, ("t", "eid"))


query("isi", "P1", "recid:i uid:i win_id:i t:f isi:f", with_ctes("isi", "SELECT recid, uid, win_id, t, isi FROM isi"))(_isi)
query("isi_pairs", "P2", "recid:i uid:i win_id:i t:f isi:f nxt:f",
      with_ctes("isi", "SELECT recid, uid, win_id, t, isi, nxt FROM isi WHERE nxt IS NOT NULL"))(
    lambda spark, sf: _isi(spark, sf).where("nxt IS NOT NULL"))

# metric -> SQL aggregate over the isi CTE
_SQL = {
    "b": "(stddev_pop(isi) - avg(isi)) / nullif(stddev_pop(isi) + avg(isi), 0)",
    "m": "corr(isi, nxt)",
    "lv": "3 * avg(pow((isi - nxt) / (isi + nxt), 2))",
    "lvr": "3 * avg((1 - 4 * isi * nxt / pow(isi + nxt, 2)) * (1 + 4 * 0.005 / (isi + nxt)))",
    "cv2": "2 * avg(abs(nxt - isi) / abs(nxt + isi))",
    "ir": "avg(abs(ln(nxt / isi)))",
    "lkappa": "CASE WHEN count(isi) > 1 THEN ln((3 - (ln(avg(isi)) - avg(ln(isi))) + sqrt(pow((ln(avg(isi)) - avg(ln(isi))) - 3, 2) "
              "+ 24 * (ln(avg(isi)) - avg(ln(isi))))) / nullif(12 * (ln(avg(isi)) - avg(ln(isi))), 0)) END",
}
_SIZE = {"b": "isi", "lkappa": "isi"}

for _m, _agg in _SQL.items():
    query(f"isi_{_m}", "P3-P10", f"recid:i uid:i win_id:i {_m}:f n_isi:i",
          with_ctes("isi", f"SELECT recid, uid, win_id, CASE WHEN count({_SIZE.get(_m, 'nxt')}) >= 3 THEN {_agg} END AS {_m}, "
                           "count(isi) AS n_isi FROM isi GROUP BY ALL"))(
        lambda spark, sf, m=_m: trains.interval_metrics(_isi(spark, sf), G, [m], min_n=3))


@query("isi_rho", "P9", "recid:i uid:i win_id:i rho:f", with_ctes(
    "isi", "SELECT recid, uid, win_id, CASE WHEN count(*) >= 3 THEN corr(ra, rb) END AS rho FROM ("
    "SELECT *, rank() OVER (PARTITION BY recid, uid, win_id ORDER BY isi) + (count(*) OVER (PARTITION BY recid, uid, win_id, isi) - 1) / 2 AS ra, "
    "rank() OVER (PARTITION BY recid, uid, win_id ORDER BY nxt) + (count(*) OVER (PARTITION BY recid, uid, win_id, nxt) - 1) / 2 AS rb "
    "FROM isi WHERE nxt IS NOT NULL) GROUP BY ALL"))
def isi_rho(spark, sf):
    return trains.interval_rho(_isi(spark, sf), G, min_n=3)


@query("isi_rate", "P11", "recid:i uid:i win_id:i isi_rate:f",
       with_ctes("isi", "SELECT recid, uid, win_id, 1 / quantile_cont(isi, 0.5) AS isi_rate FROM isi GROUP BY ALL"))
def isi_rate(spark, sf):
    return trains.interval_rate(_isi(spark, sf), G)


@query("isi_gated", "P12", "recid:i uid:i win_id:i b:f lv:f whole_b:f", with_ctes(
    "isi", "SELECT g.*, w.whole_b FROM (SELECT recid, uid, win_id, "
    f"CASE WHEN count(isi) >= 4 THEN {_SQL['b']} END AS b, CASE WHEN count(nxt) >= 4 THEN {_SQL['lv']} END AS lv FROM isi GROUP BY ALL) g "
    f"JOIN (SELECT recid, uid, CASE WHEN count(isi) > 5 THEN {_SQL['b']} END AS whole_b FROM isi GROUP BY ALL) w USING (recid, uid)"))
def isi_gated(spark, sf):
    isi = _isi(spark, sf)
    return trains.interval_metrics(isi, G, ["b", "lv"], min_n=4).join(
        trains.whole_train_metric(isi, ["recid", "uid"], "b").withColumnRenamed("b", "whole_b"), ["recid", "uid"])


_COUNTS = ("SELECT g.recid, g.uid, g.win_id, g.t0, g.t1, count(e.eid) AS n FROM (SELECT DISTINCT e.recid, e.uid, w.win_id, w.t0, w.t1 "
           "FROM ev e JOIN win w USING (recid)) g LEFT JOIN ev e ON e.recid = g.recid AND e.uid = g.uid AND e.t BETWEEN g.t0 AND g.t1 GROUP BY ALL")


def _counts(spark, sf):
    ev = src.event_rows(spark, sf)
    return trains.window_counts(ev, src.tiles(ev, TILE), bucket=TILE)


@query("log_rate", "P13", "recid:i uid:i win_id:i n:i rate:f", with_ctes(
    "ev win", "SELECT recid, uid, win_id, n, CASE WHEN n > 0 THEN log10(n / (t1 - t0)) END AS rate FROM counts", counts=_COUNTS))
def log_rate(spark, sf):
    return trains.log_rate(_counts(spark, sf))


@query("n_isis", "P17", "recid:i uid:i win_id:i n_isis:i", with_ctes(
    "ev win", "SELECT recid, uid, win_id, greatest(n - 1, 0) AS n_isis FROM counts", counts=_COUNTS))
def n_isis(spark, sf):
    counts = _counts(spark, sf)
    n = _isi(spark, sf).groupBy(*G).agg(F.count("isi").alias("n_isis"))
    return counts.join(n, G, "left").withColumn("n_isis", F.coalesce("n_isis", F.lit(0)))


_VALUES = (f"SELECT recid, uid, win_id, CASE WHEN count(isi) >= 4 THEN {_SQL['b']} END AS b, "
           f"CASE WHEN count(nxt) >= 4 THEN {_SQL['m']} END AS m, CASE WHEN count(nxt) >= 4 THEN {_SQL['lv']} END AS lv FROM isi GROUP BY ALL")


def _values(spark, sf):
    return trains.interval_metrics(_isi(spark, sf), G, ["b", "m", "lv"], min_n=4)


@query("metric_meanstd", "P14", "recid:i uid:i b_mean:f b_std:f m_mean:f m_std:f lv_mean:f lv_std:f", with_ctes(
    "isi", "SELECT recid, uid, " + ", ".join(
        f"CASE WHEN count({m}) >= 3 THEN avg({m}) END AS {m}_mean, CASE WHEN count({m}) >= 3 THEN stddev_pop({m}) END AS {m}_std"
        for m in ("b", "m", "lv")) + " FROM vals GROUP BY ALL", vals=_VALUES))
def metric_meanstd(spark, sf):
    return trains.mean_std(_values(spark, sf), ["recid", "uid"], ["b", "m", "lv"], n_min=3)


_BLOCKS = ("SELECT recid, block_id, min(t0) AS b0, max(t1) AS b1 FROM (SELECT *, ntile(2) OVER (PARTITION BY recid ORDER BY win_id) AS block_id "
           "FROM win) GROUP BY ALL")


def _blocks(spark, sf):
    win = src.tiles(src.event_rows(spark, sf), TILE)
    return equal_parts(win, "recid", "win_id", 2, "block_id").groupBy("recid", "block_id").agg(
        F.min("t0").alias("t0"), F.max("t1").alias("t1"))


@query("metric_by_block", "P15", "recid:i uid:i block_id:i b_mean:f b_std:f lv_mean:f lv_std:f", with_ctes(
    "isi", "SELECT v.recid, uid, block_id, " + ", ".join(
        f"CASE WHEN count({m}) >= 3 THEN avg({m}) END AS {m}_mean, CASE WHEN count({m}) >= 3 THEN stddev_pop({m}) END AS {m}_std"
        for m in ("b", "lv")) + " FROM vals v JOIN win w ON v.recid = w.recid AND v.win_id = w.win_id "
    "JOIN blocks k ON k.recid = w.recid AND w.t0 <= k.b1 AND w.t1 >= k.b0 GROUP BY ALL", vals=_VALUES, blocks=_BLOCKS))
def metric_by_block(spark, sf):
    win = src.tiles(src.event_rows(spark, sf), TILE)
    b = _blocks(spark, sf).select("recid", "block_id", F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    in_block = joins.interval_overlap(win, b, "recid", bucket=TILE * 4).select("recid", "win_id", "block_id")
    return trains.mean_std(_values(spark, sf).join(in_block, ["recid", "win_id"]), ["recid", "uid", "block_id"], ["b", "lv"], n_min=3)


@query("full_estimate", "P16", "recid:i uid:i win_id:i b:f m:f lv:f", with_ctes(
    "isi", "SELECT recid, uid, win_id, CASE WHEN ok THEN b END AS b, CASE WHEN ok THEN m END AS m, CASE WHEN ok THEN lv END AS lv FROM ("
    "SELECT *, b IS NOT NULL AND m IS NOT NULL AND NOT isnan(m) AND lv IS NOT NULL AS ok FROM vals)", vals=_VALUES))
def full_estimate(spark, sf):
    return trains.full_estimate(_values(spark, sf), ["b", "m", "lv"])


# Flagship: windows before triggers, purged, labelled, then interval metrics, then mean/sd per entity and state.
_PRE = 6 * 86400


@query("spontaneous_metrics", "E1", "recid:i uid:i state:s n_win:i b_mean:f b_std:f lv_mean:f lv_std:f rate_mean:f rate_std:f", with_ctes(
    "trg art quiet",
    "SELECT recid, uid, state, count(*) AS n_win, " + ", ".join(
        f"CASE WHEN count({m}) >= 2 THEN avg({m}) END AS {m}_mean, CASE WHEN count({m}) >= 2 THEN stddev_pop({m}) END AS {m}_std"
        for m in ("b", "lv", "rate")) + " FROM vals GROUP BY ALL",
    w0=f"SELECT recid, win_id, t - {_PRE} AS t0, t AS t1 FROM trg",
    w1="SELECT * FROM w0 w WHERE NOT EXISTS (SELECT 1 FROM art a WHERE a.recid = w.recid AND a.t0 BETWEEN w.t1 - 60 AND w.t1)",
    w2="SELECT w.*, CASE WHEN NOT EXISTS (SELECT 1 FROM quiet q WHERE q.recid = w.recid AND w.t1 - 1801 <= q.t1 AND w.t1 + 1 >= q.t0) THEN 'active' "
       "WHEN EXISTS (SELECT 1 FROM quiet q WHERE q.recid = w.recid AND w.t1 - 1800 <= q.t1 AND w.t1 >= q.t0) THEN 'quiet' ELSE 'uncertain' END AS state FROM w1 w",
    iv="SELECT * FROM (SELECT w.recid, w.win_id, w.state, e.uid, e.t, w.t0, w.t1, e.t - lag(e.t) OVER g AS isi, lead(e.t) OVER g - e.t AS nxt "
       "FROM w2 w JOIN ev e ON e.recid = w.recid AND e.t BETWEEN w.t0 AND w.t1 WINDOW g AS (PARTITION BY w.recid, w.win_id, e.uid ORDER BY e.t, e.eid))",
    vals=f"SELECT recid, uid, state, win_id, CASE WHEN count(isi) >= 4 THEN {_SQL['b']} END AS b, CASE WHEN count(isi + nxt) >= 4 THEN {_SQL['lv']} END AS lv, "
         "log10(count(*) / any_value(t1 - t0)) AS rate FROM iv GROUP BY recid, uid, state, win_id"))
def spontaneous_metrics(spark, sf):
    ev = src.event_rows(spark, sf).select("recid", "uid", "t", "eid")
    trg = src.triggers(spark, sf)
    ends = trg.select("recid", "win_id", (F.col("t") - 60).alias("t0"), F.col("t").alias("t1"))
    art = src.triggers(spark, sf, "error").select("recid", F.col("t").alias("t0"), F.col("t").alias("t1"))
    kept = joins.purge_windows(ends, art, "recid")
    quiet = src.event_windows(spark, sf, "signup", 3600.0, 3600.0)
    near = kept.withColumn("t0", F.col("t1") - 1800.0)
    win = joins.label_states(near, quiet, "recid").withColumn("t0", F.col("t1") - float(_PRE))
    values = windowed.windowed_metrics(ev, win, ["b", "lv"], min_n=4)
    return trains.mean_std(trains.log_rate(values), ["recid", "uid", "state"], ["b", "lv", "rate"], n_min=2, count_as="n_win")
