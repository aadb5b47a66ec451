"""Join (J) queries."""

from pyspark.sql import functions as F

from ..operators import joins, polygons, trains
from ..operators import intervals as iv
from ..operators.ranges import count_in_windows
from ..sources import tables as src
from .registry import query
from .sources_filters import units
from .sqltext import TILE, with_ctes


def _art(spark, sf):
    return src.event_windows(spark, sf, "error", 0.0, 1800.0)


def _quiet(spark, sf):
    return src.event_windows(spark, sf, "signup", 3600.0, 3600.0)


def _prestim(spark, sf, pre=3600.0):
    return src.event_windows(spark, sf, "purchase", pre, 0.0)


_PRE = "SELECT recid, win_id, t - 3600 AS t0, t AS t1 FROM trg"


@query("events_in_windows", "J1", "recid:i win_id:i eid:i uid:i t:f", with_ctes(
    "ev trg", "SELECT w.recid, w.win_id, e.eid, e.uid, e.t FROM w JOIN ev e ON e.recid = w.recid AND e.t BETWEEN w.t0 AND w.t1", w=_PRE))
def events_in_windows(spark, sf):
    return trains.events_in_windows(src.event_rows(spark, sf), _prestim(spark, sf), bucket=3600.0)


@query("window_counts", "J1", "recid:i win_id:i n:i", with_ctes(
    "ev trg", "SELECT w.recid, w.win_id, count(e.eid) AS n FROM w LEFT JOIN ev e ON e.recid = w.recid AND e.t BETWEEN w.t0 AND w.t1 GROUP BY ALL", w=_PRE))
def window_counts(spark, sf):
    return count_in_windows(_prestim(spark, sf), src.event_rows(spark, sf), "recid", "n", chunk_s=86400.0)


@query("window_counts_equal", "J1", "recid:i t0:f n:i", with_ctes(
    "ev trg", "SELECT w.recid, w.t0, count(e.eid) AS n FROM (SELECT row_number() OVER () AS id, nullif(recid, 3) AS recid, floor(t / 864000) * 864000 AS t0, floor(t / 864000) * 864000 + 3600 AS t1 FROM trg) w "
    "LEFT JOIN (SELECT nullif(recid, 3) AS recid, eid, t FROM ev) e ON e.recid IS NOT DISTINCT FROM w.recid AND e.t BETWEEN w.t0 AND w.t1 GROUP BY w.id, w.recid, w.t0"))
def window_counts_equal(spark, sf):
    """Many equal windows, and one recording without a name."""
    key = F.nullif("recid", F.lit(3)).alias("recid")
    start = (F.floor(F.col("t") / 864000) * 864000).cast("double")
    win = src.triggers(spark, sf).select(key, start.alias("t0"), (start + 3600).alias("t1"))
    return count_in_windows(win, src.event_rows(spark, sf).select(key, "t"), "recid", "n", chunk_s=86400.0)


@query("raster_events", "J2", "recid:i win_id:i eid:i rel_t:f", with_ctes(
    "ev trg", "SELECT w.recid, w.win_id, e.eid, e.t - w.t AS rel_t FROM trg w JOIN ev e ON e.recid = w.recid AND e.t > w.t - 7200 AND e.t < w.t + 3600"))
def raster_events(spark, sf):
    return trains.raster_events(src.event_rows(spark, sf), src.triggers(spark, sf), -7200.0, 3600.0)


@query("interval_overlap", "J3", "recid:i win_id:i art_id:i", with_ctes(
    "trg art", "SELECT w.recid, w.win_id, a.win_id AS art_id FROM w JOIN art a ON a.recid = w.recid AND w.t0 <= a.t1 AND w.t1 >= a.t0", w=_PRE))
def interval_overlap(spark, sf):
    a = _art(spark, sf).select("recid", F.col("win_id").alias("art_id"), F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    return joins.interval_overlap(_prestim(spark, sf), a, "recid", bucket=3600.0)


@query("purge_windows", "J4", "recid:i win_id:i t0:f t1:f", with_ctes(
    "trg art quiet", "SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.recid = w.recid AND w.t0 <= f.t1 AND w.t1 >= f.t0)",
    w=_PRE, f="SELECT recid, t0, t1 FROM art UNION ALL SELECT recid, t0 + 3000, t1 - 3000 FROM quiet"))
def purge_windows(spark, sf):
    q = _quiet(spark, sf)
    bad = _art(spark, sf).select("recid", "t0", "t1").unionByName(
        q.select("recid", (F.col("t0") + 3000).alias("t0"), (F.col("t1") - 3000).alias("t1")))
    return joins.purge_windows(_prestim(spark, sf), bad, "recid")


_STATE = ("SELECT w.*, CASE WHEN NOT EXISTS (SELECT 1 FROM quiet q WHERE q.recid = w.recid AND w.t0 - {b} <= q.t1 AND w.t1 + {b} >= q.t0) THEN 'active' "
          "WHEN EXISTS (SELECT 1 FROM quiet q WHERE q.recid = w.recid AND w.t0 <= q.t1 AND w.t1 >= q.t0) THEN 'quiet' ELSE 'uncertain' END AS state FROM w")


@query("label_states", "J5", "recid:i win_id:i state:s", with_ctes("trg quiet", _STATE.format(b=900), w=_PRE))
def label_states(spark, sf):
    return joins.label_states(_prestim(spark, sf), _quiet(spark, sf), "recid", active_buff=900.0)


@query("before_reference", "J6", "recid:i win_id:i t0:f t1:f", with_ctes(
    "ev trg", "SELECT w.* FROM w LEFT JOIN r USING (recid) WHERE r.t IS NULL OR w.t1 <= r.t - 1", w=_PRE,
    r="SELECT CASE WHEN recid = 3 THEN -3 ELSE recid END AS recid, min(t) AS t FROM ev WHERE kind = 'signup' GROUP BY recid"))
def before_reference(spark, sf):
    ref = src.event_rows(spark, sf, ["signup"]).withColumn("recid", F.expr("CASE WHEN recid = 3 THEN -3 ELSE recid END"))
    return joins.before_reference(_prestim(spark, sf), ref, "recid", buff=1.0)


_BOUNDS = "SELECT recid, min(t) AS lo, max(t) AS hi FROM ev GROUP BY recid"
# complement of windows f inside bounds, as SQL
_FREE = ("SELECT recid, reach AS t0, t0 AS t1 FROM (SELECT *, max(t1) OVER (PARTITION BY recid ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ("
         "SELECT recid, greatest(t0, lo) AS t0, least(t1, hi) AS t1 FROM {f} JOIN bounds USING (recid) WHERE least(t1, hi) > greatest(t0, lo) "
         "UNION ALL SELECT recid, lo, lo FROM bounds UNION ALL SELECT recid, hi, hi FROM bounds)) WHERE t0 > reach")


def bounds(spark, sf):
    return src.event_rows(spark, sf).groupBy("recid").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))


@query("artifact_free_trials", "J7", "recid:i win_id:i t0:f t1:f", with_ctes(
    "ev trg art", "SELECT w.* FROM w JOIN LATERAL (SELECT max_by(t1, t0) AS stop FROM free f WHERE f.recid = w.recid AND f.t0 < w.t0) l ON true WHERE w.t0 < stop AND w.t1 < stop",
    w=_PRE, bounds=_BOUNDS, free=_FREE.format(f="art")))
def artifact_free_trials(spark, sf):
    free = iv.free_intervals(_art(spark, sf), bounds(spark, sf), "recid")
    return joins.artifact_free_trials(_prestim(spark, sf), free, "recid")


@query("isolated_windows", "J8", "recid:i t0:f t1:f d_prev:f d_next:f d_min:f", with_ctes(
    "ev art", "SELECT recid, t0, t1, t0 - lag(t1) OVER g AS d_prev, lead(t0) OVER g - t1 AS d_next, "
    "least(t0 - lag(t1) OVER g, lead(t0) OVER g - t1) AS d_min FROM free WINDOW g AS (PARTITION BY recid ORDER BY t0)", bounds=_BOUNDS, free=_FREE.format(f="art")))
def isolated_windows(spark, sf):
    return joins.isolated_windows(iv.free_intervals(_art(spark, sf), bounds(spark, sf), "recid"), "recid")


@query("drop_isolated_small", "J9", "recid:i eid:i peak:f", with_ctes(
    "ev", "SELECT recid, eid, peak FROM d WHERE peak >= 10 OR EXISTS (SELECT 1 FROM d b WHERE b.recid = d.recid AND b.peak >= 45 AND abs(b.c - d.c) <= 7200)",
    d="SELECT recid, eid, value AS peak, t - 30 + ((t + 30) - (t - 30)) / 2 AS c FROM ev"))
def drop_isolated_small(spark, sf):
    det = src.event_rows(spark, sf).select("recid", "eid", F.col("value").alias("peak"), (F.col("t") - 30).alias("t0"), (F.col("t") + 30).alias("t1"))
    return joins.drop_isolated_small(det, "recid", "peak", 45, 10, 7200.0)


@query("match_entities", "J10", "unit:s n_a:i n_b:i",
       "SELECT * FROM (SELECT (user_id // 15) || '__' || user_id AS unit, count(*) AS n_a FROM events WHERE event_type = 'click' GROUP BY 1) "
       "JOIN (SELECT (user_id // 15) || '__' || user_id AS unit, count(*) AS n_b FROM events WHERE event_type = 'signup' GROUP BY 1) USING (unit)")
def match_entities(spark, sf):
    def run(kind, out):
        unit = F.concat_ws("__", F.col("recid").cast("string"), F.col("uid").cast("string")).alias("unit")
        return src.event_rows(spark, sf, [kind]).groupBy(unit).agg(F.count(F.lit(1)).alias(out))
    return joins.match_entities(run("click", "n_a"), run("signup", "n_b"), "unit")


@query("attach_delay", "J11", "uid:i resp_delay:f",
       "SELECT c_custkey AS uid, CASE WHEN n IS NULL OR n <> 1 THEN 999 WHEN p <= 0.5 THEN d END AS resp_delay FROM customer LEFT JOIN ("
       "SELECT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN o_custkey ELSE -o_orderkey END AS c_custkey, count(*) AS n, max((o_totalprice % 1000) / 1000) AS p, max(o_totalprice) AS d FROM orders GROUP BY 1) USING (c_custkey)")
def attach_delay(spark, sf):
    own = F.expr("CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN o_custkey ELSE -o_orderkey END")  # other orders name nobody
    s = src.read_table(spark, sf, "orders").select(
        own.alias("uid"), ((F.col("o_totalprice") % 1000) / 1000).alias("p"), F.col("o_totalprice").alias("d"))
    return joins.attach_delay(src.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("uid")), s, "uid", "p", "d", 0.5)


@query("score_lookup", "J12", "uid:i score_key:s score:f", with_ctes(
    "units", "SELECT uid, k AS score_key, score FROM (SELECT uid, CASE area WHEN 'NATION_1' THEN 'NATION_2' WHEN 'NATION_3' THEN 'NATION_4' ELSE area END AS k FROM units) u "
    "JOIN (SELECT n_name || CASE WHEN n_nationkey IN (3, 7) THEN ' old' ELSE '' END AS k, avg(s_acctbal) AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) USING (k)"))
def score_lookup(spark, sf):
    s, n = src.read_table(spark, sf, "supplier"), src.read_table(spark, sf, "nation")
    alias = F.concat("n_name", F.when(F.col("n_nationkey").isin(3, 7), " old").otherwise(""))
    scores = s.join(n, s.s_nationkey == n.n_nationkey).groupBy(alias.alias("area")).agg(
        F.avg("s_acctbal").alias("score"))
    return joins.score_lookup(units(spark, sf), "area", {"NATION_1": "NATION_2", "NATION_3": "NATION_4"}, scores, "score")


@query("followon_windows", "J13", "recid:i eid:i t0:f t1:f", with_ctes(
    "ev", "SELECT * FROM w b WHERE EXISTS (SELECT 1 FROM w a WHERE a.recid = b.recid AND a.v > 25 AND a.t1 = b.t0)",
    w="SELECT recid, eid, value AS v, t AS t0, lead(t) OVER (PARTITION BY recid ORDER BY t, eid) AS t1 FROM ev"))
def followon_windows(spark, sf):
    from ..operators.scan import scan, time_chunk
    ev = src.event_rows(spark, sf).select("recid", "eid", F.col("value").alias("v"), F.col("t").alias("t0"))
    w = scan(ev, "recid", ["t0", "eid"], time_chunk("t0", 86400.0), t1=("lead", "t0"))
    return joins.followon_windows(w.where("v > 25"), w, "recid")


@query("next_opposite_events", "J14", "recid:i src:i dst:i dt:f", with_ctes(
    "ev", "SELECT a.recid, a.eid AS src, b.eid AS dst, b.t - a.t AS dt FROM s a JOIN s b ON a.recid = b.recid AND b.rn BETWEEN a.rn + 1 AND a.rn + 9 "
    "WHERE a.sign <> b.sign AND b.t - a.t <= 7200 AND a.lo <= b.hi AND a.hi >= b.lo",
    s="SELECT *, value - 5 AS lo, value + 5 AS hi, CASE WHEN uid % 2 = 0 THEN 1 ELSE -1 END AS sign, row_number() OVER (PARTITION BY recid ORDER BY t, eid) AS rn FROM "
      "(SELECT recid, uid, t, eid, value FROM ev)"))
def next_opposite_events(spark, sf):
    ev = src.event_rows(spark, sf).select(
        "recid", "eid", "t", F.when(F.col("uid") % 2 == 0, 1).otherwise(-1).alias("sign"),
        (F.col("value") - 5).alias("lo"), (F.col("value") + 5).alias("hi"))
    return joins.next_opposite_events(ev, "recid", 7200.0, search=10)


POLYGONS = {
    "square": [(2.0, 1000.0), (9.0, 1000.0), (9.0, 6000.0), (2.0, 6000.0)],
    "ell": [(7.0, 500.0), (20.0, 500.0), (20.0, 3000.0), (12.0, 3000.0), (12.0, 9000.0), (7.0, 9000.0)],
    "tri": [(14.0, 5000.0), (23.0, 4000.0), (18.0, 9500.0)],
}


def _edge_values() -> str:
    rows = []
    for i, (name, pts) in enumerate(POLYGONS.items()):
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
            rows.append(f"({i}, '{name}', CAST({x1} AS DOUBLE), CAST({y1} AS DOUBLE), CAST({x2} AS DOUBLE), CAST({y2} AS DOUBLE))")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(i, roi, x1, y1, x2, y2)"


_HIT = (  # from p(uid, x, y) and edges: each point against each edge
    "hit AS (SELECT uid, i, roi, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) AS n, "
    "min(pow(x - (x1 + u * (x2 - x1)), 2) + pow(y - (y1 + u * (y2 - y1)), 2)) AS d FROM (SELECT *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / "
    "(pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS u FROM p CROSS JOIN edges) GROUP BY uid, i, roi) "
    "SELECT uid, coalesce(min_by(roi, i) FILTER (WHERE n % 2 = 1), min_by(roi, (d, i))) AS roi FROM hit GROUP BY uid")


@query("point_in_polygon", "J15", "uid:i roi:s", (
    f"WITH edges AS ({_edge_values()}), p AS (SELECT c_custkey AS uid, c_nationkey + 0.25 AS x, c_acctbal AS y FROM customer), " + _HIT))
def point_in_polygon(spark, sf):
    p = src.read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("uid"), (F.col("c_nationkey") + 0.25).alias("x"), F.col("c_acctbal").alias("y"))
    return polygons.point_in_polygon(p, POLYGONS, "x", "y", "roi")


@query("point_in_polygon_table", "J15", "uid:i roi:s", (
    "WITH s AS (SELECT s_suppkey AS i, 's' || s_suppkey AS roi, s_nationkey + s_suppkey % 7 / 7.0::DOUBLE AS x, s_acctbal AS y FROM supplier), "
    "c AS (SELECT i, roi, unnest([0, 1, 2, 3]) AS v, unnest([x - 0.5, x + 0.4, x - 0.1, x + 0.4]) AS x, unnest([y, y - 200, y, y + 200]) AS y FROM s), "
    "edges AS (SELECT a.i, a.roi, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM c a JOIN c b ON a.i = b.i AND b.v = (a.v + 1) % 4), "
    "p AS (SELECT c_custkey AS uid, c_nationkey + 0.25 AS x, c_acctbal AS y FROM customer), " + _HIT))
def point_in_polygon_table(spark, sf):
    """Customers in the concave quadrilaterals around suppliers, many of which overlap."""
    s = src.read_table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") + F.col("s_suppkey") % 7 / F.lit(7.0)).alias("sx"), F.col("s_acctbal").alias("sy"))
    turns = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(a).alias("a"), F.lit(b).alias("b")) for v, (a, b) in enumerate([(-0.5, 0.0), (0.4, -200.0), (-0.1, 0.0), (0.4, 200.0)])])
    c = s.withColumn("t", F.explode(turns)).select(
        F.col("s_suppkey").alias("i"), F.concat(F.lit("s"), "s_suppkey").alias("roi"), "t.v", (F.col("sx") + F.col("t.a")).alias("x"), (F.col("sy") + F.col("t.b")).alias("y"))
    p = src.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), (F.col("c_nationkey") + 0.25).alias("x"), F.col("c_acctbal").alias("y"))
    return polygons.point_in_polygon(p, c, "x", "y", "roi")


@query("assign_blocks", "J16", "recid:i win_id:i block_id:i", with_ctes(
    "ev trg", "SELECT w.recid, w.win_id, min(b.block_id) AS block_id FROM w JOIN b ON b.recid = w.recid AND w.t0 <= b.t1 AND w.t1 >= b.t0 GROUP BY ALL", w=_PRE,
    b=f"SELECT recid, CAST(floor(t / {TILE}) AS BIGINT) AS block_id, min(t) + 600 AS t0, max(t) - 600 AS t1 FROM ev GROUP BY ALL"))
def assign_blocks(spark, sf):
    b = src.event_rows(spark, sf).groupBy("recid", F.floor(F.col("t") / TILE).alias("block_id")).agg(
        (F.min("t") + 600).alias("t0"), (F.max("t") - 600).alias("t1"))
    return joins.assign_blocks(_prestim(spark, sf), b, "recid", bucket=86400.0)
