"""Run, burst, crossing and change-point queries (R)."""

from pyspark.sql import functions as F

from ..operators import detect as dt
from ..operators import traces as tc
from ..operators.scan import time_chunk
from ..sources import tables as src
from .registry import query
from .sqltext import with_ctes

DAY = 86400.0
# per-entity event gaps are hours to days in the stored events
BURST_S = 14400.0


def _ev(spark, sf):
    return src.event_rows(spark, sf)


def island_ctes(keys: str, apart: str, source: str = "ev", order: str = "t, eid", x: str = "t") -> dict[str, str]:
    return {
        "gap": f"SELECT *, {x} - lag({x}) OVER (PARTITION BY {keys} ORDER BY {order}) AS g FROM {source}",
        "isl": f"SELECT *, sum(CASE WHEN g IS NULL OR {apart} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS b FROM gap",
    }


_RUNS = "SELECT recid, uid, min(t) AS t0, max(t) AS t1, count(*) AS n FROM isl GROUP BY recid, uid, b"


@query("bursts", "R1", "recid:i uid:i t0:f t1:f n:i", with_ctes(
    "ev", f"SELECT * FROM ({_RUNS}) WHERE n >= 2", **island_ctes("recid, uid", f"g >= {BURST_S}")))
def bursts(spark, sf):
    return dt.bursts(_ev(spark, sf), ["recid", "uid"], BURST_S, ("t", "eid"))


@query("bursts_merged", "R2", "recid:i uid:i t0:f t1:f n:i", with_ctes(
    "ev", "SELECT recid, uid, min(t0) AS t0, max(t1) AS t1, count(*) AS n FROM (SELECT *, sum(CASE WHEN d IS NULL OR d >= 86400 THEN 1 ELSE 0 END) "
    "OVER (PARTITION BY recid, uid ORDER BY t0) AS k FROM (SELECT *, t0 - lag(t1) OVER (PARTITION BY recid, uid ORDER BY t0) AS d FROM bst)) GROUP BY recid, uid, k",
    **island_ctes("recid, uid", f"g >= {BURST_S}"), bst=f"SELECT * FROM ({_RUNS}) WHERE n >= 2"))
def bursts_merged(spark, sf):
    return dt.bursts_merged(_ev(spark, sf), ["recid", "uid"], BURST_S, DAY, ("t", "eid"))


@query("segments", "R3", "recid:i uid:i t0:f t1:f n:i", with_ctes(
    "ev", f"SELECT * FROM ({_RUNS}) WHERE n >= 3", **island_ctes("recid, uid", "g > 43200")))
def segments(spark, sf):
    return dt.segments(_ev(spark, sf), ["recid", "uid"], 43200.0, 3, ("t", "eid"))


_REC_BURSTS = island_ctes("recid", "g >= 1800")


@query("burst_patches", "R4", "recid:i burst:i chan_lo:i chan_hi:i n:i t0:f t1:f", with_ctes(
    "ev", "SELECT recid, b AS burst, min(uid) AS chan_lo, max(uid) AS chan_hi, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM ("
    "SELECT *, sum(CASE WHEN d IS NULL OR d > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY recid, b ORDER BY uid, eid ROWS UNBOUNDED PRECEDING) AS p FROM ("
    "SELECT *, uid - lag(uid) OVER (PARTITION BY recid, b ORDER BY uid, eid) AS d FROM isl)) GROUP BY recid, b, p HAVING count(*) >= 2", **_REC_BURSTS))
def burst_patches(spark, sf):
    b = dt.burst_ids(_ev(spark, sf), "recid", 1800.0, ("t", "eid"))
    return dt.burst_patches(b, ["recid", "burst"], "uid", 30, 2, "eid")


@query("network_bursts", "R5", "recid:i burst:i uid:i n:i", with_ctes(
    "ev", "SELECT recid, burst, uid, n FROM ch WHERE EXISTS (SELECT 1 FROM ch c WHERE c.recid = ch.recid AND c.burst = ch.burst AND c.chain = ch.chain AND c.pop >= 3)",
    **_REC_BURSTS, hist="SELECT recid, b AS burst, uid, count(*) AS n FROM isl GROUP BY ALL",
    pops="SELECT *, (SELECT sum(h.n) FROM hist h WHERE h.recid = hist.recid AND h.burst = hist.burst AND abs(h.uid - hist.uid) <= 30) AS pop, "
         "uid - lag(uid) OVER (PARTITION BY recid, burst ORDER BY uid) AS d FROM hist",
    ch="SELECT *, sum(CASE WHEN d IS NULL OR d > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY recid, burst ORDER BY uid) AS chain FROM pops"))
def network_bursts(spark, sf):
    b = dt.burst_ids(_ev(spark, sf), "recid", 1800.0, ("t", "eid"))
    return dt.network_bursts(b, ["recid", "burst"], "uid", 10, 3, 3)


_KIND_BLOCKS = {
    "lab": "SELECT *, lag(kind) OVER (PARTITION BY recid ORDER BY t, eid) AS pk, row_number() OVER (PARTITION BY recid ORDER BY t, eid) - 1 AS i FROM ev",
    "blk": "SELECT *, sum(CASE WHEN pk IS NULL OR pk <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY recid ORDER BY i) AS block_id FROM lab",
}


def _labelled(spark, sf):
    from ..operators.scan import scan
    ev = _ev(spark, sf).select("recid", "t", "eid", "kind")
    return scan(ev, "recid", ["t", "eid"], time_chunk("t", DAY), _r="row").withColumn("i", F.col("_r") - 1).drop("_r")


@query("run_length", "R6", "recid:i run:i kind:s n:i i0:i mid:i", with_ctes(
    "ev", "SELECT recid, block_id AS run, any_value(kind) AS kind, count(*) AS n, min(i) AS i0, min(i) + count(*) // 2 AS mid FROM blk GROUP BY recid, block_id", **_KIND_BLOCKS))
def run_length(spark, sf):
    return dt.run_length(_labelled(spark, sf), "recid", "i", "kind")


@query("change_blocks", "R7", "recid:i eid:i block_id:i", with_ctes("ev", "SELECT recid, eid, block_id FROM blk", **_KIND_BLOCKS))
def change_blocks(spark, sf):
    return dt.change_blocks(_labelled(spark, sf), "recid", "i", "kind")


@query("block_labels", "R8", "recid:i block:i t0:f t1:f name:s", with_ctes(
    "ev", "SELECT b.recid, b.block, b.t0, b.t1, coalesce(CASE max(p) WHEN 2 THEN 'rare' WHEN 1 THEN 'signup' WHEN 0 THEN 'error' END, '') AS name FROM b "
    "LEFT JOIN s ON s.recid = b.recid AND s.t BETWEEN b.t0 AND b.t1 GROUP BY ALL",
    b="SELECT recid, block, min(t) AS t0, max_by(t + 60, t) AS t1 FROM (SELECT *, CAST(floor(t / 3600) AS BIGINT) - 473000 AS block FROM ev) WHERE block > 0 GROUP BY recid, block",
    s="SELECT recid, t, CASE WHEN kind = 'view' AND value > 60 THEN 2 WHEN kind = 'signup' THEN 1 WHEN kind = 'error' THEN 0 END AS p FROM ev "
      "WHERE kind IN ('signup', 'error') OR (kind = 'view' AND value > 60)"))
def block_labels(spark, sf):
    ev = _ev(spark, sf)
    trials = ev.select("recid", (F.floor(F.col("t") / 3600) - 473000).alias("block"), F.col("t").alias("t0"), (F.col("t") + 60).alias("t1"))
    blocks = dt.block_extents(trials, "recid", "block")
    stim = ev.withColumn("stim", F.when((F.col("kind") == "view") & (F.col("value") > 60), "rare").when(F.col("kind") != "view", F.col("kind")))
    return dt.label_blocks(blocks, stim.select("recid", "t", "stim"), "recid", "block", ["error", "signup", "rare"], 3600.0)


LEVEL, DEEP = 12.345, 1.0


def crossing_ctes(level: str, source: str = "tr", v: str = "v") -> dict[str, str]:
    return {
        "sg": f"SELECT *, sign({v} - ({level})) AS s, sign(lead({v}) OVER (PARTITION BY recid ORDER BY i) - ({level})) AS n FROM {source}",
        "cr": "SELECT *, CASE WHEN n < s THEN -1 WHEN n > s THEN 1 END AS c FROM sg",
        "pr": "SELECT recid, i AS i0, c, lead(i) OVER (PARTITION BY recid ORDER BY i) AS i1 FROM cr WHERE c IS NOT NULL",
    }


@query("halfwaves", "R9", "recid:i i0:i i1:i peak:f", with_ctes(
    "tr", f"SELECT p.recid, i0, i1, min(v) AS peak FROM pr p JOIN tr ON tr.recid = p.recid AND i >= i0 AND i < i1 WHERE c = -1 AND i1 - i0 > 1 "
    f"GROUP BY p.recid, i0, i1 HAVING min(v) <= {DEEP}", **crossing_ctes(str(LEVEL))))
def halfwaves(spark, sf):
    return tc.halfwaves(src.trace(spark, sf), "recid", LEVEL, DEEP, min_dur=1)


_NB = "SELECT *, lag(v) OVER g AS p, lead(v) OVER g AS q FROM tr WINDOW g AS (PARTITION BY recid ORDER BY i)"


@query("local_extrema", "R10", "recid:i i:i v:f kind:s", with_ctes(
    "tr", "SELECT recid, i, v, CASE WHEN v > p AND v > q THEN 'max' ELSE 'min' END AS kind FROM nb WHERE (v > p AND v > q) OR (v < p AND v < q)", nb=_NB))
def local_extrema(spark, sf):
    tr = src.trace(spark, sf)
    return tc.local_extrema(tr, "recid", "max").withColumn("kind", F.lit("max")).unionByName(
        tc.local_extrema(tr, "recid", "min").withColumn("kind", F.lit("min")))


_CENTERED = "SELECT recid, i, v - 15 AS v FROM tr"


def _centered(spark, sf):
    return src.trace(spark, sf).select("recid", "i", (F.col("v") - 15).alias("v"))


_PEAKS = ("SELECT recid, i, v, z, abs(v) AS a, lag(abs(v)) OVER g AS p, lead(abs(v)) OVER g AS q FROM ("
          "SELECT *, (v - avg(v) OVER (PARTITION BY recid)) / stddev_pop(v) OVER (PARTITION BY recid) AS z FROM ce) WINDOW g AS (PARTITION BY recid ORDER BY i)")


@query("peaks_signed", "R11", "recid:i i:i z:f sign:i", with_ctes(
    "tr", "SELECT recid, i, z, sign(v) AS sign FROM pk WHERE a > p AND a > q AND abs(z) > 0.8 AND v <> 0", ce=_CENTERED, pk=_PEAKS))
def peaks_signed(spark, sf):
    return tc.signed_peaks(_centered(spark, sf), "recid", 0.8)


THRESHOLDS = [round(0.25 * k, 2) for k in range(17)]


@query("exceedance_curve", "R12", "recid:i thr:f n:i picked:f", with_ctes(
    "tr", "SELECT recid, thr, n, (SELECT min_by(thr, (abs(a / mx - 0.05), thr)) FROM (SELECT *, max(a) OVER () AS mx FROM (SELECT thr, avg(n) AS a FROM cur GROUP BY thr))) AS picked FROM cur",
    ce=_CENTERED, pk=_PEAKS, th="SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in THRESHOLDS) + "]) AS thr",
    cur="SELECT r.recid, th.thr, count(pk.i) AS n FROM (SELECT DISTINCT recid FROM pk WHERE a > p AND a > q) r CROSS JOIN th LEFT JOIN pk ON pk.recid = r.recid AND a > p AND a > q AND abs(z) >= thr GROUP BY ALL"))
def exceedance_curve(spark, sf):
    z = tc.zscored(_centered(spark, sf), "recid").withColumn("a", F.abs("v"))
    amps = tc.local_extrema(z, "recid", "max", "a").withColumn("amp", F.abs("z"))
    curve = tc.exceedance_curve(amps, "recid", "amp", THRESHOLDS)
    return curve.withColumn("picked", tc.threshold_from_fraction(curve, 0.95).scalar())


def interp_sql(knots: str, points: str) -> str:
    """Linear interpolation with extrapolation of ``knots(recid, x, y)`` at ``points(recid, i)`` as SQL."""
    return ("SELECT recid, i, y + (y2 - y) / (x2 - x) * (i - x) AS val FROM ("
            f"SELECT p.recid, p.i, arg_max(s, CASE WHEN s.x <= p.i THEN s.x ELSE -1e9 - s.x END) AS s FROM {points} p JOIN (SELECT {{'x': x, 'y': y, 'x2': x2, 'y2': y2}} AS s, recid FROM ("
            f"SELECT recid, x, y, lead(x) OVER g AS x2, lead(y) OVER g AS y2 FROM {knots} WINDOW g AS (PARTITION BY recid ORDER BY x)) WHERE x2 IS NOT NULL) k ON k.recid = p.recid "
            "GROUP BY p.recid, p.i) CROSS JOIN LATERAL (SELECT s.x AS x, s.y AS y, s.x2 AS x2, s.y2 AS y2)")


@query("halfcycle_rms", "R13", "recid:i i:i rms:f", with_ctes(
    "tr", f"SELECT recid, i, val AS rms FROM ({interp_sql('kn', 'ce')})", ce=_CENTERED, **crossing_ctes("0.0", "ce"),
    kn="SELECT p.recid, floor(i0 + (i1 - i0) / 2) AS x, sqrt(avg(v * v)) AS y FROM pr p JOIN ce ON ce.recid = p.recid AND i >= i0 AND i < i1 WHERE i1 IS NOT NULL GROUP BY p.recid, i0, i1"))
def halfcycle_rms(spark, sf):
    return tc.halfcycle_rms(_centered(spark, sf), "recid")


_ENV_CTES = {
    "nb": _NB,
    "kn": "SELECT recid, i AS x, v AS y FROM nb WHERE (v > p AND v > q) OR p IS NULL OR q IS NULL",
    "env": "SELECT recid, i, val FROM (" + interp_sql("kn", "tr") + ")",
}


@query("linear_envelope", "R14", "recid:i i:i env:f", with_ctes("tr", "SELECT recid, i, val AS env FROM env", **_ENV_CTES))
def linear_envelope(spark, sf):
    return tc.linear_envelope(src.trace(spark, sf), "recid")


@query("peaked_crossings", "R15", "recid:i t0:f t1:f n:i", with_ctes(
    "tr", "SELECT * FROM (SELECT recid, min(i0) AS t0, max(i1) AS t1, count(*) AS n FROM (SELECT *, sum(CASE WHEN d IS NULL OR d > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY recid ORDER BY i0) AS k FROM ("
    "SELECT *, i0 - lag(i1) OVER (PARTITION BY recid ORDER BY i0) AS d FROM good)) GROUP BY recid, k) WHERE t1 - t0 > 5",
    **_ENV_CTES, **crossing_ctes("22.222", "env", "val"),
    good="SELECT p.recid, i0, i1 FROM pr p JOIN nb ON nb.recid = p.recid AND nb.i BETWEEN i0 AND i1 AND nb.v > nb.p AND nb.v > nb.q AND nb.v > 18 WHERE c = 1 AND i1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"))
def peaked_crossings(spark, sf):
    tr = src.trace(spark, sf)
    env = tc.linear_envelope(tr, "recid")
    cross = tc.halfwaves(env, "recid", 22.222, -1e300, mode="crest", value="env")
    peaks = tc.local_extrema(tr, "recid", "max").where("v > 18")
    return dt.peaked_crossings(cross, peaks, "recid", 2, 2, 5)


_ACF = {
    "w": "SELECT recid, k AS win, k * 64 AS w0, k * 64 + 64 AS w1 FROM (SELECT recid, unnest(range(0, count(*) // 64)) AS k FROM tr GROUP BY recid)",
    "sm": "SELECT w.recid, w.win, ce.i - w.w0 AS i, ce.v FROM ce JOIN w ON ce.recid = w.recid AND ce.i >= w0 AND ce.i < w1",
    "ac": "SELECT a.recid, a.win, a.i - b.i AS lag, sum(a.v * b.v) / any_value(nn.n) AS c FROM sm a JOIN sm b ON a.recid = b.recid AND a.win = b.win AND abs(a.i - b.i) <= 20 "
          "JOIN (SELECT recid, win, sum(v * v) AS n FROM sm GROUP BY ALL) nn ON nn.recid = a.recid AND nn.win = a.win GROUP BY a.recid, a.win, a.i - b.i",
    "pk": "SELECT * FROM (SELECT *, lag(c) OVER g AS p, lead(c) OVER g AS q FROM ac WINDOW g AS (PARTITION BY recid, win ORDER BY lag)) WHERE c > p AND c > q AND c >= 0.1",
    "gp": "SELECT *, lag - lag(lag) OVER (PARTITION BY recid, win ORDER BY lag) AS g FROM pk",
}


@query("regular_events", "R16", "recid:i win:i n_peaks:i n_gaps:i n_good:i", with_ctes(
    "tr", "SELECT * FROM (SELECT recid, win, count(*) AS n_peaks, count(g) AS n_gaps, count(*) FILTER (WHERE g BETWEEN 3 AND 8) AS n_good FROM gp GROUP BY ALL) "
    "WHERE n_peaks >= 3 AND n_good >= 2 AND n_good >= n_gaps * 0.4", ce=_CENTERED, **_ACF))
def regular_events(spark, sf):
    ce = _centered(spark, sf)
    n = ce.groupBy("recid").agg(F.floor(F.count(F.lit(1)) / 64).alias("n")).where("n > 0")
    win = n.select("recid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("win")).withColumns(
        {"w0": F.col("win") * 64, "w1": F.col("win") * 64 + 64})
    return tc.regular_events(ce, win, "recid", 20, 3, 8, 3, 0.4)


_HW = "SELECT recid, i0, i1, i0 AS win FROM pr WHERE c = 1 AND i1 IS NOT NULL AND i1 > i0"


@query("event_shape", "R17", "recid:i win:i area:f peak:f thr:f", with_ctes(
    "tr", "SELECT s.*, CASE WHEN f.k0 = 0 THEN lo + (CASE WHEN k_last > k_end THEN k_end ELSE 0 END + 1) * 0.5 ELSE lo END AS thr FROM sh s JOIN lo USING (recid) LEFT JOIN f USING (recid)",
    **crossing_ctes(str(LEVEL)), hw=_HW, sh="SELECT h.recid, win, sum(v) / 10.0 AS area, max(v) AS peak FROM hw h JOIN tr ON tr.recid = h.recid AND i >= i0 AND i < i1 GROUP BY ALL",
    lo="SELECT recid, min(area) AS lo, CAST(floor((20 - min(area)) / 0.5) AS BIGINT) AS nb FROM sh GROUP BY recid",
    hi="SELECT recid, k, count(area) AS n FROM (SELECT recid, lo, nb, unnest(range(0, nb)) AS k FROM lo) b LEFT JOIN (SELECT recid, area, floor((area - lo) / 0.5) AS k FROM sh JOIN lo USING (recid)) USING (recid, k) GROUP BY ALL",
    ov="SELECT recid, k, k - row_number() OVER (PARTITION BY recid ORDER BY k) AS r FROM hi JOIN (SELECT recid, avg(n) + 4 * stddev_pop(n) AS cut FROM hi GROUP BY recid) USING (recid) WHERE n > cut",
    f="SELECT recid, min(k) AS k0, max(k) FILTER (WHERE r = -1) AS k_end, max(k) AS k_last FROM ov GROUP BY recid"))
def event_shape(spark, sf):
    tr = src.trace(spark, sf)
    win = tc.halfwaves(tr, "recid", LEVEL, -1e300, mode="crest").select("recid", F.col("i0").alias("win"), F.col("i0").alias("w0"), F.col("i1").alias("w1"))
    sh = tc.event_shape(tr, win, "recid", 10.0)
    return sh.join(tc.adaptive_area_threshold(sh, "recid", 0.5, 20.0), "recid")


@query("jump_segments", "R18", "vec_id:i segment:i dist:f", (
    "WITH p AS (SELECT vec_id, embedding AS e, lag(embedding) OVER (ORDER BY vec_id) AS q FROM embeddings), "
    "d AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: pow(e[i]::DOUBLE - q[i]::DOUBLE, 2))) AS d2 FROM p), "
    "s AS (SELECT vec_id, sqrt(d2) AS d FROM d) "
    "SELECT vec_id, sum(CASE WHEN d IS NULL OR d > 1.42 THEN 1 ELSE 0 END) OVER (ORDER BY vec_id) AS segment, CASE WHEN d <= 1.42 THEN d END AS dist FROM s"))
def jump_segments(spark, sf):
    return dt.jump_segments(src.read_table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 1.42, "embedding")
