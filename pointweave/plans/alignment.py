"""Histogram, smoothing and alignment queries (H)."""

from pyspark.sql import functions as F

from ..operators import align
from ..operators import intervals as iv
from ..operators import traces as tc
from ..session import cut_lineage
from ..sources import tables as src
from .detection import LEVEL, crossing_ctes
from .interval_algebra import merge_ctes
from .joining import _BOUNDS, _FREE, bounds
from .registry import query
from .sqltext import with_ctes

START, STOP, WIDTH, SIGMA = -21600.0, 21600.0, 900.0, 1800.0
N_BINS = 48

_RATE = ("SELECT b.recid, b.bin, count(e.t) / (1800.0 * {units}) AS rate FROM (SELECT recid, lo, unnest(range(0, CAST(floor((hi - lo) / 1800.0) AS BIGINT))) AS bin FROM bounds) b "
         "LEFT JOIN (SELECT e.recid, e.t, floor((e.t - lo) / 1800.0) AS bin FROM ev e JOIN bounds USING (recid)) e ON e.recid = b.recid AND e.bin = b.bin GROUP BY b.recid, b.bin")


@query("rate_histogram", "H1", "recid:i bin:i rate:f", with_ctes("ev", "SELECT * FROM r", bounds=_BOUNDS, r=_RATE.format(units=15)))
def rate_histogram(spark, sf):
    return tc.rate_histogram(src.event_rows(spark, sf), bounds(spark, sf), "recid", 1800.0, 15)


_RASTER = {
    "ra": f"SELECT e.recid, e.uid, CAST(floor((e.t - w.t - ({START})) / {WIDTH}) AS BIGINT) AS bin FROM trg w JOIN ev e ON e.recid = w.recid AND e.t > w.t + ({START}) AND e.t < w.t + {STOP}",
    "cn": f"SELECT recid, uid, bin, count(*) AS n FROM ra WHERE bin BETWEEN 0 AND {N_BINS - 1} GROUP BY ALL",
    "kk": "SELECT recid, count(*) AS k FROM trg GROUP BY recid",
    "gr": f"SELECT recid, uid, unnest(range(0, {N_BINS})) AS bin FROM (SELECT DISTINCT recid, uid FROM ev WHERE recid IN (SELECT recid FROM kk))",
}
_TAPS = align.gauss_kernel(SIGMA / WIDTH)
_KER = "SELECT unnest(range(0, {n})) - {h} AS o, unnest([{w}]) AS w".format(
    n=len(_TAPS), h=len(_TAPS) // 2, w=", ".join(f"{w!r}::DOUBLE" for w in _TAPS))
_PSTH = {**_RASTER, "ker": _KER,
         "sp": "SELECT recid, uid, bin + o AS bin, sum(n * w) AS s FROM cn CROSS JOIN ker GROUP BY recid, uid, bin + o",
         "pz": "SELECT recid, uid, bin, sum(n) AS n, sum(s) AS s FROM (SELECT recid, uid, bin, 0 AS n, 0::DOUBLE AS s FROM gr UNION ALL SELECT recid, uid, bin, n, 0 FROM cn "
               f"UNION ALL SELECT recid, uid, bin, 0, s FROM sp) WHERE bin BETWEEN 0 AND {N_BINS - 1} GROUP BY recid, uid, bin",
         "ps": f"SELECT pz.recid, uid, bin, n, s / k / {WIDTH} AS rate FROM pz JOIN kk ON kk.recid = pz.recid"}


def _psth(spark, sf, sigma):
    return align.psth(src.event_rows(spark, sf), src.triggers(spark, sf), START, STOP, WIDTH, sigma)


@query("psth", "H2", "recid:i uid:i bin:i n:i rate:f", with_ctes("ev trg", "SELECT * FROM ps", **_PSTH))
def psth(spark, sf):
    return _psth(spark, sf, SIGMA)


@query("psth_rate", "H3", "recid:i uid:i bin:i rate:f", with_ctes(
    "ev trg", f"SELECT z.recid, uid, bin, n / k / {WIDTH} AS rate FROM (SELECT recid, uid, bin, sum(n) AS n FROM (SELECT recid, uid, bin, 0 AS n FROM gr UNION ALL "
    "SELECT recid, uid, bin, n FROM cn) GROUP BY recid, uid, bin) z JOIN kk ON kk.recid = z.recid", **_RASTER))
def psth_rate(spark, sf):
    return _psth(spark, sf, None)


ZSCORE_SQL = ("SELECT recid, uid, bin, (rate - mu) / nullif(sd, 0) AS z FROM ps JOIN (SELECT recid, uid, avg(rate) FILTER (WHERE bin < 24) AS mu, stddev_pop(rate) FILTER (WHERE bin < 24) AS sd, "
              "sum(n) FILTER (WHERE bin < 24) / 21600.0 AS rp, sum(n) / 43200.0 AS rt FROM ps GROUP BY recid, uid) m USING (recid, uid) WHERE rp > 0.004 AND rt > 0.004")


@query("psth_zscore", "H4", "recid:i uid:i bin:i z:f", with_ctes("ev trg", ZSCORE_SQL, **_PSTH))
def psth_zscore(spark, sf):
    return align.psth_zscore(_psth(spark, sf, SIGMA), ["recid", "uid"], START, STOP, WIDTH, 0.004)


_SG = tc.savgol_weights(11, 3)


@query("savgol", "H5", "recid:i i:i smooth:f", with_ctes(
    "tr", "SELECT recid, i, greatest(s, 0) AS smooth FROM (SELECT a.recid, a.i, sum(b.v * w) AS s, count(*) AS k FROM tr a JOIN ker ON true JOIN pad b ON b.recid = a.recid AND b.i = a.i + o GROUP BY a.recid, a.i) WHERE k = 11",
    ker="SELECT unnest(range(0, 11)) - 5 AS o, unnest([" + ", ".join(f"{w!r}::DOUBLE" for w in _SG) + "]) AS w",
    ends="SELECT recid, min_by(v, i) AS y0, max_by(v, i) AS y1, max(i) AS n FROM tr GROUP BY recid",
    pad="SELECT recid, i, v FROM tr UNION ALL SELECT recid, -i, y0 - abs(v - y0) FROM tr JOIN ends USING (recid) WHERE i BETWEEN 1 AND 5 "
        "UNION ALL SELECT recid, 2 * n - i, y1 + abs(v - y1) FROM tr JOIN ends USING (recid) WHERE i >= n - 5 AND i < n"))
def savgol(spark, sf):
    return tc.savgol(src.trace(spark, sf), "recid", 11, 3)


_XY = "SELECT recid, i, v AS x, coalesce(lag(v, 2) OVER (PARTITION BY recid ORDER BY i), 0) + i % 3 AS y FROM tr"
_XC = ("SELECT {g}, a.i - b.i AS lag, sum(a.x * b.y) / any_value(n) AS c FROM {s} a JOIN {s} b ON {on} AND abs(a.i - b.i) <= {m} "
       "JOIN (SELECT {k}, sqrt(sum(x * x) * sum(y * y)) AS n FROM {s} GROUP BY ALL) nn ON {onn} GROUP BY {g}, a.i - b.i")


def _xy(spark, sf):
    from ..operators.traces import neighbourhood
    tr = src.trace(spark, sf).select("recid", "i", F.col("v").alias("x"))
    return neighbourhood(tr, "recid", 2, lambda w: {"y": F.coalesce(F.lag("x", 2).over(w), F.lit(0.0)) + F.col("i") % 3})


@query("xcorr", "H6", "recid:i lag:i c:f shift:i", with_ctes(
    "tr", "SELECT xc.*, shift FROM xc LEFT JOIN (SELECT recid, min_by(lag, (abs(lag), lag)) AS shift FROM (SELECT *, lag(c) OVER g AS p, lead(c) OVER g AS q FROM xc WINDOW g AS (PARTITION BY recid ORDER BY lag)) "
    "WHERE c > p AND c > q GROUP BY recid) USING (recid)",
    xy=_XY, xc=_XC.format(g="a.recid", k="recid", s="xy", on="a.recid = b.recid", onn="a.recid = nn.recid", m=12)))
def xcorr(spark, sf):
    c = tc.xcorr(_xy(spark, sf), "recid", 12)
    return c.join(tc.best_shift(c, "recid"), "recid", "left")


@query("xcorr_windowed", "H7", "recid:i win:i lag:i c:f", with_ctes(
    "tr", "SELECT * FROM xc", xy=_XY,
    w="SELECT recid, win, least(win * 96, n - 128) AS w0 FROM (SELECT recid, n, unnest(range(0, CAST(ceil((n - 128) / 96.0) AS BIGINT) + 1)) AS win FROM (SELECT recid, count(*) AS n FROM tr GROUP BY recid) WHERE n >= 128)",
    sm="SELECT w.recid, w.win, xy.i - w0 AS i, x, y FROM xy JOIN w ON w.recid = xy.recid AND xy.i >= w0 AND xy.i < w0 + 128",
    xc=_XC.format(g="a.recid, a.win", k="recid, win", s="sm", on="a.recid = b.recid AND a.win = b.win", onn="a.recid = nn.recid AND a.win = nn.win", m=6)))
def xcorr_windowed(spark, sf):
    xy = _xy(spark, sf)
    spans = xy.groupBy("recid").agg(F.lit(0).cast("bigint").alias("i0"), F.count(F.lit(1)).alias("i1"))
    s = tc.window_samples(xy, iv.sliding_windows(spans, "recid", 128, 32), "recid")
    return tc.xcorr(s, ["recid", "win"], 6)


@query("moving_average", "H8", "recid:i i:i avg:f", with_ctes(
    "tr", "SELECT recid, i, a AS avg FROM (SELECT recid, i, avg(v) OVER g AS a, count(*) OVER g AS k FROM tr WINDOW g AS (PARTITION BY recid ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)) WHERE k = 25"))
def moving_average(spark, sf):
    return tc.moving_average(src.trace(spark, sf), "recid", 25)


@query("channel_consensus", "H9", "recid:i i:i pct:f", with_ctes(
    "ev", "SELECT d.recid, d.i, count(*) * 100.0 / any_value(k) AS pct FROM det d JOIN kept USING (recid, chan) JOIN (SELECT recid, count(*) AS k FROM kept GROUP BY recid) USING (recid) "
    "WHERE NOT EXISTS (SELECT 1 FROM st s WHERE s.recid = d.recid AND d.i >= s.i - 1 AND d.i < s.i + 3) GROUP BY d.recid, d.i",
    det="SELECT DISTINCT recid, uid AS chan, CAST(floor(t / 3600) AS BIGINT) AS i FROM ev WHERE kind IN ('click', 'view')",
    st="SELECT DISTINCT recid, CAST(floor(t / 3600) AS BIGINT) AS i FROM ev WHERE kind = 'signup'",
    nn="SELECT recid, chan, count(*) AS n FROM det GROUP BY ALL",
    kept="SELECT recid, chan FROM nn JOIN (SELECT recid, avg(n) AS mu, stddev_pop(n) AS sd FROM nn GROUP BY recid) USING (recid) WHERE abs(n - mu) <= 1.5 * sd"))
def channel_consensus(spark, sf):
    ev = src.event_rows(spark, sf).withColumn("i", F.floor(F.col("t") / 3600))
    det = ev.where("kind IN ('click', 'view')").select("recid", F.col("uid").alias("chan"), "i").distinct()
    return tc.channel_consensus(det, ev.where("kind = 'signup'").select("recid", "i").distinct(), "recid", 1.5, -1, 3)


_OFF = {
    "bounds": _BOUNDS, "r": _RATE.format(units=1),
    "gm": "SELECT recid, exp(avg(ln(rate))) AS g FROM r WHERE rate > 0 GROUP BY recid",
    "rr": "SELECT recid, bin AS i, rate AS v, g FROM r JOIN gm USING (recid)",
    **crossing_ctes("g", "rr"),
    "tr0": "SELECT p.recid, CAST(i0 AS DOUBLE) AS t0, CAST(i1 AS DOUBLE) AS t1 FROM pr p JOIN rr ON rr.recid = p.recid AND i >= i0 AND i < i1 WHERE c = -1 AND i1 - i0 > 1 AND i1 - i0 <= 100 GROUP BY p.recid, i0, i1 HAVING min(v) <= 0.2 * any_value(g)",
    **merge_ctes("m", "tr0", "t0 - reach >= 3"),
    "pad": "SELECT recid, t0 - CASE WHEN n >= 3 THEN 2 ELSE 1 END AS t0, t1 + CASE WHEN n >= 3 THEN 2 ELSE 1 END AS t1 FROM m",
    "bb": "SELECT recid, CAST(0 AS DOUBLE) AS lo, CAST(floor((hi - lo) / 1800.0) AS DOUBLE) AS hi FROM bounds",
    "free": _FREE.replace("bounds", "bb").format(f="pad"),
    "longfree": "SELECT * FROM free WHERE t1 - t0 > 2",
}


@query("off_periods", "H10", "recid:i t0:f t1:f", with_ctes("ev", _FREE.replace("bounds", "bb").format(f="longfree"), **_OFF))
def off_periods(spark, sf):
    b = bounds(spark, sf)
    rate = tc.rate_histogram(src.event_rows(spark, sf), b, "recid", 1800.0).withColumnRenamed("bin", "i")
    # the trace is read by every later scan twice: it is made once
    leveled = cut_lineage(rate.join(tc.geometric_mean_level(rate, "recid"), "recid"))
    troughs = tc.halfwaves(leveled, "recid", F.col("gmean"), 0.2 * F.col("gmean"), 1, "trough", "rate").where("i1 - i0 <= 100").select(
        "recid", F.col("i0").cast("double").alias("t0"), F.col("i1").cast("double").alias("t1"))
    merged = cut_lineage(iv.merge_by_gap(troughs, "recid", 3.0, 4096.0))
    bins = b.select("recid", F.lit(0.0).alias("lo"), F.floor((F.col("hi") - F.col("lo")) / 1800.0).cast("double").alias("hi"))
    return iv.border_intervals(merged, "n", bins, "recid", 3, 2.0, 1.0, 2.0, 4096.0)


@query("hist2d", "H11", "bin_x:i bin_y:i n:i", (
    "SELECT bin_x, bin_y, count(*) AS n FROM (SELECT CAST(CASE WHEN l_quantity = 50 THEN 9 ELSE floor((l_quantity - 0) / 5) END AS BIGINT) AS bin_x, "
    "CAST(CASE WHEN l_discount = 0.1 THEN 4 ELSE floor((l_discount * 1.0 - 0) * 5 / 0.1::DOUBLE) END AS BIGINT) AS bin_y FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1) "
    "GROUP BY GROUPING SETS ((bin_x, bin_y), (bin_x), (bin_y))"))
def hist2d(spark, sf):
    return tc.hist2d(src.read_table(spark, sf, "lineitem"), "l_quantity", "l_discount", (0.0, 50.0, 10), (0.0, 0.1, 5))


@query("window_amplitude", "H12", "recid:i win:i mean:f std:f", with_ctes(
    "tr", "SELECT p.recid, i0 AS win, avg(abs(v)) AS mean, stddev_pop(abs(v)) AS std FROM pr p JOIN tr ON tr.recid = p.recid AND i >= i0 AND i < i1 WHERE c = 1 AND i1 IS NOT NULL GROUP BY p.recid, i0",
    **crossing_ctes(str(LEVEL))))
def window_amplitude(spark, sf):
    tr = src.trace(spark, sf)
    win = tc.halfwaves(tr, "recid", LEVEL, -1e300, mode="crest").select("recid", F.col("i0").alias("win"), F.col("i0").alias("w0"), F.col("i1").alias("w1"))
    return tc.window_amplitude(tc.window_samples(tr, win, "recid"), ["recid", "win"])


@query("resample_linear", "H13", "recid:i j:i v:f", with_ctes(
    "tr", "SELECT g.recid, j, a.v + coalesce((b.v - a.v) * (j * (n - 1) / (m - 1) - a.i), 0) AS v FROM (SELECT *, j * (n - 1) // (m - 1) AS i FROM "
    "(SELECT recid, n, m, unnest(range(0, m)) AS j FROM (SELECT recid, count(*) AS n, CAST(floor(count(*) * 2.5) AS BIGINT) AS m FROM tr GROUP BY recid))) g "
    "JOIN tr a ON a.recid = g.recid AND a.i = g.i LEFT JOIN tr b ON b.recid = g.recid AND b.i = g.i + 1"))
def resample_linear(spark, sf):
    return tc.resample_linear(src.trace(spark, sf), "recid", 2.0, 5.0)


@query("rolling_median", "H14", "recid:i i:i med:f", with_ctes(
    "tr", "SELECT recid, i, list_sort([coalesce(lag(v) OVER g, 0), v, coalesce(lead(v) OVER g, 0)])[2] AS med FROM tr WINDOW g AS (PARTITION BY recid ORDER BY i)"))
def rolling_median(spark, sf):
    return tc.rolling_median(src.trace(spark, sf), "recid")


@query("density_hist", "H15", "kind:s bin:i n:i prob:f density:f", with_ctes(
    "ev", "SELECT kind, bin, n, n / sum(n) OVER (PARTITION BY kind) AS prob, n / (sum(n) OVER (PARTITION BY kind) * bw) AS density FROM ("
    "SELECT g.kind, g.bin, any_value(g.bw) AS bw, count(e.value) AS n FROM (SELECT kind, nb, bw, top, unnest(range(0, nb)) AS bin FROM c) g LEFT JOIN "
    "(SELECT ev.kind, value, CAST(least(floor(value / bw), nb - 1) AS BIGINT) AS bin FROM ev JOIN c USING (kind) WHERE value BETWEEN 0 AND top) e ON e.kind = g.kind AND e.bin = g.bin GROUP BY g.kind, g.bin)",
    c="SELECT kind, CAST(floor(sqrt(count(value))) AS BIGINT) - 1 AS nb, quantile_cont(value, 0.975) / (CAST(floor(sqrt(count(value))) AS BIGINT) - 1) AS bw, quantile_cont(value, 0.975) AS top FROM ev GROUP BY kind"))
def density_hist(spark, sf):
    return tc.density_hist(src.event_rows(spark, sf), "kind", "value")
