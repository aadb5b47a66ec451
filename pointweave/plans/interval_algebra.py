"""Interval algebra (I) queries."""

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..sources import tables as src
from .joining import _BOUNDS, _FREE, _art, _quiet, bounds
from .registry import query
from .sqltext import with_ctes

MERGE_CTES = {
    "reach": "SELECT recid, t0, t1, max(t1) OVER (PARTITION BY recid ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {f}",
    "isl": "SELECT *, sum(CASE WHEN reach IS NULL OR {apart} THEN 1 ELSE 0 END) OVER (PARTITION BY recid ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS k FROM {p}reach",
    "": "SELECT recid, min(t0) AS t0, max(t1) AS t1, count(*) AS n FROM {p}isl GROUP BY recid, k",
}


def merge_ctes(prefix: str, f: str, apart: str = "t0 > reach") -> dict[str, str]:
    """SQL steps that merge table ``f``; the result is the CTE ``<prefix>``."""
    return {f"{prefix}{s}": b.format(f=f, p=prefix, apart=apart) for s, b in MERGE_CTES.items()}


_LO, _HI = 1704153600.0, 1706400000.0


@query("merge_intervals", "I1", "recid:i t0:f t1:f n:i", with_ctes(
    "art quiet", "SELECT * FROM m", w=f"SELECT * FROM (SELECT recid, least(greatest(t0, {_LO}), {_HI}) AS t0, least(greatest(t1, {_LO}), {_HI}) AS t1 "
    "FROM (SELECT recid, t0, t1 FROM art UNION ALL SELECT recid, t0, t1 FROM quiet)) WHERE t1 > t0", **merge_ctes("m", "w")))
def merge_intervals(spark, sf):
    w = _art(spark, sf).unionByName(_quiet(spark, sf))
    return iv.merge_intervals(w, "recid", lo=_LO, hi=_HI)


@query("free_intervals", "I2", "recid:i t0:f t1:f", with_ctes("ev art", "SELECT * FROM free", bounds=_BOUNDS, free=_FREE.format(f="art")))
def free_intervals(spark, sf):
    return iv.free_intervals(_art(spark, sf), bounds(spark, sf), "recid")


_PADDED = "SELECT recid, t0 - 300 AS t0, t1 + 900 AS t1 FROM art"


@query("free_after_buffer", "I3", "recid:i t0:f t1:f", with_ctes(
    "ev art", "SELECT * FROM free WHERE t1 - t0 > 2400", bounds=_BOUNDS, pad=_PADDED, free=_FREE.format(f="pad")))
def free_after_buffer(spark, sf):
    return iv.free_after_buffer(_art(spark, sf), bounds(spark, sf), "recid", 300.0, 900.0, 2400.0)


@query("baseline_intervals", "I4", "recid:i t0:f t1:f", with_ctes(
    "ev art trg", "SELECT * FROM base", bounds=_BOUNDS, pad=_PADDED, free=_FREE.format(f="pad"),
    blocked="SELECT recid, t0, t1 FROM art UNION ALL SELECT recid, t - 600, t + 1200 FROM trg UNION ALL SELECT recid, t0, t1 FROM free WHERE t1 - t0 <= 2400",
    base=_FREE.format(f="blocked")))
def baseline_intervals(spark, sf):
    b = bounds(spark, sf)
    short = iv.free_intervals(iv.pad_windows(_art(spark, sf), 300.0, 900.0), b, "recid").where("t1 - t0 <= 2400")
    trials = src.event_windows(spark, sf, "purchase", 0.0, 600.0)
    return iv.baseline_intervals(_art(spark, sf), trials, short, b, "recid", 600.0, 600.0)


@query("merge_by_gap", "I5", "recid:i t0:f t1:f n:i", with_ctes("art", "SELECT * FROM m", **merge_ctes("m", "art", "t0 - reach >= 3600")))
def merge_by_gap(spark, sf):
    return iv.merge_by_gap(_art(spark, sf), "recid", 3600.0)


@query("events_per_merge", "I6", "recid:i t0:f t1:f n_members:i", with_ctes(
    "art", "SELECT m.recid, m.t0, m.t1, count(*) AS n_members FROM m JOIN art a ON a.recid = m.recid AND a.t0 <= m.t1 AND a.t1 >= m.t0 GROUP BY ALL",
    **merge_ctes("m", "art", "t0 - reach >= 3600")))
def events_per_merge(spark, sf):
    return iv.members_per_merge(iv.merge_by_gap(_art(spark, sf), "recid", 3600.0), _art(spark, sf), "recid")


@query("border_intervals", "I7", "recid:i t0:f t1:f", with_ctes(
    "ev art", "SELECT * FROM border", bounds=_BOUNDS, **merge_ctes("m", "art", "t0 - reach >= 3600"),
    pad="SELECT recid, t0 - CASE WHEN n >= 3 THEN 1200 ELSE 300 END AS t0, t1 + CASE WHEN n >= 3 THEN 1200 ELSE 300 END AS t1 FROM m",
    free=_FREE.format(f="pad"), longfree="SELECT * FROM free WHERE t1 - t0 > 1800", border=_FREE.format(f="longfree")))
def border_intervals(spark, sf):
    m = iv.merge_by_gap(_art(spark, sf), "recid", 3600.0)
    return iv.border_intervals(m, "n", bounds(spark, sf), "recid", 3, 1200.0, 300.0, 1800.0)


@query("extend_borders", "I8", "recid:i t0:f t1:f", with_ctes(
    "art quiet", "SELECT * FROM (SELECT recid, t0 - CASE WHEN EXISTS (SELECT 1 FROM art a WHERE a.recid = m.recid AND a.t0 = m.t0) THEN 60 ELSE 0 END AS t0, "
    "t1 + CASE WHEN EXISTS (SELECT 1 FROM art a WHERE a.recid = m.recid AND a.t1 = m.t1) THEN 60 ELSE 0 END AS t1 FROM m) WHERE t1 - t0 >= 3000",
    w="SELECT recid, t0, t1 FROM art UNION ALL SELECT recid, t0, t1 FROM quiet", **merge_ctes("m", "w")))
def extend_borders(spark, sf):
    art = _art(spark, sf)
    m = iv.merge_intervals(art.unionByName(_quiet(spark, sf)), "recid")
    return iv.extend_borders(m, art, "recid", 60.0, 3000.0)


@query("gap_windows", "I9", "recid:i t0:f t1:f", with_ctes(
    "ev art", "SELECT recid, coalesce(lag(t1) OVER g, lo) AS t0, t0 AS t1 FROM m JOIN bounds USING (recid) WINDOW g AS (PARTITION BY recid ORDER BY t0) "
    "UNION ALL SELECT recid, max(t1), any_value(hi) FROM m JOIN bounds USING (recid) GROUP BY recid", bounds=_BOUNDS, **merge_ctes("m", "art")))
def gap_windows(spark, sf):
    return iv.gap_windows(iv.merge_intervals(_art(spark, sf), "recid"), bounds(spark, sf), "recid")


@query("windows_around", "I10", "recid:i win_id:i t0:f t1:f", with_ctes("trg", "SELECT recid, win_id, t - 2 AS t0, t + 0.7 AS t1 FROM trg"))
def windows_around(spark, sf):
    return iv.windows_around(src.triggers(spark, sf), 2.0, 0.7)


@query("tile_windows", "I11", "recid:i tile:i t0:f t1:f", with_ctes(
    "ev", "SELECT recid, tile, lo + tile * 10000.0 AS t0, lo + (tile + 1) * 10000.0 AS t1 FROM (SELECT recid, lo, unnest(range(1, CAST(ceil((hi - lo) / 10000.0) AS BIGINT) - 1)) AS tile FROM bounds)",
    bounds=_BOUNDS))
def tile_windows(spark, sf):
    b = bounds(spark, sf).select("recid", F.col("lo").alias("t0"), F.col("hi").alias("t1"))
    return iv.tile_windows(b, "recid", 10000.0)


@query("sliding_windows", "I12", "recid:i win:i w0:i w1:i", with_ctes(
    "ev", "SELECT recid, win, least(win * 96, n - 128) AS w0, least(win * 96, n - 128) + 128 AS w1 FROM ("
    "SELECT recid, n, unnest(range(0, CAST(ceil((n - 128) / 96.0) AS BIGINT) + 1)) AS win FROM (SELECT recid, count(*) AS n FROM ev GROUP BY recid) WHERE n >= 128)"))
def sliding_windows(spark, sf):
    spans = src.event_rows(spark, sf).groupBy("recid").agg(F.lit(0).cast("bigint").alias("i0"), F.count(F.lit(1)).alias("i1"))
    return iv.sliding_windows(spans, "recid", 128, 32)


@query("mask_samples", "I13", "recid:i i:i v:f masked:b", with_ctes(
    "tr art", "SELECT recid, i, CASE WHEN masked THEN NULL ELSE v END AS v, masked FROM (SELECT *, EXISTS (SELECT 1 FROM art a WHERE a.recid = tr.recid AND tr.t > a.t0 AND tr.t < a.t1) AS masked FROM tr)"))
def mask_samples(spark, sf):
    return iv.mask_samples(src.trace(spark, sf), _art(spark, sf), "recid", chunk_s=86400.0)


@query("time_fractions", "I14", "recid:i usable:f frac_quiet:f frac_off:f", with_ctes(
    "ev art quiet", "SELECT recid, usable, coalesce(q, 0) / nullif(usable, 0) AS frac_quiet, coalesce(o, 0) / nullif(usable, 0) AS frac_off FROM ("
    "SELECT recid, hi - lo - coalesce((SELECT sum(t1 - t0) FROM art a WHERE a.recid = b.recid), 0) AS usable, "
    "(SELECT sum(t1 - t0) FROM quiet a WHERE a.recid = b.recid) AS q, (SELECT sum(300.0) FROM ev a WHERE a.recid = b.recid AND kind = 'view') AS o FROM bounds b)",
    bounds=_BOUNDS))
def time_fractions(spark, sf):
    def kind(df, k):
        return df.select("recid", "t0", "t1", F.lit(k).alias("kind"))
    off = src.event_rows(spark, sf, ["view"]).select("recid", F.lit(0.0).alias("t0"), F.lit(300.0).alias("t1"))
    w = kind(_art(spark, sf), "art").unionByName(kind(_quiet(spark, sf), "quiet")).unionByName(kind(off, "off"))
    return iv.time_fractions(w, bounds(spark, sf), "recid", ["quiet", "off"], "art")
