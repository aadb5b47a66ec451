"""Permutation and enrichment queries (N), and the polarisation summary built on them (A10)."""

from pyspark.sql import functions as F

from ..operators import aggregate as ag
from ..operators import permute as pm
from ..sources import tables as src
from .registry import query
from .sqltext import with_ctes

REPS = 20


def _base(spark, sf):
    return src.read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("a1"), F.col("o_orderstatus").alias("a2"),
        (F.col("o_custkey") % 4).alias("const"), "o_totalprice")


_BASE = "SELECT o_orderkey AS id, o_orderpriority AS a1, o_orderstatus AS a2, o_custkey % 4 AS const, o_totalprice FROM orders"


def perm_ctes(group: str, source: str = "base", reps: int = REPS, by: str = "", p: str = "") -> dict[str, str]:
    b = f"{by}, " if by else ""
    return {
        f"{p}rk": f"SELECT {group}, rep, a1, a2, row_number() OVER (PARTITION BY {group}, rep ORDER BY md5('a_' || rep || '_' || id), id) AS ra, "
                  f"row_number() OVER (PARTITION BY {group}, rep ORDER BY md5('b_' || rep || '_' || id), id) AS rb FROM {source} CROSS JOIN (SELECT unnest(range(0, {reps})) AS rep)",
        f"{p}perm": f"SELECT {', '.join(f'x.{c}' for c in by.split(', ')) + ', ' if by else ''}x.rep, x.a1, y.a2, count(*) AS n FROM {p}rk x JOIN {p}rk y ON x.rep = y.rep AND x.ra = y.rb AND "
                    + " AND ".join(f"x.{c} = y.{c}" for c in group.split(", ")) + " GROUP BY ALL",
        f"{p}obs": f"SELECT {b}a1, a2, count(z.id) AS n FROM (SELECT DISTINCT {b}a1 FROM {source}) l1 "
                   + (f"JOIN (SELECT DISTINCT {b}a2 FROM {source}) l2 USING ({by})" if by else f"CROSS JOIN (SELECT DISTINCT a2 FROM {source}) l2")
                   + f" LEFT JOIN {source} z USING ({b}a1, a2) GROUP BY ALL",
        f"{p}dense": f"SELECT o.*, r.rep, coalesce(q.n, 0) AS m FROM {p}obs o CROSS JOIN (SELECT unnest(range(0, {reps})) AS rep) r LEFT JOIN {p}perm q USING ({b}a1, a2, rep)",
        f"{p}st": f"SELECT {b}a1, a2, any_value(n) AS n, avg(m) AS mean, stddev_pop(m) AS sd, count(*) FILTER (WHERE m < n) AS lt, count(*) FILTER (WHERE m <= n) AS le FROM {p}dense GROUP BY {b}a1, a2",
        f"{p}en": f"SELECT {b}a1, a2, n, mean, sd, CASE WHEN sd > 1e-9 THEN (n - mean) / sd END AS z, (lt + le + CASE WHEN lt < le THEN 1 ELSE 0 END) * 50.0 / {reps} AS pofs FROM {p}st",
        f"{p}lv": f"SELECT *, CASE WHEN pofs > 99.9 THEN 3 WHEN pofs < 0.1 THEN -3 WHEN pofs > 99 THEN 2 WHEN pofs < 1 THEN -2 WHEN pofs > 95 THEN 1 WHEN pofs < 5 THEN -1 ELSE 0 END AS level FROM {p}en",
    }


_N = {"base": _BASE, **perm_ctes("const")}


def _enriched(spark, sf):
    base = _base(spark, sf)
    return pm.enrichment(base, pm.permute_counts(base, "id", "a1", "a2", "const", REPS), "a1", "a2", REPS)


@query("permute_counts", "N1", "rep:i a1:s a2:s n:i", with_ctes("", "SELECT * FROM perm", **_N))
def permute_counts(spark, sf):
    return pm.permute_counts(_base(spark, sf), "id", "a1", "a2", "const", REPS)


@query("permute_counts_by_margins", "N1", "rep:i a1:s a2:s n:i")
def permute_counts_by_margins(spark, sf):
    return pm.permute_counts_by_margins(_base(spark, sf), "a1", "a2", "const", 1000)


@query("exact_moments", "N2", "a1:s a2:s n:i mean:f sd:f", with_ctes(
    "", "SELECT a1, a2, (SELECT count(*) FROM b WHERE b.a1 IS NOT DISTINCT FROM g.a1 AND b.a2 IS NOT DISTINCT FROM g.a2) AS n, mean, sd FROM g",
    b="SELECT o_orderpriority AS a1, nullif(o_orderstatus, 'P') AS a2, nullif(o_custkey % 4, 1) AS const FROM orders",
    g="SELECT a1, a2, sum(r * c / w) AS mean, sqrt(sum(CASE WHEN w > 1 THEN r * c * (w - r) * (w - c) / (w * w * (w - 1)) ELSE 0 END)) AS sd FROM ("
      "SELECT x.a1, y.a2, x.n::DOUBLE AS r, y.n::DOUBLE AS c, z.n::DOUBLE AS w FROM (SELECT const, a1, count(*) AS n FROM b GROUP BY ALL) x "
      "JOIN (SELECT const, a2, count(*) AS n FROM b GROUP BY ALL) y ON x.const IS NOT DISTINCT FROM y.const "
      "JOIN (SELECT const, count(*) AS n FROM b GROUP BY ALL) z ON z.const IS NOT DISTINCT FROM x.const) GROUP BY a1, a2"))
def exact_moments(spark, sf):
    """Closed-form moments of the null, with NULL levels and a NULL constant group."""
    o = src.read_table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("a1"), F.nullif("o_orderstatus", F.lit("P")).alias("a2"), F.nullif(F.col("o_custkey") % 4, F.lit(1)).alias("const"))
    return pm.exact_moments(o, "a1", "a2", "const")


@query("margin_draws_check", "N1", "reps:i rows_ok:b cols_ok:b mean_ok:b", "SELECT 1000 AS reps, true AS rows_ok, true AS cols_ok, true AS mean_ok")
def margin_draws_check(spark, sf):
    """A thousand repetitions keep both margins each, and their means lie within five standard errors of the exact ones."""
    base, reps = _base(spark, sf), 1000
    draws = pm.permute_counts_by_margins(base, "a1", "a2", "const", reps)
    exact = pm.exact_moments(base, "a1", "a2", "const")

    def kept(attr: str):
        want = base.groupBy(attr).agg(F.count("*").alias("want"))
        sums = draws.groupBy("rep", attr).agg(F.sum("n").alias("got")).join(want, attr)
        return sums.agg((F.count("*") == F.lit(reps) * F.countDistinct(attr)).alias("all"), F.min(F.col("got") == F.col("want")).alias("same"))

    mean = draws.groupBy("a1", "a2").agg((F.sum("n") / reps).alias("drawn"))
    near = exact.join(mean, ["a1", "a2"], "left").agg(F.min(F.abs(F.coalesce("drawn", F.lit(0.0)) - F.col("mean")) <= 5 * F.col("sd") / reps ** 0.5 + 1e-9).alias("mean_ok"))
    r, c = (kept(a).select((F.col("all") & F.col("same")).alias(n)) for a, n in (("a1", "rows_ok"), ("a2", "cols_ok")))
    one = F.lit(1).alias("one")
    return r.select("*", one).join(c.select("*", one), "one").join(near.select("*", one), "one").select(F.lit(reps).alias("reps"), "rows_ok", "cols_ok", "mean_ok")


@query("null_moments", "N2", "a1:s a2:s mean:f sd:f", with_ctes("", "SELECT * FROM st", **_N))
def null_moments(spark, sf):
    base = _base(spark, sf)
    return pm.null_moments(pm.permute_counts(base, "id", "a1", "a2", "const", REPS), "a1", "a2", REPS, source=base)


@query("enrichment_z", "N3", "a1:s a2:s n:i mean:f sd:f z:f", with_ctes("", "SELECT * FROM en", **_N))
def enrichment_z(spark, sf):
    return _enriched(spark, sf)


@query("percentile_of_score", "N4", "a1:s a2:s n:i pofs:f", with_ctes("", "SELECT * FROM en", **_N))
def percentile_of_score(spark, sf):
    return _enriched(spark, sf)


@query("signif_level", "N5", "a1:s a2:s pofs:f level:i", with_ctes("", "SELECT * FROM lv", **_N))
def signif_level(spark, sf):
    return _enriched(spark, sf)


@query("separation_index", "N6", "si:f", with_ctes("", "SELECT avg(abs(pofs - 50) / 50) AS si FROM en", **_N))
def separation_index(spark, sf):
    return pm.separation_index(_enriched(spark, sf))


@query("pofs_to_p", "N7", "a1:s a2:s p:f", with_ctes(
    "", "SELECT a1, a2, CASE WHEN pofs < 50 THEN pofs / 100 ELSE (100 - pofs) / 100 END AS p FROM en", **_N))
def pofs_to_p(spark, sf):
    return _enriched(spark, sf).withColumn("p", pm.pofs_to_p("pofs"))


_VIEWS = ("SELECT 'prio' AS view, o_orderkey AS id, o_orderpriority AS a1, o_orderstatus AS a2, CAST(o_custkey % 4 AS VARCHAR) AS const FROM orders "
          "UNION ALL SELECT 'prio_big', o_orderkey, o_orderpriority, o_orderstatus, '' FROM orders WHERE o_totalprice > 250000 "
          "UNION ALL SELECT 'cust', o_orderkey, CAST(o_custkey % 6 AS VARCHAR), o_orderstatus, o_orderpriority || '|' || (o_custkey % 2) FROM orders")


@query("enrichment_views", "N8", "view:s a1:s a2:s n:i mean:f sd:f z:f pofs:f level:i", with_ctes(
    "", "SELECT * FROM lv", base=_VIEWS, **perm_ctes("view, const", reps=10, by="view")))
def enrichment_views(spark, sf):
    o = src.read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("a2"), "o_totalprice",
        (F.col("o_custkey") % 6).alias("c6"), (F.col("o_custkey") % 4).alias("c4"), (F.col("o_custkey") % 2).alias("c2"))
    v = pm.stack_views(o, "id", "a2", {
        "prio": ("prio", ["c4"], None), "prio_big": ("prio", [], F.col("o_totalprice") > 250000), "cust": ("c6", ["prio", "c2"], None)})
    perm = pm.permute_counts(v, "id", "a1", "a2", ["view", "const"], 10, by="view")
    return pm.enrichment(v, perm, "a1", "a2", 10, by="view")


@query("shuffle_scope_compare", "N9", "scope:s a1:s a2:s mean:f sd:f z:f", with_ctes(
    "", "SELECT 'within' AS scope, a1, a2, mean, sd, z FROM win_en UNION ALL SELECT 'across', a1, a2, mean, sd, z FROM acr_en",
    base=_BASE, whole="SELECT id, a1, a2, 0 AS const FROM base", **perm_ctes("const", reps=10, p="win_"), **perm_ctes("const", "whole", 10, p="acr_")))
def shuffle_scope_compare(spark, sf):
    base = _base(spark, sf)
    both = base.select("id", "a1", "a2", F.explode(F.array(
        F.struct(F.lit("within").alias("scope"), F.col("const").alias("const")),
        F.struct(F.lit("across").alias("scope"), F.lit(0).cast("bigint").alias("const")))).alias("s")).select("s.*", "id", "a1", "a2")
    perm = pm.permute_counts(both, "id", "a1", "a2", ["scope", "const"], 10, by="scope")
    return pm.enrichment(both, perm, "a1", "a2", 10, by="scope")


@query("enrichment_presel", "N10", "a1:s a2:s z:f", with_ctes(
    "", "SELECT a1, a2, z FROM en WHERE a1 IN (SELECT a1 FROM en GROUP BY a1 HAVING sum(n) > 2980) AND NOT starts_with(a1, '5')", **_N))
def enrichment_presel(spark, sf):
    return pm.presel(_enriched(spark, sf), "a1", 2980, ~F.col("a1").startswith("5"))


_TUNE = ("SELECT 'price' AS view, o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'signif' ELSE 'ns' END AS a1, o_orderstatus AS a2, '' AS const FROM orders "
         "UNION ALL SELECT 'cust', o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'signif' ELSE 'ns' END, o_orderstatus, '' FROM orders")


@query("tuning_enrichment", "N11", "a1:s a2:s n:i z:f frac:f", with_ctes(
    "", "SELECT view AS a1, a2, n, z, sum(n) OVER (PARTITION BY view) / (SELECT count(*) FROM orders) AS frac FROM en WHERE a1 = 'signif'",
    base=_TUNE, **perm_ctes("view, const", reps=10, by="view")))
def tuning_enrichment(spark, sf):
    o = src.read_table(spark, sf, "orders")
    flags = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a2"),
                     F.when(F.col("o_totalprice") > 300000, "signif").otherwise("ns").alias("price"),
                     F.when(F.col("o_custkey") % 5 == 0, "signif").otherwise("ns").alias("cust"))
    v = pm.stack_views(flags, "id", "a2", {"price": ("price", [], None), "cust": ("cust", [], None)})
    e = pm.enrichment(v, pm.permute_counts(v, "id", "a1", "a2", ["view", "const"], 10, by="view"), "a1", "a2", 10, by="view")
    share = v.groupBy("view").agg(F.avg((F.col("a1") == "signif").cast("int")).alias("frac"))
    return pm.fuse_significant(e.join(share, "view"), "view", "a1", "signif")


_EDGES = ("SELECT a.nat AS src, b.nat AS dst, sum(a.n * b.n) AS w FROM (SELECT c_nationkey AS nat, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY ALL) a "
          "JOIN (SELECT c_nationkey AS nat, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY ALL) b ON a.seg = b.seg AND a.nat < b.nat GROUP BY ALL")


@query("shuffle_edges", "N12", "rep:i src:i dst:i w:i", with_ctes(
    "", "SELECT x.rep, x.src, x.dst, y.w FROM p x JOIN p y ON x.rep = y.rep AND x.rp = y.rw", e=_EDGES,
    p="SELECT *, row_number() OVER (PARTITION BY rep ORDER BY md5('pos_' || src || '_' || dst), src, dst) AS rp, "
      "row_number() OVER (PARTITION BY rep ORDER BY md5('w_' || rep || '_' || src || '_' || dst), src, dst) AS rw FROM e CROSS JOIN (SELECT unnest(range(0, 10)) AS rep)"))
def shuffle_edges(spark, sf):
    c = src.read_table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nat"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    b = c.select(F.col("nat").alias("dst"), "c_mktsegment", F.col("n").alias("m"))
    e = c.withColumnRenamed("nat", "src").join(b, "c_mktsegment").where("src < dst").groupBy("src", "dst").agg(F.sum(F.col("n") * F.col("m")).alias("w"))
    return pm.shuffle_edges(e, 10)


@query("polarization", "A10", "a2:s amp:f var:f", with_ctes(
    "", "SELECT CASE WHEN grouping(a2) = 1 THEN 'all' ELSE a2 END AS a2, avg(abs(coalesce(z, 0))) AS amp, var_pop(coalesce(z, 0)) AS var FROM en GROUP BY ROLLUP (a2)", **_N))
def polarization(spark, sf):
    return ag.polarization(_enriched(spark, sf), "a2", "z")


# ---- the same statistics at full size: random draws cannot be repeated in SQL, so SQL gives the exact moments that they must meet

FULL = 1000


def _near_exact(drawn, exact, by=()):
    """Observed counts and exact moments, and whether what was drawn agrees: mean and sd within five standard errors, the
    percentile with the normal law at the observed count (whose own error is a few points in small cells), level and p with
    the percentile, z with mean and sd."""
    keys = [*by, "a1", "a2"]
    j = exact.withColumnsRenamed({"mean": "exact_mean", "sd": "exact_sd", "n": "exact_n"}).join(drawn, keys, "left")
    error = 5 / FULL ** 0.5
    below = lambda x: 100 / (1 + F.exp(-1.702 * (x - F.col("exact_mean")) / F.greatest("exact_sd", F.lit(1e-9))))
    normal = (below(F.col("n") - 0.5) + below(F.col("n") + 0.5)) / 2
    level = sum(F.when(F.col("pofs") > 100 - 100 * p, 1).when(F.col("pofs") < 100 * p, -1).otherwise(0) for p in pm.P_LEVELS)
    p = F.least(F.col("pofs"), 100 - F.col("pofs")) / 100
    flags = {
        "n_ok": F.col("n") == F.col("exact_n"),
        "mean_ok": F.abs(F.col("mean") - F.col("exact_mean")) <= error * F.col("exact_sd") + 1e-9,
        "sd_ok": F.abs(F.col("sd") - F.col("exact_sd")) <= 1.5 * error * F.col("exact_sd") + 1e-9,
        "pofs_ok": (F.col("exact_sd") < 1) | (F.abs(F.col("pofs") - normal) <= 50 * error + 3),
        "level_ok": F.col("level") == level,
        "p_ok": F.abs(pm.pofs_to_p("pofs") - p) < 1e-9,
        "z_ok": F.col("z").isNull() | (F.abs(F.col("z") * F.col("sd") - (F.col("n") - F.col("mean"))) < 1e-6),
    }
    return j.select(*keys, F.col("exact_n").alias("n"), "exact_mean", "exact_sd", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])


_FLAGS = ("n_ok", "mean_ok", "sd_ok", "pofs_ok", "level_ok", "p_ok", "z_ok")
_FULL_COLUMNS = "a1:s a2:s n:i exact_mean:f exact_sd:f " + " ".join(f"{f}:b" for f in _FLAGS)


def _moments_sql(source: str, by: str = "") -> str:
    """Exact moments of the null over all cells of ``source`` (by, a1, a2, const), every flag true."""
    b, on = (f"{by}, ", f"x.{by} = y.{by} AND ") if by else ("", "")
    return with_ctes(
        "", f"SELECT {b}a1, a2, n, coalesce(mean, 0) AS exact_mean, coalesce(sd, 0) AS exact_sd, {', '.join(f'true AS {f}' for f in _FLAGS)} FROM obs LEFT JOIN g USING ({b}a1, a2)",
        base=source, obs=perm_ctes("const", by=by)["obs"],
        g=f"SELECT {b}a1, a2, sum(r * c / w) AS mean, sqrt(sum(CASE WHEN w > 1 THEN r * c * (w - r) * (w - c) / (w * w * (w - 1)) ELSE 0 END)) AS sd FROM ("
          f"SELECT {f'x.{by}, ' if by else ''}x.a1, y.a2, x.n::DOUBLE AS r, y.n::DOUBLE AS c, z.n::DOUBLE AS w FROM (SELECT {b}const, a1, count(*) AS n FROM base GROUP BY ALL) x "
          f"JOIN (SELECT {b}const, a2, count(*) AS n FROM base GROUP BY ALL) y ON {on}x.const = y.const "
          f"JOIN (SELECT {b}const, count(*) AS n FROM base GROUP BY ALL) z ON {on.replace('y.', 'z.')}z.const = x.const) GROUP BY {b}a1, a2")


def _full(df, by=()):
    """Enrichment with ``FULL`` draws from the margins."""
    drawn = pm.permute_counts_by_margins(df, "a1", "a2", "const", FULL, by)
    return pm.enrichment(df, drawn, "a1", "a2", FULL, by)


@query("enrichment_full", "N1 N2 N3 N4 N5 N7", _FULL_COLUMNS, _moments_sql(_BASE))
def enrichment_full(spark, sf):
    base = _base(spark, sf)
    return _near_exact(_full(base), pm.exact_moments(base, "a1", "a2", "const"))


_SCOPES = f"SELECT 'within' AS scope, id, a1, a2, const FROM ({_BASE}) p UNION ALL SELECT 'across', id, a1, a2, 0 FROM ({_BASE}) q"


@query("shuffle_scope_full", "N9", "scope:s " + _FULL_COLUMNS, _moments_sql(_SCOPES, "scope"))
def shuffle_scope_full(spark, sf):
    scopes = F.explode(F.array(F.struct(F.lit("within").alias("scope"), F.col("const")), F.struct(F.lit("across").alias("scope"), F.lit(0).cast("bigint").alias("const"))))
    both = _base(spark, sf).select(scopes.alias("s"), "a1", "a2").select("s.*", "a1", "a2")
    return _near_exact(_full(both, ["scope"]), pm.exact_moments(both, "a1", "a2", "const", ["scope"]), ["scope"])


#: Ten attributes of an order, as SQL that both engines read; each is a view over all orders and over the dear ones.
VIEW_ATTRIBUTES = {
    "priority": "o_orderpriority", "customer6": "o_custkey % 6", "customer10": "o_custkey % 10", "customer3": "o_custkey % 3", "year": "year(o_orderdate)",
    "month": "month(o_orderdate)", "quarter": "quarter(o_orderdate)", "band": "CAST(floor(o_totalprice / 60000) AS INT)", "order7": "o_orderkey % 7", "day": "day(o_orderdate) % 5",
}
_DEAR = "o_totalprice > 150000"


@query("enrichment_views_full", "N8", "view:s " + _FULL_COLUMNS, _moments_sql(" UNION ALL ".join(
    f"SELECT '{name}{tag}' AS view, o_orderkey AS id, CAST({sql} AS VARCHAR) AS a1, o_orderstatus AS a2, CAST(o_custkey % 4 AS VARCHAR) AS const FROM orders WHERE {where}"
    for name, sql in VIEW_ATTRIBUTES.items() for tag, where in (("", "true"), ("_dear", _DEAR))), "view"))
def enrichment_views_full(spark, sf):
    """Twenty views in one pass: rows are folded to margins once, whatever the number of draws."""
    o = src.read_table(spark, sf, "orders")
    o = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a2"), (F.col("o_custkey") % 4).alias("c4"), F.expr(_DEAR).alias("dear"),
                 *[F.expr(sql).alias(name) for name, sql in VIEW_ATTRIBUTES.items()])
    views = {f"{name}{tag}": (name, ["c4"], where) for name in VIEW_ATTRIBUTES for tag, where in (("", None), ("_dear", F.col("dear")))}
    v = pm.stack_views(o, "id", "a2", views)
    return _near_exact(_full(v, ["view"]), pm.exact_moments(v, "a1", "a2", "const", ["view"]), ["view"])


@query("tuning_enrichment_full", "N11", "view:s " + _FULL_COLUMNS, _moments_sql(_TUNE, "view"))
def tuning_enrichment_full(spark, sf):
    o = src.read_table(spark, sf, "orders")
    flags = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a2"),
                     F.when(F.col("o_totalprice") > 300000, "signif").otherwise("ns").alias("price"),
                     F.when(F.col("o_custkey") % 5 == 0, "signif").otherwise("ns").alias("cust"))
    v = pm.stack_views(flags, "id", "a2", {"price": ("price", [], None), "cust": ("cust", [], None)})
    return _near_exact(_full(v, ["view"]), pm.exact_moments(v, "a1", "a2", "const", ["view"]), ["view"])


@query("enrichment_summary_full", "N6 N10 A10", "a2:s cells:i rows:i si_ok:b amp_ok:b", with_ctes(
    "", "SELECT a2, count(*) AS cells, sum(n) AS rows, true AS si_ok, true AS amp_ok FROM obs WHERE a1 IN (SELECT a1 FROM obs GROUP BY a1 HAVING sum(n) > 100) GROUP BY a2",
    base=_BASE, obs=perm_ctes("const")["obs"]))
def enrichment_summary_full(spark, sf):
    """Separation index and mean amplitude of z of the large groups, against those of the exact moments."""
    base = _base(spark, sf)
    drawn = pm.presel(_full(base), "a1", 100)
    exact = pm.exact_moments(base, "a1", "a2", "const").withColumn("exact_z", pm.enrichment_z("n", "mean", "sd")).select("a1", "a2", "exact_z")
    si = pm.separation_index(drawn, "a2")
    amp = drawn.join(exact, ["a1", "a2"]).groupBy("a2").agg(
        F.count("*").alias("cells"), F.sum("n").alias("rows"), F.avg(F.abs("z")).alias("amp"), F.avg(F.abs("exact_z")).alias("exact_amp"))
    return amp.join(si, "a2").select("a2", "cells", "rows", F.col("si").between(0, 1).alias("si_ok"), (F.abs(F.col("amp") - F.col("exact_amp")) <= 0.25 + 0.2 * F.col("exact_amp")).alias("amp_ok"))
