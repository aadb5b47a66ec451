"""Statistical test and correlation queries (T)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import normal_tails_sql
from ..operators import slopes, trains
from ..operators import stats as st
from ..sources import tables as src
from .registry import query
from .sources_filters import units
from .sqltext import with_ctes


def _lineitem(spark, sf):
    return src.read_table(spark, sf, "lineitem")


@query("pearson", "T1", "l_returnflag:s r:f n:i", "SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1")
def pearson(spark, sf):
    return st.pearson(_lineitem(spark, sf), "l_returnflag", "l_quantity", "l_extendedprice")


_CUST = "SELECT c_mktsegment AS seg, round(c_acctbal / 50) AS x, coalesce(n, 0) AS y FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"


def _cust(spark, sf):
    o = src.read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return src.read_table(spark, sf, "customer").join(o, "c_custkey", "left").select(
        F.col("c_mktsegment").alias("seg"), F.round(F.col("c_acctbal") / 50).alias("x"), F.coalesce("n", F.lit(0)).alias("y"))


_KENDALL_P = (  # from rows c(k, id, x, y): tau-b and its tie-corrected two-sided p for each k
    "p AS (SELECT a.k, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM c a JOIN c b ON a.k = b.k AND a.id < b.id), "
    "s AS (SELECT k, sum(sx * sy)::DOUBLE AS s, sum(abs(sx))::DOUBLE AS dx, sum(abs(sy))::DOUBLE AS dy FROM p GROUP BY k), "
    "m AS (SELECT k, count(*)::DOUBLE AS n FROM c GROUP BY k), "
    "tx AS (SELECT k, sum(t * (t - 1)) AS a, sum(t * (t - 1) * (2 * t + 5)) AS v, sum(t * (t - 1) * (t - 2)) AS w FROM (SELECT k, x, count(*)::DOUBLE AS t FROM c GROUP BY ALL) GROUP BY k), "
    "ty AS (SELECT k, sum(t * (t - 1)) AS a, sum(t * (t - 1) * (2 * t + 5)) AS v, sum(t * (t - 1) * (t - 2)) AS w FROM (SELECT k, y, count(*)::DOUBLE AS t FROM c GROUP BY ALL) GROUP BY k), "
    "z AS (SELECT k, n, s / nullif(sqrt(dx * dy), 0) AS tau, s / nullif(sqrt((n * (n - 1) * (2 * n + 5) - tx.v - ty.v) / 18 + tx.a * ty.a / (2 * n * (n - 1)) + coalesce(tx.w * ty.w / nullif(9 * n * (n - 1) * (n - 2), 0), 0)), 0) AS z "
    "FROM s JOIN m USING (k) JOIN tx USING (k) JOIN ty USING (k))")


@query("kendall_tau", "T2", "seg:s tau:f n:i p:f", (
    f"WITH c AS (SELECT seg AS k, x, y, row_number() OVER () AS id FROM ({_CUST})), {_KENDALL_P} SELECT k AS seg, tau, n, {normal_tails_sql('z')} AS p FROM z"))
def kendall_tau(spark, sf):
    return st.kendall_tau(_cust(spark, sf), "seg", "x", "y")


@query("spearman", "T3", "seg:s rho:f n:i", (
    "SELECT seg, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT seg, rank() OVER (PARTITION BY seg ORDER BY x) + (count(*) OVER (PARTITION BY seg, x) - 1) / 2 AS rx, "
    f"rank() OVER (PARTITION BY seg ORDER BY y) + (count(*) OVER (PARTITION BY seg, y) - 1) / 2 AS ry FROM ({_CUST})) GROUP BY seg"))
def spearman(spark, sf):
    return st.spearman(_cust(spark, sf), "seg", "x", "y")


@query("corr_matrix", "T4", "cat_a:s cat_b:s r:f n:i", with_ctes(
    "units", "SELECT a.seg AS cat_a, b.seg AS cat_b, corr(a.v, b.v) AS r, count(*) AS n FROM g a JOIN g b ON a.area = b.area AND a.seg < b.seg GROUP BY ALL",
    g="SELECT area, seg, avg(bal) AS v FROM units GROUP BY ALL"))
def corr_matrix(spark, sf):
    g = units(spark, sf).groupBy("area", "seg").agg(F.avg("bal").alias("v"))
    return st.corr_matrix(g, "area", "seg", "v")


@query("corr_matrix_kendall", "T4", "cat_a:s cat_b:s tau:f n:i p:f", with_ctes(
    "units", f"SELECT k[1] AS cat_a, k[2] AS cat_b, tau, n, {normal_tails_sql('z')} AS p FROM (WITH {_KENDALL_P} SELECT * FROM z)",
    g="SELECT area, seg, avg(bal) AS v FROM units GROUP BY ALL",
    c="SELECT [a.seg, b.seg] AS k, a.area AS id, a.v AS x, b.v AS y FROM g a JOIN g b ON a.area = b.area AND a.seg < b.seg"))
def corr_matrix_kendall(spark, sf):
    g = units(spark, sf).groupBy("area", "seg").agg(F.avg("bal").alias("v"))
    return st.corr_matrix(g, "area", "seg", "v", method="kendall")


@query("linregress", "T5", "l_returnflag:s slope:f intercept:f r:f",
       "SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, corr(l_extendedprice, l_quantity) AS r FROM lineitem GROUP BY 1")
def linregress(spark, sf):
    return st.linregress(_lineitem(spark, sf), "l_returnflag", "l_quantity", "l_extendedprice")


_SUP = "SELECT s_acctbal AS x, q AS y FROM supplier JOIN (SELECT l_suppkey, avg(l_extendedprice) AS q FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey"


@query("theil_sen", "T6", "slope:f intercept:f", (
    f"WITH p AS ({_SUP}), m AS (SELECT quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM p a JOIN p b ON a.x < b.x) "
    "SELECT slope, (SELECT quantile_cont(y, 0.5) FROM p) - slope * (SELECT quantile_cont(x, 0.5) FROM p) AS intercept FROM m"))
def theil_sen(spark, sf):
    q = _lineitem(spark, sf).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_extendedprice").alias("y"))
    return slopes.theil_sen(src.read_table(spark, sf, "supplier").join(q, "s_suppkey").withColumnRenamed("s_acctbal", "x"), "x", "y")


@query("mann_whitney", "T7", "lang:s n_a:i n_b:i u:f auc:f", (
    "SELECT lang, n_a, n_b, s - n_a * (n_a + 1) / 2 AS u, (s - n_a * (n_a + 1) / 2) / nullif(n_a * n_b, 0) AS auc FROM (SELECT lang, count(*) FILTER (WHERE quality = 1) AS n_a, "
    "count(*) FILTER (WHERE quality <> 1) AS n_b, sum(r) FILTER (WHERE quality = 1) AS s FROM (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + "
    "(count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id)) GROUP BY lang)"))
def mann_whitney(spark, sf):
    d = src.read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(src.read_table(spark, sf, "labels"), "doc_id")
    return st.mann_whitney(d, "lang", "n_chars", "quality", 1)


CP_REPS = 10
_CP = {
    "trials": "SELECT recid, win_id, recid || '|' || (CAST(floor(t / 86400) AS BIGINT) % 3) AS cond, amp > 12 AS lab, t - 21600 AS t0, t + 21600 AS t1 FROM trg WHERE recid = recid",
    "counts": "SELECT g.uid, g.win_id, g.cond, g.recid, count(e.eid) AS n FROM (SELECT uid, t.* FROM (SELECT DISTINCT recid, uid FROM ev) u JOIN trials t USING (recid)) g "
              "LEFT JOIN ev e ON e.recid = g.recid AND e.uid = g.uid AND e.t BETWEEN g.t0 AND g.t1 GROUP BY ALL",
    "cn": "SELECT cond, any_value(recid) AS recid, count(*) FILTER (WHERE lab) AS na, count(*) FILTER (WHERE NOT lab) AS nb FROM trials GROUP BY cond HAVING count(*) FILTER (WHERE lab) > 0 AND count(*) FILTER (WHERE NOT lab) > 0",
    "rk": "SELECT uid, recid, win_id, cond, rank() OVER (PARTITION BY uid, cond ORDER BY n) + (count(*) OVER (PARTITION BY uid, cond, n) - 1) / 2 AS r FROM counts WHERE cond IN (SELECT cond FROM cn)",
    "pos": "SELECT win_id, cond, lab, row_number() OVER (PARTITION BY cond ORDER BY md5('pos_' || win_id), win_id) AS k FROM trials",
    "lb": f"SELECT cond, rep, lab, row_number() OVER (PARTITION BY cond, rep ORDER BY md5('lab_' || rep || '_' || win_id), win_id) AS k FROM trials CROSS JOIN (SELECT unnest(range(1, {CP_REPS + 1})) AS rep)",
    "pick": "SELECT 0 AS rep, win_id FROM trials WHERE lab UNION ALL SELECT rep, win_id FROM pos JOIN lb USING (cond, k) WHERE lb.lab",
    "nn": "SELECT recid, sum(na * (na + 1) / 2) AS o, sum(na * nb) AS d FROM cn GROUP BY recid",
    "cp": "SELECT recid, uid, rep, (s - o) / d AS c FROM (SELECT recid, uid, rep, sum(r) AS s FROM rk JOIN pick USING (win_id) GROUP BY ALL) JOIN nn USING (recid)",
    "ob": "SELECT recid, uid, c AS obs FROM cp WHERE rep = 0",
    "pv": f"SELECT recid, uid, any_value(obs) AS c, count(*) FILTER (WHERE obs <= c) / {CP_REPS}.0 AS p FROM cp JOIN ob USING (recid, uid) WHERE rep > 0 GROUP BY recid, uid",
}


@query("cccp", "T8", "recid:i uid:i cccp:p p:p pref:i", with_ctes(
    "ev trg", "SELECT recid, uid, CASE WHEN c < 0.5 THEN 1 - c ELSE c END AS cccp, CASE WHEN c < 0.5 THEN 1 - p ELSE p END AS p, CASE WHEN c < 0.5 THEN -1 ELSE 1 END AS pref FROM pv", **_CP))
def cccp(spark, sf):
    ev, trg = src.event_rows(spark, sf), src.triggers(spark, sf)
    cond = F.concat_ws("|", F.col("recid").cast("string"), (F.floor(F.col("t") / 86400) % 3).cast("string"))
    trials = trg.select("recid", "win_id", cond.alias("cond"), (F.col("amp") > 12).alias("lab"), (F.col("t") - 21600).alias("t0"), (F.col("t") + 21600).alias("t1"))
    counts = trains.window_counts(ev, trials, bucket=43200.0)
    return st.choice_probability(counts, trials, ["recid", "uid"], "win_id", "cond", "lab", "n", CP_REPS, group="recid")


_WILCOXON = (
    "WITH d AS (SELECT l_suppkey, l_quantity - l_linenumber * 6 AS d FROM lineitem WHERE l_quantity - l_linenumber * 6 <> 0), "
    "r AS (SELECT l_suppkey, d, rank() OVER (PARTITION BY l_suppkey ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_suppkey, abs(d)) - 1) / 2 AS r FROM d), "
    "t AS (SELECT l_suppkey, sum(pow(c, 3) - c) AS t FROM (SELECT l_suppkey, abs(d) AS a, count(*) AS c FROM d GROUP BY ALL) GROUP BY 1), "
    "g AS (SELECT l_suppkey, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r GROUP BY 1) "
    "SELECT l_suppkey, n, w, (w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - t / 2) / 24) AS z FROM g JOIN t USING (l_suppkey)")


_CP_SHARED = {
    "trials": "SELECT recid, row_number() OVER (PARTITION BY recid ORDER BY win_id) AS win_id, CAST(floor(t / 86400) AS BIGINT) % 3 AS cond, amp > 12 AS lab, t - 21600 AS t0, t + 21600 AS t1 FROM trg WHERE recid = recid",
    "counts": _CP["counts"],
    "cn": _CP["cn"].replace("SELECT cond, any_value(recid) AS recid,", "SELECT recid, cond,").replace("GROUP BY cond", "GROUP BY recid, cond"),
    "rk": "SELECT uid, recid, win_id, cond, rank() OVER (PARTITION BY recid, uid, cond ORDER BY n) + (count(*) OVER (PARTITION BY recid, uid, cond, n) - 1) / 2 AS r FROM counts SEMI JOIN cn USING (recid, cond)",
    "used": "SELECT * FROM trials SEMI JOIN cn USING (recid, cond)",
    "pos": "SELECT recid, win_id, cond, lab, row_number() OVER (PARTITION BY recid, cond ORDER BY md5('pos_' || win_id), win_id) AS k FROM used",
    "lb": f"SELECT recid, cond, rep, lab, row_number() OVER (PARTITION BY recid, cond, rep ORDER BY md5('lab_' || rep || '_' || win_id), win_id) AS k FROM used CROSS JOIN (SELECT unnest(range(1, {CP_REPS + 1})) AS rep)",
    "pick": "SELECT 0 AS rep, recid, win_id FROM used WHERE lab UNION ALL SELECT rep, recid, win_id FROM pos JOIN lb USING (recid, cond, k) WHERE lb.lab",
    "nn": _CP["nn"],
    "cp": "SELECT recid, uid, rep, (s - o) / d AS c FROM (SELECT recid, uid, rep, sum(r) AS s FROM rk JOIN pick USING (recid, win_id) GROUP BY ALL) JOIN nn USING (recid)",
    "ob": _CP["ob"], "pv": _CP["pv"],
}


@query("cccp_shared_names", "T8", "recid:i uid:i cccp:p p:p pref:i", with_ctes(
    "ev trg", "SELECT recid, uid, CASE WHEN c < 0.5 THEN 1 - c ELSE c END AS cccp, CASE WHEN c < 0.5 THEN 1 - p ELSE p END AS p, CASE WHEN c < 0.5 THEN -1 ELSE 1 END AS pref FROM pv", **_CP_SHARED))
def cccp_shared_names(spark, sf):
    """Recordings share condition names and trial numbers."""
    ev, trg = src.event_rows(spark, sf), src.triggers(spark, sf)
    number = F.row_number().over(Window.partitionBy("recid").orderBy("win_id")).cast("bigint")
    trials = trg.select("recid", number.alias("win_id"), (F.floor(F.col("t") / 86400) % 3).alias("cond"), (F.col("amp") > 12).alias("lab"), (F.col("t") - 21600).alias("t0"), (F.col("t") + 21600).alias("t1"))
    counts = trains.window_counts(ev, trials, bucket=43200.0)
    return st.choice_probability(counts, trials, ["recid", "uid"], "win_id", "cond", "lab", "n", CP_REPS, group="recid")


@query("theil_sen_close_x", "T6", "slope:f intercept:f", (
    "WITH p AS (SELECT s_suppkey // 2 + (s_suppkey % 2) * 1e-9 AS x, s_acctbal / 1000 AS y FROM supplier), m AS (SELECT quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM p a JOIN p b ON a.x < b.x) "
    "SELECT slope, (SELECT quantile_cont(y, 0.5) FROM p) - slope * (SELECT quantile_cont(x, 0.5) FROM p) AS intercept FROM m"))
def theil_sen_close_x(spark, sf):
    s = src.read_table(spark, sf, "supplier")
    return slopes.theil_sen(s.select(F.expr("s_suppkey div 2 + (s_suppkey % 2) * 1e-9D").alias("x"), (F.col("s_acctbal") / 1000).alias("y")), "x", "y")


@query("wilcoxon", "T9", "l_suppkey:i n:i w:f z:f p:f", f"SELECT *, {normal_tails_sql('z')} AS p FROM ({_WILCOXON})")
def wilcoxon(spark, sf):
    return st.wilcoxon(_lineitem(spark, sf).withColumn("base", F.col("l_linenumber") * 6.0), "l_suppkey", "base", "l_quantity")


@query("wilcoxon_fdr", "T10", "l_suppkey:i p:f p_adj:f", (
    f"WITH w AS (SELECT l_suppkey, {normal_tails_sql('z')} AS p FROM ({_WILCOXON})), q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, l_suppkey DESC) AS q FROM w) "
    "SELECT l_suppkey, p, least(1, min(q) OVER (ORDER BY p DESC, l_suppkey ROWS UNBOUNDED PRECEDING)) AS p_adj FROM q"))
def wilcoxon_fdr(spark, sf):
    w = wilcoxon(spark, sf).select("l_suppkey", "p").withColumn("fam", F.lit(1))
    return st.fdr(w, "fam", "p", "l_suppkey")


@query("fdr_null_family", "T10", "id:i fam:s p_adj:f", (
    "WITH pp AS (SELECT o_orderkey AS id, nullif(o_orderstatus, 'P') AS fam, pow((o_totalprice % 1000) / 1000, 3) AS p FROM orders), "
    "q AS (SELECT *, p * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p, id DESC) AS q FROM pp) "
    "SELECT id, fam, least(1, min(q) OVER (PARTITION BY fam ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)) AS p_adj FROM q"))
def fdr_null_family(spark, sf):
    o = src.read_table(spark, sf, "orders")
    p = o.select(F.col("o_orderkey").alias("id"), F.nullif("o_orderstatus", F.lit("P")).alias("fam"), F.pow((F.col("o_totalprice") % 1000) / 1000, F.lit(3)).alias("p"))
    return st.fdr(p, "fam", "p", "id")


_P = "SELECT o_orderkey AS id, o_orderpriority AS fam, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 2000 THEN NULL ELSE pow((o_totalprice % 1000) / 1000, 3) END AS p FROM orders"


def _adj(factor: str) -> str:
    return ("SELECT id, fam, p, CASE WHEN bool_and(p IS NOT NULL) OVER (PARTITION BY fam) THEN least(1, min(q) OVER (PARTITION BY fam ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)) END AS a "
            f"FROM (SELECT *, p * n / i{factor} AS q FROM (SELECT *, count(*) OVER (PARTITION BY fam) AS n, row_number() OVER (PARTITION BY fam ORDER BY p, id DESC) AS i FROM pp))")


@query("fdr_bh", "T10", "id:i fam:s p_bh:f p_by:f", with_ctes(
    "", "SELECT id, fam, b.a AS p_bh, y.a AS p_by FROM bh b JOIN fby y USING (id, fam)", pp=_P, bh=_adj(""), h="SELECT fam, sum(1.0::DOUBLE / i) AS h FROM (SELECT fam, row_number() OVER (PARTITION BY fam) AS i FROM pp) GROUP BY fam",
    fby=_adj(" * (SELECT h FROM h WHERE h.fam = x.fam)").replace("FROM pp))", "FROM pp) x)")))
def fdr_bh(spark, sf):
    o = src.read_table(spark, sf, "orders")
    p = F.pow((F.col("o_totalprice") % 1000) / 1000, F.lit(3))
    pp = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("fam"),
                  F.when(~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") < 2000)), p).alias("p"))
    bh = st.fdr(pp, "fam", "p", "id", "bh").select("id", "fam", F.col("p_adj").alias("p_bh"))
    return bh.join(st.fdr(pp, "fam", "p", "id", "by").select("id", F.col("p_adj").alias("p_by")), "id")


@query("tuning_signif", "T11", "id:i signif:b",
       "SELECT o_orderkey AS id, CASE WHEN c IS NOT NULL THEN (p <= 0.4 AND pn <= 0.6 AND o_orderkey % 3 = o_custkey % 3 AND c >= 0.52) END AS signif FROM ("
       "SELECT *, (o_totalprice % 100) / 100 AS p, (o_totalprice % 10) / 10 AS pn, CASE WHEN o_orderstatus <> 'P' THEN (o_totalprice % 1000) / 1000 END AS c FROM orders)")
def tuning_signif(spark, sf):
    o = src.read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), ((F.col("o_totalprice") % 100) / 100).alias("p"), ((F.col("o_totalprice") % 10) / 10).alias("pn"),
        (F.col("o_orderkey") % 3).alias("pref"), (F.col("o_custkey") % 3).alias("prefn"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_totalprice") % 1000) / 1000).alias("c"))
    return o.withColumn("signif", st.tuning_significance("p", "pn", "pref", "prefn", "c", 0.4, 0.6, 0.52))


@query("condition_ids", "T12", "id:i cond_id:i",
       "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 400000 THEN -1 ELSE dense_rank() OVER (ORDER BY o_orderpriority, o_orderstatus) END AS cond_id FROM orders")
def condition_ids(spark, sf):
    o = src.read_table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    return st.condition_ids(o, ["o_orderpriority", "o_orderstatus"], F.col("o_totalprice") > 400000)


_TRIALS = ("SELECT event_id AS id, CASE WHEN event_type = 'click' THEN value END AS cl, CASE WHEN event_type <> 'click' AND event_type <> 'error' THEN value END AS cr, "
           "CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS choice, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS fb FROM events")


@query("trial_derive", "T13", "id:i side:i contrast:f consistent:b",
       f"SELECT id, side, contrast, (side = choice) = (fb = 1) AS consistent FROM (SELECT *, CASE WHEN cl IS NOT NULL THEN -1 WHEN cr IS NOT NULL THEN 1 END AS side, coalesce(cl, cr) AS contrast FROM ({_TRIALS}))")
def trial_derive(spark, sf):
    e = src.event_rows(spark, sf)
    t = e.select(F.col("eid").alias("id"), F.when(F.col("kind") == "click", F.col("value")).alias("cl"),
                 F.when(~F.col("kind").isin("click", "error"), F.col("value")).alias("cr"),
                 F.when(F.col("eid") % 2 == 0, 1).otherwise(-1).alias("choice"), F.when(F.col("uid") % 2 == 0, 1).otherwise(-1).alias("fb"))
    return st.derive_trials(t, "cl", "cr", "choice", "fb")


@query("trial_windows", "T14", "eid:i variable:s t0:f t1:f", with_ctes(
    "ev", "SELECT eid, 'stim' AS variable, t AS t0, t + 0.1 AS t1 FROM ev WHERE rt BETWEEN 0.08 AND 2 UNION ALL SELECT eid, 'choice', m - 0.1, m FROM ev WHERE rt BETWEEN 0.08 AND 2".replace(
        "FROM ev", "FROM x"), x="SELECT *, t + value / 20 AS m, (t + value / 20) - t AS rt FROM ev"))
def trial_windows(spark, sf):
    e = src.event_rows(spark, sf).withColumn("m", F.col("t") + F.col("value") / 20)
    return st.trial_windows(e, "t", "m", {"stim": ("t", 0.0, 0.1), "choice": ("m", -0.1, 0.0)})


@query("within_group_contrast", "T15", "effect:f n_groups:i n:i",
       "SELECT sum(xd * yd) / sum(xd * xd) AS effect, count(DISTINCT l_suppkey) AS n_groups, count(*) AS n FROM (SELECT l_suppkey, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS xd, "
       "l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS yd FROM lineitem)")
def within_group_contrast(spark, sf):
    return st.within_group_contrast(_lineitem(spark, sf), "l_extendedprice", "l_quantity", "l_suppkey")


# ---- choice probability at full size: three variables, three sets of conditions, 2000 shuffles

FULL_SHUFFLES = 2000
#: What a trial is labelled by, and what its condition is, as SQL that both engines read (d: day of the trigger).
CP_VARIABLES = {"amplitude": "amp > 12", "afternoon": "t - floor(t / 86400) * 86400 >= 43200", "parity": "win_id % 2 = 0"}
CP_SETS = {"day": "CAST(floor(t / 86400) AS BIGINT) % 3", "half": "CAST(floor(t / 1296000) AS BIGINT)", "none": "CAST(0 AS BIGINT)"}
_CP_FULL = {
    "trials": " UNION ALL ".join(f"SELECT recid, win_id, '{v}' AS variable, '{c}' AS cset, {cond} AS cond, {lab} AS lab, t - 21600 AS t0, t + 21600 AS t1 FROM trg"
                                 for v, lab in CP_VARIABLES.items() for c, cond in CP_SETS.items()),
    "counts": "SELECT u.uid, t.recid, t.win_id, count(e.eid) AS n FROM (SELECT DISTINCT recid, uid FROM ev) u JOIN (SELECT DISTINCT recid, win_id, t0, t1 FROM trials) t USING (recid) "
              "LEFT JOIN ev e ON e.recid = t.recid AND e.uid = u.uid AND e.t BETWEEN t.t0 AND t.t1 GROUP BY ALL",
    "cn": "SELECT recid, variable, cset, cond, count(*) FILTER (WHERE lab) AS na, count(*) FILTER (WHERE NOT lab) AS nb FROM trials GROUP BY ALL HAVING count(*) FILTER (WHERE lab) > 0 AND count(*) FILTER (WHERE NOT lab) > 0",
    "rk": "SELECT uid, recid, variable, cset, lab, rank() OVER w + (count(*) OVER (PARTITION BY recid, uid, variable, cset, cond, n) - 1) / 2 AS r FROM counts JOIN trials USING (recid, win_id) SEMI JOIN cn USING (recid, variable, cset, cond) "
          "WINDOW w AS (PARTITION BY recid, uid, variable, cset, cond ORDER BY n)",
    "nn": "SELECT recid, variable, cset, sum(na * (na + 1) / 2) AS o, sum(na * nb) AS d FROM cn GROUP BY ALL",
    "ob": "SELECT recid, uid, variable, cset, count(*) AS n_trials, (sum(r) FILTER (WHERE lab) - any_value(o)) / any_value(d) AS c FROM rk JOIN nn USING (recid, variable, cset) GROUP BY ALL",
}


def choice_trials(trg):
    """Trials of every variable and condition set: (recid, variable, cset, win_id, cond, lab)."""
    both = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(c).alias("cset"), F.expr(cond).alias("cond"), F.expr(lab).alias("lab"))
                               for v, lab in CP_VARIABLES.items() for c, cond in CP_SETS.items()]))
    return trg.select("recid", "win_id", both.alias("x")).select("recid", "win_id", "x.*")


@query("cccp_full", "T8", "recid:i uid:i variable:s cset:s n_trials:i cccp:p pref:i p_ok:b", with_ctes(
    "ev trg", "SELECT recid, uid, variable, cset, n_trials, CASE WHEN c < 0.5 THEN 1 - c ELSE c END AS cccp, CASE WHEN c < 0.5 THEN -1 ELSE 1 END AS pref, true AS p_ok FROM ob", **_CP_FULL))
def cccp_full(spark, sf):
    """All variables and condition sets in one run. ``p_ok``: p is a multiple of one shuffle between 0 and 1, and near what
    the observed probability allows: below a half where the probability lies clearly above it, for many trials."""
    ev, trg = src.event_rows(spark, sf), src.triggers(spark, sf)
    spans = trg.select("recid", "win_id", (F.col("t") - 21600).alias("t0"), (F.col("t") + 21600).alias("t1"))
    counts = trains.window_counts(ev, spans, bucket=43200.0).select("recid", "uid", "win_id", "n").where("recid IS NOT NULL")
    trials = choice_trials(trg)
    keys = ["recid", "variable", "cset"]
    out = st.choice_probability_matrix(counts, trials, ["recid", "uid", "variable", "cset"], "win_id", "cond", "lab", "n", FULL_SHUFFLES, group=keys)
    whole = F.abs(F.col("p") * FULL_SHUFFLES - F.round(F.col("p") * FULL_SHUFFLES)) < 1e-6
    clear = (F.col("cccp") < 0.75) | (F.col("n_trials") < 100) | (F.col("p") < 0.05)
    return out.withColumn("p_ok", F.col("p").between(0, 1) & whole & clear)


@query("tuning_signif_full", "T11", "variable:s units:i tuned_ok:b", with_ctes(
    "ev trg", "SELECT variable, count(DISTINCT (recid, uid)) AS units, true AS tuned_ok FROM ob WHERE cset = 'none' GROUP BY variable", **_CP_FULL))
def tuning_signif_full(spark, sf):
    """Significance from the shuffles: conditions by day against no conditions; no more units are tuned than pass either level."""
    ev, trg = src.event_rows(spark, sf), src.triggers(spark, sf)
    spans = trg.select("recid", "win_id", (F.col("t") - 21600).alias("t0"), (F.col("t") + 21600).alias("t1"))
    trials = choice_trials(trg).where("cset IN ('day', 'none')")
    counts = trains.window_counts(ev, spans, bucket=43200.0).select("recid", "uid", "win_id", "n").where("recid IS NOT NULL")
    keys = ["recid", "variable", "cset"]
    cp = st.choice_probability_matrix(counts, trials, ["recid", "uid", "variable", "cset"], "win_id", "cond", "lab", "n", FULL_SHUFFLES, group=keys)
    day = cp.where("cset = 'day'").select("recid", "uid", "variable", "cccp", "p", "pref")
    none = cp.where("cset = 'none'").select("recid", "uid", "variable", F.col("p").alias("p0"), F.col("pref").alias("pref0"))
    both = none.join(day, ["recid", "uid", "variable"], "left").withColumn("tuned", st.tuning_significance("p", "p0", "pref", "pref0", "cccp"))
    return both.groupBy("variable").agg(
        F.count("*").alias("units"), (F.count(F.when(F.col("tuned"), 1)) <= F.count(F.when((F.col("p") <= 0.05) & (F.col("p0") <= 0.001), 1))).alias("tuned_ok"))
