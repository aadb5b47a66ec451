"""Feature, map and clustering queries (M)."""

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import labels
from ..operators.scan import percentile_columns
from ..sources import tables as src
from .registry import query
from .sources_filters import units
from .sqltext import with_ctes

DIM = 64


def _emb(spark, sf):
    return ft.as_vectors(src.read_table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec")), "vec")


# 64-d vectors as double lists, label centroids as prototypes (node = order of the label)
M_CTES = {
    "emb": "SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings",
    "cells": f"SELECT vec_id, label, d, e[d] AS v FROM (SELECT vec_id, label, e, unnest(range(1, {DIM + 1})) AS d FROM emb)",
    "proto": "SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS node, list(v ORDER BY d) AS w FROM (SELECT label, d, avg(v) AS v FROM cells GROUP BY ALL) GROUP BY label",
    "dist": "SELECT vec_id, emb.label, node, list_distance(e, w) AS d FROM emb CROSS JOIN proto",
    "best": "SELECT vec_id, label, node, d, second FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, node) AS r, lead(node) OVER (PARTITION BY vec_id ORDER BY d, node) AS second FROM dist) WHERE r = 1",
}


def _prototypes(df):
    return ft.collect_model(ft.group_means(df, "vec", "label", DIM), "label", "vec")


@query("standardize", "M1", "vec_id:i d:i z:f", with_ctes(
    "", "SELECT vec_id, d - 1 AS d, (v - avg(v) OVER (PARTITION BY d)) / stddev_pop(v) OVER (PARTITION BY d) * CASE WHEN d <= 32 THEN 1.0 ELSE 0.5 END AS z FROM cells", **M_CTES))
def standardize(spark, sf):
    s = ft.standardize(_emb(spark, sf), "vec", [1.0] * 32 + [0.5] * 32)
    return s.select("vec_id", F.posexplode("vec").alias("d", "z"))


@query("som_shape", "M2", "cols:i rows:i")
def som_shape(spark, sf):
    e = _emb(spark, sf)
    c, r = ft.som_shape(e, "vec")
    return e.agg(F.lit(c).alias("cols"), F.lit(r).alias("rows"), F.count(F.lit(1)).alias("n")).select("cols", "rows")


SOM_SHAPE = (5, 4)
SOM_FULL, SOM_FULL_ITERS = (20, 20), 200


def _model_rows(spark, w):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(w)], "node int, vec array<double>")


def _trained(spark, sf):
    e = ft.standardize(_emb(spark, sf), "vec")
    return e, ft.som_train(e, "vec", SOM_FULL, SOM_FULL_ITERS)


@query("som_train", "M3", "node:i hits:i qe:f")
def som_train(spark, sf):
    e, w = _trained(spark, sf)
    return ft.bmu(e, "vec", w).groupBy("node").agg(F.count(F.lit(1)).alias("hits"), F.avg("dist").alias("qe"))


@query("som_train_full", "M3", "nodes:i rows:i qe_ok:b te_ok:b u_ok:b", "SELECT 400 AS nodes, count(*) AS rows, true AS qe_ok, true AS te_ok, true AS u_ok FROM embeddings")
def som_train_full(spark, sf):
    """A map of the usual size, 400 nodes and 200 iterations: every row has a node, the rows lie nearer to their nodes than to
    those of the initial plane, and neighbouring nodes lie nearer to each other than nodes do on average."""
    e = ft.standardize(_emb(spark, sf), "vec")
    start = ft.som_init(e, "vec", SOM_FULL)
    w = ft.som_train(e, "vec", SOM_FULL, SOM_FULL_ITERS, init=start)
    grid = ft.hex_distances(SOM_FULL)
    apart = ((w[:, None, :] - w[None, :, :]) ** 2).sum(axis=2) ** 0.5
    ordered = bool(apart[(grid > 0) & (grid < 1.01)].mean() < apart[grid > 0].mean())
    before = ft.bmu(e, "vec", start).agg(F.avg("dist").alias("plane"))
    after = ft.bmu(e, "vec", w).agg(F.count(F.lit(1)).alias("rows"), F.avg("dist").alias("qe"), F.countDistinct("node").alias("used"))
    one = F.lit(1).alias("_one")
    return after.select("*", one).join(before.select("*", one), "_one").select(
        F.lit(len(w)).alias("nodes"), "rows", (F.col("qe") < F.col("plane")).alias("qe_ok"), (F.col("used") > 1).alias("te_ok"), F.lit(ordered).alias("u_ok"))


@query("som_init", "M4", "node:i d:i w:f")
def som_init(spark, sf):
    w = ft.som_init(_emb(spark, sf), "vec", SOM_SHAPE)
    return _model_rows(spark, w).select("node", F.posexplode("vec").alias("d", "w"))


@query("bmu", "M5", "vec_id:i node:i dist:f", with_ctes("", "SELECT vec_id, node, d AS dist FROM best", **M_CTES))
def bmu(spark, sf):
    e = _emb(spark, sf)
    return ft.bmu(e, "vec", _prototypes(e)[1])


@query("som_hits", "M5", "node:i hits:i", with_ctes("", "SELECT node, count(*) AS hits FROM best GROUP BY node", **M_CTES))
def som_hits(spark, sf):
    e = _emb(spark, sf)
    return ft.som_hits(ft.bmu(e, "vec", _prototypes(e)[1]))


@query("pca_scores", "M6", "vec_id:i comp:i score:f")
def pca_scores(spark, sf):
    return ft.pca_scores(_emb(spark, sf), "vec", 0.8).select("vec_id", F.posexplode("scores").alias("comp", "score"))


@query("pca_score_corr", "M7", "pc:s target:s r:f")
def pca_score_corr(spark, sf):
    u = units(spark, sf)
    long = u.groupBy("area", "seg").agg(F.avg("bal").alias("v"))
    s, n = src.read_table(spark, sf, "supplier"), src.read_table(spark, sf, "nation")
    score = s.join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("area")).agg(F.avg("s_acctbal").alias("score"))
    cats = [r[0] for r in u.select("seg").distinct().orderBy("seg").collect()]
    return ft.pca_score_corr(long, "area", "seg", "v", score, "score", cats)


@query("som_errors", "M8", "label:i qe:f te:f n:i", with_ctes(
    "", "SELECT label, avg(d) AS qe, avg(CASE WHEN abs(sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)) - 1) < 1e-4 THEN 0 ELSE 1 END) AS te, count(*) AS n FROM ("
    "SELECT *, node % 5 + 0.5 * ((node // 5) % 2) AS x1, (node // 5) * 0.8660254 AS y1, second % 5 + 0.5 * ((second // 5) % 2) AS x2, (second // 5) * 0.8660254 AS y2 FROM best) GROUP BY label", **M_CTES))
def som_errors(spark, sf):
    e = _emb(spark, sf)
    w = _prototypes(e)[1]
    return ft.som_errors(e, "vec", w, (5, -(-len(w) // 5)), by="label")


@query("som_error_ranks", "M8", "label:i median_qe:f pos:i", with_ctes(
    "", "SELECT label, m AS median_qe, row_number() OVER (ORDER BY m, label) - 1 AS pos FROM (SELECT label, quantile_cont(d, 0.5) AS m FROM best GROUP BY label)", **M_CTES))
def som_error_ranks(spark, sf):
    e = _emb(spark, sf)
    b = ft.bmu(e, "vec", _prototypes(e)[1])
    med = percentile_columns(b, "label", "dist", {"median_qe": 0.5})
    pos = ft.relabel_by_median(b.select("label", "dist"), "label", "dist", "pos").select("label", "pos").distinct()
    return med.join(pos, "label")


def _pc3(spark, sf):
    return ft.pca_scores(_emb(spark, sf), "vec", 0.999999, max_comps=3).select("vec_id", "label", F.col("scores").alias("vec"))


@query("kmeans", "M9", "vec_id:i cluster:i")
def kmeans(spark, sf):
    return ft.kmeans(_emb(spark, sf).drop("label"), "vec", 8, out="cluster")


@query("bisecting", "M10", "k:i label:i n:i")
def bisecting(spark, sf):
    return ft.bisecting(_emb(spark, sf).drop("label"), "vec", range(2, 11)).groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"))


@query("bisecting_cuts", "M10", "k:i labels:i rows:i", "SELECT k, k AS labels, count(*) AS rows FROM embeddings CROSS JOIN (SELECT unnest(range(2, 11)) AS k) GROUP BY k")
def bisecting_cuts(spark, sf):
    """Each of the nine cuts has its number of classes and all rows."""
    return ft.bisecting(_emb(spark, sf).drop("label"), "vec", range(2, 11)).groupBy("k").agg(F.countDistinct("label").alias("labels"), F.count(F.lit(1)).alias("rows"))


@query("bisecting_nested", "M10", "k:i pairs:i rows:i", "SELECT k, k + 1 AS pairs, count(*) AS rows FROM embeddings CROSS JOIN (SELECT unnest(range(2, 10)) AS k) GROUP BY k")
def bisecting_nested(spark, sf):
    """Each cut splits one class of the cut before: k and k + 1 classes meet in k + 1 pairs."""
    t = ft.split_tree(_emb(spark, sf), "vec", 10, out="cuts")
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("cuts")[k - 1].alias("a"), F.col("cuts")[k].alias("b")) for k in range(2, 10)])).alias("s")
    return t.select(steps).select("s.*").groupBy("k").agg(F.countDistinct("a", "b").alias("pairs"), F.count(F.lit(1)).alias("rows"))


@query("node_label", "M11", "vec_id:i node:i cat:s", with_ctes(
    "", "SELECT vec_id, node, CASE WHEN node % 3 = 0 THEN 'a' WHEN node % 3 = 1 THEN 'b' ELSE 'c' END AS cat FROM best", **M_CTES))
def node_label(spark, sf):
    e = _emb(spark, sf)
    _, w = _prototypes(e)
    nodes = spark.range(len(w)).select(F.col("id").cast("int").alias("node"))
    cats = nodes.withColumn("cat", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("node") % 3 + 1).cast("int")))
    return ft.node_label(ft.bmu(e, "vec", w), cats)


@query("relabel_clusters", "M12", "vec_id:i by_median:i by_distance:i", with_ctes(
    "", "SELECT vec_id, r1.pos AS by_median, r2.pos AS by_distance FROM emb JOIN r1 USING (label) JOIN r2 USING (label)", **M_CTES,
    md="SELECT label, list(m ORDER BY d) AS m FROM (SELECT label, d, quantile_cont(v, 0.5) AS m FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS d FROM emb) GROUP BY ALL) GROUP BY label",
    r1="SELECT label, row_number() OVER (ORDER BY m[1], label) - 1 AS pos FROM md",
    rf="SELECT m AS a FROM md ORDER BY m[1] DESC, label LIMIT 1",
    r2="SELECT label, row_number() OVER (ORDER BY list_distance(m, a) DESC, label) - 1 AS pos FROM md CROSS JOIN rf"))
def relabel_clusters(spark, sf):
    e = _emb(spark, sf).select("vec_id", "label", *[F.col("vec")[i].alias(f"f{i}") for i in range(64)])
    m = ft.relabel_by_median(e, "label", "f0", "by_median").select("vec_id", "by_median")
    d = ft.relabel_by_distance(e, "label", [f"f{i}" for i in range(64)], "f0", "by_distance").select("vec_id", "by_distance")
    return m.join(d, "vec_id")


# group vectors: balance and size of each market segment per nation
GV_CTES = {
    "seg": "SELECT c_nationkey AS nat, c_mktsegment AS s, avg(c_acctbal) / 1000 AS v FROM customer GROUP BY ALL",
    "gv": "SELECT nat, n_regionkey AS lab, list(v ORDER BY s) AS e FROM (SELECT n.nat, s.s, coalesce(v, 0) AS v FROM (SELECT DISTINCT nat FROM seg) n CROSS JOIN (SELECT DISTINCT s FROM seg) s LEFT JOIN seg USING (nat, s)) "
          "JOIN nation ON n_nationkey = nat GROUP BY nat, n_regionkey",
    "pr": "SELECT a.nat AS src, b.nat AS dst, a.lab AS la, b.lab AS lb, a.e AS ae, b.e AS be, list_distance(a.e, b.e) AS d FROM gv a JOIN gv b ON a.nat <> b.nat",
}


def _group_vectors(spark, sf):
    c = src.read_table(spark, sf, "customer")
    n = src.read_table(spark, sf, "nation")
    segs = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    v = c.groupBy(F.col("c_nationkey").alias("nat")).agg(F.array(*[
        F.coalesce(F.avg(F.when(F.col("c_mktsegment") == s, F.col("c_acctbal"))) / 1000, F.lit(0.0)) for s in segs]).alias("vec"))
    return v.join(n.select(F.col("n_nationkey").alias("nat"), F.col("n_regionkey").alias("lab")), "nat")


@query("cluster_quality", "M13", "dunn:f silhouette:f db:f", with_ctes(
    "", "SELECT (SELECT min(d) FILTER (WHERE la <> lb) / max(d) FILTER (WHERE la = lb) FROM pr) AS dunn, (SELECT avg((b - a) / greatest(a, b)) FROM sil) AS silhouette, (SELECT avg(r) FROM dbx) AS db",
    **GV_CTES, m="SELECT src, la, lb, avg(d) AS d FROM pr GROUP BY ALL",
    sil="SELECT src, max(d) FILTER (WHERE la = lb) AS a, min(d) FILTER (WHERE la <> lb) AS b FROM m GROUP BY src",
    ce="SELECT lab, list(v ORDER BY k) AS c FROM (SELECT lab, k, avg(e[k]) AS v FROM (SELECT lab, e, unnest(range(1, len(e) + 1)) AS k FROM gv) GROUP BY ALL) GROUP BY lab",
    sc="SELECT lab, c, avg(list_distance(e, c)) AS s FROM gv JOIN ce USING (lab) GROUP BY ALL",
    dbx="SELECT x.lab, max((x.s + y.s) / list_distance(x.c, y.c)) AS r FROM sc x JOIN sc y ON x.lab <> y.lab GROUP BY x.lab"))
def cluster_quality(spark, sf):
    return ft.cluster_quality(_group_vectors(spark, sf), "nat", "vec", "lab")


@query("cluster_quality_curve", "M13", "k:i dunn:f silhouette:f db:f", with_ctes(
    "", "SELECT k, dunn, silhouette, db FROM du JOIN (SELECT k, avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette FROM sil GROUP BY k) USING (k) JOIN (SELECT k, avg(r) AS db FROM dbx GROUP BY k) USING (k)",
    **GV_CTES, ks="SELECT unnest(range(2, 9)) AS k", pk="SELECT src, dst, k, src % k AS la, dst % k AS lb, d FROM pr CROSS JOIN ks",
    du="SELECT k, min(d) FILTER (WHERE la <> lb AND d > 0) / max(d) FILTER (WHERE la = lb) AS dunn FROM pk GROUP BY k",
    m="SELECT k, src, la, lb, avg(d) AS d FROM pk GROUP BY ALL",
    sil="SELECT k, src, max(d) FILTER (WHERE la = lb) AS a, min(d) FILTER (WHERE la <> lb) AS b FROM m GROUP BY k, src",
    lv="SELECT k, nat % k AS lab, e FROM gv CROSS JOIN ks",
    ce="SELECT k, lab, list(v ORDER BY i) AS c FROM (SELECT k, lab, i, avg(e[i]) AS v FROM (SELECT k, lab, e, unnest(range(1, len(e) + 1)) AS i FROM lv) GROUP BY ALL) GROUP BY k, lab",
    sc="SELECT k, lab, c, avg(list_distance(e, c)) AS s FROM lv JOIN ce USING (k, lab) GROUP BY ALL",
    dbx="SELECT x.k, x.lab, max((x.s + y.s) / list_distance(x.c, y.c)) AS r FROM sc x JOIN sc y ON x.k = y.k AND x.lab <> y.lab GROUP BY x.k, x.lab"))
def cluster_quality_curve(spark, sf):
    """Quality over k; the labels of cut k are the nation's number modulo k."""
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("nat") % k).alias("label")) for k in range(2, 9)])
    return ft.quality_curve(_group_vectors(spark, sf).withColumn("cuts", cuts), "nat", "vec", "cuts")


@query("cluster_quality_rows", "M13", "db:f silhouette:f", with_ctes(
    "", "SELECT (SELECT avg(r) FROM dbx) AS db, (SELECT avg((b - a) / greatest(a, b)) FROM sil) AS silhouette", **M_CTES,
    pd="SELECT a.vec_id, a.label AS la, b.label AS lb, avg(pow(list_distance(a.e, b.e), 2)) AS d FROM emb a JOIN emb b ON a.vec_id <> b.vec_id GROUP BY ALL",
    sil="SELECT vec_id, max(d) FILTER (WHERE la = lb) AS a, min(d) FILTER (WHERE la <> lb) AS b FROM pd GROUP BY vec_id",
    sc="SELECT emb.label AS lab, w AS c, avg(list_distance(e, w)) AS s FROM emb JOIN proto ON emb.label = proto.label GROUP BY ALL",
    dbx="SELECT x.lab, max((x.s + y.s) / list_distance(x.c, y.c)) AS r FROM sc x JOIN sc y ON x.lab <> y.lab GROUP BY x.lab"))
def cluster_quality_rows(spark, sf):
    e = _emb(spark, sf)
    one = F.lit(1)
    return ft.davies_bouldin(e, "vec", "label").withColumn("k", one).join(ft.squared_silhouette(e, "vec", "label").withColumn("k", one), "k")


_SIM = ("SELECT src, dst, d AS dist, 1 - d / max(d) OVER () AS sim, list_cosine_similarity(ae, be) AS cosine, (sab / n - ma * mb) / sqrt((saa / n - ma * ma) * (sbb / n - mb * mb)) AS corr FROM ("
        "SELECT *, len(ae) AS n, list_sum(ae) / len(ae) AS ma, list_sum(be) / len(be) AS mb, list_dot_product(ae, be) AS sab, list_dot_product(ae, ae) AS saa, list_dot_product(be, be) AS sbb FROM pr WHERE src < dst)")


@query("similarity_matrix", "M14", "src:i dst:i dist:f sim:f cosine:f corr:f", with_ctes("", _SIM, **GV_CTES))
def similarity_matrix(spark, sf):
    return ft.similarity_matrix(_group_vectors(spark, sf), "nat", "vec")


@query("similarity_edges", "M15", "src:i dst:i w:f", with_ctes("", "SELECT src, dst, sim AS w FROM sm WHERE sim >= 0.5", **GV_CTES, sm=_SIM))
def similarity_edges(spark, sf):
    return ft.similarity_edges(ft.similarity_matrix(_group_vectors(spark, sf), "nat", "vec"), 0.5)


@query("modularity", "M16", "q:f", with_ctes(
    "", "SELECT sum(coalesce(i, 0) / (SELECT count(*) FROM e) - 1.2 * pow(dg / (2.0 * (SELECT count(*) FROM e)), 2)) AS q FROM (SELECT l, count(*) AS dg FROM (SELECT la AS l FROM e UNION ALL SELECT lb FROM e) GROUP BY l) "
    "LEFT JOIN (SELECT la AS l, count(*) AS i FROM e WHERE la = lb GROUP BY la) USING (l)", **GV_CTES, sm=_SIM,
    e="SELECT a.lab AS la, b.lab AS lb FROM sm JOIN gv a ON a.nat = src JOIN gv b ON b.nat = dst WHERE sim >= 0.5"))
def modularity(spark, sf):
    g = _group_vectors(spark, sf)
    e = ft.similarity_edges(ft.similarity_matrix(g, "nat", "vec"), 0.5)
    return ft.modularity(e, g, "nat", "lab", 1.2)


@query("harmonize_labels", "M17", "label:i cluster:i b_new:i n:i")
def harmonize_labels(spark, sf):
    k = ft.kmeans(_emb(spark, sf).withColumnRenamed("label", "a"), "vec", 6, out="cluster")
    return labels.harmonize_labels(k.withColumnRenamed("a", "label"), "label", "cluster").groupBy("label", "cluster", "b_new").agg(F.count(F.lit(1)).alias("n"))


@query("harmonize_chain", "M17", "k:i label:i label_new:i n:i")
def harmonize_chain(spark, sf):
    """Seven cuts of one tree renamed outward from the one with five classes."""
    t = ft.split_tree(_emb(spark, sf).drop("label"), "vec", 8, out="cuts")
    cols = [f"c{k}" for k in range(2, 9)]
    h = labels.harmonize_chain(t.select(*[F.col("cuts")[k - 1].alias(f"c{k}") for k in range(2, 9)]), cols, 3)
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("label"), F.col(f"c{k}_new").alias("label_new")) for k in range(2, 9)])).alias("s")
    return h.select(both).select("s.*").groupBy("k", "label", "label_new").agg(F.count(F.lit(1)).alias("n"))


@query("order_by_labels", "M18", "nat:i path:s pos:i rank:i", with_ctes(
    "", "SELECT nat, path, row_number() OVER (ORDER BY path, nat) - 1 AS pos, rank FROM (SELECT nat, lpad(lab::VARCHAR, 4, '0') || lpad((nat % 2)::VARCHAR, 4, '0') AS path, rank FROM gv JOIN ("
    "SELECT lab, row_number() OVER (ORDER BY m DESC, lab) - 1 AS rank FROM (SELECT lab, quantile_cont(e[1], 0.5) AS m FROM gv GROUP BY lab)) USING (lab))", **GV_CTES))
def order_by_labels(spark, sf):
    g = _group_vectors(spark, sf).select("nat", "lab", (F.col("nat") % 2).alias("sub"), F.col("vec")[0].alias("f"))
    return ft.order_by_path(ft.relabel_by_median(g, "lab", "f", "rank", descending=True), "nat", ["lab", "sub"])


@query("balanced_tiles", "M19", "uid:i region:s tile:i", with_ctes(
    "units", "SELECT uid, region, a * 4 + b * 2 + ntile(2) OVER (PARTITION BY region, a, b ORDER BY x, uid) - 1 AS tile FROM (SELECT *, ntile(2) OVER (PARTITION BY region, a ORDER BY y, uid) - 1 AS b FROM ("
    "SELECT *, ntile(2) OVER (PARTITION BY region ORDER BY x, uid) - 1 AS a FROM (SELECT uid, region, bal AS x, uid * 7 % 101 AS y FROM units)))"))
def balanced_tiles(spark, sf):
    u = units(spark, sf).select("uid", "region", F.col("bal").alias("x"), (F.col("uid") * 7 % 101).alias("y"))
    return ft.balanced_tiles(u, "region", "x", "y", "uid", depth=3)


def _tile_levels(levels: int) -> dict[str, str]:
    out = {"t0": "SELECT uid, region, bal AS x, uid * 7 % 101 AS y, 0 AS tile, greatest(round(count(*) OVER (PARTITION BY region) / 20.0), 1)::BIGINT AS parts FROM units"}
    for i in range(levels):
        left = "rn <= floor(c * (parts // 2) / parts + 0.5)"
        out[f"t{i + 1}"] = (f"SELECT uid, region, x, y, CASE WHEN parts = 1 OR {left} THEN tile ELSE tile + parts // 2 END AS tile, CASE WHEN parts = 1 THEN 1 WHEN {left} THEN parts // 2 ELSE parts - parts // 2 END AS parts FROM ("
                            f"SELECT *, row_number() OVER (PARTITION BY region, tile ORDER BY {'xy'[i % 2]}, uid) AS rn, (count(*) OVER (PARTITION BY region, tile))::DOUBLE AS c FROM t{i})")
    return out


@query("balanced_tiles_by_size", "M19", "uid:i region:s tile:i", with_ctes("units", "SELECT uid, region, tile FROM t10", **_tile_levels(10)))
def balanced_tiles_by_size(spark, sf):
    """Every region has its own number of tiles of about 20 points."""
    u = units(spark, sf).select("uid", "region", F.col("bal").alias("x"), (F.col("uid") * 7 % 101).alias("y"))
    return ft.balanced_tiles(u, "region", "x", "y", "uid", per_tile=20)


@query("polygon_area", "M20", "area_name:s area:f cx:f cy:f pos:i", with_ctes(
    "units", "SELECT area AS area_name, a AS area, cx, cy, row_number() OVER (ORDER BY cx, area) - 1 AS pos FROM (SELECT area, abs(sum(x * ny - nx * y)) / 2 AS a, avg(x) AS cx, avg(y) AS cy FROM ("
    "SELECT *, coalesce(lead(x) OVER g, first_value(x) OVER g) AS nx, coalesce(lead(y) OVER g, first_value(y) OVER g) AS ny FROM (SELECT area, uid, bal / 1000 AS x, uid * 7 % 101 / 10 AS y FROM units) "
    "WINDOW g AS (PARTITION BY area ORDER BY uid)) GROUP BY area)"))
def polygon_area(spark, sf):
    u = units(spark, sf).select(F.col("area").alias("area_name"), "uid", (F.col("bal") / 1000).alias("x"), (F.col("uid") * 7 % 101 / 10).alias("y"))
    return ft.polygon_area(u, "area_name", "uid", "x", "y")


@query("cluster_compactness", "M21", "lab:i iq:f d_min:f d_median:f d_max:f diversity:f", with_ctes(
    "", "SELECT lab, iq, d_min, d_median, d_max, diversity FROM (SELECT l AS lab, avg(sim) FILTER (WHERE la = lb) - avg(sim) FILTER (WHERE la <> lb) AS iq, min(dist) FILTER (WHERE la = lb) AS d_min, "
    "quantile_cont(dist, 0.5) FILTER (WHERE la = lb) AS d_median, max(dist) FILTER (WHERE la = lb) AS d_max FROM (SELECT *, la AS l FROM p UNION ALL SELECT *, lb FROM p WHERE la <> lb) GROUP BY l) "
    "JOIN (SELECT lab, count(DISTINCT nat % 4) / count(*) AS diversity FROM gv GROUP BY lab) USING (lab)",
    **GV_CTES, sm=_SIM, p="SELECT a.lab AS la, b.lab AS lb, sim, dist FROM sm JOIN gv a ON a.nat = src JOIN gv b ON b.nat = dst"))
def cluster_compactness(spark, sf):
    g = _group_vectors(spark, sf)
    sim = ft.similarity_matrix(g, "nat", "vec")
    return ft.cluster_compactness(sim, g.withColumn("run", F.col("nat") % 4), "nat", "lab", "run")


@query("normalize_rows", "M22", "vec_id:i d:i u:f", with_ctes(
    "", "SELECT vec_id, d - 1 AS d, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS u FROM cells", **M_CTES))
def normalize_rows(spark, sf):
    return ft.l2_rows(_emb(spark, sf), "vec", "u").select("vec_id", F.posexplode("u").alias("d", "u"))


@query("fano", "M22", "kind:s fano:f", "SELECT event_type AS kind, var_pop(value) / avg(value) AS fano FROM events GROUP BY 1")
def fano(spark, sf):
    return ft.fano(src.event_rows(spark, sf), "kind", "value")


@query("distance_to_ref", "M23", "vec_id:i d:f", with_ctes(
    "", "SELECT vec_id, (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) AS d FROM (SELECT vec_id, list_distance(e, (SELECT w FROM proto WHERE node = 0)) AS d FROM emb)", **M_CTES))
def distance_to_ref(spark, sf):
    e = _emb(spark, sf)
    return ft.distance_to_ref(e, "vec", _prototypes(e)[1][0])


@query("u_matrix", "M24", "node:i u_mean:f u_scaled:f", with_ctes(
    "", "SELECT node, u_mean, u / max(u) OVER () AS u_scaled FROM (SELECT a.node, avg(list_distance(a.w, b.w)) AS u_mean, sum(list_distance(a.w, b.w)) AS u FROM proto a JOIN proto b ON a.node <> b.node "
    "AND abs(a.node % 5 - b.node % 5) <= 1 AND abs(a.node // 5 - b.node // 5) <= 1 GROUP BY a.node)", **M_CTES))
def u_matrix(spark, sf):
    _, w = _prototypes(_emb(spark, sf))
    return ft.u_matrix(_model_rows(spark, w), "node", "vec", (5, -(-len(w) // 5)))


@query("gmm_confidence", "M25", "vec_id:i label:i confidence:f")
def gmm_confidence(spark, sf):
    return ft.gmm_confidence(_pc3(spark, sf).drop("label"), "vec", 3)


_MAP_B = {
    "grp": "SELECT vec_id, e, CAST(floor(e[1] * 10) AS BIGINT) AS g FROM emb",
    "pb": "SELECT g, dense_rank() OVER (ORDER BY g) - 1 AS node_b, list(v ORDER BY d) AS wb FROM (SELECT g, d, avg(e[d]) AS v FROM (SELECT g, e, unnest(range(1, 65)) AS d FROM grp) GROUP BY ALL) GROUP BY g",
    "tr2": "SELECT label, arg_min(g, (list_distance(w, wb), node_b)) AS label_b FROM proto CROSS JOIN pb GROUP BY label",
}


@query("label_transfer", "M26", "label:i label_b:i n:i frac:f", with_ctes(
    "", "SELECT label % 3 AS label, label_b, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY label % 3) AS frac FROM tr2 GROUP BY label % 3, label_b", **M_CTES, **_MAP_B))
def label_transfer(spark, sf):
    e = _emb(spark, sf)
    a = ft.group_means(e, "vec", "label", DIM).withColumn("label", F.col("label") % 3)
    g = e.withColumn("g", F.floor(F.col("vec")[0] * 10))
    keys, wb = ft.collect_model(ft.group_means(g, "vec", "g", DIM), "g", "vec")
    labels_b = spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], "node int, label_b bigint")
    return ft.label_transfer(a, "vec", "label", wb, labels_b)[1]
