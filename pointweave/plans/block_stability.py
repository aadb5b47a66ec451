"""Block and transition queries (K)."""

from pyspark.sql import functions as F

from ..operators import stability as sb
from ..operators.scan import time_chunk
from ..sources import tables as src
from .registry import query
from .sqltext import TILE, with_ctes

DAY = 86400.0

# category of an entity per 5-day block: mean event value in steps of 5, NULL below 5 events
K_CTES = {
    "blk": f"SELECT recid, uid, CAST(floor(t / {TILE}) AS BIGINT) - 3944 AS block, count(*) AS n, CASE WHEN count(*) >= 5 THEN least(3, CAST(floor(avg(value) / 5) AS BIGINT)) END AS cat FROM ev GROUP BY ALL",
    "whole": "SELECT recid, uid, least(3, CAST(floor(avg(value) / 5) AS BIGINT)) AS cat FROM ev GROUP BY ALL",
    "tr": "SELECT a.recid, a.block AS step, a.cat AS src, b.cat AS dst, count(*) AS n FROM blk a JOIN blk b ON a.recid = b.recid AND a.uid = b.uid AND b.block = a.block + 1 WHERE a.n >= 5 AND b.n >= 5 GROUP BY ALL",
}


def _cat(keys, df):
    value = F.least(F.lit(3).cast("bigint"), F.floor(F.avg("value") / 5))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 5, value).alias("cat"))


def _blocks(spark, sf):
    ev = src.event_rows(spark, sf).withColumn("block", F.floor(F.col("t") / TILE) - 3944)
    return _cat(["recid", "uid", "block"], ev)


def _transitions(spark, sf):
    return sb.transitions(_blocks(spark, sf), "recid", "uid", "block", "cat", "n", 5)


@query("chop_blocks", "K1", "recid:i win_id:i block:i", with_ctes(
    "trg", "SELECT recid, win_id, CASE WHEN r <= (n % k) * (n // k + 1) THEN (r - 1) // (n // k + 1) ELSE n % k + (r - 1 - (n % k) * (n // k + 1)) // (n // k) END AS block FROM ("
    "SELECT *, n // 15 AS k FROM (SELECT recid, win_id, count(*) OVER (PARTITION BY recid) AS n, row_number() OVER (PARTITION BY recid ORDER BY t, win_id) AS r FROM trg)) WHERE k > 0"))
def chop_blocks(spark, sf):
    return sb.chop_blocks(src.triggers(spark, sf), "recid", ["t", "win_id"], 15, time_chunk("t", DAY))


@query("split_block", "K2", "recid:i win_id:i block:i", with_ctes(
    "trg", "SELECT recid, win_id, CASE WHEN b = 1 THEN b + ntile(3) OVER (PARTITION BY recid, b ORDER BY t, win_id) - 1 WHEN b > 1 THEN b + 2 ELSE b END AS block FROM ("
    f"SELECT *, CAST(floor(t / {TILE}) AS BIGINT) - 3944 AS b FROM trg)"))
def split_block(spark, sf):
    t = src.triggers(spark, sf).withColumn("block", F.floor(F.col("t") / TILE) - 3944)
    return sb.split_block(t, "recid", "win_id", "block", 1, 3)


# A small example model (reference moments, weights, prototypes and their labels).
MODEL = {
    "ref": ([15.0, 0.0], [5.0, 0.3]), "weights": [1.0, 0.5],
    "prototypes": [[-1.0, -0.5], [-0.2, 0.4], [0.3, -0.3], [1.2, 0.6]], "labels": ["low", "mid", "mid", "high"],
}


@query("classify_blocks", "K3", "uid:i block:i node:i cat:s", with_ctes(
    "ev", "SELECT uid, block, node, CASE node WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'mid' WHEN 3 THEN 'high' END AS cat FROM (SELECT uid, block, CASE WHEN f1 IS NOT NULL AND f2 IS NOT NULL THEN "
    "(SELECT arg_min(i, (pow((f1 - 15) / 5 - a, 2) + pow((f2 - 0) / 0.3 * 0.5 - b, 2), i)) FROM (VALUES (0, -1.0::DOUBLE, -0.5::DOUBLE), (1, -0.2, 0.4), (2, 0.3, -0.3), (3, 1.2, 0.6)) AS p(i, a, b)) END AS node FROM bf)",
    bf=f"SELECT uid, CAST(floor(t / {TILE}) AS BIGINT) - 3944 AS block, CASE WHEN count(value) >= 3 THEN avg(value) END AS f1, CASE WHEN count(*) FILTER (WHERE value > 0) >= 3 THEN avg(log10(value)) FILTER (WHERE value > 0) - 1 END AS f2 FROM ev GROUP BY ALL"))
def classify_blocks(spark, sf):
    ev = src.event_rows(spark, sf).select(
        "uid", (F.floor(F.col("t") / TILE) - 3944).alias("block"), F.col("value").alias("f1"), (F.log10(F.when(F.col("value") > 0, F.col("value"))) - 1).alias("f2"))
    b = sb.block_features(ev, ["uid", "block"], ["f1", "f2"])
    return sb.classify_blocks(b, ["f1", "f2"], MODEL["ref"], MODEL["weights"], MODEL["prototypes"], MODEL["labels"])


@query("block_match", "K4", "whole:s in_block:s n:i frac:f same:b", with_ctes(
    "ev", "SELECT whole, in_block, n, n / sum(n) OVER (PARTITION BY whole) AS frac, whole = in_block AS same FROM (SELECT w.cat::VARCHAR AS whole, coalesce(b.cat::VARCHAR, 'NA') AS in_block, count(*) AS n FROM blk b JOIN whole w USING (recid, uid) GROUP BY ALL)", **K_CTES))
def block_match(spark, sf):
    whole = _cat(["recid", "uid"], src.event_rows(spark, sf)).select("recid", "uid", F.col("cat").alias("whole"))
    return sb.block_match(_blocks(spark, sf).join(whole, ["recid", "uid"]), "whole", "cat")


@query("transitions", "K5", "recid:i step:i src:i dst:i n:i", with_ctes("ev", "SELECT * FROM tr", **K_CTES))
def transitions(spark, sf):
    return _transitions(spark, sf)


_STATS = {
    "tt": "SELECT src, dst, sum(n) AS n FROM tr GROUP BY ALL",
    "tf": "SELECT a.src, b.dst, coalesce(n, 0) AS n FROM (SELECT DISTINCT src FROM tt) a CROSS JOIN (SELECT DISTINCT dst FROM tt) b LEFT JOIN tt ON tt.src = a.src AND tt.dst = b.dst",
    "tm": "SELECT *, r * c / tot AS e FROM (SELECT *, sum(n) OVER (PARTITION BY src) AS r, sum(n) OVER (PARTITION BY dst) AS c, sum(n) OVER () AS tot FROM tf)",
}


@query("transition_stats", "K6", "src:i dst:i n:i prob:f expected:f ratio:f pct:f", with_ctes(
    "ev", "SELECT src, dst, n, n / r AS prob, e AS expected, n / e AS ratio, 100 * (n - e) / e AS pct FROM tm", **K_CTES, **_STATS))
def transition_stats(spark, sf):
    return sb.transition_stats(_transitions(spark, sf))


@query("stability_index", "K7", "recid:i si:f", with_ctes(
    "ev", "SELECT recid, coalesce(sum(n) FILTER (WHERE src = dst), 0) / sum(n) AS si FROM tr GROUP BY recid", **K_CTES))
def stability_index(spark, sf):
    return sb.stability_index(_transitions(spark, sf), "recid")


@query("coincidence_coeff", "K8", "src:i dst:i coco:f", with_ctes(
    "ev", "SELECT src, dst, CASE WHEN n >= e THEN (n - e) / nullif(least(r, c) - e, 0) ELSE (n - e) / e END AS coco FROM tm", **K_CTES, **_STATS))
def coincidence_coeff(spark, sf):
    return sb.transition_stats(_transitions(spark, sf))


_NAMED = {
    "bs": f"SELECT recid, block, count(*) AS n, CASE WHEN block % 2 = 0 THEN 'off' ELSE 'on' END || (block // 2 + 1) AS name FROM (SELECT recid, CAST(floor(t / {TILE}) AS BIGINT) - 3944 AS block FROM ev WHERE kind = 'purchase') GROUP BY ALL",
}


def _named(spark, sf):
    b = src.triggers(spark, sf).groupBy("recid", (F.floor(F.col("t") / TILE) - 3944).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return sb.block_names(b, "recid", "block", "context")


@query("transition_rollup", "K9", "pair:s src:i dst:i n:i n_rec:i", with_ctes(
    "ev", "SELECT a.name || '>' || b.name AS pair, src, dst, sum(tr.n) AS n, count(DISTINCT tr.recid) AS n_rec FROM tr JOIN bs a ON a.recid = tr.recid AND a.block = tr.step JOIN bs b ON b.recid = tr.recid AND b.block = tr.step + 1 "
    "WHERE a.n >= 15 AND b.n >= 15 GROUP BY ALL", **K_CTES, **_NAMED))
def transition_rollup(spark, sf):
    return sb.transition_rollup(_transitions(spark, sf), _named(spark, sf), "recid", 15, sb.context_pair("name_a", "name_b"))


@query("block_names", "K10", "recid:i block:i context:s plain:s", with_ctes(
    "ev", "SELECT recid, block, name AS context, 'B' || row_number() OVER (PARTITION BY recid ORDER BY block) AS plain FROM bs", **_NAMED))
def block_names(spark, sf):
    n = _named(spark, sf).withColumnRenamed("name", "context")
    return sb.block_names(n, "recid", "block").withColumnRenamed("name", "plain")


@query("stability_profile", "K11", "step:i si:f si_exp:f n_rec:i", with_ctes(
    "ev", "SELECT o.step, si, e / n AS si_exp, n_rec FROM (SELECT step, sum(n) AS n, coalesce(sum(n) FILTER (WHERE src = dst), 0) / sum(n) AS si, count(DISTINCT recid) AS n_rec FROM tr GROUP BY step) o "
    "JOIN (SELECT step, sum(r * c / tot) AS e FROM (SELECT x.step, x.r, y.c, z.tot FROM (SELECT step, src, sum(n) AS r FROM tr GROUP BY ALL) x JOIN (SELECT step, dst, sum(n) AS c FROM tr GROUP BY ALL) y "
    "ON x.step = y.step AND x.src = y.dst JOIN (SELECT step, sum(n) AS tot FROM tr GROUP BY step) z ON z.step = x.step) GROUP BY step) p USING (step)", **K_CTES))
def stability_profile(spark, sf):
    return sb.stability_profile(_transitions(spark, sf), "step", "recid")
