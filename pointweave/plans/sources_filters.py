"""Source (S) and projection/filter (F) queries."""

from pyspark.sql import functions as F

from ..operators import filters as flt
from ..session import output_folder
from ..sources import tables as src
from .registry import query
from .sqltext import with_ctes


def units(spark, sf):
    """Customers with their nation as area and region as parent area."""
    c, n, r = (src.read_table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("c_custkey").alias("uid"), F.col("n_name").alias("area"), F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nat"))


@query("load_event_trains", "S1", "recid:i uid:i t:f", with_ctes("ev", "SELECT DISTINCT recid, uid, t FROM ev"))
def load_event_trains(spark, sf):
    return src.load_event_trains(src.event_rows(spark, sf), ["recid", "uid"])


@query("unpack_jagged", "S2", "recid:i uid:i pos:i value:f", with_ctes(
    "ev", "SELECT recid, uid, row_number() OVER (PARTITION BY recid ORDER BY uid, t) - 1 AS pos, t AS value FROM (SELECT DISTINCT recid, uid, t FROM ev)"))
def unpack_jagged(spark, sf):
    trains = src.load_event_trains(src.event_rows(spark, sf), ["recid", "uid"])
    values, ends = src.pack_jagged(trains, "recid", "uid", "t", "t")
    return src.unpack_jagged(values, ends, "recid", "uid")


@query("scan_recordings", "S3", "source_file:s n:i", "SELECT 'events.parquet' AS source_file, count(*) AS n FROM events")
def scan_recordings(spark, sf):
    pool = [f"{sf}/{t}.parquet" for t in ("events", "orders", "lineitem", "labels")]
    return src.scan_recordings(spark, pool, "events", ["events"]).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


@query("allowed_recordings", "S4", "c_name:s c_mktsegment:s",
       "SELECT DISTINCT trim(c_name) AS c_name, trim(c_mktsegment) AS c_mktsegment FROM customer "
       "WHERE contains(c_name, '00007') AND c_mktsegment NOT IN ('-', '?', 'MACHINERY')")
def allowed_recordings(spark, sf):
    return src.allowed_recordings(src.read_table(spark, sf, "customer"), "c_name", "c_mktsegment", "00007", ["-", "?", "MACHINERY"])


@query("lookup_scores", "S5", "uid:i area:s score:f", with_ctes(
    "units", "SELECT uid, area, coalesce(score, -1) AS score FROM units LEFT JOIN (SELECT n_name || CASE WHEN n_regionkey = 2 THEN ' old' ELSE '' END AS area, avg(s_acctbal) AS score "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, n_regionkey) USING (area)"))
def lookup_scores(spark, sf):
    s, n = src.read_table(spark, sf, "supplier"), src.read_table(spark, sf, "nation")
    alias = F.concat("n_name", F.when(F.col("n_regionkey") == 2, " old").otherwise(""))
    scores = s.join(n, s.s_nationkey == n.n_nationkey).groupBy(alias.alias("area")).agg(F.avg("s_acctbal").alias("score"))
    path = output_folder(spark, "scores")
    scores.write.option("header", True).csv(path)
    return src.lookup_scores(units(spark, sf), src.read_scores(spark, path, "area"), "area", "score", default=-1.0)


@query("write_sections", "S6", "section:s row_key:s field:s number:f text:s", with_ctes(
    "units",
    "SELECT 'areas' AS section, area AS row_key, 'n' AS field, CAST(count(*) AS DOUBLE) AS number, NULL AS text FROM units GROUP BY area "
    "UNION ALL SELECT 'areas', area, 'bal', avg(bal), NULL FROM units GROUP BY area "
    "UNION ALL SELECT 'areas', area, 'region', NULL, any_value(region) FROM units GROUP BY area "
    "UNION ALL SELECT 'segments', seg, 'n', CAST(count(*) AS DOUBLE), NULL FROM units GROUP BY seg"))
def write_sections(spark, sf):
    u = units(spark, sf)
    areas = u.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.avg("bal").alias("bal"), F.min("region").alias("region"))
    segs = u.groupBy("seg").agg(F.count(F.lit(1)).alias("n"))
    path = output_folder(spark, "sections")
    src.write_sections({"areas": areas, "segments": segs}, path)
    back = [src.read_section(spark, path, name).withColumn("section", F.lit(name)) for name in ("areas", "segments")]
    return back[0].unionByName(back[1])


@query("filter_units", "F1", "p_partkey:i p_brand:s p_type:s", (
    "SELECT p_partkey, p_brand, p_type FROM part WHERE (contains(p_brand, '1') OR contains(p_brand, '5')) "
    "AND p_type IN ('ECONOMY', 'SMALL') AND p_size % 2 = 1 AND p_retailprice > 950"))
def filter_units(spark, sf):
    p = src.read_table(spark, sf, "part").withColumns({
        "quality": F.col("p_size") % 2, "wavequality": (F.col("p_retailprice") > 950).cast("int")})
    return flt.filter_units(p, "p_brand", ["1", "5"], {"p_type": ["ECONOMY", "SMALL"]}, ["quality", "wavequality"])


_FEATS = "SELECT c_custkey AS uid, CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END AS f1, 1000 / nullif(c_acctbal - 2000, 0) AS f2 FROM customer"


def _features(spark, sf):
    return src.read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("uid"), F.log10("c_acctbal").alias("f1"),
        (1000 / F.nullif(F.col("c_acctbal") - 2000, F.lit(0.0))).alias("f2"))


@query("complete_features", "F2", "uid:i f1:f f2:f", f"SELECT * FROM ({_FEATS}) WHERE f1 IS NOT NULL AND f2 IS NOT NULL")
def complete_features(spark, sf):
    return flt.complete_features(_features(spark, sf), ["f1", "f2"])


@query("physical_bounds", "F3", "uid:i f1:f f2:f",
       f"SELECT * FROM ({_FEATS}) WHERE coalesce(f1 BETWEEN 2 AND 3.9, true) AND coalesce(f2 BETWEEN -5 AND 5, true)")
def physical_bounds(spark, sf):
    return flt.physical_bounds(_features(spark, sf), {"f1": (2.0, 3.9), "f2": (-5.0, 5.0), "absent": (0.0, 1.0)})


@query("min_windows", "F4", "eid:i uid:i", with_ctes(
    "ev", "SELECT eid, uid FROM ev WHERE uid IN (SELECT uid FROM ev WHERE kind = 'error' GROUP BY uid HAVING count(*) > 12)"))
def min_windows(spark, sf):
    ev = src.event_rows(spark, sf)
    return flt.min_windows(ev, ev.where("kind = 'error'"), "uid", 12)


@query("trim_outliers", "F5", "l_orderkey:i l_linenumber:i l_extendedprice:f l_quantity:f",
       "WITH a AS (SELECT * FROM lineitem WHERE abs(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) <= "
       "1.5 * (SELECT stddev_pop(l_extendedprice) FROM lineitem)) SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM a "
       "WHERE abs(l_quantity - (SELECT avg(l_quantity) FROM a)) <= 1.5 * (SELECT stddev_pop(l_quantity) FROM a)")
def trim_outliers(spark, sf):
    li = src.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return flt.trim_outliers(li, ["l_extendedprice", "l_quantity"], 1.5)


@query("decompose_region", "F6", "p_partkey:i area:s layer:s",
       "SELECT p_partkey, regexp_extract(p_brand, '^([^0-9]*)', 1) AS area, regexp_replace(p_brand, '^[^0-9]*', '') AS layer FROM part")
def decompose_region(spark, sf):
    p = src.read_table(spark, sf, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("region"))
    return flt.decompose_region(p, "region")


@query("parent_region", "F7", "uid:i area:s parent:s",
       with_ctes("units", "SELECT uid, area, CASE WHEN region = 'ASIA' THEN 'na' ELSE region END AS parent FROM units"))
def parent_region(spark, sf):
    n, r = src.read_table(spark, sf, "nation"), src.read_table(spark, sf, "region")
    parents = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat("n_name", F.when(F.col("r_name") == "ASIA", " old").otherwise("")).alias("area"), F.col("r_name").alias("parent"), F.col("r_regionkey").alias("rank"))
    return flt.parent_region(units(spark, sf), "area", parents)


@query("composite_keys", "F8", "p_partkey:i area_layer:s roi_layer:s depth:s roi_depth:s",
       "SELECT p_partkey, p_type || '|' || d AS area_layer, p_size || '|' || d AS roi_layer, depth, p_size || '|' || depth AS roi_depth FROM ("
       "SELECT *, regexp_replace(p_brand, '[^0-9]', '', 'g') AS d, CASE WHEN p_brand LIKE '%5%' OR p_brand LIKE '%6%' THEN 'deep' ELSE 'sup' END AS depth FROM part)")
def composite_keys(spark, sf):
    return flt.composite_keys(src.read_table(spark, sf, "part"), "p_type", "p_brand", "p_size")


@query("recode_values", "F9", "c_custkey:i c_mktsegment:s",
       "SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'HH' WHEN 'MACHINERY' THEN 'Passive' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def recode_values(spark, sf):
    return flt.recode_values(src.read_table(spark, sf, "customer"), {"c_mktsegment": {"HOUSEHOLD": "HH", "MACHINERY": "Passive"}})


@query("bool_label", "F10", "o_orderkey:i label:s",
       "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_totalprice > 400000 THEN 'large' "
       "WHEN o_orderstatus = 'F' THEN 'done' ELSE 'na' END AS label FROM orders")
def bool_label(spark, sf):
    o = src.read_table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("done"), (F.col("o_totalprice") > 400000).alias("large"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return flt.bool_label(o, ["done", "large", "urgent"], "label")


@query("threshold_class", "F11", "eid:i cls:s",
       "SELECT event_id AS eid, CASE WHEN value < 10 THEN 'narrow' WHEN value > 20 THEN 'wide' ELSE 'unclassified' END AS cls FROM events")
def threshold_class(spark, sf):
    return flt.threshold_class(src.event_rows(spark, sf), "value", 10, 20, "cls")


@query("text_group", "F12", "doc_id:i grp:s",
       "SELECT doc_id, CASE WHEN regexp_matches(text, '[Tt]he ') THEN 'article' WHEN regexp_matches(text, 'tion') THEN 'noun' ELSE 'other' END AS grp FROM documents")
def text_group(spark, sf):
    return flt.text_group(src.read_table(spark, sf, "documents"), "text", {"article": "[Tt]he ", "noun": "tion"}, "grp")


@query("param_profile", "F13", "param:s is_bool:b n_values:i lo:f hi:f", " UNION ALL ".join(
    f"SELECT '{p}' AS param, bool_and({p} IN (0, 1)) AND NOT bool_and({p} = 1) AS is_bool, count(DISTINCT {p}) AS n_values, min({p}) AS lo, max({p}) AS hi FROM labels"
    for p in ("quality", "toxic", "doc_id")))
def param_profile(spark, sf):
    return flt.param_profile(src.read_table(spark, sf, "labels"), ["quality", "toxic", "doc_id"])


@query("affine_coords", "F14", "eid:i x:f y:f",
       "SELECT event_id AS eid, CASE event_type WHEN 'click' THEN round(value * 0.5 + 3, 3) WHEN 'view' THEN round(value * -2.0 + 1, 3) ELSE value END AS x, "
       "CASE event_type WHEN 'click' THEN round(user_id * 2.0 - 1, 3) ELSE user_id END AS y FROM events")
def affine_coords(spark, sf):
    e = src.event_rows(spark, sf).select("eid", "kind", F.col("value").alias("x"), F.col("uid").alias("y"))
    return flt.affine_coords(e, "kind", {"click": {"x": (0.5, 3.0), "y": (2.0, -1.0)}, "view": {"x": (-2.0, 1.0)}})


@query("metric_filter", "F15", "uid:i n:i sd:f skew:f",
       "SELECT * FROM (SELECT user_id AS uid, count(*) AS n, stddev_samp(value) AS sd, avg(value) / nullif(min(value) - 0.01, 0) AS skew FROM events GROUP BY 1) "
       "WHERE n >= 60 AND sd IS NOT NULL AND skew IS NOT NULL")
def metric_filter(spark, sf):
    m = src.event_rows(spark, sf).groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"),
        (F.avg("value") / F.nullif(F.min("value") - 0.01, F.lit(0.0))).alias("skew"))
    return flt.metric_filter(m, ["sd", "skew"], "n", 60)
