"""One query per family whose recording 0 has a NULL key: a NULL key is a key like others, so its rows are those of recording 0."""

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import intervals as iv
from ..operators import traces as tc
from ..operators import trains
from ..sources import tables as src
from . import alignment, interval_algebra, joining, metrics
from .registry import REGISTRY, query


def _nulled(df):
    return df.withColumn("recid", F.nullif("recid", F.lit(0)))


def null_query(name: str, item: str, columns: str):
    """Register the function as ``<name>_null_keys`` against the SQL of query ``name``, recording 0 renamed to NULL."""
    picked = ", ".join(c.split(":")[0] for c in columns.split())
    return query(f"{name}_null_keys", item, columns, f"SELECT {picked} FROM (SELECT * REPLACE (nullif(recid, 0) AS recid) FROM ({REGISTRY[name].sql}) AS p) AS r")


def _art(spark, sf):
    return _nulled(interval_algebra._art(spark, sf))


def _bounds(spark, sf):
    return _nulled(joining.bounds(spark, sf))


@null_query("free_intervals", "I2", "recid:i t0:f t1:f")
def free_intervals(spark, sf):
    return iv.free_intervals(_art(spark, sf), _bounds(spark, sf), "recid")


@null_query("free_after_buffer", "I3", "recid:i t0:f t1:f")
def free_after_buffer(spark, sf):
    return iv.free_after_buffer(_art(spark, sf), _bounds(spark, sf), "recid", 300.0, 900.0, 2400.0)


@null_query("border_intervals", "I7", "recid:i t0:f t1:f")
def border_intervals(spark, sf):
    m = iv.merge_by_gap(_art(spark, sf), "recid", 3600.0)
    return iv.border_intervals(m, "n", _bounds(spark, sf), "recid", 3, 1200.0, 300.0, 1800.0)


@null_query("events_in_windows", "J1", "recid:i win_id:i eid:i uid:i t:f")
def events_in_windows(spark, sf):
    return trains.events_in_windows(_nulled(src.event_rows(spark, sf)), _nulled(joining._prestim(spark, sf)), bucket=3600.0)


def _events_and_tiles(spark, sf):
    ev = src.event_rows(spark, sf)
    return _nulled(ev), _nulled(src.tiles(ev, metrics.TILE))


@null_query("isi_rate", "P11", "recid:i uid:i win_id:i isi_rate:f")
def isi_rate(spark, sf):
    ev, tiles = _events_and_tiles(spark, sf)
    return trains.interval_rate(trains.intervals(trains.events_in_windows(ev, tiles, bucket=metrics.TILE), metrics.G, ("t", "eid")), metrics.G)


@null_query("log_rate", "P13", "recid:i uid:i win_id:i n:i rate:f")
def log_rate(spark, sf):
    ev, tiles = _events_and_tiles(spark, sf)
    return trains.log_rate(trains.window_counts(ev, tiles, bucket=metrics.TILE))


@null_query("xcorr", "H6", "recid:i lag:i c:f")
def xcorr(spark, sf):
    return tc.xcorr(_nulled(alignment._xy(spark, sf)), "recid", 12)


@query("relabel_null_label", "M12", "vec_id:i new_label:i",
       "SELECT vec_id, rk AS new_label FROM e JOIN (SELECT label, row_number() OVER (ORDER BY m, label NULLS FIRST) - 1 AS rk FROM (SELECT label, quantile_cont(f, 0.5) AS m FROM e GROUP BY label)) r "
       "ON e.label IS NOT DISTINCT FROM r.label".join(("WITH e AS (SELECT vec_id, nullif(label, 0) AS label, CAST(embedding[1] AS DOUBLE) AS f FROM embeddings) ", "")))
def relabel_null_label(spark, sf):
    e = src.read_table(spark, sf, "embeddings").select("vec_id", F.nullif("label", F.lit(0)).alias("label"), F.col("embedding")[0].cast("double").alias("f"))
    return ft.relabel_by_median(e, "label", "f")
