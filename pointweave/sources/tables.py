"""Readers, writers and the logical event/window tables derived from the stored ones."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite, names, seconds
from ..operators.scan import scan, time_chunk

DAY = 86400.0


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load_event_trains(df: DataFrame, keys: Sequence[str] | str, t: str = "t") -> DataFrame:
    """One row per (entity, time): repeated event times of an entity are collapsed, NaN times dropped."""
    keys = names(keys)
    return df.select(*keys, finite(t).alias(t)).where(F.col(t).isNotNull()).dropDuplicates(keys + [t])


def pack_jagged(df: DataFrame, group: str, entity: str, order: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows to jagged form: values with their flat position, and the end offset of each entity.

    The flat array of a group is never built; a value carries its 0-based position instead.
    """
    counts = df.groupBy(group, entity).agg(F.count(F.lit(1)).alias("n"))
    ends = scan(counts, group, entity, F.floor(F.col(entity) / 4096), end_idx=("sum", "n"))
    ranked = scan(df, [group, entity], [order], time_chunk(order, DAY), _r="row")
    values = ranked.join(ends.select(group, entity, "n", "end_idx"), [group, entity]).select(
        group, (F.col("end_idx") - F.col("n") + F.col("_r") - 1).alias("pos"), F.col(value).alias("value"))
    return values, ends.select(group, entity, "end_idx")


def unpack_jagged(values: DataFrame, ends: DataFrame, group: str, entity: str, width: int = 65536) -> DataFrame:
    """Jagged form to rows: entity u of a group owns positions ``[end[u-1], end[u])``.

    The end offsets become half-open ranges, each cut into blocks of ``width`` positions, and meet the
    values on (group, block): a large entity spreads over many blocks.
    """
    spans = scan(ends, group, entity, F.floor(F.col(entity) / 4096), _prev=("lag", "end_idx")).select(
        group, entity, F.coalesce("_prev", F.lit(0)).alias("_lo"), F.col("end_idx").alias("_hi")
    ).where("_hi > _lo")
    spans = spans.withColumn("_bk", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))))
    v = values.withColumn("_bk", F.floor(F.col("pos") / width))
    return v.join(spans, [group, "_bk"]).where("pos >= _lo AND pos < _hi").select(group, entity, "pos", "value")


def scan_recordings(
    spark: SparkSession, paths: Sequence[str], must_contain: str, expected: Sequence[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read the files of a pool whose name contains ``must_contain``; every expected id needs exactly one."""
    hits = [p for p in paths if must_contain in os.path.basename(p)]
    for rec in expected or []:
        n = sum(os.path.basename(p).startswith(rec) for p in hits)
        if n != 1:
            raise ValueError(f"{n} files match recording {rec!r}, need exactly one")
    if not hits:
        raise ValueError(f"no file name contains {must_contain!r}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    out = reader.parquet(*hits)
    return out.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def allowed_recordings(df: DataFrame, recid: str, usable: str, contains: str, banned: Sequence[str]) -> DataFrame:
    """Ids that contain a marker and whose usable flag, trimmed, is not on the banned list."""
    trimmed = df.select(F.trim(recid).alias(recid), F.trim(usable).alias(usable))
    return trimmed.where(F.col(recid).contains(contains) & ~F.col(usable).isin(list(banned))).distinct()


def read_scores(spark: SparkSession, path: str, key: str = "key", score: str = "score") -> DataFrame:
    """Score table from CSV with an explicit schema; unparsable scores become NULL."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(score, T.DoubleType())])
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE").select(
        F.trim(key).alias(key), finite(score).alias(score))


def lookup_scores(df: DataFrame, scores: DataFrame, key: str, score: str, default: float | None = None) -> DataFrame:
    """Left lookup of a score by key. Catalyst broadcasts the score side when its size allows."""
    out = df.join(scores.select(key, F.col(score)), key, "left")
    return out if default is None else out.withColumn(score, F.coalesce(F.col(score), F.lit(default)))


def write_sections(sections: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Persist named tables as one long data set partitioned by ``section``.

    Each table is unpivoted to (row_key, field, number, text) so that sheets of any shape share a schema.
    """
    long = None
    for name, df in sections.items():
        part = to_long_section(df, df.columns[0]).withColumn("section", F.lit(name))
        long = part if long is None else long.unionByName(part)
    if long is None:
        raise ValueError("no sections to write")
    long.write.mode(mode).partitionBy("section").parquet(path)


def read_section(spark: SparkSession, path: str, section: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("section") == section).drop("section")


def to_long_section(df: DataFrame, key: str) -> DataFrame:
    """(row_key, field, number, text): one row per cell of ``df`` other than the key."""
    cells = []
    for f in df.schema.fields:
        if f.name == key:
            continue
        numeric = isinstance(f.dataType, T.NumericType)
        cells.append(F.struct(
            F.lit(f.name).alias("field"),
            (F.col(f.name).cast("double") if numeric else F.lit(None).cast("double")).alias("number"),
            (F.lit(None).cast("string") if numeric else F.col(f.name).cast("string")).alias("text")))
    return df.select(F.col(key).cast("string").alias("row_key"), F.explode(F.array(*cells)).alias("c")).select(
        "row_key", "c.field", "c.number", "c.text")


# Logical tables of the event model, derived from the stored tables.

def event_rows(spark: SparkSession, folder: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """``(recid, uid, t, eid, kind, value)``: the stored events as per-entity trains.

    Fifteen neighbouring entities share a recording, so recordings grow in number, not in size.
    """
    e = read_table(spark, folder, "events")
    if kinds:
        e = e.where(F.col("event_type").isin(list(kinds)))
    return e.select(
        F.floor(F.col("user_id") / 15).alias("recid"), F.col("user_id").alias("uid"), seconds("ts").alias("t"),
        F.col("event_id").alias("eid"), F.col("event_type").alias("kind"), "value")


def triggers(spark: SparkSession, folder: str, kind: str = "purchase") -> DataFrame:
    """``(recid, win_id, t, amp)``: events of one kind seen as stimuli of the recording."""
    return event_rows(spark, folder, [kind]).select("recid", F.col("eid").alias("win_id"), "t", F.col("value").alias("amp"))


def event_windows(spark: SparkSession, folder: str, kind: str, pre: float, post: float) -> DataFrame:
    """``(recid, win_id, t0, t1)``: a window around every event of a kind."""
    return triggers(spark, folder, kind).select(
        "recid", "win_id", (F.col("t") - pre).alias("t0"), (F.col("t") + post).alias("t1"))


def tiles(ev: DataFrame, width: float, key: str = "recid") -> DataFrame:
    """``(recid, win_id, t0, t1)``: the fixed-width tiles in which a recording has events."""
    k = F.floor(F.col("t") / F.lit(float(width)))
    return ev.select(key, k.alias("win_id")).distinct().select(
        key, "win_id", (F.col("win_id") * F.lit(float(width))).alias("t0"),
        ((F.col("win_id") + 1) * F.lit(float(width))).alias("t1"))


def trace(spark: SparkSession, folder: str) -> DataFrame:
    """``(recid, i, t, v)``: event values in time order as an equally indexed trace, i from 0."""
    ev = event_rows(spark, folder).select("recid", "eid", "t", F.col("value").alias("v"))
    return scan(ev, "recid", ["t", "eid"], time_chunk("t", DAY), _r="row").select(
        "recid", (F.col("_r") - 1).alias("i"), "t", "v")
