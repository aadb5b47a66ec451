"""What several operators share: shared folders, Arrow slices of bounded size, words, hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one step of a vectorised function holds at a time (a single longer text is a step of its own).
SLICE_BYTES = 2_000_000
#: Bytes of an Arrow batch between Spark and Python: rows alone would let long texts fill either side.
BATCH_BYTES = 4_000_000
#: Edges to a file while components are joined.
FILE_ROWS = 100_000
_OWN: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only a local session without that setting (tests) gets a local one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = _OWN.setdefault("top", tempfile.mkdtemp(prefix="pointweave-"))
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def bounded_batches(spark: SparkSession, free: bool = False) -> Iterator[None]:
    """What runs inside passes Arrow batches of at most ``BATCH_BYTES`` (or one row); ``free``: and gives up its shuffle files."""
    wanted = {_BATCH: str(BATCH_BYTES)} | ({_CLEANUP: "true"} if free else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, what: str, free: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later steps neither recompute it nor depend on executors.

    ``free``: the shuffle files of this step go as soon as the table is complete.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, what)
    with bounded_batches(spark, free):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or with underscores in front until no column (in any case) has that name."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column, null as the empty text."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(array: pa.Array) -> pa.Array:
    return pc.ascii_lower(array)


def words(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (offsets per text, all words in order)."""
    lists = pc.ascii_split_whitespace(array)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        offsets, flat = kept[offsets], flat.filter(full)
    return offsets, flat


def codes(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the words of a slice and the distinct words."""
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash

    hash_ = xxhash.xxh3_64_intdigest
    return np.fromiter((hash_(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)


def combine(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each tuple of hashes, in order."""
    out = columns[0].astype(np.uint64, copy=True)
    for c in columns[1:]:
        out = mix(out) * _STEP + c
    return mix(out)


def shingle_sets(array: pa.Array, k: int, crowd: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each text its sorted distinct ``k``-word shingle hashes; fewer words make one shingle, no words none.

    ``crowd`` gives a number for each word hash; with it comes, for each shingle, the least number of its words.
    """
    offsets, flat = words(array)
    index, distinct = codes(flat)
    own = word_hashes(distinct)
    h, n = own[index], len(index)
    rolled = combine([h[i : n - k + 1 + i] for i in range(k)]) if n >= k else np.empty(0, np.uint64)
    least = whole = None
    if crowd:
        whole = crowd(own)[index]
        least = whole[: max(n - k + 1, 0)].copy()
        for i in range(1, k):
            np.minimum(least, whole[i : n - k + 1 + i], out=least)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            part = rolled[a : b - k + 1]
            if crowd:
                order = np.argsort(part)
                part, most = part[order], least[a : b - k + 1][order]
            else:
                part, most = np.sort(part), None
            fresh = part[1:] != part[:-1]
            if not fresh.all():
                keep = np.concatenate([[True], fresh])
                part, most = part[keep], most[keep] if crowd else None
            yield part, most
        elif b > a:
            yield np.array([combine([h[a + i : a + i + 1] for i in range(b - a)])[0] ^ np.uint64(b - a)], np.uint64), whole[a:b].min(keepdims=True) if crowd else None
        else:
            yield np.empty(0, np.uint64), np.empty(0, np.uint32) if crowd else None


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for undirected ``edges``: component is the smallest node reachable.

    Large-star and small-star steps alternate until the edge set no longer changes. Each step is one or two joins by
    node, writes its edges to the shared folder, and never gathers a component in one place. A node that everything
    hangs on is only ever the *value* of its neighbours' minimum, so its row count is not grouped in a task: minima
    are pre-aggregated before the shuffle.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "edges")
    last = None
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u moves to the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        # no more files than the edges of the last round fill
        edges = materialise(small.coalesce(min(most, 8 + (last[0] if last else FILE_ROWS * most) // FILE_ROWS)), "edges")
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == last:
            break
        last = (mark["n"], mark["h"])
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
