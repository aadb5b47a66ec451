"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (operator 2).

Every shard owns ``vnodes`` points of a 64-bit ring; a row belongs to the owner of the first point clockwise of its
hash. A shard takes at most its capacity; rows that find it full go on clockwise to the next point whose owner has
room. Capacities add up to the number of rows (law ``rows``: counts at most one apart) or leave ``slack`` on top.

The ring is cut into cells by the points and an even grid of ``2**grid_bits`` bounds. Only the row count of every cell
(at most ``2**grid_bits + shards * vnodes`` numbers, whatever the input) reaches the driver, which lets the cells flow
round the ring. Rows are then ranked inside their cell, and rank plus cell start decide shard and slot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .registry import llm_query

SHARDS, VNODES, GRID_BITS = 40, 100, 16


def ring_points(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Positions (sorted, signed 64 bit) and owners; the points of a shard do not depend on the number of shards."""
    made = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s)
        for s in range(shards) for v in range(vnodes)
    )
    return np.array([p for p, _ in made], np.int64), np.array([s for _, s in made], np.int64)


def flow(cells_owner: np.ndarray, counts: np.ndarray, shards: int, capacity: np.ndarray) -> np.ndarray:
    """Segments (first global rank, shard, first slot) after overflow, ordered by rank.

    Rows are ranked clockwise. Own rows come first: a shard fills from its cells in ring order; what is left over then
    walks on, in ring order, to the next cell whose owner still has room.
    """
    start = np.concatenate([[0], np.cumsum(counts)])
    room, pieces, waiting = capacity.astype(np.int64).copy(), [], []
    for c in np.flatnonzero(counts):
        s, n = cells_owner[c], int(counts[c])
        took = min(n, int(room[s]))
        room[s] -= took
        if took:
            pieces.append((int(start[c]), took, int(s)))
        if took < n:
            waiting.append((c, int(start[c]) + took, n - took))
    open_cells = np.flatnonzero(room[cells_owner] > 0)
    for c, first, n in waiting:
        while n:
            at = int(np.searchsorted(open_cells, c))
            s = int(cells_owner[open_cells[at % len(open_cells)]])
            took = min(n, int(room[s]))
            room[s] -= took
            pieces.append((first, took, s))
            first, n = first + took, n - took
            if not room[s]:
                open_cells = open_cells[cells_owner[open_cells] != s]
    pieces.sort()
    used = np.zeros(shards, np.int64)
    out = np.zeros((len(pieces), 3), np.int64)
    for i, (first, n, s) in enumerate(pieces):
        out[i] = first, s, used[s]
        used[s] += n
    return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """Without slack: floor or ceiling of the mean, adding up to ``rows``. With slack: the mean times (1 + slack), rounded up."""
    if slack > 0:
        return np.full(shards, int(np.ceil(rows * (1 + slack) / shards)), np.int64)
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def shard(docs: DataFrame, keys: list[str], shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0, grid_bits: int = GRID_BITS) -> DataFrame:
    """``keys`` of every row with its ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    The ring position is the hash of all ``keys``. Rows equal in all keys are counted first and travel as one row until
    the end, so any number of them can be split over shards; which of them gets which slot is immaterial. Null keys are
    values like others. An empty table gives an empty result. Columns of ``docs`` outside ``keys`` are not read.
    """
    points, owners = ring_points(shards, vnodes)
    grid = (np.arange(1, 1 << grid_bits, dtype=np.int64) << (64 - grid_bits)) + np.iinfo(np.int64).min
    bounds = np.unique(np.concatenate([grid, points]))
    cell_owner = owners[np.searchsorted(points, np.concatenate([bounds, [np.iinfo(np.int64).max]])) % len(points)]

    @F.pandas_udf(T.IntegerType())
    def cell_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, h.to_numpy(), side="left").astype(np.int32))

    names = [f"k{i}" for i in range(len(keys))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)])
    rows = rows.groupBy(*names).agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64(*names)).withColumn("cell", cell_of("h"))
    counts = np.zeros(len(bounds) + 1, np.int64)
    for r in rows.groupBy("cell").agg(F.sum("copies").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    total = int(counts.sum())
    start = np.concatenate([[0], np.cumsum(counts)])[:-1]
    parts = flow(cell_owner, counts, shards, capacities(total, shards, slack)) if total else np.zeros((1, 3), np.int64)
    first, to, slot0 = parts[:, 0], parts[:, 1], parts[:, 2]

    @F.pandas_udf("shard int, slot long")
    def place(cell: pd.Series, rank: pd.Series) -> pd.DataFrame:
        g = start[cell.to_numpy()] + rank.to_numpy()
        i = np.searchsorted(first, g, side="right") - 1
        return pd.DataFrame({"shard": to[i].astype(np.int32), "slot": slot0[i] + g - first[i]})

    order = Window.partitionBy("cell").orderBy("h", *names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("end", F.sum("copies").over(order))
    # copies travel in runs of at most a thousand, so that many of them unfold in many tasks
    runs = ranked.withColumn("low", F.explode(F.expr("sequence(end - copies, end - 1, 1000L)"))).withColumn("high", F.least(F.col("low") + 999, F.col("end") - 1))
    each = runs.withColumn("rank", F.explode(F.expr("sequence(low, high)"))).withColumn("p", place("cell", "rank"))
    return each.select(*[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)], "p.shard", "p.slot")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16; null text: 16) and text_crc32 (null text: that of the empty text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def write_shards(docs: DataFrame, path: str) -> None:
    """Write placed rows as one folder per shard."""
    docs.write.partitionBy("shard").parquet(path)


@llm_query("op2_ring_sharding")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = sized(table(spark, folder, "documents"))
    placed = shard(docs, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
