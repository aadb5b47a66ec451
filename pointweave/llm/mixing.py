"""Mixing sources to target weights by Pfair scheduling (operator 5); DataFrame functions only.

Each source's rows are cut into blocks. With target weight ``w`` block ``k`` of a source is released at ``floor(k / w)``
and due by ``ceil((k + 1) / w)``; earliest deadline first over the released blocks then keeps every source within one
block of its share at every moment. Weights are whole numbers of ``SCALE`` parts, which is the precision of a float, so
this holds against the targets themselves however long the schedule is. A block has ``BLOCK_ROWS`` rows, or as many as
keep the schedule within ``MOST_SLOTS`` slots: the driver lays out a bounded list of numbers (no data) whatever the number
of rows, and rows look their slot up in it.

The mix ends when the last source has been seen once. Sources that are through earlier start over, so no document is
lost and every document's number of turns differs from its neighbours' by at most one.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, table
from .registry import llm_query

BLOCK_ROWS = 16
#: Slots of the whole schedule, up to one or two more for each source (8 bytes each on the driver and in the broadcast).
MOST_SLOTS = 400_000
#: Parts of all weights together.
SCALE = 1 << 60
#: Slots of a source in one row of the layout.
SLOTS = 256
#: Default target: rows of a source to this power, normalised. Below one it lifts small sources.
TEMPER = 0.9
BUCKET_BITS = 12


def parts_of(weights: list[float], period: int) -> list[int]:
    """Whole parts of ``period`` by largest remainder; a source that would get none takes one from the largest."""
    total = sum(map(Fraction, weights))
    exact = [Fraction(w) * period / total for w in weights]
    parts = [int(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (parts[i] - exact[i], i))[: period - sum(parts)]:
        parts[i] += 1
    for i in range(len(parts)):
        if not parts[i]:
            parts[parts.index(max(parts))] -= 1
            parts[i] = 1
    return parts


def rows_of_block(totals: list[int], share: list[float], block_rows: int, most: int) -> int:
    """The block size from ``block_rows`` on with which the mix ends within ``most`` slots: its length in rows is set by the
    source that needs longest at its share."""
    longest = max(n * sum(map(Fraction, share)) / Fraction(w) for n, w in zip(totals, share, strict=True))
    return max(block_rows, -(-int(longest) // most))


def pfair(parts: list[int], blocks: list[int] | None = None) -> list[array]:
    """For each source its slots, by earliest deadline first among released blocks.

    The schedule covers one period of ``sum(parts)`` slots, or with ``blocks`` ends when each source had so many slots.
    Then those blocks are also due by the earliest end that their number allows, so that a source whose only block may
    wait does not make the others start over; the end moves on when that cannot be kept.
    """
    period = sum(parts)
    if not blocks:
        return _earliest_deadline(parts, parts, period)
    end = max((b - 1) * period // p + 1 for b, p in zip(blocks, parts, strict=True))
    while (used := sum(max(end * p // period, b) for b, p in zip(blocks, parts, strict=True))) > end:
        end = used
    step = len(parts)
    while not (slots := _earliest_deadline(parts, blocks, end)):
        end, step = end + step, 2 * step
    return slots


def _earliest_deadline(parts: list[int], blocks: list[int], end: int) -> list[array]:
    """The slots until each source had ``blocks``, due by ``end``; an empty list if a deadline is missed."""
    period = sum(parts)
    waiting = [(0, s) for s in range(len(parts))]
    ready: list[tuple[int, int]] = []
    slots = [array("q") for _ in parts]
    t, short = 0, len(parts)
    while short:
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            k = len(slots[s])
            due = -(-(k + 1) * period // parts[s])
            heapq.heappush(ready, (min(due, end) if k < blocks[s] else due, s))
        due, s = heapq.heappop(ready)
        if due <= t:
            return []
        slots[s].append(t)
        t += 1
        k = len(slots[s])
        short -= k == blocks[s]
        heapq.heappush(waiting, (max(t, k * period // parts[s]), s))
    return slots


def mix(docs: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, temper: float = TEMPER, period: int | None = None) -> tuple[DataFrame, int]:
    """``docs`` plus ``mix_position`` (long), ``mix_slot`` (long), ``mix_epoch`` (int), and the end of all positions.

    ``weights`` names the target of each source (others: weight 0 is not possible, they count as the smallest named
    one); without it targets are row counts to the power ``temper``. ``period`` rounds the targets to whole parts of so many
    slots (at least four a source), which then repeat; without it they hold as they are. The number of sources is that of a configuration:
    one row per source reaches the driver. A null source is a source of its own. Rows are taken in the order of a hash
    of all their columns; equal rows are all kept. An empty table gives an empty result. New columns get underscores in
    front if ``docs`` has their names. Weights of zero and below are refused. ``block_rows`` is the least size of a block.
    """
    spark = docs.sparkSession
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    cols = inner.columns
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"c{names.index(source)}").cast("string")), F.lit("n"))
    rows = inner.withColumn("skey", key).withColumn("h", F.xxhash64(*cols)).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    below = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(rows.groupBy("skey", "bucket").agg(F.count("*").alias("n")).withColumn("low", F.coalesce(F.sum("n").over(below), F.lit(0))), "mix")
    totals = {r["skey"]: r["n"] for r in starts.groupBy("skey").agg(F.sum("n").alias("n")).orderBy("skey").collect()}
    plan, chunks, slots_all = [], [], 0
    if totals:
        if weights:
            named = {"n" if k is None else f"s{k}": w for k, w in weights.items()}
            share = [named.get(k, min(named.values())) for k in totals]
        else:
            share = [n**temper for n in totals.values()]
        if min(share) <= 0:
            raise ValueError("a target weight must be above zero")
        block_rows = rows_of_block(list(totals.values()), share, block_rows, MOST_SLOTS)
        blocks = [-(-n // block_rows) for n in totals.values()]
        slots = pfair(parts_of(share, max(period, 4 * len(totals)) if period else SCALE), blocks)
        slots_all = 1 + max(own[-1] for own in slots)
        for k, b, own in zip(totals, blocks, slots, strict=True):
            plan.append((k, b, len(own)))
            cuts = np.append(np.arange(0, len(own), SLOTS), len(own)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(own, np.int64)))
            chunks.append(pa.table({"skey": [k] * len(lists), "chunk": np.arange(len(lists)), "own": lists}))
    layout = spark.createDataFrame(plan, "skey string, blocks long, turns long")
    kinds = pa.schema([("skey", pa.string()), ("chunk", pa.int64()), ("own", pa.list_(pa.int64()))])
    schedule = spark.createDataFrame(pa.concat_tables([kinds.empty_table(), *(c.cast(kinds) for c in chunks)]))
    inside = Window.partitionBy("skey", "bucket").orderBy("h", *cols)
    ranked = rows.join(starts.select("skey", "bucket", "low"), ["skey", "bucket"]).withColumn("rank", F.col("low") + F.row_number().over(inside) - 1)
    # one row per source, and at most MOST_SLOTS numbers
    timed = ranked.join(F.broadcast(layout), "skey").withColumn("block", F.expr(f"rank div {block_rows}"))
    timed = timed.withColumn("epoch", F.explode(F.expr("sequence(0L, (turns - 1 - block) div blocks)")))
    timed = timed.withColumn("turn", F.col("block") + F.col("epoch") * F.col("blocks"))
    timed = timed.withColumn("chunk", F.expr(f"turn div {SLOTS}")).join(F.broadcast(schedule), ["skey", "chunk"])
    timed = timed.withColumn("slot", F.get("own", (F.col("turn") % SLOTS).cast("int")))
    place = F.col("slot") * block_rows + F.col("rank") % block_rows
    added = {"mix_position": place, "mix_slot": F.col("slot"), "mix_epoch": F.col("epoch").cast("int")}
    out = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return timed.select(*out, *[c.alias(free_name(names, n)) for n, c in added.items()]), slots_all * block_rows


def mix_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the documents in mixed order, small sources repeated as their weight asks."""
    names = docs.columns
    mixed, end = mix(docs)
    position = free_name(names, "mix_position")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.expr(f"cast({position} * {n}L div {max(end, 1)}L as int)")
    return mixed.repartitionById(n, part).sortWithinPartitions(position).select(*names)


@llm_query("op5_pfair_mix")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    mixed, _ = mix(table(spark, folder, "documents").select("doc_id", "source", "n_chars"))
    return mixed.select("doc_id", "source", F.col("mix_slot").alias("slot"), F.col("mix_position").alias("position"), F.col("mix_epoch").alias("epoch"))
