"""Constrained permutation of two categories and the enrichment statistics built on it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import hash_key, names, ratio
from .aggregate import crosstab, levels_grid
from ..session import cut_lineage
from .filters import dense_ids
from .scan import hash_chunk, join_null_safe, scan

# P levels of the signed significance code.
P_LEVELS = (0.05, 0.01, 0.001)
#: Repetitions that one task draws together.
REP_BLOCK = 250
#: Cells times repetitions of a random table that one task draws.
TASK_CELLS = 20_000_000
#: Entities of a hash prefix, and ranks of a block in which both attributes meet.
CHUNK = 65_536
#: Tasks that share even few rows, rows that a task packs together, and entities that a task orders.
SPREAD, PACK_ROWS, TASK_KEYS = 48, 500_000, 2_000_000
#: Cells of (group, level, level) up to which their codes are broadcast.
BROADCAST_CELLS = 200_000


def permute_counts(
    df: DataFrame, entity: str, a1: str, a2: str, const: Sequence[str] | str, reps: int, by: Sequence[str] | str = (),
    salts: tuple[str, str] = ("a", "b"),
) -> DataFrame:
    """``(by, rep, a1, a2, n)``: cell counts after shuffling both attributes inside each constant group.

    Both attributes get a rank from a salted md5 of (rep, entity) and are paired by rank, so a run is repeatable and
    does not depend on partitioning. Groups and levels travel as codes. A row of the shuffle is a piece of a group: the
    entities of one digest prefix in ascending order, as compressed differences, with the codes of one attribute. Digests
    cannot be compressed, so they do not travel: the task that orders a prefix takes them again. A prefix holds about
    ``CHUNK`` entities, however large the group; its sorted codes and the number of entities before it are the ranks.
    """
    by, const = names(by), [c for c in names(const) if c not in names(by)]
    if not by + const:
        df, const = df.withColumn("_whole", F.lit(0)), ["_whole"]
    group = by + const
    cells = df.groupBy(*group, a1, a2).agg(F.count(F.lit(1)).alias("_n"))
    for cols, code in ((group, "_gid"), ([a1], "_c1"), ([a2], "_c2")):
        cells = dense_ids(cells, cols, code)
    cells = cut_lineage(cells)
    size = cells.agg(F.count(F.lit(1)), F.sum("_n"), F.max("_c1"), F.max("_c2"), F.max("_gid")).first()
    dtype = np.min_scalar_type(max(size[2] or 0, size[3] or 0))
    spread = 1 + max(min((size[1] or 0) // 8192, SPREAD), (size[1] or 0) // PACK_ROWS)
    parts = 1 + 2 * reps * (size[1] or 0) // TASK_KEYS
    codes = join_null_safe(cells, cells.groupBy("_gid").agg(F.sum("_n").alias("_all")), ["_gid"]).drop("_n")
    codes = F.broadcast(codes) if size[0] <= BROADCAST_CELLS else codes
    whole = df.schema[entity].dataType.typeName() in ("byte", "short", "integer", "long")
    coded = join_null_safe(df.select(*group, a1, a2, F.col(entity).cast("long" if whole else "string").alias("_id")), codes, [*group, a1, a2])
    pack, order, tally = _rank_tasks(reps, salts, dtype, (size[3] or 0) + 1, whole)
    keys = ["side", "rep", "gid", "chunk"]
    coded = coded.select("_gid", "_all", "_c1", "_c2", "_id").repartition(spread, F.coalesce("_id", F.col("_c1").cast("long" if whole else "string")))
    pieces = coded.mapInArrow(pack, "side int, rep int, gid long, chunk long, rows int, nulls int, raw int, ids binary, codes binary")
    chunks = pieces.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(order, "side int, rep int, gid long, chunk long, n long, codes binary")
    chunks = cut_lineage(chunks)
    before = F.sum("n").over(Window.partitionBy("side", "rep", "gid").orderBy("chunk")) - F.col("n")
    starts = chunks.select(*keys, before.alias("start"))  # a row for each chunk, the codes stay where they are
    few = 2 * reps * ((size[4] or 0) + 1 + 2 * (size[1] or 0) // CHUNK) <= BROADCAST_CELLS
    chunks = chunks.join(F.broadcast(starts) if few else starts, keys)
    blocks = chunks.withColumn("block", F.explode(F.expr(f"sequence(start div {CHUNK}, (start + n - 1) div {CHUNK})")))
    blocks = blocks.withColumns({"lo": F.greatest("start", F.col("block") * CHUNK), "hi": F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * CHUNK)})
    cut = lambda col, at, lo, hi: F.expr(f"substring({col}, cast(({lo} - {at}) * {dtype.itemsize} + 1 as int), cast(({hi} - {lo}) * {dtype.itemsize} as int))")
    meet = ["rep", "gid", "block"]
    blocks = blocks.select("side", *meet, "lo", "hi", cut("codes", "start", "lo", "hi").alias("codes"))
    a, b = (blocks.where(F.col("side") == i).select(*meet, *[F.col(c).alias(c + str(i)) for c in ("lo", "hi", "codes")]).repartition(parts, *meet) for i in (0, 1))
    paired = a.join(b, meet).where("lo0 < hi1 AND lo1 < hi0").withColumns({"lo": F.greatest("lo0", "lo1"), "hi": F.least("hi0", "hi1")})
    paired = paired.select("rep", "gid", cut("codes0", "lo0", "lo", "hi").alias("x"), cut("codes1", "lo1", "lo", "hi").alias("y"))
    n = paired.mapInArrow(tally, "rep int, _gid long, _c1 long, _c2 long, n long").groupBy("rep", "_gid", "_c1", "_c2").agg(F.sum("n").alias("n"))
    for cols, code in ((by, "_gid"), ([a1], "_c1"), ([a2], "_c2")):
        n = n.join(cells.select(code, *cols).distinct(), code)
    return n.groupBy(*by, "rep", a1, a2).agg(F.sum("n").alias("n"))


def _rank_tasks(reps: int, salts: tuple[str, str], dtype: np.dtype, width: int, whole: bool):
    """The steps on packed pieces: entities of the rows of a task by digest prefix, codes in the order of the digests, counts of pairs.

    ``whole``: entities are whole numbers. Entities with one digest are the same one, and are ordered by their codes.
    """
    def digests(side: int, rep: int, words: Sequence[bytes]) -> np.ndarray:
        salt = f"{salts[side]}_{rep}".encode()
        return np.frombuffer(b"".join([hashlib.md5(salt + w, usedforsecurity=False).digest() for w in words]), ">u8").reshape(-1, 2)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tables(batches, lambda t: t.num_rows >= PACK_ROWS):
            t = t.sort_by([("_id", "ascending")])  # NULL last
            gids, g = np.unique(t["_gid"].to_numpy(), return_inverse=True)
            total = np.zeros(len(gids), np.int64)
            total[g] = t["_all"].to_numpy()
            bits = np.ceil(np.log2(np.maximum(total / CHUNK, 1))).astype(np.uint64)
            first = np.concatenate([[0], np.cumsum(1 << bits.astype(np.int64))])  # number of a group's first chunk
            known = t.num_rows - t["_id"].null_count
            ids = t["_id"].combine_chunks()
            values = ids.slice(0, known).to_numpy(zero_copy_only=False)
            _, at = np.unique(values, return_index=True)  # a repeated entity is digested once
            of_id = np.append(np.repeat(np.arange(len(at)), np.diff(np.append(at, known))), np.full(t.num_rows - known, len(at)))
            words = [_word(x) for x in values[at].tolist()] + [b""]
            for side, code in enumerate(("_c1", "_c2")):
                own = t[code].to_numpy().astype(dtype)
                for rep in range(reps):
                    high = digests(side, rep, words)[:, 0].astype(np.uint64)[of_id]
                    chunk = first[g] + np.where(bits[g] == 0, 0, high >> np.where(bits[g] == 0, 0, 64 - bits[g])).astype(np.int64)
                    to = np.argsort(chunk, kind="stable")
                    start = np.flatnonzero(np.diff(chunk[to], prepend=-1))
                    of = g[to[start]]
                    ends = np.append(start, len(to))
                    nulls = np.add.reduceat(to >= known, start, dtype=np.int32)
                    parts = [_squeezed(values[to[i : j - n]], whole) for i, j, n in zip(ends[:-1], ends[1:], nulls, strict=True)]
                    yield pa.record_batch({
                        "side": pa.array(np.full(len(start), side, np.int32)), "rep": pa.array(np.full(len(start), rep, np.int32)), "gid": pa.array(gids[of]),
                        "chunk": pa.array(chunk[to[start]] - first[of]), "rows": pa.array(np.diff(ends).astype(np.int32)), "nulls": pa.array(nulls),
                        "raw": pa.array([len(x) for x in parts], pa.int32()), "ids": pa.array([pa.compress(x, "zstd", asbytes=True) for x in parts], pa.binary()),
                        "codes": _binary(own[to], ends * dtype.itemsize)})

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["side", "rep", "gid", "chunk"]
        for t, new in _whole_keys(batches, keys):
            rows = t["rows"].to_numpy()
            d = np.empty((rows.sum(), 2), np.uint64)
            end = 0
            for side, rep, n, nulls, raw, ids in zip(*[t[c] for c in ("side", "rep", "rows", "nulls", "raw", "ids")], strict=True):
                values = _unsqueezed(pa.decompress(ids.as_buffer(), raw.as_py(), "zstd"), n.as_py() - nulls.as_py(), whole)
                d[end : end + n.as_py()] = digests(side.as_py(), rep.as_py(), [_word(x) for x in values] + [b""] * nulls.as_py())
                end += n.as_py()
            codes = _bytes(t["codes"])[0].view(dtype)
            at = np.repeat(np.cumsum(new), rows)
            to = np.lexsort((d[:, 0], at))
            if ((np.diff(d[to, 0]) == 0) & (np.diff(at[to]) == 0)).any():
                to = np.lexsort((codes, d[:, 1], d[:, 0], at))
            start = np.flatnonzero(np.diff(at, prepend=0))
            ends = np.append(start, len(at))
            first = t.filter(pa.array(new)).select(keys).to_batches()
            head = pa.Table.from_batches(first).combine_chunks()
            yield pa.record_batch({k: head[k].chunk(0) for k in keys} | {"n": pa.array(np.diff(ends)), "codes": _binary(codes[to], ends * dtype.itemsize)})

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):  # a row has at most CHUNK pairs
                t = pa.Table.from_batches([whole.slice(i, 64)])
                (x, ends), (y, _) = _bytes(t["x"]), _bytes(t["y"])
                pair = x.view(dtype).astype(np.int64) * width + y.view(dtype)
                row = pd.MultiIndex.from_arrays([t["rep"].to_numpy(), t["gid"].to_numpy()]).factorize()
                group = np.repeat(row[0], np.diff(ends) // dtype.itemsize)
                cell, where = np.unique(pair, return_inverse=True)
                key, n = np.unique(group * len(cell) + where, return_counts=True)
                head, got = row[1][key // len(cell)], cell[key % len(cell)]
                yield pa.record_batch({
                    "rep": pa.array(head.get_level_values(0).to_numpy().astype(np.int32)), "_gid": pa.array(head.get_level_values(1).to_numpy().astype(np.int64)),
                    "_c1": pa.array(got // width), "_c2": pa.array(got % width), "n": pa.array(n.astype(np.int64))})

    return pack, order, tally


def _word(entity: int | str) -> bytes:
    """What follows the salt of an entity, as in ``salt_rep_entity``."""
    return f"_{entity}".encode()


def _squeezed(entities: np.ndarray, whole: bool) -> bytes:
    """Ascending entities as bytes that compress well: differences, or lengths and texts; equal places of the numbers stand together."""
    texts = [] if whole else [x.encode() for x in entities]
    numbers = np.diff(entities.astype(np.int64).view(np.uint64), prepend=np.uint64(0)) if whole else np.array([len(x) for x in texts], np.uint64)
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + b"".join(texts)


def _unsqueezed(data: pa.Buffer, n: int, whole: bool) -> list[int] | list[str]:
    data = memoryview(data)
    numbers = np.frombuffer(data[: 8 * n], np.uint8).reshape(8, -1).T.copy().view("<u8")[:, 0].astype(np.uint64)
    ends = np.cumsum(numbers, dtype=np.uint64)
    if whole:
        return ends.view(np.int64).tolist()
    text = bytes(data[8 * n :])
    return [text[j - k : j].decode() for j, k in zip(ends.tolist(), numbers.tolist(), strict=True)]


def _tables(batches: Iterator[pa.RecordBatch], full: Callable[[pa.Table], bool]) -> Iterator[pa.Table]:
    """Batches joined until they are ``full``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held += [b] if b.num_rows else []
        if held and full(pa.Table.from_batches(held)):
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches ordered by integer ``keys`` cut so that no key is in two of them, each with marks at the first row of a key."""
    held = None

    def marks(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([np.diff(t[k].to_numpy()) != 0 for k in keys], axis=0)
        return new

    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            new = marks(t)
            last = int(np.flatnonzero(new)[-1])
            held = t.slice(last)
            if last:
                yield t.slice(0, last), new[:last]
    if held is not None:
        yield held, marks(held)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary column of the bytes of ``values`` cut at ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without NULL and where each row ends, with a 0 before."""
    sizes = pc.binary_length(column).to_numpy().astype(np.int64)
    data = b"".join(x.as_buffer() for c in column.chunks for x in c)
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def permute_counts_by_margins(
    df: DataFrame, a1: str, a2: str, const: Sequence[str] | str, reps: int, by: Sequence[str] | str = (), seed: int = 0,
    task_cells: int = TASK_CELLS,
) -> DataFrame:
    """The same null distribution drawn from the margins alone.

    Shuffling inside a constant group only leaves the group's two margins fixed, so each repetition is a draw from the
    multivariate hypergeometric law of its contingency table. Rows are read once and aggregated map-side; what is drawn
    is levels x groups x reps, whatever the row count. A table is drawn as a tree: the levels of ``a1`` are halved, one
    draw for each column says how much of it falls to the first half, and each half is a table of its own. Halves of a
    table with more than ``task_cells`` cells and repetitions go to different tasks until they are small enough.
    """
    by, const = names(by), [c for c in names(const) if c not in names(by)]
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if not by + const:
        df, const = df.withColumn("_whole", F.lit(0)), ["_whole"]
    group = by + const
    cells = df.groupBy(*group, a1, a2).agg(F.count(F.lit(1)).alias("n"))

    def margin(attr: str, out: str) -> DataFrame:
        n = cells.groupBy(*group, attr).agg(F.sum("n").alias("n"))
        return n.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(attr).alias("v"), "n"))).alias(out))

    joined = cut_lineage(join_null_safe(margin(a1, "m1"), margin(a2, "m2"), group))
    tag = F.to_json(F.struct(*group))  # different groups, NULL included, get different streams
    blocks = F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(REP_BLOCK)))
    nodes = joined.select(*by, tag.alias("_g"), blocks.alias("rep"), F.lit("").alias("_path"), "m1", F.col("m2.v").alias("m2"), F.array(F.col("m2.n")).alias("left"))
    halve, draw = _table_tasks(a1, a2, by, reps, seed, task_cells)
    largest = joined.agg(F.max(F.size("m1").cast("long") * F.size("m2"))).first()[0] or 0
    while largest * min(REP_BLOCK, reps) > task_cells and largest > 1:
        nodes = nodes.repartition("_g", "rep", "_path").mapInPandas(halve, nodes.schema)
        largest = (largest + 1) // 2
    schema = "".join(f"`{c}` {fields[c]}, " for c in by) + f"rep int, `{a1}` {fields[a1]}, `{a2}` {fields[a2]}, n bigint"
    drawn = nodes.repartition("_g", "rep", "_path").mapInPandas(draw, schema)
    return drawn.groupBy(*by, "rep", a1, a2).agg(F.sum("n").alias("n"))


def _table_tasks(a1: str, a2: str, by: Sequence[str], reps: int, seed: int, task_cells: int):
    """The two steps on nodes of the tree: hand on the halves of a large one, draw all cells of a small one."""

    def opened(r: dict) -> tuple[np.random.Generator, np.ndarray, np.ndarray]:
        key = hashlib.blake2b(f"{seed}|{r['rep']}|{r['_g']}|{r['_path']}".encode(), digest_size=8).digest()
        left = np.array([np.asarray(x, np.int64) for x in r["left"]])
        if len(left) == 1:  # the root: all repetitions have the same columns
            left = np.tile(left, (min(REP_BLOCK, reps - r["rep"]), 1))
        return np.random.default_rng(int.from_bytes(key, "little")), np.array([x["n"] for x in r["m1"]], np.int64), left

    def halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if len(r["m1"]) * len(r["m2"]) * min(REP_BLOCK, reps) <= task_cells or len(r["m1"]) < 2:
                    out.append(r)
                    continue
                rng, rows, left = opened(r)
                half = len(rows) // 2
                first = _share(rng, left, np.full(len(left), rows[:half].sum()))
                out.append({**r, "_path": r["_path"] + "0", "m1": r["m1"][:half], "left": first.tolist()})
                out.append({**r, "_path": r["_path"] + "1", "m1": r["m1"][half:], "left": (left - first).tolist()})
            if out:
                yield pd.DataFrame(out, columns=pdf.columns)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                rng, rows, left = opened(r)
                table = _random_tables(rng, rows, left)
                t, i, j = np.nonzero(table)
                v1, v2 = np.array([x["v"] for x in r["m1"]], object), np.array(list(r["m2"]), object)
                out.append(pd.DataFrame({c: [r[c]] * len(i) for c in by} | {"rep": r["rep"] + t, a1: v1[i], a2: v2[j], "n": table[t, i, j]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return halve, draw


def exact_moments(df: DataFrame, a1: str, a2: str, const: Sequence[str] | str, by: Sequence[str] | str = ()) -> DataFrame:
    """``(by, a1, a2, n, mean, sd)``: observed count and the exact moments of the null, without any draw.

    In a constant group with N rows, of which r have the row level and c the column level, the count has mean r c / N
    and variance r c (N - r)(N - c) / (N^2 (N - 1)); groups are independent, so both add up.
    """
    by, const = names(by), [c for c in names(const) if c not in names(by)]
    group, one = by + const, F.count(F.lit(1))
    m1 = df.groupBy(*group, a1).agg(one.alias("_r"))
    m2 = df.groupBy(*group, a2).agg(one.alias("_c")).withColumn("_one", F.lit(1))
    whole = df.groupBy(*group).agg(one.alias("_n")).withColumn("_one", F.lit(1))
    cells = join_null_safe(join_null_safe(m1.withColumn("_one", F.lit(1)), m2, [*group, "_one"]), whole, [*group, "_one"])
    r, c, n = (F.col(x).cast("double") for x in ("_r", "_c", "_n"))
    var = F.when(n > 1, r * c * (n - r) * (n - c) / (n * n * (n - 1))).otherwise(0.0)
    null = cells.groupBy(*by, a1, a2).agg(F.sum(r * c / n).alias("mean"), F.sqrt(F.sum(var)).alias("sd"))
    grid = join_null_safe(crosstab(df, a1, a2, by), null, [*by, a1, a2], "left")
    return grid.select(*by, a1, a2, "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("sd", F.lit(0.0)).alias("sd"))


def _share(rng: np.random.Generator, left: np.ndarray, need: np.ndarray) -> np.ndarray:
    """How many of ``need`` items fall to each column of ``left`` (tables, columns): one draw a column for all tables."""
    out, rest = np.empty_like(left), left.sum(axis=1)
    for j in range(left.shape[1]):
        rest = rest - left[:, j]
        out[:, j] = _hypergeometric(rng, left[:, j], rest, need)
        need = need - out[:, j]
    return out


def _random_tables(rng: np.random.Generator, rows: np.ndarray, left: np.ndarray) -> np.ndarray:
    """(reps, rows, columns): a random table with margins ``rows`` for each line of column sums ``left`` (reps, columns).

    All nodes of one level of the tree are split together.
    """
    width = 1 << (len(rows) - 1).bit_length()
    margins = np.zeros(width, np.int64)
    margins[: len(rows)] = rows
    reps, columns = left.shape
    nodes = left[None]
    while width > 1:
        need = margins.reshape(-1, width)[:, : width // 2].sum(axis=1)
        first = _share(rng, nodes.reshape(-1, columns), np.repeat(need, reps)).reshape(nodes.shape)
        nodes = np.stack([first, nodes - first], axis=1).reshape(-1, reps, columns)
        width //= 2
    return nodes[: len(rows)].transpose(1, 0, 2)


def _hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Exact draws; numpy's sampler refuses a billion items or more, those are inverted from the mode."""
    if max(good.max(), bad.max()) < 1_000_000_000:
        return rng.hypergeometric(good, bad, n)
    return np.array([_invert(rng.random(), int(g), int(b), int(k)) for g, b, k in zip(good, bad, n, strict=True)], dtype=np.int64)


def _invert(u: float, good: int, bad: int, n: int) -> int:
    """The smallest x whose cumulative probability exceeds ``u``, summed over all x within 40 deviations of the mode."""
    low, high = max(0, n - bad), min(n, good)
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    wide = int(40 * np.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1)))) + 40
    a, b = max(low, mode - wide), min(high, mode + wide)
    x = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
    logp = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logp - logp.max())
    return a + int(np.searchsorted(np.cumsum(p) / p.sum(), u, side="right"))


def enrichment(
    df: DataFrame, perm: DataFrame, a1: str, a2: str, reps: int, by: Sequence[str] | str = ()
) -> DataFrame:
    """Observed counts against the permuted ones, in one aggregation over the repetitions.

    Columns: ``n`` (observed), ``mean`` and ``sd`` (population, absent cells count as 0), ``z``, ``pofs``
    (percentile of score, average of strict and weak), ``level`` (signed code). Cells run over all levels.
    """
    by = names(by)
    keys = [*by, a1, a2]
    obs = crosstab(df, a1, a2, by)
    stat = join_null_safe(obs.withColumnRenamed("n", "_o"), perm, keys, "left").groupBy(*keys).agg(
        F.max("_o").alias("n"), F.sum("n").alias("_s"), F.sum(F.col("n").cast("double") * F.col("n")).alias("_q"), F.count("n").alias("_k"),
        F.count(F.when(F.col("n") < F.col("_o"), 1)).alias("_lt"), F.count(F.when(F.col("n") <= F.col("_o"), 1)).alias("_le"))
    r = F.lit(float(reps))
    mean = F.coalesce("_s", F.lit(0)) / r
    sd = F.sqrt(F.greatest(F.coalesce("_q", F.lit(0.0)) / r - mean * mean, F.lit(0.0)))
    absent = F.lit(reps) - F.col("_k")
    lt = F.col("_lt") + F.when(F.col("n") > 0, absent).otherwise(0)
    le = F.col("_le") + absent
    e = stat.select(*keys, "n", mean.alias("mean"), sd.alias("sd"), percentile_of_score(lt, le, r).alias("pofs"))
    return e.withColumns({"z": enrichment_z("n", "mean", "sd"), "level": signif_level("pofs")})


def null_moments(
    perm: DataFrame, a1: str, a2: str, reps: int, by: Sequence[str] | str = (), source: DataFrame | None = None
) -> DataFrame:
    """Mean and population sd of every cell over the repetitions; a repetition without the cell counts as 0.

    ``source``, the table that was permuted, gives the category levels without running the permutation again.
    """
    by = names(by)
    g = perm.groupBy(*by, a1, a2).agg(F.sum("n").alias("_s"), F.sum(F.col("n").cast("double") * F.col("n")).alias("_q"))
    full = join_null_safe(levels_grid(g if source is None else source, a1, a2, by), g, [*by, a1, a2], "left")
    mean = F.coalesce("_s", F.lit(0)) / F.lit(float(reps))
    var = F.coalesce("_q", F.lit(0.0)) / F.lit(float(reps)) - mean * mean
    return full.select(*by, a1, a2, mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))


def enrichment_z(n: str, mean: str, sd: str) -> Column:
    return ratio(F.col(n) - F.col(mean), sd)


def percentile_of_score(lt: Column, le: Column, reps: Column) -> Column:
    """Percentile rank from the counts of strictly smaller and not larger values."""
    return (lt + le + (lt < le).cast("int")) * 50.0 / reps


def signif_level(pofs: str) -> Column:
    """Code 1, 2, 3 by the first to last p level passed strictly, negative below the median side."""
    out = F.lit(0)
    for k, p in enumerate(P_LEVELS, start=1):
        out = F.when(F.col(pofs) > 100 - 100 * p, k).when(F.col(pofs) < 100 * p, -k).otherwise(out)
    return out


def separation_index(e: DataFrame, by: Sequence[str] | str = (), pofs: str = "pofs") -> DataFrame:
    return e.groupBy(*names(by)).agg(F.avg(F.abs(F.col(pofs) - 50) / 50).alias("si"))


def pofs_to_p(pofs: str) -> Column:
    return F.when(F.col(pofs) < 50, F.col(pofs) / 100).otherwise((100 - F.col(pofs)) / 100)


def stack_views(df: DataFrame, entity: str, cat: str, views: Mapping[str, tuple[str, Sequence[str], Column | None]]) -> DataFrame:
    """Long table ``(view, entity, a1, a2, const)`` of several attribute/constraint/subset choices.

    All views are made in one pass over the rows and shuffled in one job.
    """
    parts = []
    for name, (attr, const, where) in views.items():
        c = F.concat_ws("|", *[F.col(x).cast("string") for x in const]) if const else F.lit("")
        s = F.struct(F.lit(name).alias("view"), F.col(attr).cast("string").alias("a1"), c.alias("const"))
        parts.append(s if where is None else F.when(where, s))
    return df.select(F.col(entity), F.col(cat).alias("a2"), F.explode(F.array_compact(F.array(*parts))).alias("v")).select(
        "v.view", entity, "v.a1", "a2", "v.const")


def presel(e: DataFrame, a1: str, n_min: int, rule: Column | None = None) -> DataFrame:
    """Groups with more than ``n_min`` observed members (row total) and an acceptable label."""
    totals = e.groupBy(a1).agg(F.sum("n").alias("_t")).where(F.col("_t") > n_min).select(a1)
    out = e.join(totals, a1, "left_semi")
    return out if rule is None else out.where(rule)


def fuse_significant(e: DataFrame, view: str, a1: str, label: str) -> DataFrame:
    """One row set per attribute: the enrichment of its significant members, named after the attribute."""
    return e.where(F.col(a1) == label).withColumn(a1, F.col(view)).drop(view)


def shuffle_edges(edges: DataFrame, reps: int, src: str = "src", dst: str = "dst", weight: str = "w") -> DataFrame:
    """``(rep, src, dst, w)``: weights of an upper-triangle edge list permuted over its positions."""
    e = edges.where(F.col(src) < F.col(dst)).select(src, dst, weight)
    each = e.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    at = each.withColumn("_h", hash_key("pos", src, dst))
    pos = scan(at, "rep", ["_h", src, dst], hash_chunk("_h"), _r="row").select("rep", src, dst, "_r")
    wt = each.withColumn("_h", hash_key("w", "rep", src, dst))
    drawn = scan(wt, "rep", ["_h", src, dst], hash_chunk("_h"), _r="row").select("rep", "_r", weight)
    return pos.join(drawn, ["rep", "_r"]).drop("_r")
