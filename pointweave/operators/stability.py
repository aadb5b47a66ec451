"""Blocks of windows and category transitions between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import finite, names, ratio, sq_distance
from .aggregate import levels_grid, with_share
from .scan import join_null_safe, scan


def _tile_of(row: Column, n: Column, k: Column) -> Column:
    """Part (1-based) of a 1-based row when ``n`` rows are cut into ``k`` parts, larger parts first."""
    q, r = F.floor(n / k), n % k
    big = r * (q + 1)
    return F.when(row <= big, F.floor((row - 1) / (q + 1)) + 1).otherwise(
        r + F.floor((row - 1 - big) / F.greatest(q, F.lit(1))) + 1).cast("bigint")


def equal_parts(
    df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str, k: int | Column, out: str, chunk: Column | None = None
) -> DataFrame:
    """Cut each key's ordered rows into ``k`` nearly equal parts numbered from 1 (larger parts first)."""
    order = names(order)
    by = F.floor(F.col(order[0]) / F.lit(4096.0)) if chunk is None else chunk
    r = scan(df, keys, order, by, _r="row", _n=("total", F.lit(1)))
    parts = F.lit(k) if isinstance(k, int) else k
    return r.withColumn(out, _tile_of(F.col("_r"), F.col("_n"), parts)).drop("_r", "_n")


def chop_blocks(win: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str, n_per: int, chunk: Column | None = None) -> DataFrame:
    """Cut each key's windows into ``int(n / n_per)`` blocks (from 0); keys with fewer than ``n_per`` are left out."""
    keys = names(keys)
    n = win.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) / n_per).alias("_k")).where("_k > 0")
    parts = equal_parts(join_null_safe(win, n, keys), keys, order, F.col("_k"), "block", chunk)
    return parts.withColumn("block", F.col("block") - 1).drop("_k")


def split_block(df: DataFrame, keys: Sequence[str] | str, order: str, block: str, target: int, k: int) -> DataFrame:
    """Cut one block into ``k`` nearly equal sub-blocks; later blocks move up by ``k - 1``."""
    keys = names(keys)
    parts = equal_parts(df, [*keys, block], order, k, "_p")
    moved = F.when(F.col(block) == target, target + F.col("_p") - 1).when(F.col(block) > target, F.col(block) + (k - 1)).otherwise(F.col(block))
    return parts.withColumn(block, moved.cast("bigint")).drop("_p")


def block_features(values: DataFrame, keys: Sequence[str] | str, features: Sequence[str], n_min: int = 3) -> DataFrame:
    """Mean of each feature over the finite values of a block, NULL below ``n_min``."""
    aggs = []
    for f in features:
        x = finite(f)
        aggs.append(F.when(F.count(x) >= n_min, F.avg(x)).alias(f))
    return values.groupBy(*names(keys)).agg(*aggs)


def classify_blocks(
    blocks: DataFrame, features: Sequence[str], ref: tuple[Sequence[float], Sequence[float]], weights: Sequence[float],
    prototypes: Sequence[Sequence[float]], labels: Sequence,
) -> DataFrame:
    """Category of each block by its nearest prototype after referencing; NULL when a feature is missing.

    The model is small, so the nearest prototype is a plain column expression.
    """
    scaled = F.array(*[(F.col(f) - float(m)) / float(s) * float(w) for f, m, s, w in zip(features, *ref, weights, strict=True)])
    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull()
    cands = [F.struct(sq_distance("_x", F.array(*[F.lit(float(v)) for v in p])).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(prototypes)]
    node = F.array_min(F.array(*cands))["i"]
    cat = F.lit(None)
    for i, lab in enumerate(labels):
        cat = F.when(F.col("node") == i, F.lit(lab)).otherwise(cat)
    out = blocks.withColumn("_x", scaled).withColumn("node", F.when(complete, node))
    return out.withColumn("cat", cat).drop("_x")


def block_match(df: DataFrame, whole: str, block_cat: str, na: str = "NA") -> DataFrame:
    """Counts and row fractions of overall against block category, missing blocks as ``na``."""
    b = F.coalesce(F.col(block_cat).cast("string"), F.lit(na))
    n = df.groupBy(F.col(whole).cast("string").alias("whole"), b.alias("in_block")).agg(F.count(F.lit(1)).alias("n"))
    return with_share(n, "whole").withColumn("same", F.col("whole") == F.col("in_block"))


def transitions(blocks: DataFrame, keys: Sequence[str] | str, entity: str, block: str, cat: str, n: str, n_min: int) -> DataFrame:
    """``(keys, step, src, dst, n)``: category pairs of consecutive blocks that both have enough values."""
    keys = names(keys)
    ok = blocks.where((F.col(n) >= n_min) & F.col(cat).isNotNull())
    a = ok.select(*keys, entity, F.col(block).alias("step"), F.col(cat).alias("src"))
    b = ok.select(*keys, entity, (F.col(block) - 1).alias("step"), F.col(cat).alias("dst"))
    return join_null_safe(a, b, [*keys, entity, "step"]).groupBy(*keys, "step", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def transition_stats(trans: DataFrame, by: Sequence[str] | str = ()) -> DataFrame:
    """Probability, expected count, ratio, percent increase and coincidence coefficient per (src, dst).

    The coefficient scales the surplus by its largest possible value, the smaller margin of the cell.
    Works on level-pair counts, so its windows are as small as the category table.
    """
    by = names(by)
    t = trans.groupBy(*by, "src", "dst").agg(F.sum("n").alias("n"))
    full = join_null_safe(levels_grid(t, "src", "dst", by), t, [*by, "src", "dst"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row, col, tot = (F.sum("n").over(Window.partitionBy(*by, *c)) for c in (["src"], ["dst"], [F.lit(0)]))
    m = full.withColumns({"_r": row, "_c": col, "_t": tot})
    m = m.withColumn("expected", ratio(F.col("_r") * F.col("_c").cast("double"), "_t"))
    surplus = F.col("n") - F.col("expected")
    return m.withColumns({
        "prob": ratio("n", "_r"), "ratio": ratio("n", "expected"), "pct": ratio(surplus, "expected") * 100,
        "coco": F.when(surplus >= 0, ratio(surplus, F.least("_r", "_c") - F.col("expected"))).otherwise(ratio(surplus, "expected")),
    }).drop("_r", "_c", "_t")


def stability_index(trans: DataFrame, by: Sequence[str] | str = ()) -> DataFrame:
    """Share of transitions that keep their category."""
    return trans.groupBy(*names(by)).agg(ratio(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)), F.sum("n")).alias("si"))


def block_names(blocks: DataFrame, keys: Sequence[str] | str, block: str, mode: str = "default", tags: tuple[str, str] = ("off", "on")) -> DataFrame:
    """'B1', 'B2', .. or, for alternating contexts, 'off1', 'on1', 'off2', .. by block number."""
    if mode == "default":
        rank = F.row_number().over(Window.partitionBy(*names(keys)).orderBy(block))  # one row per block
        return blocks.withColumn("name", F.concat(F.lit("B"), rank.cast("string")))
    num = F.floor(F.col(block) / 2) + 1
    tag = F.when(F.col(block) % 2 == 0, F.lit(tags[0])).otherwise(F.lit(tags[1]))
    return blocks.withColumn("name", F.concat(tag, num.cast("string")))


def context_pair(a: str, b: str, on: str = "on") -> Column:
    """Do two context names form a pair: different states, and the 'off' number equal to or one above the 'on' one."""
    number = lambda c: F.regexp_replace(c, "[^0-9]", "").cast("int")
    first_on = F.col(a).contains(on)
    gap = F.when(first_on, number(b) - number(a)).otherwise(number(a) - number(b))
    return (F.substring(a, 1, 3) != F.substring(b, 1, 3)) & gap.isin(0, 1)


def transition_rollup(trans: DataFrame, block_sizes: DataFrame, keys: Sequence[str] | str, n_min: int, allowed: Column | None = None) -> DataFrame:
    """Transition counts summed over recordings for named block pairs that both have enough trials.

    ``block_sizes`` holds ``(keys, block, name, n)``; the pair is called 'first>second'.
    """
    keys = names(keys)
    s = block_sizes.where(F.col("n") >= n_min)
    a = s.select(*keys, F.col("block").alias("step"), F.col("name").alias("name_a"))
    b = s.select(*keys, (F.col("block") - 1).alias("step"), F.col("name").alias("name_b"))
    named = join_null_safe(a, b, keys + ["step"])
    if allowed is not None:
        named = named.where(allowed)
    j = join_null_safe(trans, named, keys + ["step"]).withColumn("pair", F.concat_ws(">", "name_a", "name_b"))
    return j.groupBy("pair", "src", "dst").agg(F.sum("n").alias("n"), F.count_distinct(*keys).alias("n_rec"))


def stability_profile(trans: DataFrame, by: Sequence[str] | str, recid: str) -> DataFrame:
    """Observed and expected stability index and number of recordings per transition."""
    by = names(by)
    marg = transition_stats(trans, by)
    exp = marg.where("src = dst").groupBy(*by).agg(F.sum("expected").alias("_e"))
    tot = trans.groupBy(*by).agg(F.sum("n").alias("_n"), F.count_distinct(recid).alias("n_rec"))
    return stability_index(trans, by).join(tot, by).join(exp, by, "left").select(*by, "si", ratio(F.coalesce("_e", F.lit(0.0)), "_n").alias("si_exp"), "n_rec")
