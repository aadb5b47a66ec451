"""Labellings made comparable: the labels of one renamed after another's, along a whole chain of resolutions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import scan


def label_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, n)``: rows per pair of labels; rows without one of them are left out."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _by_turns(pairs: DataFrame) -> DataFrame:
    """``(a, b)``: labels a, the largest first, each take the free b they share most rows with.

    All a ask for their best b at once, each b stays with the first in turn, and pairs behind the one it stays with
    fall away. That settles on the same pairs as one turn after the other, in few rounds and without a collect.
    """
    rank = pairs.groupBy("a").agg(F.sum("n").alias("size"))
    left = cut_lineage(pairs.join(rank, "a").select("b", F.struct("size", "a").alias("turn"), F.struct((-F.col("n")).alias("m"), "b").alias("wish")))
    while True:
        asked = left.groupBy("turn").agg(F.min("wish").alias("wish")).select("turn", F.col("wish.b").alias("b"))
        held = asked.groupBy("b").agg(F.max("turn").alias("first"), F.count(F.lit(1)).alias("n"))
        if held.where("n > 1").isEmpty():
            return asked.select(F.col("turn.a").alias("a"), "b")
        left = cut_lineage(left.join(held, "b", "left").where(F.col("first").isNull() | (F.col("turn") >= F.col("first"))).select("b", "turn", "wish"))


def label_map(pairs: DataFrame, mode: str = "desc") -> DataFrame:
    """``(b, new)`` for every label b of ``pairs`` (a, b, n), so that b's numbers agree with a's.

    ``desc``: each a, by falling size (ties: larger label first), names the free b it overlaps most. ``asc``: each b takes the name
    of the a it overlaps most, which several may share. Equal overlaps go to the smaller label. Labels b left over get
    the smallest unused numbers from 0, in order.
    """
    if mode == "desc":
        named = _by_turns(pairs).select("b", F.col("a").alias("new"))
    elif mode == "asc":
        named = pairs.groupBy("b").agg(F.min(F.struct((-F.col("n")).alias("m"), "a"))["a"].alias("new"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    named = cut_lineage(named)
    every = pairs.select("b").distinct()
    numbers = every.agg(F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.count(F.lit(1)) - 1, F.lit(0).cast("bigint")))).alias("new"))
    row = lambda df, c: scan(df, [], c, F.floor(F.col(c) / 4096), _r="row")
    spare = row(numbers.join(named.select("new"), "new", "left_anti"), "new")
    rest = row(every.join(named.select("b"), "b", "left_anti"), "b")
    return cut_lineage(named.select("b", "new").unionByName(rest.join(spare, "_r").select("b", "new")))


def _renamed(df: DataFrame, col: str, names: DataFrame, out: str) -> DataFrame:
    """A NULL label stays NULL; a label that never met one of the other side keeps its number."""
    table = names.select(F.col("b").alias("_old"), F.col("new").alias("_new"))
    return df.join(table, F.col(col) == F.col("_old"), "left").withColumn(out, F.coalesce("_new", F.col(col).cast("bigint"))).drop("_old", "_new")


def harmonize_labels(df: DataFrame, a: str, b: str, out: str = "b_new", mode: str = "desc") -> DataFrame:
    """``df`` with the labels of ``b`` renamed by ``label_map`` so that they match ``a``."""
    return _renamed(df, b, label_map(label_pairs(df, a, b), mode), out)


def harmonize_chain(df: DataFrame, levels: Sequence[str], ref: int, suffix: str = "_new") -> DataFrame:
    """Labellings ``levels`` (coarse to fine) renamed outward from ``levels[ref]``, which keeps its labels.

    Finer ones follow their coarser neighbour by ``desc``, coarser ones their finer neighbour by ``asc``. The rows are
    counted once per pair of neighbours; renaming works on these counts, and the rows meet all new names at the end.
    """
    if not 0 <= ref < len(levels):
        raise ValueError(f"no level {ref}")
    maps: dict[int, DataFrame] = {}
    for step, mode, ids in ((1, "desc", range(ref + 1, len(levels))), (-1, "asc", range(ref - 1, -1, -1))):
        for i in ids:
            pairs = label_pairs(df, levels[i - step], levels[i])
            if i - step in maps:
                pairs = _renamed(pairs, "a", maps[i - step], "a").groupBy("a", "b").agg(F.sum("n").alias("n"))
            maps[i] = label_map(cut_lineage(pairs), mode)
    for i, c in enumerate(levels):
        df = _renamed(df, c, maps[i], c + suffix) if i in maps else df.withColumn(c + suffix, F.col(c).cast("bigint"))
    return df
