"""Interval metrics of many overlapping windows from prefix sums: events are never paired with windows.

The intervals of an entity do not depend on the window that looks at them, only its first and last ones do. So each entity's
terms are summed up along time once, both ends of every window read the sums there, and the difference, less the terms
that reach over an end, is what the window holds. Rows: events plus two for each (window, entity), however long a window
is and however many windows overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import REFRACTORY_S
from ..functions.scalars import names, ratio
from .scan import join_null_safe, scan, time_chunk
from .trains import intervals


def _terms(wanted: Sequence[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Summands of single intervals and of pairs of consecutive ones that the wanted metrics need.

    ``_x`` and ``_y`` are intervals less the entity's mean interval, which keeps sums of squares small.
    """
    a, b, x, y = F.col("isi"), F.col("nxt"), F.col("_x"), F.col("_y")
    s = a + b
    single = {"b": {"x": x, "xx": x * x}, "lkappa": {"x": x, "ln": F.ln(a)}}
    pair = {
        "m": {"a": x, "b": y, "aa": x * x, "bb": y * y, "ab": x * y},
        "lv": {"lv": F.pow(ratio(a - b, s), 2)},
        "lvr": {"lvr": (1 - ratio(4 * a * b, s * s)) * (1 + ratio(F.lit(4.0 * REFRACTORY_S), s))},
        "cv2": {"cv2": ratio(F.abs(b - a), F.abs(s))},
        "ir": {"ir": F.abs(F.ln(ratio(b, a)))},
    }
    unknown = [m for m in wanted if m not in single and m not in pair]
    if unknown:
        raise ValueError(f"no prefix sums for {unknown}")
    one, two = {}, {}
    for m in wanted:
        one |= single.get(m, {})
        two |= pair.get(m, {})
    return one, two


def _variance(square: str, total: str, k: Column) -> Column:
    """Population variance from two sums; a spread below 1e-7 of the mean interval is rounding and counts as none."""
    var = F.col(square) / k - F.pow(F.col(total) / k, 2)
    return F.when(var > 1e-14 * F.pow("_mean", F.lit(2)), var).otherwise(0.0)


def _metric(name: str, n: Column) -> Column:
    """A metric from the summed terms; ``n`` is the number of events. Terms that are NULL count nowhere."""
    if name in ("b", "lkappa"):
        k = n - 1
        mu = F.col("_mean") + F.col("s_x") / k
        if name == "b":
            sd = F.sqrt(_variance("s_xx", "s_x", k))
            return ratio(sd - mu, sd + mu)
        s = F.ln(mu) - ratio("s_ln", "k_ln")
        return F.ln(ratio((F.lit(3.0) - s) + F.sqrt(F.pow(s - 3, 2) + 24 * s), 12 * s))
    if name == "m":
        k = n - 2
        spread = F.sqrt(_variance("s_aa", "s_a", k)) * F.sqrt(_variance("s_bb", "s_b", k))
        return ratio(F.col("s_ab") / k - F.col("s_a") * F.col("s_b") / (k * k), spread)
    return {"lv": 3, "lvr": 3, "cv2": 2, "ir": 1}[name] * ratio(f"s_{name}", f"k_{name}")


def windowed_metrics(
    ev: DataFrame, win: DataFrame, wanted: Sequence[str], keys: Sequence[str] | str = "recid", entity: str = "uid", tie: str = "eid",
    win_id: str = "win_id", min_n: int = 3, chunk_s: float = 86400.0,
) -> DataFrame:
    """Interval metrics of every entity in every closed window ``[t0, t1]`` of its keys that holds one of its events.

    One row per (window, entity) with the columns of ``win``, the entity, ``n`` events and the metrics, each NULL below
    ``min_n`` inputs. ``win_id`` tells the windows of a key apart; ``tie`` orders events of equal time. Sums are doubles:
    against summing each window by itself they differ by about 1e-16 of the entity's whole sum.
    """
    keys = names(keys)
    own = [*keys, entity]
    one, two = _terms(wanted)
    train = ev.select(*own, "t", F.col(tie).alias("_tie")).where("t IS NOT NULL")
    mean = train.groupBy(*own).agg(ratio(F.max("t") - F.min("t"), F.count(F.lit(1)) - 1).alias("_mean"))
    gaps = join_null_safe(intervals(train, own, ("t", "_tie"), chunk_s, keep_first=True), mean, own)
    gaps = gaps.withColumns({"_x": F.col("isi") - F.col("_mean"), "_y": F.col("nxt") - F.col("_mean")})
    both = F.col("isi").isNotNull() & F.col("nxt").isNotNull()
    terms = {f"1{k}": c for k, c in one.items()} | {f"2{k}": F.when(both, c) for k, c in two.items()}
    kept = F.struct(*[c.alias(k) for k, c in terms.items()])

    grid = join_null_safe(win, mean, keys)  # window x entity of its keys: the shape of the result
    ends = F.explode(F.array(*[F.struct(F.col(c).cast("double").alias("pos"), F.lit(side).alias("side")) for c, side in (("t0", -1), ("t1", 1))]))
    row = F.struct(*win.columns, "_mean").alias("_row")
    probes = grid.select(*own, row, F.col(win_id).cast("bigint").alias("_tie"), ends.alias("_e"))
    events = gaps.select(*own, F.col("t").cast("double").alias("_pos"), F.lit(0).alias("_side"), F.col("_tie").cast("bigint").alias("_tie"), kept.alias("_terms"))
    probes = probes.select(
        *own, F.col("_e.pos").alias("_pos"), F.col("_e.side").alias("_side"), "_tie",
        F.lit(None).cast(events.schema["_terms"].dataType).alias("_terms"), "_row")
    events = events.withColumn("_row", F.lit(None).cast(probes.schema["_row"].dataType))

    sums = {"_n": ("sum", F.when(F.col("_side") == 0, 1))}
    for k in terms:
        sums |= {f"s{k}": ("sum", F.coalesce(F.col("_terms")[k], F.lit(0.0))), f"k{k}": ("sum", F.col("_terms")[k].isNotNull().cast("bigint"))}
    seen = scan(events.unionByName(probes), own, ["_pos", "_side", "_tie"], time_chunk("_pos", chunk_s),
                **sums, _before=("last", "_terms"), _after=("next", "_terms")).where("_side <> 0")
    side = F.col("_side")
    # an interval ends at its event, a pair stands at its middle one: the first event's terms, and the last one's pair, reach outside
    edge = {}
    for k in terms:
        first = F.when(side == -1, F.col("_after")[k])
        over = first if k[0] == "1" else F.coalesce(first, F.when(side == 1, F.col("_before")[k]))
        edge |= {f"s{k}": F.coalesce(over, F.lit(0.0)), f"k{k}": over.isNotNull().cast("bigint")}
    total = [F.sum(side * F.coalesce("_n", F.lit(0))).alias("_n")]
    total += [(F.sum(side * F.coalesce(c, F.lit(0)) - over)).alias(f"{c[0]}_{c[2:]}") for c, over in edge.items()]
    held = seen.groupBy(*own, F.col(f"_row.{win_id}").alias("_w")).agg(F.any_value("_row").alias("_row"), *total).where("_n > 0")
    flat = held.select(entity, "_row.*", F.col("_n").alias("n"), *[f"{c[0]}_{c[2:]}" for c in edge])
    size = {m: F.col("n") - (1 if m in ("b", "lkappa") else 2) for m in wanted}
    return flat.select(*win.columns, entity, "n", *[F.when(size[m] >= max(min_n, 1), _metric(m, F.col("n"))).alias(m) for m in wanted])
