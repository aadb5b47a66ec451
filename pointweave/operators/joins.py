"""Joins of windows, events and entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import names
from .ranges import overlap_flag, window_pairs
from .scan import join_null_safe, scan, time_chunk

DAY = 86400.0
# Fixed value: marks an entity without a single matching score.
NO_SCORE = 999.0


def interval_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str] | str, bucket: float) -> DataFrame:
    """Overlapping (closed) window pairs; ``b`` has its window in ``b0, b1``."""
    return window_pairs(a, b, keys, bucket)


def purge_windows(
    win: DataFrame, forbidden: DataFrame, keys: Sequence[str] | str, chunk_s: float = DAY
) -> DataFrame:
    """Windows that touch none of the forbidden ones."""
    return overlap_flag(win, forbidden, keys, "_hit", chunk_s).where("NOT _hit").drop("_hit")


def label_states(
    win: DataFrame, quiet: DataFrame, keys: Sequence[str] | str, active_buff: float = 1.0, quiet_buff: float = 0.0,
    chunk_s: float = DAY,
) -> DataFrame:
    """'active': no quiet window near; 'quiet': overlaps one and is not active; else 'uncertain'."""
    keys = names(keys)
    f = overlap_flag(win, quiet, keys, "_near", chunk_s, pad=active_buff)
    f = overlap_flag(f, quiet, keys, "_in", chunk_s, pad=quiet_buff)
    state = F.when(~F.col("_near"), "active").when(F.col("_in"), "quiet").otherwise("uncertain")
    return f.withColumn("state", state).drop("_near", "_in")


def before_reference(win: DataFrame, ref: DataFrame, keys: Sequence[str] | str, buff: float = 1.0) -> DataFrame:
    """Windows that end at least ``buff`` before the first reference event; no reference keeps all."""
    keys = names(keys)
    first = ref.groupBy(*keys).agg(F.min("t").alias("_ref"))
    return join_null_safe(win, first, keys, "left").where(
        F.col("_ref").isNull() | (F.col("t1") <= F.col("_ref") - buff)).drop("_ref")


def artifact_free_trials(trials: DataFrame, free: DataFrame, keys: Sequence[str] | str, chunk_s: float = DAY) -> DataFrame:
    """As-of join: a trial stays when it ends inside the last free stretch begun strictly before it."""
    keys = names(keys)
    t = trials.select(*keys, F.struct(*trials.columns).alias("_row"), F.col("t0").alias("_pos"), F.lit(0).alias("_side"),
                      F.lit(None).cast("double").alias("_end"))
    f = free.groupBy(*keys, "t0").agg(F.max("t1").alias("_end")).select(
        *keys, F.lit(None).cast(t.schema["_row"].dataType).alias("_row"), F.col("t0").alias("_pos"), F.lit(1).alias("_side"), "_end")
    both = t.unionByName(f).withColumn("_n", F.xxhash64("_row"))
    # trials sort before a free stretch that begins at the same instant: strictly before
    run = scan(both, keys, ["_pos", "_side", "_n"], time_chunk("_pos", chunk_s), _stop=("last", "_end"))
    return run.where((F.col("_side") == 0) & (F.col("_row.t0") < F.col("_stop")) & (F.col("_row.t1") < F.col("_stop"))).select("_row.*")


def isolated_windows(win: DataFrame, keys: Sequence[str] | str, chunk_s: float = DAY) -> DataFrame:
    """Distance of each (disjoint) window to the previous and next one, and the smaller of the two."""
    out = scan(win, keys, ["t0", "t1"], time_chunk("t0", chunk_s), _p=("lag", "t1"), _q=("lead", "t0"))
    return out.withColumns({"d_prev": F.col("t0") - F.col("_p"), "d_next": F.col("_q") - F.col("t1")}).withColumn(
        "d_min", F.least("d_prev", "d_next")).drop("_p", "_q")


def nearest_distance(a: DataFrame, b: DataFrame, keys: Sequence[str] | str, x: str, out: str, chunk_s: float = DAY) -> DataFrame:
    """Distance of each row of ``a`` to the nearest row of ``b`` along ``x``; no pairs, two carried values."""
    keys = names(keys)
    left = a.select(*keys, F.struct(*a.columns).alias("_row"), F.col(x).alias("_pos"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_b"))
    right = b.select(*keys, F.col(x).alias("_pos")).distinct().select(
        *keys, F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_pos", F.lit(0).alias("_side"), F.col("_pos").cast("double").alias("_b"))
    both = left.unionByName(right).withColumn("_n", F.xxhash64("_row"))
    run = scan(both, keys, ["_pos", "_side", "_n"], time_chunk("_pos", chunk_s), _lo=("last", "_b"), _hi=("next", "_b"))
    return run.where("_side = 1").select("_row.*", F.least(F.col("_pos") - F.col("_lo"), F.col("_hi") - F.col("_pos")).alias(out))


def drop_isolated_small(
    det: DataFrame, keys: Sequence[str] | str, peak: str, big: float, small: float, max_dist: float, chunk_s: float = DAY
) -> DataFrame:
    """Drop detections with peak below ``small`` that have no big one (peak >= ``big``) within ``max_dist``."""
    c = det.withColumn("_c", F.col("t0") + (F.col("t1") - F.col("t0")) / 2)
    near = nearest_distance(c, c.where(F.col(peak) >= big), keys, "_c", "_d", chunk_s)
    return near.where((F.col(peak) >= small) | (F.col("_d") <= max_dist)).drop("_c", "_d")


def match_entities(a: DataFrame, b: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Inner join of two runs on the entity id; with ``check`` an id repeated in ``b`` is an error."""
    if check and not b.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{key} is not unique on the right side")
    return a.join(b, key)


def attach_delay(units: DataFrame, scores: DataFrame, key: str, p: str, delay: str, p_thr: float = 0.01) -> DataFrame:
    """Delay of significant entities, NULL when not significant, a flag value without a single match."""
    single = scores.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(p).alias("_p"), F.max(delay).alias("_d"))
    j = units.join(single, key, "left")
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    out = F.when(~one, F.lit(NO_SCORE)).when(F.col("_p") <= p_thr, F.col("_d"))
    return j.withColumn("resp_delay", out.cast("double")).drop("_n", "_p", "_d")


def score_lookup(df: DataFrame, key: str, aliases: Mapping[str, str], scores: DataFrame, score: str) -> DataFrame:
    """Translate keys by the alias map, look the score up, drop keys without one."""
    name = F.col(key)
    for old, new in aliases.items():
        name = F.when(F.col(key) == old, F.lit(new)).otherwise(name)
    s = scores.select(F.col(key).alias("_k"), F.col(score)).where(F.col(score).isNotNull() & ~F.isnan(score))
    return df.withColumn("_k", name).join(s, "_k").withColumnRenamed("_k", "score_key")


def followon_windows(a: DataFrame, b: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Windows of ``b`` that start exactly where a window of ``a`` stops."""
    keys = names(keys)
    ends = a.select(*keys, F.col("t1").alias("t0")).distinct()
    return join_null_safe(b, ends, keys + ["t0"], "left_semi")


def next_opposite_events(
    ev: DataFrame, keys: Sequence[str] | str, max_diff: float, search: int = 10, chunk_s: float = DAY
) -> DataFrame:
    """For each event the later ones among the next ``search - 1`` rows that have the other sign, an
    overlapping ``[lo, hi]`` extent and start within ``max_diff``. Fan-out per row is fixed by ``search``."""
    keys = names(keys)
    r = scan(ev, keys, ["t", "eid"], time_chunk("t", chunk_s), _rn="row")
    a = r.select(*keys, F.col("eid").alias("src"), F.col("t").alias("_t"), F.col("sign").alias("_s"), F.col("lo").alias("_lo"),
                 F.col("hi").alias("_hi"), F.explode(F.sequence(F.col("_rn") + 1, F.col("_rn") + (search - 1))).alias("_rn"))
    j = join_null_safe(a, r, keys + ["_rn"])
    ok = (F.col("sign") != F.col("_s")) & (F.col("t") - F.col("_t") <= max_diff) & (F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo"))
    return j.where(ok).select(*keys, "src", F.col("eid").alias("dst"), (F.col("t") - F.col("_t")).alias("dt"))


def assign_blocks(win: DataFrame, blocks: DataFrame, keys: Sequence[str] | str, bucket: float) -> DataFrame:
    """First block (lowest id) each window overlaps; windows in no block are dropped."""
    keys = names(keys)
    b = blocks.select(*keys, "block_id", F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    return window_pairs(win, b, keys, bucket).groupBy(*win.columns).agg(F.min("block_id").alias("block_id"))
