"""Rank statistics, correlations and multiple-test correction as aggregations and ordered scans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import correlation, hash_key, names, normal_tails, ratio, regression_slope
from ..session import cut_lineage
from .filters import dense_ids
from .scan import average_rank, hash_chunk, join_null_safe, magnitude_chunk, percentile_columns, running_rank, scan

#: Bytes of shuffled labels that a task keeps.
HELD_BYTES = 200_000_000


def pearson(df: DataFrame, keys: Sequence[str] | str, x: str, y: str) -> DataFrame:
    return df.groupBy(*names(keys)).agg(correlation(x, y).alias("r"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))


def spearman(df: DataFrame, keys: Sequence[str] | str, x: str, y: str) -> DataFrame:
    keys = names(keys)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_rank(average_rank(both, keys, x, "_rx"), keys, y, "_ry")
    return r.groupBy(*keys).agg(correlation("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def _discordant(cells: DataFrame, keys: list[str], bits: Column) -> DataFrame:
    """``(keys, d)``: pairs with x smaller and y larger, from integer ranks ``rx, ry`` below ``2 ** bits`` with weight ``w``.

    Counting inversions by the bits of the y rank: two different ranks part at exactly one bit level,
    where they share the higher bits. At each level a row with bit 0 adds the weight of bit-1 rows of the
    same node with smaller x. That is ``bits`` rows per cell and running sums, instead of all pairs.
    """
    lv = cells.withColumn("_l", F.explode(F.sequence(F.lit(0), bits - 1)))
    node = F.expr("shiftright(ry, _l + 1)")
    bit = F.expr("shiftright(ry, _l) & 1")
    nodes = lv.groupBy(*keys, "_l", node.alias("_node"), "rx").agg(
        F.sum(F.when(bit == 0, F.col("w")).otherwise(0)).alias("_w0"), F.sum(F.when(bit == 1, F.col("w")).otherwise(0)).alias("_w1"))
    run = scan(nodes, [*keys, "_l", "_node"], "rx", F.floor(F.col("rx") / 65536), _c=("sum", "_w1"))
    before = (F.col("_c") - F.col("_w1")).cast("double")
    return run.groupBy(*keys).agg(F.sum(F.col("_w0") * before).alias("d"))


def kendall_tau(df: DataFrame, keys: Sequence[str] | str, x: str, y: str) -> DataFrame:
    """Kendall tau-b per key, exact with ties, in n log n rows, and its two-sided p by the tie-corrected normal limit."""
    shown = names(keys)
    keys = shown or ["_all"]
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_all", F.lit(0)).select(*keys, x, y)
    rx = running_rank(both, keys, x).select(*keys, x, F.col("below").alias("rx"))
    ry = running_rank(both, keys, y).select(*keys, y, F.col("below").alias("ry"))
    n = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    cells = join_null_safe(join_null_safe(both.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("w")), rx, keys + [x]), ry, keys + [y])
    cells = cells.groupBy(*keys, "rx", "ry").agg(F.sum("w").alias("w"))
    d = _discordant(join_null_safe(cells, n, keys), keys, F.length(F.bin("n")))
    half = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    c = F.col("c").cast("double")

    def ties(side: str, i: int) -> DataFrame:
        moments = [half("c").alias(f"n{i}"), F.sum(c * (c - 1) * (2 * c + 5)).alias(f"v{i}"), F.sum(c * (c - 1) * (c - 2)).alias(f"w{i}")]
        return both.groupBy(*keys, side).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(*moments)

    tx, ty = ties(x, 1), ties(y, 2)
    txy = cells.groupBy(*keys).agg(half("w").alias("n3"))
    j = n
    for part in (tx, ty, txy, d):
        j = join_null_safe(j, part, keys)
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    agree = n0 - F.col("n1") - F.col("n2") + F.col("n3") - F.col("d")
    score, m = agree - F.col("d"), F.col("n").cast("double")
    var = (m * (m - 1) * (2 * m + 5) - F.col("v1") - F.col("v2")) / 18 + F.coalesce(ratio(2 * F.col("n1") * F.col("n2"), m * (m - 1)), F.lit(0.0)) + F.coalesce(
        ratio(F.col("w1") * F.col("w2"), 9 * m * (m - 1) * (m - 2)), F.lit(0.0))
    tau = ratio(score, F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2"))))
    out = j.select(*shown, tau.alias("tau"), "n", ratio(score, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("_z"))
    return out.withColumn("p", F.when(F.col("tau").isNotNull(), normal_tails("_z"))).drop("_z")


def linregress(df: DataFrame, keys: Sequence[str] | str, x: str, y: str) -> DataFrame:
    mean_x, mean_y = F.avg(F.when(F.col(y).isNotNull(), F.col(x))), F.avg(F.when(F.col(x).isNotNull(), F.col(y)))
    return df.groupBy(*names(keys)).agg(
        regression_slope(y, x).alias("slope"), (mean_y - regression_slope(y, x) * mean_x).alias("intercept"), correlation(x, y).alias("r"))


def corr_matrix(long: DataFrame, item: str, key_a: str, value: str, other: DataFrame | None = None, upper: bool = True, rank: bool = False, method: str = "pearson") -> DataFrame:
    """Correlation of every category pair over shared items; ``method`` ``kendall`` gives tau and p instead of r.

    ``long`` and ``other`` are level-sized ``(item, category, value)`` tables (enrichment scores); the result
    has one row per category pair.
    """
    def ranks(d: DataFrame) -> DataFrame:
        return average_rank(d, key_a, value, "_r").drop(value).withColumnRenamed("_r", value) if rank else d
    a = ranks(long.where(F.col(value).isNotNull())).select(item, F.col(key_a).alias("cat_a"), F.col(value).alias("_x"))
    b = (ranks((long if other is None else other).where(F.col(value).isNotNull()))).select(item, F.col(key_a).alias("cat_b"), F.col(value).alias("_y"))
    j = a.join(b, item)
    if other is None and upper:
        j = j.where("cat_a < cat_b")
    if method == "kendall":
        return kendall_tau(j, ["cat_a", "cat_b"], "_x", "_y")
    return j.groupBy("cat_a", "cat_b").agg(correlation("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n"))


def mann_whitney(df: DataFrame, keys: Sequence[str] | str, value: str, label: str, positive) -> DataFrame:
    """U of the ``positive`` label with average ranks, and the group sizes."""
    keys = names(keys)
    pos = F.col(label) == F.lit(positive)
    r = average_rank(df.where(F.col(value).isNotNull()), keys, value, "_r")
    g = r.groupBy(*keys).agg(F.count(F.when(pos, 1)).alias("n_a"), F.count(F.when(~pos, 1)).alias("n_b"), F.sum(F.when(pos, F.col("_r"))).alias("_s"))
    na = F.col("n_a").cast("double")
    return g.select(*keys, "n_a", "n_b", (F.col("_s") - na * (na + 1) / 2).alias("u")).withColumn("auc", ratio("u", F.col("n_a") * F.col("n_b").cast("double")))


def permuted_labels(trials: DataFrame, trial: str, condition: Sequence[str] | str, label: str, reps: int) -> DataFrame:
    """``(rep, trial, condition, is_a)``: labels shuffled inside each condition; rep 0 is the observed one.

    ``condition`` may be several columns (a recording and its condition). One shuffle of the labels serves every entity.
    """
    condition = names(condition)
    t = trials.select(trial, *condition, label)
    by_id = scan(t.withColumn("_h", hash_key("pos", trial)), condition, ["_h", trial], hash_chunk("_h"), _r="row").select(*condition, trial, "_r")
    each = t.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    drawn = scan(each.withColumn("_h", hash_key("lab", "rep", trial)), [*condition, "rep"], ["_h", trial], hash_chunk("_h"), _r="row").select(
        *condition, "rep", "_r", label)
    shuffled = join_null_safe(by_id, drawn, [*condition, "_r"]).select("rep", trial, *condition, F.col(label).alias("is_a"))
    return shuffled.unionByName(t.select(F.lit(0).alias("rep"), trial, *condition, F.col(label).alias("is_a")))


def choice_probability(
    counts: DataFrame, trials: DataFrame, entity: Sequence[str] | str, trial: str, condition: str, label: str, value: str, reps: int,
    group: Sequence[str] | str = (),
) -> DataFrame:
    """Combined-conditions choice probability per entity: sum of U over sum of nA nB, permutation p, preference.

    ``trials`` holds a boolean ``label`` per trial; ``group`` (part of ``entity``) names what shares a trial
    set, e.g. the recording. Conditions without both labels are left out. Ranks do not depend on the labels,
    so they are taken once; a shuffle only picks which ranks are summed.
    """
    entity, group = names(entity), names(group)
    na, nb = F.col("n_a").cast("double"), F.col("n_b")
    both = trials.groupBy(*group, condition).agg(
        F.sum(F.col(label).cast("int")).alias("n_a"), F.sum((~F.col(label)).cast("int")).alias("n_b")).where("n_a > 0 AND n_b > 0")
    norm = both.withColumn("_g", F.lit(0)).groupBy("_g", *group).agg(F.sum(na * (na + 1) / 2).alias("_o"), F.sum(na * nb).alias("_d"))
    # a condition, and a trial number, mean something only inside their group
    used = join_null_safe(trials, both.select(*group, condition), [*group, condition], "left_semi")
    cond = used.select(*group, trial, condition)
    ranks = average_rank(join_null_safe(counts.drop(condition), cond, [*group, trial]), entity + [condition], value, "_r").select(*entity, trial, "_r")
    picked = permuted_labels(used, trial, [*group, condition], label, reps).where("is_a").select("rep", *group, trial)
    sums = join_null_safe(ranks, picked, [*group, trial]).groupBy(*entity, "rep").agg(F.sum("_r").alias("_s")).withColumn("_g", F.lit(0))
    cp = join_null_safe(sums, norm, ["_g", *group]).select(*entity, "rep", ((F.col("_s") - F.col("_o")) / F.col("_d")).alias("_v"))
    obs = cp.where("rep = 0").select(*entity, F.col("_v").alias("_c"))
    p = join_null_safe(cp.where("rep > 0"), obs, entity).groupBy(*entity, "_c").agg(
        (F.count(F.when(F.col("_c") <= F.col("_v"), 1)) / F.lit(float(reps))).alias("_p"))
    flip = F.col("_c") < 0.5
    return p.select(*entity, F.when(flip, 1 - F.col("_c")).otherwise(F.col("_c")).alias("cccp"),
                    F.when(flip, 1 - F.col("_p")).otherwise(F.col("_p")).alias("p"), F.when(flip, -1).otherwise(1).alias("pref"))


def choice_probability_matrix(
    counts: DataFrame, trials: DataFrame, entity: Sequence[str] | str, trial: str, condition: str, label: str, value: str, reps: int,
    group: Sequence[str] | str = (), seed: int = 0,
) -> DataFrame:
    """As ``choice_probability``, for thousands of shuffles: ``(entity, cccp, p, pref, n_trials)``.

    The shuffled labels of a group's condition are a function of ``seed``, so they are never rows: each task makes them once
    as a matrix of bits and multiplies it with the rank vectors of all entities of the group. What is shuffled is one
    vector of values an entity and one of labels a group; ranks are taken where they meet. ``counts`` may lack columns of
    ``group``: its entities then meet every group that agrees in the others. A NULL label leaves a trial out.
    """
    entity, group = names(entity), names(group)
    own, shared = [c for c in entity if c in counts.columns], [c for c in group if c in counts.columns]
    pair = F.struct(F.col(trial).alias("t"), F.col(value).alias("v"))
    vectors = counts.groupBy(*own).agg(F.collect_list(pair).alias("_x")).select(*own, F.col("_x.t").alias("_trial"), F.col("_x.v").alias("_value"))
    # trials in the order of their hash, condition by condition: the place of a trial does not depend on partitioning
    mark = F.struct(F.to_json(F.struct(condition)).alias("c"), hash_key("pos", trial).alias("h"), F.col(trial).alias("t"), F.col(label).alias("l"))
    marks = trials.where(F.col(label).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_list(mark)).alias("_m"))
    marks = marks.select(*group, F.col("_m.c").alias("_conds"), F.col("_m.t").alias("_trials"), F.col("_m.l").alias("_labels"), (F.to_json(F.struct(*group)) if group else F.lit("")).alias("_tag"))
    if shared:
        joined = join_null_safe(vectors.repartition(*shared).sortWithinPartitions(*shared), marks, shared)
    else:
        joined = vectors.withColumn("_one", F.lit(1)).join(marks.withColumn("_one", F.lit(1)), "_one").drop("_one")
    kinds = dict(joined.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in entity) + "cccp double, p double, pref int, n_trials long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict] = {}
        for pdf in batches:
            out = np.zeros((len(pdf), 2))
            size = np.zeros(len(pdf), np.int64)
            for row, (name, conds, ids, labels, trial_ids, values) in enumerate(pdf[["_tag", "_conds", "_trials", "_labels", "_trial", "_value"]].itertuples(index=False)):
                if name not in held:
                    while held and sum(bits.nbytes for of in held.values() for _, _, bits in of.values()) > HELD_BYTES:
                        held.pop(next(iter(held)))
                    held[name] = _shuffled_labels(conds, labels, name, reps, seed)
                out[row], size[row] = _combined_probability(ids, trial_ids, values, held[name], reps)
            flip = out[:, 0] < 0.5
            done = pdf[entity].assign(
                cccp=np.where(flip, 1 - out[:, 0], out[:, 0]), p=np.where(flip, 1 - out[:, 1], out[:, 1]), pref=np.where(flip, -1, 1).astype("int32"), n_trials=size)
            yield done[size > 0]

    return joined.mapInPandas(run, schema)


def _shuffled_labels(conds: np.ndarray, labels: np.ndarray, name: str, reps: int, seed: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """condition with both labels -> (its trials' positions, labels, packed bits of ``reps`` shuffles)."""
    out = {}
    for c, rows in pd.Series(conds).groupby(conds, sort=False).indices.items():
        own = np.array(labels[rows], bool)
        if own.all() or not own.any():
            continue
        key = hashlib.blake2b(f"{seed}|{name}|{c}".encode(), digest_size=8).digest()
        rng = np.random.default_rng(int.from_bytes(key, "little"))
        step = max(1, 4_000_000 // len(own))
        packed = [np.packbits(rng.permuted(np.tile(own, (min(step, reps - i), 1)), axis=1), axis=1) for i in range(0, reps, step)]
        out[c] = rows, own, np.concatenate(packed)
    return out


def _combined_probability(
    ids: np.ndarray, trial_ids: np.ndarray, values: np.ndarray, shuffled: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], reps: int
) -> tuple[tuple[float, float], int]:
    """(sum of U over sum of nA nB, share of shuffles not below it) of one entity, and its number of trials."""
    code = pd.factorize(np.concatenate([ids, trial_ids]), use_na_sentinel=False)[0]
    of, at = code[: len(ids)], code[len(ids):]
    order = np.argsort(at, kind="stable")
    low, high = (np.searchsorted(at[order], of, side) for side in ("left", "right"))
    seen, drawn, pairs, n = 0.0, np.zeros(reps), 0, 0
    for rows, own, packed in shuffled.values():
        times = (high - low)[rows]  # a trial without a value has rank 0, a repeated one counts as often
        place = np.repeat(np.arange(len(rows)), times)
        if not len(place):
            met = np.zeros(0)
        else:
            first = np.repeat(low[rows] - np.cumsum(times) + times, times)
            met = pd.Series(values[order[first + np.arange(len(place))]]).rank(na_option="top").to_numpy()
        rank = np.zeros(len(own))
        rank[place] = met
        n += len(place)
        n_a = int(own.sum())
        pairs += n_a * (len(own) - n_a)
        least = n_a * (n_a + 1) / 2
        seen += rank[own].sum() - least
        step = max(1, 4_000_000 // len(own))
        for i in range(0, reps, step):  # ranks are halves, so sums are exact
            drawn[i : i + step] += np.unpackbits(packed[i : i + step], axis=1, count=len(own)) @ rank - least
    return (seen / max(pairs, 1), float((drawn >= seen).mean())), n


def wilcoxon(df: DataFrame, keys: Sequence[str] | str, base: str, value: str) -> DataFrame:
    """Signed-rank statistic, tie-corrected z and two-sided normal p of value - base; zero differences are dropped."""
    keys = names(keys)
    d = df.withColumn("_d", F.col(value) - F.col(base)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    hist = running_rank(d, keys, "_a")  # d has no NULL difference: NULL <> 0 is not true
    ties = hist.groupBy(*keys).agg(F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("_t"))
    r = join_null_safe(d, hist.select(*keys, "_a", (F.col("below") + (F.col("n") + 1) / 2.0).alias("_r")), keys + ["_a"])
    g = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("_up"), F.sum("_r").alias("_all"))
    g = join_null_safe(g, ties, keys)
    n = F.col("n").cast("double")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_t") / 2) / 24)
    return g.select(*keys, "n", F.least(F.col("_up"), F.col("_all") - F.col("_up")).alias("w"),
                    ratio(F.least(F.col("_up"), F.col("_all") - F.col("_up")) - n * (n + 1) / 4, se).alias("z")).withColumn("p", normal_tails("z"))


def fdr(df: DataFrame, keys: Sequence[str] | str, p: str, tie: str, method: str = "bh", null_poisons: bool = True) -> DataFrame:
    """Step-up adjusted p per key (``bh`` or ``by``), clipped to [0, 1].

    ``null_poisons`` keeps the rule that one missing p blanks its whole vector; else missing ones stay out.
    """
    keys = names(keys)
    known = df.where(F.col(p).isNotNull()).withColumn("_o", -F.col(p))
    r = scan(known, keys, ["_o", tie], magnitude_chunk("_o"), _row="row", _n=("total", F.lit(1)))
    r = r.withColumn("_i", F.col("_n") - F.col("_row") + 1)  # rank in ascending order
    r = r.withColumn("_q", F.col(p) * F.col("_n") / F.col("_i"))
    r = scan(r, keys, ["_o", tie], magnitude_chunk("_o"), _m=("min", "_q"), _h=("total", 1 / F.col("_i").cast("double")))
    adj = F.col("_m") * F.col("_h") if method == "by" else F.col("_m")
    done = r.select(*df.columns, F.least(F.greatest(adj, F.lit(0.0)), F.lit(1.0)).alias("p_adj"))
    out = done.unionByName(df.where(F.col(p).isNull()).withColumn("p_adj", F.lit(None).cast("double")))
    if not null_poisons:
        return out
    if not keys:
        some = df.agg(F.max(F.col(p).isNull().cast("int"))).scalar()
        return out.withColumn("p_adj", F.when(some == 0, F.col("p_adj")))
    flag = df.groupBy(*keys).agg(F.max(F.col(p).isNull().cast("int")).alias("_bad"))
    return join_null_safe(out, flag, keys).withColumn("p_adj", F.when(F.col("_bad") == 0, F.col("p_adj"))).drop("_bad")


def tuning_significance(p: str, p_naive: str, pref: str, pref_naive: str, cccp: str, p_thr: float = 0.05, naive_thr: float = 0.001, cp_thr: float = 0.52) -> Column:
    """All four criteria met; NULL where the choice probability is missing."""
    ok = (F.col(p) <= p_thr) & (F.col(p_naive) <= naive_thr) & (F.col(pref) == F.col(pref_naive)) & (F.col(cccp) >= cp_thr)
    return F.when(F.col(cccp).isNotNull(), F.coalesce(ok, F.lit(False)))


def condition_ids(trials: DataFrame, variables: Sequence[str], exclude: Column | None = None, out: str = "cond_id") -> DataFrame:
    """Id (from 1) of each distinct combination of the variables; excluded trials get -1."""
    t = dense_ids(trials, variables, out).withColumn(out, F.col(out) + 1)
    return t if exclude is None else t.withColumn(out, F.when(exclude, F.lit(-1).cast("bigint")).otherwise(F.col(out)))


def derive_trials(trials: DataFrame, left: str, right: str, choice: str, feedback: str) -> DataFrame:
    """Stimulus side and contrast from two nullable columns, and whether choice and feedback agree with it."""
    side = F.when(F.col(left).isNotNull(), F.lit(-1)).when(F.col(right).isNotNull(), F.lit(1))
    d = trials.withColumns({"side": side, "contrast": F.coalesce(left, right)})
    correct = F.col("side") == F.col(choice)
    return d.withColumn("consistent", correct == (F.col(feedback) == 1))


def trial_windows(trials: DataFrame, start: str, move: str, align: Mapping[str, tuple[str, float, float]], rt: tuple[float, float] = (0.08, 2.0)) -> DataFrame:
    """Windows ``(variable, t0, t1)`` around the alignment time of each variable for trials with a usable reaction time."""
    ok = (F.col(move) - F.col(start)).between(*rt)
    wins = [F.struct(F.lit(v).alias("variable"), (F.col(c) + a).alias("t0"), (F.col(c) + b).alias("t1")) for v, (c, a, b) in align.items()]
    keep = [c for c in trials.columns if c not in ("t0", "t1", "variable")]
    return trials.where(ok).select(*keep, F.explode(F.array(*wins)).alias("w")).select(*keep, "w.*")


def within_group_contrast(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """Effect of ``x`` on ``y`` within groups: the slope of the group-demeaned values, from group moments alone."""
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    m = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(y, x).alias("c"), F.var_pop(x).alias("v"))
    return m.agg(ratio(F.sum(F.col("c") * F.col("n")), F.sum(F.col("v") * F.col("n"))).alias("effect"),
                 F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"))


