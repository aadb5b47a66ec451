import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import stats as st


def average_ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def exact(values, labels, conditions):
    """Combined probability and the exact share of all relabellings that reach it, condition by condition."""
    parts = []
    for c in sorted(set(conditions)):
        v = [x for x, k in zip(values, conditions, strict=True) if k == c]
        own = [m for m, k in zip(labels, conditions, strict=True) if k == c]
        n_a = sum(own)
        if 0 < n_a < len(own):
            r = average_ranks(v)
            least = n_a * (n_a + 1) / 2
            parts.append((sum(q for q, m in zip(r, own, strict=True) if m) - least, [r[list(s)].sum() - least for s in itertools.combinations(range(len(own)), n_a)], n_a * (len(own) - n_a)))
    seen = sum(p[0] for p in parts)
    sums = [sum(x) for x in itertools.product(*[p[1] for p in parts])]
    return seen / sum(p[2] for p in parts), np.mean([s >= seen for s in sums])


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_relabellings(spark, seed):
    rng = np.random.default_rng(seed)
    trials, counts, want, reps = [], [], {}, 2000
    for rec in (None, 1, 2):
        n = 9
        cond, lab = rng.integers(0, 2, n).tolist(), rng.integers(0, 2, n).astype(bool).tolist()
        lab[:2], cond[:2] = [True, False], [0, 0]
        trials += [(rec, i, cond[i], lab[i]) for i in range(n)]
        for unit in range(3):
            values = rng.integers(0, 5, n).tolist()
            counts += [(rec, unit, i, values[i]) for i in range(n)]
            want[rec, unit] = exact(values, lab, cond)
    trials.append((1, 99, 0, None))  # no label, no trial
    t = spark.createDataFrame(trials, "recid long, trial long, cond long, lab boolean")
    c = spark.createDataFrame(counts, "recid long, uid long, trial long, n long")
    got = st.choice_probability_matrix(c, t, ["recid", "uid"], "trial", "cond", "lab", "n", reps, group="recid").collect()
    assert len(got) == len(want)
    for r in got:
        cp, p = want[r["recid"], r["uid"]]
        if cp < 0.5:
            cp, p, sign = 1 - cp, 1 - p, -1
        else:
            sign = 1
        assert r["cccp"] == pytest.approx(cp) and r["pref"] == sign
        assert abs(r["p"] - p) <= 5 * (p * (1 - p) / reps) ** 0.5 + 1e-9


def test_no_usable_condition_and_repeatable(spark):
    t = spark.createDataFrame([(1, i, 0, True) for i in range(4)], "recid long, trial long, cond long, lab boolean")
    c = t.select("recid", F.lit(1).alias("uid"), "trial", F.col("trial").alias("n"))
    assert st.choice_probability_matrix(c, t, ["recid", "uid"], "trial", "cond", "lab", "n", 50, group="recid").count() == 0
    t = t.withColumn("lab", F.col("trial") % 2 == 0)
    a, b = (st.choice_probability_matrix(c, t, ["recid", "uid"], "trial", "cond", "lab", "n", 50, group="recid").collect() for _ in range(2))
    assert a == b and len(a) == 1


def test_matrix_meets_groups_finer_than_the_counts(spark):
    """Counts of a recording meet each of its label sets without a copy of the counts for every set."""
    counts = spark.createDataFrame([("r", u, i, (i * 7 + u) % 5) for u in range(2) for i in range(30)], "recid string, uid int, trial int, n int")
    trials = spark.createDataFrame([("r", v, i, i % 2, (i * k) % 3 == 0) for v, k in (("x", 1), ("y", 2)) for i in range(30)], "recid string, variable string, trial int, cond int, lab boolean")
    entity, group = ["recid", "uid", "variable"], ["recid", "variable"]
    got, want = (
        st.choice_probability_matrix(c, trials, entity, "trial", "cond", "lab", "n", 50, group=group).collect()
        for c in (counts, counts.join(trials.select("recid", "variable").distinct(), "recid")))
    assert len(got) == 4 and sorted(map(tuple, got)) == sorted(map(tuple, want))
