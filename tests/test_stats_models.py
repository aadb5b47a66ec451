import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from pointweave.operators import aggregate as ag
from pointweave.operators import features as ft
from pointweave.operators import permute as pm
from pointweave.operators import select as sl
from pointweave.operators import stability as sb
from pointweave.operators import slopes
from pointweave.operators import stats as st
from pointweave.plans import feature_maps


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    data = [(i, "abc"[rng.integers(3)], "xy"[rng.integers(2)], "gh"[rng.integers(2)]) for i in range(120)] + [(120, "a", "x", "single")]
    return spark.createDataFrame(data, "id int, a1 string, a2 string, const string")


def test_permutation_keeps_margins(spark, labelled):
    perm = pm.permute_counts(labelled, "id", "a1", "a2", "const", 5)
    for c in ("a1", "a2"):
        want = dict(rows(labelled.groupBy(c).count()))
        for rep in range(5):
            assert dict(rows(perm.where(F.col("rep") == rep).groupBy(c).agg(F.sum("n")))) == want


def test_margin_sampler_has_the_exact_null(spark, labelled):
    reps = 400
    perm = pm.permute_counts_by_margins(labelled, "a1", "a2", "const", reps)
    assert perm.groupBy("rep").agg(F.sum("n").alias("n")).where("n <> 121").count() == 0
    got = {(r["a1"], r["a2"]): (r["mean"], r["sd"]) for r in pm.null_moments(perm, "a1", "a2", reps).collect()}
    pdf = labelled.toPandas()
    for (a, b) in itertools.product("abc", "xy"):
        mean = var = 0.0
        for _, g in pdf.groupby("const"):
            n, r, c = len(g), (g.a1 == a).sum(), (g.a2 == b).sum()
            mean += r * c / n
            var += r * c * (n - r) * (n - c) / (n * n * (n - 1)) if n > 1 else 0.0
        assert got[a, b][0] == pytest.approx(mean, abs=5 * np.sqrt(var / reps))
        assert got[a, b][1] == pytest.approx(np.sqrt(var), rel=0.2)
    again = pm.permute_counts_by_margins(labelled, "a1", "a2", "const", reps)
    assert rows(again.where("rep < 3")) == rows(perm.where("rep < 3"))
    whole = pm.permute_counts_by_margins(labelled, "a1", "a2", [], 3)
    assert whole.groupBy("rep").agg(F.sum("n").alias("n")).where("n <> 121").count() == 0


def test_empty_cells_count_as_zero(spark):
    df = spark.createDataFrame([(1, "a", "x", 0), (2, "b", "y", 1)], "id int, a1 string, a2 string, const int")
    e = {(r["a1"], r["a2"]): r for r in pm.enrichment(df, pm.permute_counts(df, "id", "a1", "a2", "const", 4), "a1", "a2", 4).collect()}
    assert len(e) == 4 and e["a", "y"]["n"] == 0 and e["a", "y"]["mean"] == 0 and e["a", "y"]["z"] is None
    assert e["a", "x"]["mean"] == 1 and e["a", "x"]["pofs"] == 62.5 and e["a", "x"]["level"] == 0


def test_fdr_ties_null_and_by(spark):
    p = [0.01, 0.04, 0.04, 0.5]
    df = spark.createDataFrame([(i, "k", x) for i, x in enumerate(p)] + [(9, "bad", None), (10, "bad", 0.1)], "id int, k string, p double")
    got = {r["id"]: r["p_adj"] for r in st.fdr(df, "k", "p", "id").collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5]) and got[9] is None and got[10] is None
    kept = {r["id"]: r["p_adj"] for r in st.fdr(df, "k", "p", "id", null_poisons=False).collect()}
    assert kept[10] == pytest.approx(0.1)
    by = {r["id"]: r["p_adj"] for r in st.fdr(df, "k", "p", "id", "by").collect()}
    assert by[0] == pytest.approx(0.04 * (1 + 1 / 2 + 1 / 3 + 1 / 4))
    nokey = {r["id"]: r["p_adj"] for r in st.fdr(df.where("k = 'k'"), [], "p", "id").collect()}
    assert nokey[3] == pytest.approx(0.5)


def test_kendall_and_theil_sen_against_pairs(spark):
    rng = np.random.default_rng(11)
    x, y = rng.integers(0, 12, 60).astype(float), np.round(rng.normal(size=60), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    i, j = np.triu_indices(60, 1)
    sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    assert st.kendall_tau(df, [], "x", "y").first()["tau"] == pytest.approx((sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum()))
    ok = x[i] != x[j]
    slope = np.median((y[i] - y[j])[ok] / (x[i] - x[j])[ok])
    r = slopes.theil_sen(df, "x", "y").first()
    assert r["slope"] == pytest.approx(slope, abs=1e-9)
    assert r["intercept"] == pytest.approx(np.median(y) - slope * np.median(x), abs=1e-9)


def test_tuning_significance_keeps_missing(spark):
    df = spark.createDataFrame([(0.01, 0.0001, 1, 1, 0.6), (0.01, 0.0001, 1, -1, 0.6), (0.01, 0.0001, 1, 1, None)], "p double, pn double, a int, b int, c double")
    assert [r[0] for r in df.select(st.tuning_significance("p", "pn", "a", "b", "c")).collect()] == [True, False, None]


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vec array<double>")


def test_pca_and_standardize_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=(50, 4)) * [3, 2, 1, 0.1] + 5
    df = vectors(spark, x)
    val, axes = np.linalg.eigh(np.cov(x.T))
    k = int(np.argmax(np.cumsum(val[::-1]) / val.sum() > 0.95)) + 1
    want = (x - x.mean(axis=0)) @ axes[:, ::-1][:, :k]
    got = np.array([r["scores"] for r in ft.pca_scores(df, "vec").orderBy("id").collect()])
    assert got.shape == want.shape and np.allclose(abs(got), abs(want))
    z = np.array([r["vec"] for r in ft.standardize(df, "vec", [1, 2, 1, 1]).orderBy("id").collect()])
    assert np.allclose(z, (x - x.mean(axis=0)) / x.std(axis=0) * [1, 2, 1, 1])


def test_batch_map_against_numpy(spark):
    x = np.random.default_rng(4).normal(size=(60, 3))
    shape, iters = (3, 3), 5
    w = ft.som_init(vectors(spark, x), "vec", shape)
    got = ft.som_train(vectors(spark, x), "vec", shape, iters, w)
    d = ft.hex_distances(shape)
    s0, s1 = d.max(), d[d > 0].min()
    for it in range(iters):
        sigma = s0 * (s1 / s0) ** (it / iters)
        best = np.array([np.argmin(np.linalg.norm(w - r, axis=1)) for r in x])
        h = np.exp(-d[best] ** 2 / sigma ** 2)
        w = (h.T @ x) / h.sum(axis=0)[:, None]
    assert np.allclose(got, w)


def test_batch_map_with_tasks_without_rows(spark):
    x = np.random.default_rng(5).normal(size=(12, 3))
    few, many = vectors(spark, x).coalesce(1), vectors(spark, x).repartition(40)
    w = ft.som_init(few, "vec", (2, 2))
    assert np.allclose(ft.som_train(many, "vec", (2, 2), 3, w), ft.som_train(few, "vec", (2, 2), 3, w))


def test_batch_map_where_models_meet_in_tasks(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(300, 3))
    many = vectors(spark, x).repartition(9)
    w = ft.som_init(many, "vec", (4, 3))
    whole = ft.som_train(many, "vec", (4, 3), 4, w)
    monkeypatch.setattr(ft, "DRIVER_CELLS", 0)
    monkeypatch.setattr(ft, "BLOCK_CELLS", 20)
    assert np.allclose(ft.som_train(many, "vec", (4, 3), 4, w), whole)


def test_som_train_is_the_whole_map(spark, tmp_path):
    """The registered query trains 400 nodes in 200 passes: hits and errors as numpy has them."""
    x = np.random.default_rng(6).normal(size=(90, 4)) * [3, 2, 1, 1] + [0, 5, 0, 0]
    own = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    own.write.parquet(str(tmp_path / "embeddings.parquet"))
    e = ft.standardize(feature_maps._emb(spark, str(tmp_path)), "vec")
    x, w = np.array([r["vec"] for r in e.orderBy("vec_id").collect()]), ft.som_init(e, "vec", (20, 20))
    d = ft.hex_distances((20, 20))
    s0, s1 = d.max(), d[d > 0].min()
    for it in range(200):
        best = np.linalg.norm(x[:, None, :] - w[None, :, :], axis=2).argmin(axis=1)
        h = np.exp(-d[best] ** 2 / (s0 * (s1 / s0) ** (it / 200)) ** 2)
        w = (h.T @ x) / h.sum(axis=0)[:, None]
    far = np.linalg.norm(x[:, None, :] - w[None, :, :], axis=2)
    best, dist = far.argmin(axis=1), far.min(axis=1)
    got = {r["node"]: (r["hits"], r["qe"]) for r in feature_maps.som_train(spark, str(tmp_path)).collect()}
    assert len(got) > 20 and got == {n: (int((best == n).sum()), pytest.approx(dist[best == n].mean(), abs=1e-6)) for n in set(best.tolist())}


def test_best_nodes_by_products_are_the_measured_ones():
    rng = np.random.default_rng(7)
    x, w = rng.normal(size=(700, 6)), rng.normal(size=(40, 6))
    grid = np.array([[i, j] for i in range(6) for j in range(6)], dtype=float)
    odd = x.copy()
    odd[3, 2], odd[5] = np.nan, np.inf
    cases = [
        (x, w), (x, np.vstack([w, w])), (x, w[:1]), (x[:0], w), (x + 1e7, w + 1e7), (x * 1e-170, w * 1e-170), (x * 1e170, w * 1e170),
        (rng.integers(0, 12, (700, 2)) / 2, grid), (x, np.repeat(w[:9], 4, axis=0) * (1 + 2.3e-16 * rng.integers(-2, 3, (36, 1)))), (odd, w),
    ]
    with np.errstate(all="ignore"):
        for a, b in cases:
            assert (ft._best_nodes(a, b) == ft._distances(a, b).argmin(axis=1)).all()


def test_first_prototype_wins_and_errors(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [0.1, 0.0]])
    w = np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [5.0, 5.0]])
    got = rows(ft.bmu(vectors(spark, x), "vec", w), "id", "node", "second")
    assert got == [(0, 0, 1), (1, 2, 0), (2, 0, 1)]
    e = ft.som_errors(vectors(spark, x), "vec", w, (2, 2)).first()
    assert e["qe"] == pytest.approx(0.1 / 3) and e["te"] == pytest.approx(0.0)


def test_balanced_tiles_sizes(spark):
    df = spark.range(103).select(F.lit("r").alias("region"), F.col("id"), (F.col("id") * 37 % 103).cast("double").alias("x"), (F.col("id") * 11 % 103).cast("double").alias("y"))
    n = [r[1] for r in rows(ft.balanced_tiles(df, "region", "x", "y", "id", per_tile=20).groupBy("tile").count())]
    assert sum(n) == 103 and max(n) - min(n) <= 1 and max(n) <= 22


def test_parts_transitions_and_names(spark):
    df = spark.range(11).select(F.lit("r").alias("k"), "id")
    n = [r[1] for r in rows(sb.equal_parts(df, "k", "id", 4, "p").groupBy("p").count())]
    assert n == [len(p) for p in np.array_split(np.arange(11), 4)]
    assert sb.chop_blocks(df, "k", "id", 12).count() == 0
    b = spark.createDataFrame([("r", "u", 0, 1, 5), ("r", "u", 1, 2, 5), ("r", "u", 2, 2, 4), ("r", "v", 0, 1, 9), ("r", "v", 1, 1, 9)], "recid string, uid string, block int, cat int, n int")
    t = sb.transitions(b, "recid", "uid", "block", "cat", "n", 5)
    assert rows(t, "step", "src", "dst", "n") == [(0, 1, 1, 1), (0, 1, 2, 1)]
    assert sb.stability_index(t).first()["si"] == 0.5
    names = spark.createDataFrame([("off1", "on1"), ("on1", "off2"), ("on1", "off3"), ("off2", "off2")], "a string, b string")
    assert [r[0] for r in names.select(sb.context_pair("a", "b")).collect()] == [True, True, False, False]


def test_coincidence_is_one_for_full_stability(spark):
    t = spark.createDataFrame([(0, 0, 6), (1, 1, 4)], "src int, dst int, n bigint")
    c = {(r["src"], r["dst"]): r["coco"] for r in sb.transition_stats(t).collect()}
    assert c[0, 0] == pytest.approx(1.0) and c[1, 1] == pytest.approx(1.0) and c[0, 1] == pytest.approx(-1.0)


def test_caps_and_samples(spark):
    t = spark.createDataFrame([("r", i, float(i)) for i in range(10)] + [("few", 20, 1.0)], "recid string, win_id int, t double")
    assert rows(sl.cap_trials(t, "recid", 2, 3), "win_id") == [(0,), (1,), (2,)]
    assert sl.cap_trials(t, "recid", 10, 3).count() == 10
    one, two = sl.cap_trials(t, "recid", 2, 3, "random"), sl.cap_trials(t.repartition(3), "recid", 2, 3, "random")
    assert rows(one) == rows(two) and one.count() == 3
    assert sl.sample_per_group(t, "recid", 4, "win_id").count() == 5


def test_crosstab_has_zeros(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "p string, q string")
    assert rows(ag.crosstab(df, "p", "q")) == [("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)]
