"""Theil-Sen slopes by selection against all pairs."""

import numpy as np
import pytest

from pointweave.operators import slopes


def by_pairs(x, y):
    i, j = np.triu_indices(len(x), 1)
    ok = x[i] != x[j]
    return np.median((y[i] - y[j])[ok] / (x[i] - x[j])[ok])


def frame(spark, x, y):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")


CASES = {
    "close x": lambda g: (np.arange(300) // 2 + np.arange(300) % 2 * 1e-9, g.normal(size=300)),
    "lattice": lambda g: (g.integers(0, 9, 300), g.integers(0, 5, 300)),
    "repeats": lambda g: (np.repeat(g.normal(size=60), 5), np.repeat(g.normal(size=60), 5)),
}


@pytest.mark.parametrize("case", CASES)
def test_rounds_reach_the_median_of_all_pairs(spark, monkeypatch, case):
    monkeypatch.setattr(slopes, "SAMPLE", 512)
    x, y = (np.asarray(v, dtype=float) for v in CASES[case](np.random.default_rng(5)))
    r = slopes.theil_sen(frame(spark, x, y), "x", "y", few=1500).first()
    want = by_pairs(x, y)
    assert r["slope"] == pytest.approx(want, rel=1e-12, abs=1e-12)
    assert r["intercept"] == pytest.approx(np.median(y) - want * np.median(x), rel=1e-9, abs=1e-9)


def test_counts_and_lists_against_pairs(spark):
    g = np.random.default_rng(8)
    x, y = g.integers(0, 20, 120).astype(float), g.normal(size=120)
    i, j = np.triu_indices(120, 1)
    ok = x[i] != x[j]
    s = ((y[i] - y[j])[ok] / (x[i] - x[j])[ok])
    pts = frame(spark, x, y).selectExpr("x", "y", "1L AS w")
    pts = slopes.scan(pts, [], ["x", "y"], slopes.magnitude_chunk("x"), r="row")
    got = slopes._counts(pts, [-0.5, 0.1, 2.0], 7)
    assert [got[c][0] for c in (-0.5, 0.1, 2.0)] == [(s < c).sum() for c in (-0.5, 0.1, 2.0)]
    for lo, hi in ((None, None), (None, 0.1), (-0.5, None), (-0.5, 0.1)):
        inside = s[(s >= (-np.inf if lo is None else lo)) & (s < (np.inf if hi is None else hi))]
        found = slopes._slopes(pts, slopes._tree(slopes._orders(pts, lo, hi), [], 7)).toPandas()["s"]
        assert np.allclose(np.sort(found), np.sort(inside), atol=1e-12)


def test_no_slope_and_odd_values(spark):
    assert slopes.theil_sen(frame(spark, [], []), "x", "y").first() == (None, None)
    assert slopes.theil_sen(frame(spark, [1, 1], [2, 3]), "x", "y").first() == (None, None)
    odd = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 2.0), (float("inf"), 0.0), (0.0, 1.0), (2.0, 5.0)], "x double, y double")
    assert slopes.theil_sen(odd, "x", "y").first() == (2.0, 1.0)
