import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import traces as tc


def brute(x, y, max_lag):
    """Products of samples that exist, by position; None where all of them are missing."""
    norm = math.sqrt(sum(v * v for v in x.values() if v is not None) * sum(v * v for v in y.values() if v is not None))
    out = {}
    for lag in range(-max_lag, max_lag + 1):
        pairs = [(x[i + lag], y[i]) for i in y if i + lag in x]
        if pairs:
            p = [a * b for a, b in pairs if a is not None and b is not None]
            out[lag] = sum(p) / norm if p and norm else None
    return out


def check(spark, series, max_lag):
    data = [(k, i, s[0][i], s[1][i]) for k, s in series.items() for i in s[0]]
    got = tc.xcorr(spark.createDataFrame(data, "k string, i long, x double, y double"), "k", max_lag).collect()
    assert len({(r["k"], r["lag"]) for r in got}) == len(got)
    for k, (x, y) in series.items():
        want = brute(x, y, max_lag)
        mine = {r["lag"]: r["c"] for r in got if r["k"] == k}
        assert set(mine) == set(want)
        for lag, c in want.items():
            assert (c is None) == (mine[lag] is None) and (c is None or abs(c - mine[lag]) < 1e-9)


def noise(rng, at):
    return {int(i): float(v) for i, v in zip(at, rng.normal(2, 1, len(at)))}


@pytest.mark.parametrize("frame", [8, 50, 65536])
@pytest.mark.parametrize("max_lag", [0, 5, 40])
def test_frames_against_brute_force(spark, monkeypatch, frame, max_lag):
    monkeypatch.setattr(tc, "FRAME", frame)
    rng = np.random.default_rng(2)
    holes = [i for i in range(-20, 120) if i % 7 and not 30 < i < 60]
    series = {None: (noise(rng, range(90)), noise(rng, range(90))), "holes": (noise(rng, holes), noise(rng, holes)), "one": ({3: 2.0}, {3: 1.0})}
    gaps = noise(rng, range(60))
    gaps[10] = gaps[59] = None
    series["missing"] = (gaps, noise(rng, range(60)))
    series["zero"] = ({0: 0.0, 1: 0.0}, {0: 1.0, 1: 2.0})
    series["none"] = ({0: None, 1: None}, {0: 1.0, 1: 2.0})
    check(spark, series, max_lag)


def test_thousand_lags_over_several_frames(spark, monkeypatch):
    monkeypatch.setattr(tc, "FRAME", 1024)
    rng = np.random.default_rng(4)
    check(spark, {"a": (noise(rng, range(3000)), noise(rng, range(3000))), "short": (noise(rng, range(10)), noise(rng, range(10)))}, 1000)


def test_transforms_equal_direct_sums():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=30000), rng.normal(size=30000)
    big = tc._lagged_sums(x, y, 100)
    direct = [float((x[max(lag, 0):len(x) + min(lag, 0)] * y[max(-lag, 0):len(y) - max(lag, 0)]).sum()) for lag in range(-100, 101)]
    assert np.allclose(big, direct, atol=1e-8)


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], "k string, i long, x double, y double")
    c = tc.xcorr(df, "k", 3)
    assert c.count() == 0
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    same = spark.range(40).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.sin("id").alias("x"), F.sin("id").alias("y"))
    assert tc.xcorr(same, "k", 3).where("lag = 0").first()["c"] == pytest.approx(1.0)
