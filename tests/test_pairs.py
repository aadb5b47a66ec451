import math

import numpy as np
import pytest

from pointweave.operators import features as ft


@pytest.mark.parametrize("block", [1, 4, 512])
def test_blocks_against_each_pair_by_itself(spark, monkeypatch, block):
    monkeypatch.setattr(ft, "BLOCK", block)
    rng = np.random.default_rng(3)
    vecs = {f"g{i:02d}": [float(x) for x in rng.normal(size=5)] for i in range(14)}
    vecs |= {"const": [0.1] * 5, "zero": [0.0] * 5, "holes": [1.0, None, 2.0, None, 4.0], "short": [3.0, 1.0], "none": [None] * 5, "empty": []}
    df = spark.createDataFrame([*vecs.items(), (None, [1.0] * 5), ("nothing", None)], "g string, v array<double>")
    got = {(r["src"], r["dst"]): r for r in ft.pair_moments(df, "g", "v").collect()}
    want = {}
    for a in vecs:
        for b in vecs:
            both = [(x, y) for x, y in zip(vecs[a], vecs[b]) if x is not None and y is not None]
            if a < b and both:
                want[a, b] = np.array(both).T
    assert set(got) == set(want)
    for pair, (x, y) in want.items():
        r = got[pair]
        norm = math.sqrt((x @ x) * (y @ y))
        flat = len(set(x)) == 1 or len(set(y)) == 1
        assert r["dist"] == pytest.approx(math.sqrt(((x - y) ** 2).sum()))
        assert r["cosine"] == pytest.approx(x @ y / norm if norm else 0.0)
        assert r["corr"] == pytest.approx(0.0 if flat else np.corrcoef(x, y)[0, 1])


def test_no_vectors(spark):
    assert ft.pair_moments(spark.createDataFrame([], "g long, v array<double>"), "g", "v").count() == 0
