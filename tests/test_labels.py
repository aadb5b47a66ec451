"""Harmonised labels, split trees and quality over k against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from pointweave.operators import features as ft
from pointweave.operators import labels


def renamed(a, b, mode):
    """One turn after the other, on plain arrays."""
    sizes = lambda v: sorted(set(v.tolist()), key=lambda x: ((v == x).sum(), x), reverse=True)
    new = {}
    if mode == "desc":
        for x in sizes(a):
            free = {y: ((a == x) & (b == y)).sum() for y in set(b[a == x].tolist()) - set(new)}
            if free:
                new[min(free, key=lambda y: (-free[y], y))] = x
    else:
        for y in set(b.tolist()):
            hit = {x: ((a == x) & (b == y)).sum() for x in set(a[b == y].tolist())}
            new[y] = min(hit, key=lambda x: (-hit[x], x))
    spare = iter(sorted(set(range(len(set(b.tolist())))) - set(new.values())))
    for y in sorted(set(b.tolist()) - set(new)):
        new[y] = next(spare)
    return np.array([new[y] for y in b.tolist()])


def test_chain_both_ways_with_nulls(spark):
    g = np.random.default_rng(4)
    cols = [g.integers(0, k, 300) for k in (3, 5, 8, 12)]
    ref = 1
    want = {ref: cols[ref]}
    for i in (2, 3):
        want[i] = renamed(want[i - 1], cols[i], "desc")
    want[0] = renamed(want[1], cols[0], "asc")
    data = [(i, *[int(c[i]) for c in cols]) for i in range(300)] + [(300, None, None, None, None)]
    df = spark.createDataFrame(data, "id int, c0 int, c1 int, c2 int, c3 int")
    got = labels.harmonize_chain(df, ["c0", "c1", "c2", "c3"], ref).orderBy("id").toPandas()
    for i in range(4):
        assert got[f"c{i}_new"][:300].astype(int).tolist() == want[i].tolist()
        assert np.isnan(got[f"c{i}_new"][300])
    with pytest.raises(ValueError):
        labels.harmonize_chain(df, ["c0"], 1)


def test_large_overlaps_first_and_spare_numbers(spark):
    df = spark.createDataFrame([(0, 5)] * 4 + [(0, 7)] + [(1, 7)] * 3 + [(2, 9)] + [(0, 11)], "a int, b int")
    assert dict(rows(labels.harmonize_labels(df, "a", "b").select("b", "b_new").distinct())) == {5: 0, 7: 1, 9: 2, 11: 3}
    assert labels.harmonize_labels(df.limit(0), "a", "b").count() == 0


def test_split_tree_refines_and_stops_at_equal_vectors(spark):
    pts = [(0.0, 0.0)] * 4 + [(10.0, 0.0)] * 3 + [(10.0, 1.0)] * 2
    df = spark.createDataFrame([(i, list(p)) for i, p in enumerate(pts)], "id int, vec array<double>")
    cuts = [r["labels"] for r in ft.split_tree(df, "vec", 5).orderBy("id").collect()]
    part = lambda k: [{c[k - 1] for c in cuts[a:b]} for a, b in ((0, 4), (4, 7), (7, 9))]
    assert all(len(s) == 1 for k in range(1, 6) for s in part(k))
    assert part(2)[1] == part(2)[2] != part(2)[0]
    assert len({min(s) for s in part(3)}) == 3 and part(3) == part(4) == part(5)


def test_quality_curve_leaves_out_missing_labels(spark):
    g = np.random.default_rng(9)
    data = [(i, [float(v) for v in g.normal(size=3)], [(2, i % 2), (3, None if i > 7 else i % 3)]) for i in range(10)]
    df = spark.createDataFrame(data, "id int, vec array<double>, cuts array<struct<k: int, label: int>>")
    got = {r["k"]: r for r in ft.quality_curve(df, "id", "vec", "cuts").collect()}
    for k, kept in ((2, df), (3, df.where("id <= 7"))):
        one = ft.cluster_quality(kept.withColumn("l", F.col("id") % k), "id", "vec", "l").first()
        assert [got[k][c] for c in ("dunn", "silhouette", "db")] == pytest.approx([one[c] for c in ("dunn", "silhouette", "db")])
