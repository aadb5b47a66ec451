"""Points in polygons against the plain test of every edge."""

import numpy as np
from pyspark.sql import functions as F

from pointweave.operators import polygons


def brute(shapes, px, py):
    """Index of the first polygon that holds each point, else of the one with the nearest edge."""
    inside, dist = [], []
    for pts in shapes:
        a = np.asarray(pts, dtype=float)
        b = np.roll(a, -1, axis=0)
        dx, dy = (b - a).T
        with np.errstate(divide="ignore", invalid="ignore"):
            at = dx * (py[:, None] - a[:, 1]) / dy + a[:, 0]
            u = ((px[:, None] - a[:, 0]) * dx + (py[:, None] - a[:, 1]) * dy) / (dx * dx + dy * dy)
        spans = (a[:, 1] > py[:, None]) != (b[:, 1] > py[:, None])
        inside.append((spans & (px[:, None] < at)).sum(axis=1) % 2 == 1)
        u = np.clip(np.nan_to_num(u), 0, 1)
        dist.append((((px[:, None] - (a[:, 0] + u * dx)) ** 2) + (py[:, None] - (a[:, 1] + u * dy)) ** 2).min(axis=1))
    inside, dist = np.array(inside), np.array(dist)
    return np.where(inside.any(axis=0), inside.argmax(axis=0), dist.argmin(axis=0))


def ask(spark, shapes, pts, table=False):
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, x double, y double")
    named = {f"p{i}": s for i, s in enumerate(shapes)}
    got = polygons.point_in_polygon(p, polygons.polygon_table(spark, named) if table else named, "x", "y", "roi")
    return [r["roi"] for r in got.orderBy("id").collect()]


def test_first_of_several_borders_and_corners(spark):
    shapes = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(6, 0), (12, 0), (12, 2), (8, 2), (8, 6), (6, 6)], [(2, 2), (9, 2), (9, 9)]]
    pts = [(1, 1), (7, 5), (11, 5), (5.2, 1), (4.5, 9), (3, 3), (4, 2), (0, 0), (12, 2), (2, 4), (5, 5), (1e6, -1e6), (5, 1), (1, 1)]
    want = brute(shapes, *np.array(pts, dtype=float).T)
    assert ask(spark, shapes, pts) == [f"p{i}" for i in want]


def test_many_edges_concave(spark):
    """100,000 edges in five ragged rings, one of them with half of all edges."""
    g = np.random.default_rng(3)
    shapes = []
    for k, n in enumerate((50_000, 20_000, 15_000, 10_000, 5_000)):
        a = np.linspace(0, 2 * np.pi, n, endpoint=False)
        r = 10 + 3 * np.sin(9 * a) + g.uniform(-0.2, 0.2, n)
        shapes.append(np.stack([30 * k + r * np.cos(a), 5 * k + r * np.sin(a)], axis=1))
    pts = np.concatenate([g.uniform((-30, -30), (160, 60), (300, 2)), g.uniform(-2000, 2000, (20, 2)), shapes[2][::3000]])
    with np.errstate(all="ignore"):
        want = brute(shapes, *pts.T)
    assert ask(spark, [[(float(x), float(y)) for x, y in s] for s in shapes], pts, table=True) == [f"p{i}" for i in want]


def test_odd_points_and_no_polygon(spark):
    p = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (1.0, float("inf")), (1.0, 1.0)], "x double, y double")
    one = polygons.polygon_table(spark, {"a": [(0, 0), (2, 0), (1, 3)], "dot": [(5, 5)]})
    got = polygons.point_in_polygon(p.withColumn("roi", p.x), one, "x", "y", "roi").collect()
    assert sorted((r["roi"] or "") for r in got) == ["", "", "", "a"]
    assert {r["roi"] for r in polygons.point_in_polygon(p, one.limit(0), "x", "y", "roi").collect()} == {None}


def test_many_overlapping_polygons_leave_few_to_ask(spark):
    """Polygons of three sizes, thirty deep: the first that holds a point, and few cells and pieces kept for each polygon."""
    g = np.random.default_rng(5)
    shapes = []
    for k in range(1500):
        x, y, s = g.uniform(0, 20), g.uniform(-500, 9000), (0.05, 1.0, 1.4)[k % 3]
        shapes.append([(x - 0.5 * s, y), (x + 0.4 * s, y - 1500 * s), (x - (0.1 if k % 2 else 0.4) * s, y), (x + 0.4 * s, y + 1500 * s)])
    pts = np.concatenate([g.uniform((-1, -2500), (21, 11000), (1500, 2)), np.array([p for s in shapes[::50] for p in s])])
    with np.errstate(all="ignore"):
        want = brute(shapes, *pts.T)
    assert ask(spark, shapes, pts, table=True) == [f"p{i}" for i in want]
    edges = polygons.polygon_edges(polygons.polygon_table(spark, {f"p{i}": s for i, s in enumerate(shapes)})).cache()
    shape = edges.groupBy("i").agg(F.min("x1").alias("bx0"), F.max("x1").alias("bx9"), F.min("y1").alias("by0"), F.max("y1").alias("by9"), F.lit(1.0).alias("step"))
    assert polygons._cells(edges.join(shape, "i"), shape).count() < 40 * len(shapes)


def test_open_chain(spark):
    """A chain without its way back has no inside: each of its edges counts, as far left as a point may be."""
    edges = polygons.polygon_edges(polygons.polygon_table(spark, {"a": [(0, 0), (2, 0), (1, 3)]})).where("NOT (x1 = 1 AND y1 = 3)")
    p = spark.createDataFrame([(1.0, 1.0), (-9.0, 1.0), (1.9, 1.0), (-9.0, 7.0)], "px double, py double")
    assert sorted((r["px"], r["i"]) for r in polygons._containing(p, edges, 0.0, 1.0).collect()) == [(-9.0, 0), (1.0, 0)]
