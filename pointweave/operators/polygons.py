"""Points in polygons by cells that a polygon covers, and the nearest border by a pyramid of boxes around short pieces of edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import scan

LANES = 8  # parts of the points of a cell that meet its edges in different tasks
FAN = 4  # cells of one level that stand side by side in a cell of the next
SLACK = 1e-9  # relative; boxes are compared a little wider than computed, so rounding drops no border
CELLS = 16  # cells that the box around a polygon spans at most along x and along y
TOUCH = 1e-12  # relative to the coordinates; an edge this near to a cell touches it


def polygon_table(spark: SparkSession, polygons: Mapping[str, Sequence[tuple[float, float]]]) -> DataFrame:
    """``(i, roi, v, x, y)``: the corners ``v`` of polygon ``i`` in order."""
    rows = [(i, name, v, float(a), float(b)) for i, (name, pts) in enumerate(polygons.items()) for v, (a, b) in enumerate(pts)]
    return spark.createDataFrame(rows, "i long, roi string, v long, x double, y double")


def polygon_edges(corners: DataFrame) -> DataFrame:
    """``(i, roi, x1, y1, x2, y2)``: each corner of a table like ``polygon_table``'s and the next one, the last back to the first."""
    pts = corners.select("i", "roi", "v", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"))
    e = scan(pts, "i", "v", F.floor(F.col("v") / 4096), _next=("lead", F.struct("x1", "y1")), _first=("first", F.struct("x1", "y1")))
    to = F.coalesce("_next", "_first")
    return e.select("i", "roi", "x1", "y1", to["x1"].alias("x2"), to["y1"].alias("y2"))


def point_in_polygon(points: DataFrame, polygons: Mapping[str, Sequence[tuple[float, float]]] | DataFrame, x: str, y: str, out: str) -> DataFrame:
    """First polygon (smallest ``i``) that contains the point, else the one with the nearest border (ties: smallest ``i``).

    ``polygons`` is a table of corners ``(i, roi, v, x, y)``, or a mapping of names to corners. Neither its edges nor the
    points are bounded: a point meets the polygons whose border touches its cell and that come before the first one that
    covers the cell, and of each the edges of one slab of y. Points in no polygon go down a pyramid of boxes, keeping those
    that may hold the nearest border, to the edges of few leaves. Equal points are settled once. A point with a NULL, NaN or infinite coordinate, and every point where there is no polygon, gets NULL.
    """
    corners = polygons if isinstance(polygons, DataFrame) else polygon_table(points.sparkSession, polygons)
    edges = cut_lineage(polygon_edges(corners))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    size = edges.agg(
        F.count(F.lit(1)).alias("n"), F.min("x1").alias("x0"), F.max("x1").alias("x9"), F.min("y1").alias("y0"), F.max("y1").alias("y9"),
        F.sum(F.when(length < float("inf"), length)).alias("length")).first()
    if not size["n"]:
        return points.withColumn(out, F.lit(None).cast("string"))
    levels = max(1, ceil(log(size["n"]) / log(FAN * FAN)))
    side = FAN ** levels
    height = (size["y9"] - size["y0"]) / side or 1.0
    cell = max(size["x9"] - size["x0"], size["y9"] - size["y0"]) / side or 1.0
    cell = max(cell, (size["length"] or 0.0) / size["n"] / FAN)  # at most FAN + 1 pieces an edge on average
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    spots = points.select(px.alias("px"), py.alias("py")).where((F.abs("px") < float("inf")) & (F.abs("py") < float("inf"))).distinct()
    held = cut_lineage(spots.join(_containing(spots, edges, size["y0"], height), ["px", "py"], "left"))
    near = _nearest(held.where("i IS NULL").select("px", "py"), edges, size["x0"], size["y0"], cell, levels)
    settled = held.where("i IS NOT NULL").select("px", "py", "i").unionByName(near)
    named = settled.join(edges.groupBy("i").agg(F.min("roi").alias("_roi")), "i").select(F.col("px").alias("_px"), F.col("py").alias("_py"), "_roi")
    return points.drop(out).join(named, (px == F.col("_px")) & (py == F.col("_py")), "left").withColumn(out, F.col("_roi")).drop("_px", "_py", "_roi")


def _containing(spots: DataFrame, edges: DataFrame, y0: float, height: float) -> DataFrame:
    """``(px, py, i)``: the first polygon with an odd number of edges right of the point.

    A cell that no edge of a polygon touches lies in it or out of it as a whole, so the first polygon that covers a cell
    bounds what is asked there. Edges that do not close, as of a repeated corner or one that is not a finite number, bound
    no inside and meet all points of a slab.
    """
    real = F.coalesce(reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in ("x1", "y1", "x2", "y2")]), F.lit(False))
    ends = lambda x, y: F.sum(F.xxhash64(x, y).cast("decimal(20,0)"))
    shape = edges.where("i IS NOT NULL").groupBy("i").agg(
        (F.min(real) & (ends("x1", "y1") == ends("x2", "y2"))).alias("closed"), F.min("x1").alias("bx0"), F.max("x1").alias("bx9"), F.min("y1").alias("by0"), F.max("y1").alias("by9"),
        (F.sum(F.abs(F.col("y2") - F.col("y1"))) / F.count(F.lit(1))).alias("step"))  # slabs of this height hold three rows an edge at most
    shape = cut_lineage(shape)
    e = edges.join(shape.where("closed AND step > 0"), "i")
    cells = cut_lineage(_cells(e, shape.where("closed AND step > 0")))
    sizes = F.broadcast(cells.select("w", "h", "x0", "y0").distinct())
    at = lambda p, o, s: F.floor((F.col(p) - F.col(o)) / F.col(s))
    placed = spots.crossJoin(sizes).withColumns({"cx": at("px", "x0", "w"), "cy": at("py", "y0", "h")})
    where = ["w", "h", "cx", "cy"]
    sure = placed.join(cells.where("NOT touched").select(*where, "i"), where).groupBy("px", "py").agg(F.min("i").alias("first"))
    asked = placed.join(cells.where("touched").select(*where, "i", "by0", "step"), where).join(sure, ["px", "py"], "left")
    asked = asked.where("first IS NULL OR i < first").withColumn("slab", at("py", "by0", "step")).select("px", "py", "i", "slab")
    spans = e.where("y1 != y2").withColumn("slab", F.explode(F.sequence(*[F.floor((f("y1", "y2") - F.col("by0")) / F.col("step")) for f in (F.least, F.greatest)])))
    slab = lambda c: F.floor((c - y0) / height)
    loose = edges.join(shape.where("NOT closed").select("i"), "i").where("y1 != y2").withColumn("slab", F.explode(F.sequence(slab(F.least("y1", "y2")), slab(F.greatest("y1", "y2")))))
    met = [asked.join(spans, ["i", "slab"]), spots.withColumn("slab", slab(F.col("py"))).join(loose, "slab")]
    hits = reduce(DataFrame.unionByName, [m.where(_crossed(F.col("px"), F.col("py"))).select("px", "py", "i") for m in met])
    inside = hits.groupBy("px", "py", "i").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("px", "py", "i")
    return inside.unionByName(sure.withColumnRenamed("first", "i")).groupBy("px", "py").agg(F.min("i").alias("i"))


def _right(y: Column) -> Column:
    """Where the edge crosses the height ``y``."""
    return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")


def _crossed(x: Column, y: Column) -> Column:
    return ((F.col("y1") > y) != (F.col("y2") > y)) & (x < _right(y))


def _cells(edges: DataFrame, shape: DataFrame) -> DataFrame:
    """``(w, h, cx, cy, x0, y0, i, touched, by0, step)``: of each cell the first polygon that covers it and those before it whose edges touch it.

    Cells are ``w`` wide and ``h`` high, powers of four at a sixteenth of the polygon's box or up to four times that, so
    polygons of one size share a grid. The parity of a cell is that of its middle.
    """
    box = shape.agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, "bx0"), ("x9", F.max, "bx9"), ("y0", F.min, "by0"), ("y9", F.max, "by9"))])
    e = edges.crossJoin(F.broadcast(box))
    near = lambda a, b: F.greatest(F.abs(a), F.abs(b)) * TOUCH
    size = lambda a, b, wide, tol: F.pow(F.lit(4.0), F.ceil(F.log2(F.greatest((F.col(b) - F.col(a)) / CELLS, wide / (1 << 20), 16 * tol)) / 2))
    e = e.withColumns({"tx": near("x0", "x9"), "ty": near("y0", "y9")})
    e = e.withColumns({"w": F.coalesce(size("bx0", "bx9", F.col("x9") - F.col("x0"), F.col("tx")), F.lit(1.0)), "h": size("by0", "by9", F.col("y9") - F.col("y0"), F.col("ty"))})
    col = lambda x: F.floor((x - F.col("x0")) / F.col("w"))
    row = lambda y: F.floor((y - F.col("y0")) / F.col("h"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.withColumn("cy", F.explode(F.sequence(row(low - F.col("ty")), row(high + F.col("ty")))))
    # the part of the edge in this row of cells, a little longer
    inside = lambda y: F.least(F.greatest(y, low), high)
    ends = [inside(F.col("y0") + F.col("cy") * F.col("h") - F.col("ty")), inside(F.col("y0") + (F.col("cy") + 1) * F.col("h") + F.col("ty"))]
    xs = [F.when(F.col("y1") == F.col("y2"), F.col(x)).otherwise((y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")) + F.col("x1")) for x, y in zip(("x1", "x2"), ends, strict=True)]
    middle = F.col("y0") + (F.col("cy") + 0.5) * F.col("h")
    e = e.withColumns({
        "c0": col(F.least(*xs) - F.col("tx")), "c1": col(F.greatest(*xs) + F.col("tx")),
        "last": F.when((F.col("y1") > middle) != (F.col("y2") > middle), F.ceil((_right(middle) - F.col("x0")) / F.col("w") - 0.5) - 1)})
    start = F.when(F.col("last").isNotNull(), F.least(col(F.col("bx0")), "c0")).otherwise(F.col("c0"))
    e = e.withColumn("cx", F.explode(F.sequence(start, "c1")))
    where = ["w", "h", "cx", "cy"]
    c = e.groupBy("i", *where).agg(
        F.max(F.col("cx") >= F.col("c0")).alias("touched"), F.count(F.when(F.col("cx") <= F.col("last"), 1)).alias("n"), *[F.min(x).alias(x) for x in ("x0", "y0", "by0", "step")])
    c = cut_lineage(c.where("touched OR n % 2 = 1").drop("n"))
    first = c.where("NOT touched").groupBy(*where).agg(F.min("i").alias("first"))
    return c.join(first, where, "left").where("first IS NULL OR i < first OR (i = first AND NOT touched)").drop("first")


def _nearest(spots: DataFrame, edges: DataFrame, x0: float, y0: float, cell: float, levels: int) -> DataFrame:
    """``(px, py, i)``: the polygon of the nearest edge."""
    pieces = cut_lineage(_pieces(edges, x0, y0, cell, FAN ** levels - 1))
    boxes = [F.min("left").alias("left"), F.max("right").alias("right"), F.min("low").alias("low"), F.max("high").alias("high")]
    nodes = [pieces.groupBy("cx", "cy").agg(*boxes)]
    for _ in range(levels - 1):
        up = nodes[-1].select(F.floor(F.col("cx") / FAN).alias("cx"), F.floor(F.col("cy") / FAN).alias("cy"), "left", "right", "low", "high")
        nodes.append(up.groupBy("cx", "cy").agg(*boxes))
    at = spots.withColumns({"cx": F.lit(0).cast("bigint"), "cy": F.lit(0).cast("bigint")})  # the one cell above all
    for below in reversed(nodes):
        kids = below.withColumns({"kx": F.col("cx"), "ky": F.col("cy"), "cx": F.floor(F.col("cx") / FAN), "cy": F.floor(F.col("cy") / FAN)})
        at = _kept(at.join(kids, ["cx", "cy"])).select("px", "py", F.col("kx").alias("cx"), F.col("ky").alias("cy"))
    # few small rows make many pairs: they are dealt over all tasks, and each pair is folded where it arises
    lane, parts = ["cx", "cy", "lane"], int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = cut_lineage(at.withColumn("lane", F.pmod(F.xxhash64("px", "py"), F.lit(LANES))).repartition(parts, *lane))
    whole = pieces.groupBy("cx", "cy", "x1", "y1", "x2", "y2").agg(F.min("i").alias("i")).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))))
    met = at.repartition(parts, *lane).join(whole.repartition(parts, *lane), lane).select("px", "py", "i", F.coalesce(_distance(), F.lit(-1.0)).alias("d"))  # an edge without a place comes first
    best = met.groupBy("px", "py").agg(F.min("d").alias("best"))
    return met.join(cut_lineage(best), ["px", "py"]).where("d = best").groupBy("px", "py").agg(F.min("i").alias("i"))


def _pieces(edges: DataFrame, x0: float, y0: float, cell: float, last: int) -> DataFrame:
    """Edges cut to pieces no longer than a cell, each in the cell of its middle, with the box around it."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / cell), F.lit(1))
    p = edges.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    a, b = F.col("k") / F.col("n"), (F.col("k") + 1) / F.col("n")
    p = p.withColumns({"ax": F.col("x1") + a * dx, "ay": F.col("y1") + a * dy, "bx": F.col("x1") + b * dx, "by": F.col("y1") + b * dy})
    at = lambda s, t, o: F.greatest(F.least(F.floor(((F.col(s) + F.col(t)) / 2 - o) / cell), F.lit(last)), F.lit(0)).cast("bigint")
    return p.select(
        "i", "x1", "y1", "x2", "y2", F.least("ax", "bx").alias("left"), F.greatest("ax", "bx").alias("right"), F.least("ay", "by").alias("low"),
        F.greatest("ay", "by").alias("high"), at("ax", "bx", x0).alias("cx"), at("ay", "by", y0).alias("cy"))


def _kept(at: DataFrame) -> DataFrame:
    """Boxes that may hold the nearest border: no farther at their near side than the best box is at its far corner."""
    near = lambda p, a, b: F.greatest(F.col(a) - F.col(p), F.col(p) - F.col(b), F.lit(0.0))
    far = lambda p, a, b: F.greatest(F.abs(F.col(p) - F.col(a)), F.abs(F.col(p) - F.col(b)))
    reach = lambda f: F.hypot(f("px", "left", "right"), f("py", "low", "high"))
    at = at.withColumns({"_lo": reach(near), "_hi": reach(far)})
    best = at.groupBy("px", "py").agg((F.min("_hi") * (1 + SLACK)).alias("_best"))
    return at.join(best, ["px", "py"]).where(F.col("_lo") * (1 - SLACK) <= F.col("_best"))


def _distance() -> Column:
    """Squared distance of the point to the whole edge."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    u = ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(u, F.lit(0.0))))
    ex, ey = F.col("px") - (F.col("x1") + u * dx), F.col("py") - (F.col("y1") + u * dy)
    return ex * ex + ey * ey
