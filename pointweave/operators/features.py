"""Feature vectors: scaling, principal components, self-organising maps, clustering and cluster quality.

Rows carry their vector in an array column. What goes through the driver is model-sized only: moments and
covariances (dimension), prototypes and centroids (nodes), each behind ``MAX_MODEL`` cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import correlation, dot, names, ratio, sq_distance
from ..session import cut_lineage
from .aggregate import with_share
from .scan import join_null_safe, magnitude_chunk, percentile_columns, range_chunks, scan

MAX_MODEL = 4_000_000  # cells of a model array that may travel to every task
BLOCK_CELLS = 500_000  # values of a block of packed vectors
DRIVER_CELLS = 4_000_000  # cells of the tasks' models that one pass may bring to the driver
HEX_ROW = 0.8660254  # fixed value: row spacing of the hexagonal grid


def _check_cells(*shape: int) -> None:
    cells = int(np.prod(shape))
    if cells > MAX_MODEL:
        raise ValueError(f"model of {cells} cells exceeds the bound of {MAX_MODEL}")


def _bounded(model: np.ndarray) -> np.ndarray:
    _check_cells(*model.shape)
    return model


def as_vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn(vec, F.col(vec).cast("array<double>"))


def dimension(df: DataFrame, vec: str) -> int:
    row = df.select(F.size(vec)).first()
    if row is None:
        raise ValueError("no vectors")
    return row[0]


def moments(df: DataFrame, vec: str, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population sd per dimension (one aggregation)."""
    d = d or dimension(df, vec)
    row = df.agg(*[F.avg(F.col(vec)[i]) for i in range(d)], *[F.stddev_pop(F.col(vec)[i]) for i in range(d)]).first()
    return np.array(row[:d], dtype=float), np.array(row[d:], dtype=float)


def _literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def standardize(
    df: DataFrame, vec: str, weights: Sequence[float] | None = None, ref: tuple[Sequence[float], Sequence[float]] | None = None
) -> DataFrame:
    """(x - mean) / population sd * weight per dimension; ``ref`` projects new data with stored moments.

    An empty table stays empty.
    """
    if ref is None and df.isEmpty():
        return df
    mu, sd = ref if ref is not None else moments(df, vec)
    w = weights if weights is not None else [1.0] * len(mu)
    m, s, g = _literal(mu), _literal(sd), _literal(w)
    return df.withColumn(vec, F.transform(vec, lambda x, i: ratio(x - F.get(m, i), F.get(s, i)) * F.get(g, i)))


def covariance(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and row count; each task folds its rows to one d x d block first."""
    d = dimension(df, vec)
    _check_cells(d, d)
    shift = np.array(df.agg(*[F.avg(F.col(vec)[i]) for i in range(d)]).first(), dtype=float)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, gram = 0, np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf[vec].to_numpy()) - shift
                n, gram = n + len(x), gram + x.T @ x
        yield pd.DataFrame({"i": np.arange(d), "n": n, "row": list(gram)})

    parts = df.select(vec).mapInPandas(fold, "i int, n bigint, row array<double>")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(d)]).orderBy("i").collect()
    n = rows[0]["n"]
    gram = np.array([[r[f"c{j}"] for j in range(d)] for r in rows])
    return shift, gram / max(n - 1, 1), n


def principal_axes(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and axes as columns; the largest loading of each axis is positive."""
    val, vecs = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1]
    val, vecs = val[order], vecs[:, order]
    flip = np.sign(vecs[np.abs(vecs).argmax(axis=0), np.arange(vecs.shape[1])])
    return val, vecs * np.where(flip == 0, 1, flip)


def pca_scores(df: DataFrame, vec: str, share: float = 0.95, max_comps: int | None = None, out: str = "scores") -> DataFrame:
    """Scores on the leading components whose explained variance first exceeds ``share``."""
    mu, cov, _ = covariance(df, vec)
    val, axes = principal_axes(cov)
    k = int(np.argmax(np.cumsum(val) / val.sum() > share)) + 1
    k = min(k, max_comps) if max_comps else k
    offset = mu @ axes
    return df.withColumn(out, F.array(*[dot(vec, _literal(axes[:, j])) - F.lit(float(offset[j])) for j in range(k)]))


def som_shape(df: DataFrame, vec: str, n_nodes: float | None = None) -> tuple[int, int]:
    """Grid (columns, rows) from the ratio of the two largest covariance eigenvalues; default 5 sqrt(n) nodes."""
    _, cov, n = covariance(df, vec)
    val, _ = principal_axes(cov)
    r = val[1] / val[0]
    x = np.sqrt((n_nodes or 5 * np.sqrt(n)) / r)
    return int(np.ceil(x * r)), int(np.ceil(x))


def hex_grid(shape: tuple[int, int]) -> np.ndarray:
    """Node positions, row by row; odd rows are shifted by half a step."""
    nx, ny = shape
    col, row = np.tile(np.arange(nx), ny), np.repeat(np.arange(ny), nx)
    return np.column_stack([col + 0.5 * (row % 2), row * HEX_ROW])


def hex_distances(shape: tuple[int, int]) -> np.ndarray:
    p = hex_grid(shape)
    return np.linalg.norm(p[:, None, :] - p[None, :, :], axis=2)


def som_init(df: DataFrame, vec: str, shape: tuple[int, int]) -> np.ndarray:
    """Initial prototypes on the plane of the two leading components, rounded to 6 digits."""
    nx, ny = shape
    mu, cov, _ = covariance(df, vec)
    val, axes = principal_axes(cov)
    unit = lambda k: np.linspace(-1, 1, k) if k > 1 else np.zeros(1)
    a, b = np.repeat(unit(ny), nx), np.tile(unit(nx), ny)
    return np.round(mu + np.outer(a * val[0], axes[:, 0]) + np.outer(b * val[1], axes[:, 1]), 6)


def _distances(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Euclidean distances rows x nodes, in row blocks that keep memory flat."""
    out = np.empty((len(x), len(w)))
    step = max(1, int(2_000_000 / max(w.size, 1)))
    for i in range(0, len(x), step):
        out[i:i + step] = np.sqrt(((x[i:i + step, None, :] - w[None, :, :]) ** 2).sum(axis=2))
    return out


def nearest_node(vec: str, prototypes: np.ndarray) -> Column:
    """``struct(node, dist, second)``: best and second node and the distance; the first index wins ties."""
    w = _bounded(np.asarray(prototypes, dtype=float))

    @F.pandas_udf("node int, dist double, second int")
    def best(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"node": [], "dist": [], "second": []}).astype({"node": "int32", "second": "int32"})
        d = _distances(np.vstack(v.to_numpy()), w)
        order = np.argsort(d, axis=1, kind="stable")[:, :2]
        first = order[:, 0]
        second = order[:, 1] if w.shape[0] > 1 else np.full(len(d), -1)
        return pd.DataFrame({"node": first.astype("int32"), "dist": d[np.arange(len(d)), first], "second": second.astype("int32")})

    return best(F.col(vec))


def bmu(df: DataFrame, vec: str, prototypes: np.ndarray) -> DataFrame:
    return df.withColumn("_b", nearest_node(vec, prototypes)).select(*df.columns, "_b.node", "_b.dist", "_b.second")


def som_hits(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("node").agg(F.count(F.lit(1)).alias("hits"))


def _best_nodes(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``_distances(x, w).argmin(axis=1)`` by matrix products, in row blocks that keep memory flat.

    Squared distances about the middle of the nodes, less a row's own part, err by less than ``slack``. Rows whose two
    least lie nearer to each other than that, or have values that are not finite, are measured directly.
    """
    mid = w.mean(axis=0)
    nodes = w - mid
    size = (nodes ** 2).sum(axis=1)
    eps = 16 * (w.shape[1] + 4) * np.finfo(float).eps
    out = np.empty(len(x), dtype=np.int64)
    step = max(1, 250_000 // len(w))
    for i in range(0, len(x), step):
        part = x[i:i + step] - mid
        score = part @ (-2 * nodes.T)
        score += size
        at, best = np.arange(len(part)), score.argmin(axis=1)
        least = score[at, best]
        score[at, best] = np.inf
        slack = eps * (np.sqrt((part ** 2).sum(axis=1)) + np.sqrt(size.max())) ** 2
        unsure = np.nonzero(~(score.min(axis=1) - least > slack))[0]
        if len(unsure):
            best[unsure] = _distances(x[i:i + step][unsure], w).argmin(axis=1)
        out[i:i + step] = best
    return out


def som_train(
    df: DataFrame, vec: str, shape: tuple[int, int], iters: int = 200, init: np.ndarray | None = None
) -> np.ndarray:
    """Batch map on a hexagonal grid.

    The neighbourhood weight depends on a row only through its best node, so one pass needs just the count
    and vector sum per node: each task folds its rows to that, Spark adds the folds up, and the driver
    applies the nodes x nodes neighbourhood. Sigma shrinks from the largest to the smallest grid distance.
    """
    grid = hex_distances(shape)
    _bounded(grid)
    w = _bounded(np.asarray(som_init(df, vec, shape) if init is None else init, dtype=float))
    k, d = w.shape
    s0, s1 = grid.max(), grid[grid > 0].min() if k > 1 else 1.0
    blocks = _packed(df, vec, d).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for it in range(iters):
            h = np.exp(-(grid ** 2) / (s0 * (s1 / s0) ** (it / iters)) ** 2) if k > 1 else np.ones((1, 1))
            n, s = _fold_by_node(blocks, w)
            mass = h @ n
            w = np.where(mass[:, None] > 0, (h @ s) / np.maximum(mass, 1e-300)[:, None], w)
    finally:
        blocks.unpersist()
    return w


def _packed(df: DataFrame, vec: str, d: int) -> RDD[bytes]:
    """Vectors as blocks of doubles, for passes that read all rows again and again: no plan, no row by row conversion."""
    step = max(1, BLOCK_CELLS // d) * d

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            if lists.null_count or not pc.all(pc.equal(pc.list_value_length(lists), d)).as_py():
                raise ValueError(f"a vector is missing or has not {d} values")
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
            for i in range(0, len(x), step):
                yield pa.record_batch({"x": pa.array([x[i:i + step].tobytes()], pa.binary())})

    return df.select(vec).mapInArrow(pack, "x binary").rdd.map(lambda r: bytes(r["x"]))


def _fold_by_node(blocks: RDD[bytes], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and vector sum of each node. A core folds all its partitions to one model, so what moves in a pass does not
    depend on the rows. Few models meet on the driver; more than ``DRIVER_CELLS`` meet by spans of nodes in tasks before."""
    k, d = w.shape
    tasks = max(1, min(blocks.getNumPartitions(), blocks.context.defaultParallelism))
    spans = 1 if tasks * k * (d + 1) <= DRIVER_CELLS else min(k, math.isqrt(tasks) + 1)
    cuts = [k * i // spans for i in range(spans + 1)]

    def fold(parts: Iterator[bytes]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        n, s = np.zeros(k), np.zeros((k, d))
        with np.errstate(invalid="ignore", over="ignore"):
            for part in parts:
                x = np.frombuffer(part).reshape(-1, d)
                b = _best_nodes(x, w)
                n += np.bincount(b, minlength=k)
                order = np.argsort(b, kind="stable")
                hit, first = np.unique(b[order], return_index=True)
                s[hit] += np.add.reduceat(x[order], first, axis=0)
        if n.any():  # a task may have no rows
            yield from ((i, (n[cuts[i]:cuts[i + 1]], s[cuts[i]:cuts[i + 1]])) for i in range(spans))

    parts = blocks.coalesce(tasks).mapPartitions(fold)
    if spans > 1:
        parts = parts.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), spans)
    n, s = np.zeros(k), np.zeros((k, d))
    for i, (rows, total) in parts.collect():
        n[cuts[i]:cuts[i + 1]] += rows
        s[cuts[i]:cuts[i + 1]] += total
    return n, s


def som_errors(df: DataFrame, vec: str, prototypes: np.ndarray, shape: tuple[int, int], by: Sequence[str] | str = ()) -> DataFrame:
    """Quantisation error (mean distance) and topographic error (share of rows whose two best nodes are not neighbours)."""
    near = np.isclose(hex_distances(shape), 1.0)
    pairs = [int(i) * near.shape[0] + int(j) for i, j in zip(*np.nonzero(near), strict=True)]
    key = F.col("node") * near.shape[0] + F.col("second")
    return bmu(df, vec, prototypes).groupBy(*names(by)).agg(
        F.avg("dist").alias("qe"), F.avg((~key.isin(pairs)).cast("int")).alias("te"), F.count(F.lit(1)).alias("n"))


def group_means(df: DataFrame, vec: str, group: Sequence[str] | str, d: int | None = None) -> DataFrame:
    """``(group, n, vec)``: mean vector per group, one aggregation."""
    d = d or dimension(df, vec)
    return df.groupBy(*names(group)).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col(vec)[i]) for i in range(d)]).alias(vec))


def collect_model(means: DataFrame, key: str, vec: str) -> tuple[list, np.ndarray]:
    """Keys and matrix of a model-sized table, ordered by key; its size is checked before it is fetched."""
    _check_cells(means.count(), dimension(means, vec))
    rows = means.select(key, vec).orderBy(key).collect()
    return [r[0] for r in rows], _bounded(np.array([r[1] for r in rows], dtype=float))


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 1, out: str = "label") -> DataFrame:
    feats = df.withColumn("_f", array_to_vector(F.col(vec)))
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol=out).fit(feats)
    return model.transform(feats).drop("_f")


def split_tree(df: DataFrame, vec: str, k: int, seed: int = 1, out: str = "labels") -> DataFrame:
    """Divisive clustering by one tree: ``labels[i]`` is the row's class in the cut with ``i + 1`` classes.

    The class with the largest sum of squared distances is split in two, so each cut refines the one before: the new
    class gets the next number, the others keep theirs. Once only classes of equal vectors are left, later cuts repeat
    the last one. Only centres and one sum per class come to the driver.
    """
    d = dimension(df, vec)
    now = cut_lineage(df.withColumns({"_f": array_to_vector(F.col(vec)), "_at": F.lit(0), out: F.array(F.lit(0))}))
    spread: dict[int, float] = {}
    fresh = [0]
    for i in range(1, k):
        spread |= _spreads(now.where(F.col("_at").isin(fresh)), vec, "_at", d)
        at = max(spread, key=lambda c: (spread[c], -c))
        if spread[at] <= 0:
            now = now.withColumn(out, F.concat(out, F.array("_at")))
            fresh = [at]
            continue
        centres = KMeans(k=2, seed=seed, featuresCol="_f").fit(now.where(F.col("_at") == at)).clusterCenters()
        if len(centres) < 2:
            raise ValueError("a class with some spread has one centre only")
        _check_cells(2, d)
        closer = sq_distance(F.col(vec), _literal(centres[1])) < sq_distance(F.col(vec), _literal(centres[0]))
        now = now.withColumn("_at", F.when((F.col("_at") == at) & closer, i).otherwise(F.col("_at")))
        now = cut_lineage(now.withColumn(out, F.concat(out, F.array("_at"))))
        fresh = [at, i]
    return now.drop("_f", "_at")


def _spreads(df: DataFrame, vec: str, label: str, d: int) -> dict[int, float]:
    """Sum of squared distances to the class mean per class; 0 where all vectors of a class are equal."""
    v = [F.col(vec)[j] for j in range(d)]
    got = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.var_pop(c) for c in v]).alias("s"), F.array(*[F.max(c) - F.min(c) for c in v]).alias("w"))
    return {r[label]: r["n"] * sum(r["s"]) if max(r["w"]) > 0 else 0.0 for r in got.collect()}


def bisecting(df: DataFrame, vec: str, ks: Sequence[int], seed: int = 1) -> DataFrame:
    """Divisive clustering for every k: one row per (row, k), all cuts from one tree."""
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), F.col("_cuts")[k - 1].alias("label")) for k in ks])
    return split_tree(df, vec, max(ks), seed, "_cuts").withColumn("_c", F.explode(cuts)).withColumns({"k": F.col("_c.k"), "label": F.col("_c.label")}).drop("_c", "_cuts")


def gmm_confidence(df: DataFrame, vec: str, k: int, seed: int = 1) -> DataFrame:
    """Mixture label and the largest posterior as confidence."""
    feats = df.withColumn("_f", array_to_vector(F.col(vec)))
    m = GaussianMixture(k=k, seed=seed, featuresCol="_f", predictionCol="label", probabilityCol="_p").fit(feats).transform(feats)
    return m.withColumn("confidence", F.array_max(vector_to_array("_p"))).drop("_f", "_p")


def node_label(assigned: DataFrame, labels: DataFrame, node: str = "node") -> DataFrame:
    """Category of each entity through its map node."""
    return assigned.join(labels, node, "left")


def relabel_by_median(df: DataFrame, label: str, feature: str, out: str = "new_label", descending: bool = False) -> DataFrame:
    """Labels renumbered from 0 by the rank of their feature median."""
    med = percentile_columns(df, label, feature, {"_med": 0.5})
    key = F.desc("_med") if descending else F.asc("_med")
    rank = med.select(label, (F.row_number().over(Window.orderBy(key, label)) - 1).alias(out))  # one row per label
    return join_null_safe(df, rank, [label])


def relabel_by_distance(df: DataFrame, label: str, features: Sequence[str], sort_feature: str, out: str = "new_label", low_to_high: bool = True) -> DataFrame:
    """Labels renumbered by the distance of their median vector to that of the cluster with the largest median of one feature."""
    at = list(features).index(sort_feature) if sort_feature in features else len(features)
    cells = F.posexplode(F.array(*[F.col(f).cast("double") for f in [*features, sort_feature][: max(len(features), at + 1)]])).alias("_dim", "_cell")
    med = percentile_columns(df.select(label, cells), [label, "_dim"], "_cell", {"_m": 0.5})  # all features in one pass
    of = lambda i: F.max(F.when(F.col("_dim") == i, F.col("_m")))
    v = med.groupBy(label).agg(F.array(*[of(i) for i in range(len(features))]).alias("_v"), of(at).alias("_s"))
    ref = v.agg(F.max_by("_v", F.struct("_s", -F.col(label))).alias("_ref")).withColumn("_k", F.lit(1))
    dist = v.withColumn("_k", F.lit(1)).join(ref, "_k").withColumn("_d", sq_distance("_v", "_ref"))  # one row per label
    key = F.desc("_d") if low_to_high else F.asc("_d")
    return join_null_safe(df, dist.select(label, (F.row_number().over(Window.orderBy(key, label)) - 1).alias(out)), [label])


def relabel_fixed(df: DataFrame, label: str, mapping: dict, out: str = "new_label") -> DataFrame:
    """Labels replaced by a table of old and new ones; others, NULL included, stay."""
    if not mapping:
        return df.withColumn(out, F.col(label))
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(label)), F.col(label)))


def davies_bouldin(df: DataFrame, vec: str, label: str, by: Sequence[str] | str = ()) -> DataFrame:
    """Mean over clusters of the worst (scatter_i + scatter_j) / centroid distance, per ``by``; only cluster-sized joins.

    A row without a label belongs to no cluster.
    """
    keys = names(by)
    df = df.where(F.col(label).isNotNull())
    cent = group_means(df, vec, [*keys, label]).withColumnRenamed(vec, "_c").select(*keys, label, "_c")
    near = join_null_safe(df, cent, [*keys, label])
    scatter = near.groupBy(*keys, label).agg(F.avg(F.sqrt(sq_distance(vec, "_c"))).alias("_s"), F.first("_c").alias("_c")).withColumn("_all", F.lit(0))
    other = scatter.select(*keys, "_all", F.col(label).alias("_l2"), F.col("_s").alias("_s2"), F.col("_c").alias("_c2"))
    pair = join_null_safe(scatter, other, [*keys, "_all"]).where(F.col(label) != F.col("_l2"))
    pair = pair.withColumn("_r", ratio(F.col("_s") + F.col("_s2"), F.sqrt(sq_distance("_c", "_c2"))))
    return pair.groupBy(*keys, label).agg(F.max("_r").alias("_r")).groupBy(*keys).agg(F.avg("_r").alias("db"))


def squared_silhouette(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Mean silhouette with squared distances, exact for any row count: the mean squared distance of a row to
    a cluster follows from the cluster's size, mean and mean square. Rows without a label are left out."""
    df = df.where(F.col(label).isNotNull())
    sq = F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v * v)
    square = df.groupBy(label).agg(F.avg(sq).alias("_q"))
    means = group_means(df, vec, label)
    keys, cent = collect_model(means, label, vec)
    extra = {r[label]: (r["n"], r["_q"]) for r in means.select(label, "n").join(square, label).collect()}
    size, mean_sq = np.array([extra[k][0] for k in keys], dtype=float), np.array([extra[k][1] for k in keys])

    order = np.argsort(np.array(keys), kind="stable")
    ranked = np.array(keys)[order]

    @F.pandas_udf("double")
    def width(v: pd.Series, own: pd.Series) -> pd.Series:
        x = np.vstack(v.to_numpy())
        me, at = order[np.searchsorted(ranked, own.to_numpy())], np.arange(len(x))
        d = (x ** 2).sum(axis=1)[:, None] - 2 * x @ cent.T + mean_sq
        a = d[at, me] * size[me] / np.maximum(size[me] - 1, 1)
        d[at, me] = np.inf
        b = d.min(axis=1)
        return pd.Series(np.where(size[me] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)))

    return df.select(width(F.col(vec), F.col(label)).alias("s")).agg(F.avg("s").alias("silhouette"))


def cluster_quality(model: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """Davies-Bouldin, Dunn and silhouette of a labelled model table (prototypes, group vectors), from its pair distances.

    A row without a label belongs to no cluster.
    """
    return quality_curve(model.withColumn("_cuts", F.array(F.struct(F.lit(1).alias("k"), F.col(label).alias("label")))), key, vec, "_cuts").drop("k")


def quality_curve(model: DataFrame, key: str, vec: str, cuts: str) -> DataFrame:
    """``(k, dunn, silhouette, db)`` of a model table for each of its labellings: ``cuts`` is an array of (k, label), alike in all rows.

    The distance of a pair is computed once and serves every k. A row without a label in a cut belongs to no cluster there.
    """
    lab = model.select(F.col(key).alias("src"), F.explode(cuts).alias("_c")).select("src", "_c.k", F.col("_c.label").alias("_own")).where("_own IS NOT NULL")
    d = pair_moments(model, key, vec).select("src", "dst", "dist")
    d = d.unionByName(d.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    d = d.join(lab, "src").join(lab.select(F.col("src").alias("dst"), "k", F.col("_own").alias("_other")), ["dst", "k"])
    per = d.groupBy("k", "src", "_own", "_other").agg(
        F.avg("dist").alias("_m"), F.max("dist").alias("_far"), F.min(F.when(F.col("dist") > 0, F.col("dist"))).alias("_close"))
    same = F.col("_own") == F.col("_other")
    row = per.groupBy("k", "src").agg(
        F.max(F.when(same, F.col("_m"))).alias("_a"), F.min(F.when(~same, F.col("_m"))).alias("_b"),
        F.min(F.when(~same, F.col("_close"))).alias("_apart"), F.max(F.when(same, F.col("_far"))).alias("_wide"))
    # the only member of its class has silhouette 0
    sil = F.when(F.col("_a").isNull(), 0.0).otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b", F.lit(1e-300)))
    q = row.groupBy("k").agg(ratio(F.min("_apart"), F.max(F.coalesce("_wide", F.lit(0.0)))).alias("dunn"), F.avg(sil).alias("silhouette"))
    flat = model.select(F.col(vec).alias("_vec"), F.explode(cuts).alias("_c")).select("_vec", "_c.k", "_c.label")
    return q.join(davies_bouldin(flat, "_vec", "label", "k"), "k", "left")


BLOCK = 512  # vectors that meet as one matrix


def _padded(vectors: list, d: int) -> np.ndarray:
    """Rows of one length; NULL and absent cells are NaN."""
    out = np.full((len(vectors), d), np.nan)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = np.asarray(v, dtype=float)
    return out


def _block_moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Common positions, distance, cosine and correlation of each row of ``x`` with each of ``y``; NaN is missing."""
    has_x, has_y = np.isfinite(x), np.isfinite(y)
    n = has_x.astype(float) @ has_y.T.astype(float)
    dist, cosine, corr = (np.zeros(n.shape) for _ in range(3))
    for i, (row, has) in enumerate(zip(x, has_x, strict=True)):
        both = has & has_y
        a, b = np.where(both, row, 0.0), np.where(both, y, 0.0)
        k = np.maximum(n[i], 1)[:, None]
        dist[i] = np.sqrt(((a - b) ** 2).sum(axis=1))
        for out, u, v in ((cosine, a, b), (corr, *(np.where(both, c - c.sum(axis=1, keepdims=True) / k, 0.0) for c in (a, b)))):
            size = np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))
            out[i] = np.divide((u * v).sum(axis=1), size, out=np.zeros(len(v)), where=size > 0)
        flat = lambda c: np.where(both, c, -np.inf).max(axis=1) == np.where(both, c, np.inf).min(axis=1)
        corr[i][flat(a) | flat(b)] = 0.0
    return n, dist, cosine, corr


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):  # a row holds two blocks
            one, two = batch.column("one")[r].values, batch.column("two")[r].values
            left, right = one.field("v").to_pylist(), two.field("v").to_pylist()
            d = max(len(v) for v in left + right)
            n, *measures = _block_moments(_padded(left, d), _padded(right, d))
            i, j = np.nonzero(n > 0)
            src, dst = one.field("g").take(pa.array(i)), two.field("g").take(pa.array(j))
            swap = pc.greater(src, dst)
            low, high = pc.if_else(swap, dst, src), pc.if_else(swap, src, dst)
            out = pa.RecordBatch.from_arrays([low, high, *[pa.array(m[i, j]) for m in measures]], ["src", "dst", "dist", "cosine", "corr"])
            # a block with itself meets each pair from both sides
            once = pc.less(src, dst) if batch.column("same")[r].as_py() else pc.not_equal(src, dst)
            yield out.filter(once)


def pair_moments(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """(src, dst, dist, cosine, corr) for each pair src < dst of group vectors, one row per group.

    Groups fall into blocks of about ``BLOCK`` by hash and two blocks meet as matrices, so a vector travels once for each
    block instead of once for each pair, and a task holds two blocks. One row per pair is the operator's result. NULL and
    non-finite cells are missing: a pair is measured where both have values, and is left out where there is no such place.
    Cosine and correlation of a zero or constant vector are 0.
    """
    own = vectors.where(F.col(group).isNotNull() & (F.size(vec) > 0)).select(F.col(group).alias("g"), F.col(vec).cast("array<double>").alias("v"))
    n = max(-(-own.count() // BLOCK), 1)
    blocks = own.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(n))).groupBy("b").agg(F.collect_list(F.struct("g", "v")).alias("m"))
    i, j = F.least("b", "o"), F.greatest("b", "o")
    sides = blocks.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))).select(i.alias("i"), j.alias("j"), "b", "m")
    met = sides.groupBy("i", "j").agg(F.max_by("m", -F.col("b")).alias("one"), F.max_by("m", F.col("b")).alias("two"), F.count_distinct("b").alias("sides"))
    met = met.where((F.col("i") == F.col("j")) | (F.col("sides") == 2)).select("one", "two", (F.col("i") == F.col("j")).alias("same"))
    kind = own.schema["g"].dataType.simpleString()
    return met.mapInArrow(_block_pairs, f"src {kind}, dst {kind}, dist double, cosine double, corr double")


def similarity_matrix(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """Euclidean distance, 1 - d / max d, cosine and correlation for each pair of group vectors."""
    s = pair_moments(vectors, group, vec)
    top = s.agg(F.max("dist")).scalar()
    return s.withColumn("sim", 1 - ratio(F.col("dist"), top))


def similarity_edges(sim: DataFrame, thr: float, col: str = "sim") -> DataFrame:
    return sim.where((F.col("src") < F.col("dst")) & (F.col(col) >= thr)).select("src", "dst", F.col(col).alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, node: str, label: str, resolution: float = 1.0, weight: str | None = None) -> DataFrame:
    """Quality of a labelling of an undirected graph at a resolution."""
    w = F.col(weight) if weight else F.lit(1.0)
    ends = edges.select("src", "dst", w.cast("double").alias("_w"))
    la = labels.select(F.col(node).alias("src"), F.col(label).alias("_la"))
    lb = labels.select(F.col(node).alias("dst"), F.col(label).alias("_lb"))
    e = ends.join(la, "src").join(lb, "dst")
    total = e.agg(F.sum("_w")).scalar()
    deg = e.select(F.explode(F.array("_la", "_lb")).alias("_l"), "_w").groupBy("_l").agg(F.sum("_w").alias("_deg"))
    inner = e.where("_la = _lb").groupBy(F.col("_la").alias("_l")).agg(F.sum("_w").alias("_in"))
    q = deg.join(inner, "_l", "left").select(
        (ratio(F.coalesce("_in", F.lit(0.0)), total) - resolution * F.pow(ratio("_deg", 2 * total), 2)).alias("_q"))
    return q.agg(F.sum("_q").alias("q"))


def order_by_path(df: DataFrame, item: str, levels: Sequence[str], out: str = "pos") -> DataFrame:
    """Position (from 0) of items sorted by their label path over the levels (one row per item)."""
    path = F.concat_ws("", *[F.format_string("%04d", F.col(c).cast("int")) for c in levels])
    placed = range_chunks(df.withColumn("path", path), ["path", item])
    return scan(placed, [], ["path", item], F.col("_range"), **{out: "row"}).withColumn(out, F.col(out) - 1).drop("_range")


def polygon_area(vertices: DataFrame, roi: str, order: str, x: str, y: str) -> DataFrame:
    """Shoelace area, mean vertex and position of each ROI along x."""
    e = scan(vertices, roi, order, F.floor(F.col(order) / 4096), _x=("lead", x), _y=("lead", y), _x0=("first", x), _y0=("first", y))
    nx, ny = F.coalesce("_x", "_x0"), F.coalesce("_y", "_y0")
    g = e.groupBy(roi).agg((F.abs(F.sum(F.col(x) * ny - nx * F.col(y))) / 2).alias("area"), F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    return g.withColumn("pos", (F.row_number().over(Window.orderBy("cx", roi)) - 1).cast("bigint"))  # one row per ROI


def cluster_compactness(sim: DataFrame, labels: DataFrame, node: str, label: str, run: str, col: str = "sim", dist: str = "dist") -> DataFrame:
    """Inside minus outside similarity, within-cluster distances, and distinct runs per member."""
    la = labels.select(F.col(node).alias("src"), F.col(label).alias("_la"))
    lb = labels.select(F.col(node).alias("dst"), F.col(label).alias("_lb"))
    p = sim.join(la, "src").join(lb, "dst")
    both = p.select(F.explode(F.array_distinct(F.array("_la", "_lb"))).alias(label), (F.col("_la") == F.col("_lb")).alias("_in"), F.col(col).alias("_s"), F.col(dist).alias("_d"))
    iq = both.groupBy(label).agg(
        (F.avg(F.when(F.col("_in"), F.col("_s"))) - F.avg(F.when(~F.col("_in"), F.col("_s")))).alias("iq"),
        F.min(F.when(F.col("_in"), F.col("_d"))).alias("d_min"), F.max(F.when(F.col("_in"), F.col("_d"))).alias("d_max"))
    med = percentile_columns(both.where("_in"), label, "_d", {"d_median": 0.5})
    div = labels.groupBy(label).agg(ratio(F.count_distinct(run), F.count(F.lit(1))).alias("diversity"))
    return iq.join(med, label, "left").join(div, label)


def l2_rows(df: DataFrame, vec: str, out: str) -> DataFrame:
    n = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v * v))
    return df.withColumn(out, F.transform(vec, lambda v: ratio(v, n)))


def fano(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(ratio(F.var_pop(value), F.avg(value)).alias("fano"))


def distance_to_ref(df: DataFrame, vec: str, ref: Sequence[float], out: str = "d") -> DataFrame:
    """Distance to a reference vector, scaled to [0, 1] over the table."""
    d = df.withColumn("_d", F.sqrt(sq_distance(vec, _literal(ref))))
    m = d.agg(F.struct(F.min("_d").alias("lo"), F.max("_d").alias("hi"))).scalar()
    return d.withColumn(out, ratio(F.col("_d") - m.getField("lo"), m.getField("hi") - m.getField("lo"))).drop("_d")


def u_matrix(prototypes: DataFrame, node: str, vec: str, shape: tuple[int, int]) -> DataFrame:
    """Distances of each map node to the nodes around it: their mean, and their sum scaled to a maximum of 1.

    The eight grid neighbours are enumerated per node, so the join has at most eight rows per node.
    """
    nx, ny = shape
    p = prototypes.select(F.col(node).alias("node"), F.col(vec).alias("_a"), (F.col(node) % nx).alias("_c"), F.floor(F.col(node) / nx).alias("_r"))
    steps = F.array(*[F.struct(F.lit(i).alias("dc"), F.lit(j).alias("dr")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    n = p.withColumn("_s", F.explode(steps)).withColumns({"_c2": F.col("_c") + F.col("_s.dc"), "_r2": F.col("_r") + F.col("_s.dr")})
    n = n.where((F.col("_c2") >= 0) & (F.col("_c2") < nx) & (F.col("_r2") >= 0) & (F.col("_r2") < ny)).withColumn("_n2", F.col("_r2") * nx + F.col("_c2"))
    q = prototypes.select(F.col(node).alias("_n2"), F.col(vec).alias("_b"))
    u = n.join(q, "_n2").groupBy("node").agg(F.sum(F.sqrt(sq_distance("_a", "_b"))).alias("_u"), F.avg(F.sqrt(sq_distance("_a", "_b"))).alias("u_mean"))
    top = u.agg(F.max("_u")).scalar()
    return u.select("node", "u_mean", ratio("_u", top).alias("u_scaled"))


def label_transfer(a: DataFrame, vec: str, label_a: str, prototypes_b: np.ndarray, labels_b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels of map B for the nodes of map A by best node, and the row-normalised confusion of the labels."""
    moved = node_label(bmu(a, vec, prototypes_b), labels_b)
    conf = moved.groupBy(label_a, "label_b").agg(F.count(F.lit(1)).alias("n"))
    return moved, with_share(conf, label_a)


def balanced_tiles(points: DataFrame, region: str, x: str, y: str, tie: str, depth: int | None = None, per_tile: int = 100) -> DataFrame:
    """Cells of nearly equal count per region by repeated cuts along x and y in turn; ``tile`` counts from 0 in a region.

    A region of n points gets ``2 ** depth`` cells, or round(n / per_tile) (at least one). A cell that stands for p cells
    is cut at the point floor(p / 2) / p of its count, so regions of any size end with cells of their mean size, give or
    take the rounding of one point per cut.
    """
    size = points.groupBy(region).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.lit(2**depth if depth else 1) if depth is not None else F.greatest(F.round(F.col("_n") / per_tile), F.lit(1))
    size = size.select(region, parts.cast("bigint").alias("_parts"))
    if depth is None:
        most = size.agg(F.max("_parts")).first()[0] or 1
        depth = (most - 1).bit_length()
    out = join_null_safe(points, size, [region]).withColumn("tile", F.lit(0).cast("bigint"))
    for level in range(depth):
        axis = x if level % 2 == 0 else y
        ranked = scan(out, [region, "tile"], [axis, tie], magnitude_chunk(axis), _row="row", _total=("total", F.lit(1)))
        half = F.floor(F.col("_parts") / 2)
        left = F.col("_row") <= F.floor(F.col("_total") * half / F.col("_parts") + 0.5)
        cut = F.when(F.col("_parts") == 1, F.col("tile")).when(left, F.col("tile")).otherwise(F.col("tile") + half)
        now = F.when(F.col("_parts") == 1, 1).when(left, half).otherwise(F.col("_parts") - half)
        out = ranked.select(*points.columns, cut.alias("tile"), now.cast("bigint").alias("_parts"))
        if level % 3 == 2:
            out = cut_lineage(out)
    return out.select(*points.columns, "tile")


def pca_score_corr(long: DataFrame, group: str, cat: str, value: str, scores: DataFrame, score: str, categories: Sequence, n_comps: int = 2) -> DataFrame:
    """Components of the z-scored group x category table, correlated with an external score and each category."""
    z = long.groupBy(group).agg(F.array(*[F.coalesce(F.max(F.when(F.col(cat) == c, F.col(value))), F.lit(0.0)) for c in categories]).alias("vec"))
    p = pca_scores(standardize(z, "vec"), "vec", share=0.999999, max_comps=n_comps)
    j = p.join(scores.select(group, F.col(score).alias("_score")), group)
    outs = [F.struct(F.lit(f"pc{k + 1}").alias("pc"), F.get("scores", F.lit(k)).alias("s")) for k in range(n_comps)]
    rows = j.select(group, "vec", "_score", F.explode(F.array(*outs)).alias("o")).select("vec", "_score", "o.pc", "o.s")
    with_score = rows.groupBy("pc").agg(correlation("s", "_score").alias("r")).withColumn("target", F.lit("score"))
    cats = rows.groupBy("pc").agg(*[correlation("s", F.get("vec", F.lit(i))).alias(f"c{i}") for i in range(len(categories))])
    long_c = cats.select("pc", F.explode(F.array(*[F.struct(F.lit(str(c)).alias("target"), F.col(f"c{i}").alias("r")) for i, c in enumerate(categories)])).alias("t")).select("pc", "t.r", "t.target")
    return with_score.unionByName(long_c)
