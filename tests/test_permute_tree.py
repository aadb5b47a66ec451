import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pointweave.operators import permute as pm


def test_tables_keep_margins_and_moments():
    rng = np.random.default_rng(0)
    rows, cols = np.array([5, 0, 17, 3, 9]), np.array([10, 4, 20])
    t = pm._random_tables(rng, rows, np.tile(cols, (4000, 1)))
    assert (t.sum(axis=2) == rows).all() and (t.sum(axis=1) == cols).all()
    want = np.outer(rows, cols) / 34
    sd = np.sqrt(want * (34 - rows)[:, None] * (34 - cols) / (34 * 33))
    assert (np.abs(t.mean(axis=0) - want) <= 5 * sd / 4000 ** 0.5 + 1e-9).all()
    assert np.allclose(t.std(axis=0), sd, rtol=0.1)


def test_large_tables_are_split_over_tasks(spark):
    """Groups of many levels, one level, a NULL key: halves drawn in different tasks are one draw together."""
    df = spark.range(3000).select(
        (F.col("id") * 7919 % 41).alias("a1"), (F.col("id") * 104729 % 3).alias("a2"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2).alias("const"))
    df = df.unionByName(spark.createDataFrame([(1, 1, 9)], "a1 long, a2 long, const long"))
    reps = 400
    drawn = pm.permute_counts_by_margins(df, "a1", "a2", "const", reps, task_cells=2000).cache()
    for attr in ("a1", "a2"):
        want = {r[0]: r[1] for r in df.groupBy(attr).count().collect()}
        sums = drawn.groupBy("rep", attr).agg(F.sum("n").alias("n")).collect()
        assert len(sums) == reps * len(want) and all(r["n"] == want[r[attr]] for r in sums)
    exact = {(r["a1"], r["a2"]): (r["mean"], r["sd"]) for r in pm.exact_moments(df, "a1", "a2", "const").collect()}
    got = {(r["a1"], r["a2"]): (r["s"] / reps, r["q"] / reps) for r in drawn.groupBy("a1", "a2").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")).collect()}
    for cell, (mean, sd) in exact.items():
        m, q = got.get(cell, (0.0, 0.0))
        assert abs(m - mean) <= 5 * sd / reps ** 0.5 + 1e-9
        assert abs((q - m * m) ** 0.5 - sd) <= 0.25 * sd + 1e-9
    again = pm.permute_counts_by_margins(df, "a1", "a2", "const", reps, task_cells=2000)
    assert again.exceptAll(drawn).isEmpty()


def test_shuffled_counts_from_packed_pieces(spark, monkeypatch):
    """Groups of many hash prefixes, one entity, NULL group, levels and ids: ranks as if all rows were sorted in one place."""
    for name, value in {"CHUNK": 8, "PACK_ROWS": 150, "TASK_KEYS": 100}.items():
        monkeypatch.setattr(pm, name, value)
    data = [(i, "xyz"[i * 7 % 3] if i % 11 else None, i * 5 % 4, "pq"[i % 2] if i % 10 else None, i % 3 // 2) for i in range(400)]
    data += [(None, "x", 1, "p", 0), (900, None, None, "alone", 1)]
    df = spark.createDataFrame(data, "id long, a1 string, a2 int, const string, by int")
    reps = 3
    want = Counter()
    for rep in range(reps):
        groups = {}
        for r in data:
            groups.setdefault((r[4], r[3]), []).append(r)
        for (by, _), members in groups.items():
            key = lambda salt, r: hashlib.md5("_".join([salt, str(rep)] + ([] if r[0] is None else [str(r[0])])).encode()).digest()  # noqa: B023, E731
            first, second = (sorted(members, key=lambda r: key(salt, r)) for salt in "ab")  # noqa: B023
            want.update((by, rep, x[1], y[2]) for x, y in zip(first, second, strict=True))
    got = pm.permute_counts(df, "id", "a1", "a2", ["by", "const"], reps, by="by")
    assert got.dtypes == [("by", "int"), ("rep", "int"), ("a1", "string"), ("a2", "int"), ("n", "bigint")]
    assert {tuple(r)[:4]: r["n"] for r in got.collect()} == want
    whole = pm.permute_counts(df, "id", "a1", "a2", (), 2).groupBy("rep").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == [(0, 402), (1, 402)]
    assert pm.permute_counts(df.limit(0), "id", "a1", "a2", "const", 2).isEmpty()


def test_no_row_of_a_shuffle_for_each_entity_and_repetition(spark):
    """Digests and codes are packed: 20 repetitions of 4000 entities in two groups are a few rows."""
    df = spark.range(4000).select("id", (F.col("id") % 3).alias("a1"), (F.col("id") % 5).alias("a2"), (F.col("id") % 2).alias("const"))
    plan = pm.permute_counts(df, "id", "a1", "a2", "const", 20)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "md5" not in plan


def test_no_digest_in_a_shuffle_and_ids_of_any_kind(spark, monkeypatch, tmp_path):
    """Entities travel as compressed differences, under 6 bytes with their codes (13 as digests); text and odd numbers as well."""
    monkeypatch.setattr(pm, "SPREAD", 1)
    n, reps = 40_000, 2
    df = spark.range(n).select((F.col("id") * 3 + 10 ** 12).alias("id"), (F.col("id") % 3).alias("a1"), (F.col("id") * 7919 % 5).alias("a2"))
    pack = pm._rank_tasks(reps, ("a", "b"), np.dtype("u1"), 8, True)[0]
    coded = df.select(F.lit(0).cast("long").alias("_gid"), F.lit(n).cast("long").alias("_all"), F.col("a1").alias("_c1"), F.col("a2").alias("_c2"), F.col("id").alias("_id"))
    pieces = coded.coalesce(1).mapInArrow(pack, "side int, rep int, gid long, chunk long, rows int, nulls int, raw int, ids binary, codes binary")
    size = pieces.agg(F.sum("rows"), F.sum(F.length("ids") + F.length("codes"))).first()
    assert size[0] == 2 * reps * n and size[1] < 6 * size[0]
    odd = [-(1 << 63), (1 << 63) - 1, -1, 0, 7, 7, None, *range(100, 160)]
    for kind, ids in (("long", odd), ("string", [None if i is None else f"é{i}" for i in odd] + ["", "a b"])):
        data = [(x, i * 5 % 3, i % 4) for i, x in enumerate(ids)]
        got = pm.permute_counts(spark.createDataFrame(data, f"id {kind}, a1 int, a2 int"), "id", "a1", "a2", (), reps)
        want = Counter()
        for rep in range(reps):
            key = lambda salt, r: hashlib.md5("_".join([salt, str(rep)] + ([] if r[0] is None else [str(r[0])])).encode()).digest()  # noqa: B023, E731
            first, second = sorted(data, key=lambda r: (key("a", r), r[1])), sorted(data, key=lambda r: (key("b", r), r[2]))  # noqa: B023
            want.update((rep, x[1], y[2]) for x, y in zip(first, second, strict=True))
        assert {tuple(r)[:3]: r["n"] for r in got.collect()} == want
