"""Scans agree with plain Python whatever the chunks."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from conftest import rows
from pointweave.operators import scan as sc
from pointweave.operators.features import order_by_path
from pointweave.operators.filters import dense_ids
from pointweave.operators.ranges import count_in_windows, overlap_flag, points_in_windows, window_pairs

DATA = [("a", 1.0, 1, 5), ("a", 2.0, 2, None), ("a", 2.0, 3, 7), ("a", 90.0, 4, 1), ("a", 250.0, 5, None), ("b", 3.0, 6, 2), ("b", 300.0, 7, 9)]


def frame(spark):
    return spark.createDataFrame(DATA, "k string, t double, id int, v int")


SPECS = dict(
    lag=("lag", "v"), lead=("lead", "v"), s=("sum", "v"), mx=("max", "v"), mn=("min", "v"), reach=("reach", "v"), last=("last", "v"),
    prior=("prior", "v"), nxt=("next", "v"), follow=("follow", "v"), first=("first", "v"), total=("total", "v"), rn="row")


def test_chunk_width_does_not_matter(spark):
    """One chunk for all, many small ones: the same rows, NULL keys and NULL order values included."""
    data = DATA + [(None, 3.0, 8, 1), (None, 400.0, 9, None), (None, None, 10, 4), ("a", None, 11, 3)]
    df = spark.createDataFrame(data, "k string, t double, id int, v int")
    wide, narrow = (rows(sc.scan(df, "k", ["t", "id"], sc.time_chunk("t", w), **SPECS)) for w in (1e9, 5.0))
    assert wide == narrow and len(wide) == len(data)
    by_id = {r[2]: r for r in narrow}
    rn = list(SPECS).index("rn") + 4
    assert [by_id[i][rn] for i in (10, 8, 9, 11, 1)] == [1, 2, 3, 1, 2]


def test_values(spark):
    got = {r["id"]: r for r in sc.scan(frame(spark), "k", ["t", "id"], sc.time_chunk("t", 50.0), **SPECS).collect()}
    assert (got[3]["lag"], got[3]["lead"], got[4]["lag"], got[4]["lead"]) == (None, 1, 7, None)
    assert (got[4]["s"], got[4]["mx"], got[4]["reach"], got[5]["last"], got[2]["next"] if "next" in got[2] else got[2]["nxt"]) == (13, 7, 7, 1, 7)
    assert (got[1]["rn"], got[5]["rn"], got[6]["rn"], got[5]["total"], got[5]["first"]) == (1, 5, 1, 13, 5)
    assert (got[1]["reach"], got[5]["follow"], got[3]["prior"]) == (None, None, 5)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(hs.lists(hs.tuples(hs.sampled_from("xy"), hs.integers(-5, 5)), min_size=1, max_size=30))
def test_average_rank_and_percentiles(spark, data):
    df = spark.createDataFrame([(i, k, float(v)) for i, (k, v) in enumerate(data)], "id int, k string, v double")
    got = {r["id"]: r["r"] for r in sc.average_rank(df, "k", "v", "r").collect()}
    med = {r["k"]: r["m"] for r in sc.percentile_columns(df, "k", "v", {"m": 0.5}).collect()}
    low = {r["k"]: r["m"] for r in sc.percentile_columns(df, "k", "v", {"m": 0.4}, "lower").collect()}
    for i, (k, v) in enumerate(data):
        peers = sorted(x for kk, x in data if kk == k)
        at = [j + 1 for j, x in enumerate(peers) if x == v]
        assert got[i] == pytest.approx(sum(at) / len(at))
        n = len(peers)
        mid = (n - 1) / 2
        assert med[k] == pytest.approx((peers[int(mid)] + peers[-int(-mid // 1)]) / 2)
        assert low[k] == peers[int(0.4 * (n - 1))]


WINDOWS = [("r", 1, 0.0, 10.0), ("r", 2, 10.0, 20.0), ("r", 3, 35.0, 35.0), ("q", 4, 5.0, 6.0)]
OTHERS = [("r", 20.0, 30.0), ("r", 35.0, 36.0), ("q", 7.0, 8.0)]


def test_overlap_closed_and_padded(spark):
    w = spark.createDataFrame(WINDOWS, "k string, id int, t0 double, t1 double")
    o = spark.createDataFrame(OTHERS, "k string, t0 double, t1 double")
    hit = {r["id"]: r["h"] for r in overlap_flag(w, o, "k", "h", 10.0).collect()}
    assert hit == {1: False, 2: True, 3: True, 4: False}
    near = {r["id"]: r["h"] for r in overlap_flag(w, o, "k", "h", 10.0, pad=1.0).collect()}
    assert near == {1: False, 2: True, 3: True, 4: True}


def test_points_and_counts_at_the_border(spark):
    w = spark.createDataFrame(WINDOWS, "k string, id int, t0 double, t1 double")
    p = spark.createDataFrame([("r", 10.0), ("r", 0.0), ("r", 35.0), ("q", 5.5), ("q", 6.0)], "k string, t double")
    pairs = rows(points_in_windows(p, w, "k", 7.0), "id", "t")
    assert pairs == [(1, 0.0), (1, 10.0), (2, 10.0), (3, 35.0), (4, 5.5), (4, 6.0)]
    assert rows(points_in_windows(p, w, "k", 7.0, closed=False), "id", "t") == [(4, 5.5)]
    assert rows(count_in_windows(w, p, "k", "n", 7.0), "id", "n") == [(1, 2), (2, 1), (3, 1), (4, 2)]


def test_window_pairs_once(spark):
    a = spark.createDataFrame([("r", 1, 0.0, 100.0)], "k string, id int, t0 double, t1 double")
    b = spark.createDataFrame([("r", 7, 20.0, 80.0), ("r", 8, 100.0, 101.0), ("r", 9, 101.0, 102.0)], "k string, o int, b0 double, b1 double")
    assert rows(window_pairs(a, b, "k", 10.0), "id", "o") == [(1, 7), (1, 8)]


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        sc.scan(frame(spark), "k", ["t", "id"], F.lit(0), x=("nope", "v"))


def test_dense_ids_and_paths_over_a_constant_first_column(spark):
    """Range partitions number rows that the first column cannot spread, NULLs first."""
    data = [(None if i % 50 == 0 else "one", None if i % 41 == 0 else i * 7 % 83, i % 3, i) for i in range(600)]
    df = spark.createDataFrame(data, "a string, b int, g int, id int")
    rank = lambda r: tuple((v is not None, v if v is not None else 0) for v in (r["a"], r["b"]))
    got = dense_ids(df, ["a", "b"], "n").collect()
    order = sorted({rank(r) for r in got})
    assert [r["n"] for r in got] == [order.index(rank(r)) for r in got]
    for g in range(3):
        part = [r for r in dense_ids(df, ["a", "b"], "n", ["g"]).collect() if r["g"] == g]
        order = sorted({rank(r) for r in part})
        assert [r["n"] for r in part] == [order.index(rank(r)) for r in part]
    flat = order_by_path(df.select("id", F.lit(1).alias("l0"), (F.col("id") % 2).alias("l1")), "id", ["l0", "l1"]).orderBy("pos").collect()
    assert [r["id"] for r in flat] == [*range(0, 600, 2), *range(1, 600, 2)] and [r["pos"] for r in flat] == list(range(600))


@pytest.mark.parametrize("chunk", [1.0, 5.0, 1e6])
def test_linked_islands_against_a_plain_sweep(spark, chunk):
    rng = np.random.default_rng(11)
    spans = [(k, float(a), float(a + d)) for k in ("x", None) for a, d in zip(rng.integers(0, 90, 60), rng.choice([0, 0, 1, 2, 30], 60, p=[0.4, 0.2, 0.2, 0.18, 0.02]))]
    df = spark.createDataFrame([(*s, i) for i, s in enumerate(spans)], "k string, a double, b double, i long")
    for gap in (0.0, 1.5, 3.0):
        got = sc.linked(df, "k", ["a", "i"], F.floor(F.col("a") / chunk), "a", "b", lambda lo, r: lo - r > gap)
        want, reach, number = {}, {}, 0
        for k, a, b, i in sorted([(*s, i) for i, s in enumerate(spans)], key=lambda s: (str(s[0]), s[1], s[3])):
            if k not in reach or a - reach[k] > gap:
                number += 1
            reach[k] = max(b, reach.get(k, b))
            want.setdefault(number, set()).add(i)
        sets = {}
        for r in got.collect():
            sets.setdefault((r["k"], r["_start"]), set()).add(r["i"])
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, want.values()))
