import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from pointweave.operators import detect, filters, joins, trains
from pointweave.operators import intervals as iv
from pointweave.operators import traces as tc
from pointweave.sources import tables as src


def wins(spark, data):
    return spark.createDataFrame([("r", float(a), float(b)) for a, b in data], "recid string, t0 double, t1 double")


BLOCKED = [(300, 400), (550, 700), (1000, 1100), (5000, 5600), (410, 460), (690, 720), (740, 790), (800, 1050), (1060, 1070), (0, 600)]


def test_merge_and_complement_example(spark):
    m = iv.merge_intervals(wins(spark, BLOCKED), "recid", lo=0.0, hi=5000.0)
    assert rows(m, "t0", "t1") == [(0.0, 720.0), (740.0, 790.0), (800.0, 1100.0)]
    assert rows(iv.merge_intervals(m, "recid"), "t0", "t1") == rows(m, "t0", "t1")
    b = spark.createDataFrame([("r", 0.0, 5000.0), ("empty", 0.0, 9.0)], "recid string, lo double, hi double")
    free = iv.free_intervals(wins(spark, BLOCKED), b, "recid")
    assert rows(free) == [("empty", 0.0, 9.0), ("r", 720.0, 740.0), ("r", 790.0, 800.0), ("r", 1100.0, 5000.0)]
    blocked = sum(t1 - t0 for t0, t1 in rows(m, "t0", "t1"))
    assert blocked + sum(t1 - t0 for r, t0, t1 in rows(free) if r == "r") == 5000.0


def test_touching_windows_and_gaps(spark):
    w = wins(spark, [(0, 1), (1, 2), (5, 6), (7, 8), (3, 3)])
    assert rows(iv.merge_intervals(w, "recid"), "t0", "t1") == [(0.0, 2.0), (5.0, 6.0), (7.0, 8.0)]
    assert rows(iv.merge_by_gap(wins(spark, [(0, 2), (5, 6), (7, 8)]), "recid", 1.0), "t0", "t1") == [(0.0, 2.0), (5.0, 6.0), (7.0, 8.0)]
    assert rows(iv.merge_by_gap(wins(spark, [(0, 2), (5, 6), (7, 8)]), "recid", 1.5), "t0", "t1") == [(0.0, 2.0), (5.0, 8.0)]


def test_tiles_and_sliding(spark):
    assert rows(iv.tile_windows(wins(spark, [(0, 10.5)]), "recid", 2.0), "t0") == [(2.0,), (4.0,), (6.0,), (8.0,)]
    assert iv.tile_windows(wins(spark, [(0, 4)]), "recid", 2.0).count() == 0
    s = spark.createDataFrame([("r", 0, 10), ("short", 0, 3)], "recid string, i0 bigint, i1 bigint")
    assert rows(iv.sliding_windows(s, "recid", 4, 1), "w0", "w1") == [(0, 4), (3, 7), (6, 10)]
    s = spark.createDataFrame([("r", 0, 9)], "recid string, i0 bigint, i1 bigint")
    assert rows(iv.sliding_windows(s, "recid", 4, 1), "w0", "w1") == [(0, 4), (3, 7), (5, 9)]


def metric(times, name):
    d = np.diff(times)
    a, b = d[:-1], d[1:]
    return {
        "b": (d.std() - d.mean()) / (d.std() + d.mean()), "m": np.corrcoef(a, b)[0, 1], "lv": 3 * np.mean(((a - b) / (a + b)) ** 2),
        "lvr": 3 * np.mean((1 - 4 * a * b / (a + b) ** 2) * (1 + 0.02 / (a + b))), "cv2": 2 * np.mean(abs(b - a) / abs(b + a)),
        "ir": np.mean(abs(np.log(b / a)))}[name]


def test_interval_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.exponential(1.0, 40))
    ev = spark.createDataFrame([("u", float(x)) for x in t] + [("one", 1.0), ("two", 1.0), ("two", 2.0)], "uid string, t double")
    isi = trains.intervals(ev, "uid")
    got = {r["uid"]: r for r in trains.interval_metrics(isi, "uid", ["b", "m", "lv", "lvr", "cv2", "ir"], 3).collect()}
    for name in ("b", "m", "lv", "lvr", "cv2", "ir"):
        assert got["u"][name] == pytest.approx(metric(t, name), abs=1e-9)
    assert got["two"]["b"] is None and "one" not in got
    rate = {r["uid"]: r["isi_rate"] for r in trains.interval_rate(isi, "uid").collect()}
    assert rate["u"] == pytest.approx(1 / np.median(np.diff(t)))


def test_equal_intervals_and_gate(spark):
    ev = spark.createDataFrame([("u", float(x)) for x in range(5)], "uid string, t double")
    isi = trains.intervals(ev, "uid")
    r = trains.interval_metrics(isi, "uid", ["b", "m"], 4).first()
    assert r["b"] == -1.0 and r["m"] is None and r["n_isi"] == 4 and r["n_pairs"] == 3


def test_isi_stays_inside_windows_and_log_rate(spark):
    ev = spark.createDataFrame([("r", "u", t) for t in (1.0, 2.0, 11.0, 12.5)], "recid string, uid string, t double")
    w = spark.createDataFrame([("r", 1, 0.0, 10.0), ("r", 2, 10.0, 20.0), ("r", 3, 20.0, 30.0)], "recid string, win_id int, t0 double, t1 double")
    isi = trains.intervals(trains.events_in_windows(ev, w, 10.0), ["uid", "win_id"])
    assert rows(isi, "win_id", "isi") == [(1, 1.0), (2, 1.5)]
    rate = dict(rows(trains.log_rate(trains.window_counts(ev, w, 10.0)), "win_id", "rate"))
    assert rate[1] == pytest.approx(math.log10(0.2)) and rate[3] is None


def test_duplicates_are_collapsed(spark):
    ev = spark.createDataFrame([("u", 1.0), ("u", 1.0), ("u", float("nan")), ("u", 2.0)], "uid string, t double")
    assert rows(src.load_event_trains(ev, "uid"), "t") == [(1.0,), (2.0,)]


def test_bursts(spark):
    ev = spark.createDataFrame([("u", t) for t in (0.0, 1.0, 1.5, 5.0, 9.0, 9.2)] + [("v", 1.0)], "uid string, t double")
    assert rows(detect.bursts(ev, "uid", 1.1), "t0", "t1", "n") == [(0.0, 1.5, 3), (9.0, 9.2, 2)]
    assert rows(detect.segments(ev, "uid", 4.0, 3), "t0", "t1", "n") == [(0.0, 9.2, 6)]
    assert detect.bursts(ev.where("uid = 'v'"), "uid", 1.1).count() == 0


def test_network_bursts_keep_chains_with_a_core(spark):
    chans = [0, 10, 20, 60, 200, 210]
    e = spark.createDataFrame([("r", 1, c) for c in chans], "recid string, burst int, chan int")
    got = rows(detect.network_bursts(e, ["recid", "burst"], "chan", 10, 3, 4), "chan")
    assert got == [(0,), (10,), (20,), (60,)]


def test_halfwaves_drop_open_ends(spark):
    v = [0.0, 2.0, 2.0, -1.0, -3.0, -1.0, 2.0, -0.5, 2.0, -4.0]
    tr = spark.createDataFrame([("r", i, x) for i, x in enumerate(v)], "recid string, i bigint, v double")
    assert rows(tc.halfwaves(tr, "recid", 1.0, -2.0, 0), "i0", "i1", "peak") == [(2, 5, -3.0)]
    # the extreme is taken up to, not including, the last sample inside
    assert rows(tc.halfwaves(tr, "recid", 1.0, 2.0, 0), "i0", "i1", "peak") == [(2, 5, -3.0), (6, 7, 2.0)]
    assert rows(tc.halfwaves(tr, "recid", 1.0, 2.0, 1), "i0", "i1") == [(2, 5)]


def test_neighbourhood_crosses_frames(spark, monkeypatch):
    monkeypatch.setattr(tc, "FRAME", 8)
    v = np.round(np.sin(np.arange(40) / 2.0) * 10, 3)
    tr = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(v)], "recid string, i bigint, v double")
    got = [r[1] for r in rows(tc.moving_average(tr, "recid", 5), "i", "avg")]
    assert got == pytest.approx(list(np.convolve(v, np.ones(5) / 5, "valid")))
    mx = [r[0] for r in rows(tc.local_extrema(tr, "recid"), "i")]
    assert mx == [i for i in range(1, 39) if v[i] > v[i - 1] and v[i] > v[i + 1]]
    n, m = 40, 60
    new = [r[1] for r in rows(tc.resample_linear(tr, "recid", 2.0, 3.0), "j", "v")]
    assert new == pytest.approx(list(np.interp(np.arange(m) * (n - 1) / (m - 1), np.arange(n), v)))
    grid = spark.createDataFrame([("r", 0.0, 20.0)], "recid string, lo double, hi double")
    assert rows(tc.index_grid(grid, ["recid"], F.lit(19).cast("bigint"), "k"), "k") == [(k,) for k in range(19)]


def test_regions_labels_and_bounds(spark):
    r = spark.createDataFrame([("CA1",), ("MOp5",), ("VISp2/3",), ("PL|x",), ("AUDd6a",)], "region string")
    assert rows(filters.decompose_region(r, "region"), "area", "layer") == [("AUDd", "6a"), ("CA1", "NA"), ("MOp", "5"), ("PL", "NA"), ("VISp", "2/3")]
    b = spark.createDataFrame([(True, True), (True, False), (False, False)], "a boolean, b boolean")
    assert rows(filters.bool_label(b, ["a", "b"], "lab"), "lab") == [("a",), ("b",), ("na",)]
    p = spark.createDataFrame([(1.0, 1.0, 2.0), (0.0, 1.0, 1.0)], "x double, y double, z double")
    prof = {r["param"]: (r["is_bool"], r["n_values"]) for r in filters.param_profile(p, ["x", "y", "z"]).collect()}
    assert prof == {"x": (True, 2), "y": (False, 1), "z": (False, 2)}


def test_as_of_needs_strictly_earlier_start(spark):
    t = spark.createDataFrame([("r", 1, 10.0, 11.0), ("r", 2, 10.5, 20.0), ("r", 3, 12.0, 13.0)], "recid string, id int, t0 double, t1 double")
    free = wins(spark, [(10, 15)])
    assert rows(joins.artifact_free_trials(t, free, "recid"), "id") == [(3,)]


def test_unique_match_is_checked(spark):
    a = spark.createDataFrame([("r__1", 1)], "k string, x int")
    b = spark.createDataFrame([("r__1", 1), ("r__1", 2)], "k string, y int")
    with pytest.raises(ValueError):
        joins.match_entities(a, b, "k")


def test_sources_round_trip(spark, tmp_path):
    s = tmp_path / "scores.csv"
    s.write_text("key,score\n A ,1.5\nB,\nC,x\n")
    assert rows(src.read_scores(spark, str(s))) == [("A", 1.5), ("B", None), ("C", None)]
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    src.write_sections({"one": df, "two": df.limit(1)}, str(tmp_path / "sections"))
    back = src.read_section(spark, str(tmp_path / "sections"), "one")
    assert rows(back.where("field = 'n'"), "row_key", "number") == [("a", 1.0), ("b", 2.0)]
    df.write.parquet(str(tmp_path / "rec1_metrics.parquet"))
    paths = [str(tmp_path / "rec1_metrics.parquet"), str(tmp_path / "rec1_other.parquet")]
    assert src.scan_recordings(spark, paths, "metrics", ["rec1"]).count() == 2
    with pytest.raises(ValueError):
        src.scan_recordings(spark, paths, "metrics", ["rec2"])
