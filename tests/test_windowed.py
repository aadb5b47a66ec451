import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import trains, windowed

ALL = ["b", "m", "lv", "lvr", "cv2", "ir", "lkappa"]


@pytest.mark.parametrize("chunk", [1.0, 7.0, 1e6])
def test_prefix_sums_equal_windows_summed_by_themselves(spark, chunk):
    rng = np.random.default_rng(5)
    t = [(r, f"u{u}", float(x)) for r in ("a", None) for u in range(3) for x in np.round(np.cumsum(rng.exponential(0.4, 60)), 2)]
    t += [("a", "tied", float(x)) for x in (3, 3, 3, 4, 4, 6, 9, 9)] + [("a", "one", 5.0), ("a", None, 2.0), ("a", None, 2.5)]
    ev = spark.createDataFrame([(*row, i) for i, row in enumerate(t)], "recid string, uid string, t double, eid long")
    spans = [(0, 50), (3, 9), (3, 3), (4.5, 4.6), (-9, -1), (2, 8), (2.1, 7.9), (6, 60)]
    win = spark.createDataFrame([(r, i, float(a), float(b)) for r in ("a", None, "no events") for i, (a, b) in enumerate(spans)], "recid string, win_id long, t0 double, t1 double")
    got = windowed.windowed_metrics(ev, win, ALL, chunk_s=chunk)
    evw = trains.events_in_windows(ev, win, 10.0)
    isi = trains.intervals(evw, ["recid", "uid", "win_id"], ("t", "eid"), keep_first=True)
    want = trains.interval_metrics(isi, ["recid", "uid", "win_id", "t0", "t1"], ALL).withColumnRenamed("n_rows", "n")
    cols = ["recid", "uid", "win_id", "t0", "t1", "n", *ALL]
    key = lambda r: tuple((x is not None, str(x)) for x in r[:3])
    a, b = (sorted([tuple(r) for r in d.select(cols).collect()], key=key) for d in (got, want))
    assert len(a) == len(b) > 40
    for x, y in zip(a, b, strict=True):
        assert x[:6] == y[:6]
        for m, p, q in zip(ALL, x[6:], y[6:], strict=True):
            assert (p is None) == (q is None) and (p is None or abs(p - q) < 1e-8 or np.isnan([p, q]).all()), (m, x, y)


def test_regular_trains_keep_their_small_spread(spark):
    """Intervals that differ by a ten-thousandth of themselves, far down a long train."""
    rng = np.random.default_rng(6)
    t = np.cumsum(100.0 + rng.normal(0, 0.01, 4000))
    ev = spark.createDataFrame([("r", 1, float(x), i) for i, x in enumerate(t)], "recid string, uid int, t double, eid long")
    win = spark.createDataFrame([("r", 0, float(t[3900]), float(t[3990]))], "recid string, win_id long, t0 double, t1 double")
    r = windowed.windowed_metrics(ev, win, ["b", "m"]).first()
    d = np.diff(t[3900:3991])
    assert r["n"] == 91
    assert r["b"] == pytest.approx((d.std() - d.mean()) / (d.std() + d.mean()), abs=1e-9)
    assert r["m"] == pytest.approx(np.corrcoef(d[:-1], d[1:])[0, 1], abs=1e-5)


def test_empty_tables_and_unknown_metric(spark):
    ev = spark.createDataFrame([], "recid string, uid int, t double, eid long")
    win = spark.createDataFrame([("r", 0, 0.0, 1.0)], "recid string, win_id long, t0 double, t1 double")
    assert windowed.windowed_metrics(ev, win, ALL).count() == 0
    some = spark.createDataFrame([("r", 1, 0.5, 1)], "recid string, uid int, t double, eid long")
    assert windowed.windowed_metrics(some, win.where(F.lit(False)), ALL).count() == 0
    assert windowed.windowed_metrics(some, win, ["b"]).select("n", "b").first() == (1, None)
    with pytest.raises(ValueError):
        windowed.windowed_metrics(ev, win, ["rho"])
