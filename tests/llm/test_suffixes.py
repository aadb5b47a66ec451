import hashlib
import random

import numpy as np
import pytest
from odd_rows import SF, nothing, odd, ordered  # noqa: F401

from pointweave.llm import suffixes

COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length=50):
    """Every string of ``length`` bytes in a dictionary with its least document."""
    least = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        if doc_id is not None:
            for i in range(len(raw) - length + 1):
                s = raw[i : i + length]
                least[s] = min(least.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        if doc_id is not None:
            for i in range(len(raw) - length + 1):
                if least[raw[i : i + length]] < doc_id:
                    gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((doc_id, len(raw), len(raw) - len(kept), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def result(docs, **kw):
    from pyspark.sql import functions as F

    return ordered(suffixes.remove_repeats(docs, **kw).withColumn("kept_sha256", F.sha2("kept", 256)), *COLS)


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r[2] for r in want) > 0
    assert ordered(suffixes.op11(spark, SF), *COLS) == want


def test_odd_rows_and_empty_table(odd, nothing):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(odd) == brute(rows)
    assert suffixes.remove_repeats(nothing).count() == 0


def tangled(seed, docs=60):
    """Texts of few letters, runs of one letter, shared passages, edits, copies and repeated ids."""
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abé ") for _ in range(rng.randrange(40, 160))) for _ in range(6)]
    out = []
    for i in range(docs):
        parts = [rng.choice([rng.choice(shared), "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(0, 80))), "x" * rng.randrange(0, 120), "ab" * rng.randrange(0, 60), shared[0][: rng.randrange(20, 60)]]) for _ in range(rng.randrange(0, 8))]
        out.append((rng.randrange(-20, 40), "".join(parts)))
    return out + out[:3]


@pytest.mark.parametrize(("seed", "length", "limit"), [(1, 50, 0), (2, 50, 2000), (3, 20, 0), (4, 9, 1500), (5, 33, 0)])
def test_tangled_texts(spark, monkeypatch, seed, length, limit):
    if limit:  # several texts in a slice, long texts in pieces, buckets that are too large for a task, few suffixes sorted at a time
        monkeypatch.setattr(suffixes, "PIECE", 150)
        monkeypatch.setattr(suffixes, "BUCKET_BYTES", limit)
        monkeypatch.setattr(suffixes, "SORTED", 30)
    rows = tangled(seed)
    got = result(spark.createDataFrame(rows, "doc_id long, text string"), length=length, passes=1 + seed % 3)
    assert got == brute(rows, length)


def test_cover_and_ranks():
    for period in (3, 7, 13, 21):
        cover = suffixes.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    rng = np.random.default_rng(0)
    x = rng.integers(97, 99, 400).astype(np.uint8)
    at = rng.integers(0, 340, 200)
    group = rng.integers(0, 3, 200)
    order, common = suffixes.ranked(suffixes.Words(x), group, at, 50)
    keys = [(group[i], x[at[i] : at[i] + 56].tobytes()) for i in order]
    assert keys == sorted(keys)
    for i in range(1, 200):
        want = 0
        if keys[i][0] == keys[i - 1][0]:
            while want < 56 and keys[i][1][want] == keys[i - 1][1][want]:
                want += 1
        assert common[i] == want


def test_large_buckets_are_handed_on(spark, monkeypatch):
    """The small limit of the test above does send stretches through Spark, and they give spans there."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 1500)
    docs = spark.createDataFrame(tangled(4), "k long, t string").withColumn("r", F.lit(0).cast("long")).select("k", "r", "t")
    found = suffixes.sorted_buckets(suffixes.bucket_rows(docs, 9, 4, 0, 1), 9, 4)
    late = found.where("data is not null")
    assert late.count() > 0 and suffixes.single_suffixes(late, 9).count() > 0
