import random

import pytest

from odd_rows import nothing, odd, ordered as rows_of  # noqa: F401
from pointweave.llm import ngram_join as nj


def shingles(text, k):
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    w = low.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(data, k, percent):
    """(id, n, component) by comparing all pairs; rows that share an id are one document."""
    sets = [(i, shingles(t, k)) for i, t in data]
    parent = {i: i for i, _ in data}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = lambda x: (x is not None, x or 0)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(sets[a][0]), root(sets[b][0])), key=order)
                parent[q] = p
    return sorted([(i, len(s), root(i)) for i, s in sets], key=lambda r: [(x is not None, x or 0) for x in r])


def near_copies(seed, families=6, size=25):
    rng = random.Random(seed)
    out = []
    line = "this very common line stands in most of all the texts here"
    for f in range(families):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(20, 160))]
        for _ in range(size):
            words = base[:]
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(99)}"
            if rng.random() < 0.5:
                words = words + line.split()
            out.append((len(out), " ".join(words)))
    return out


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_components_against_all_pairs(spark, odd, monkeypatch, k, percent):
    data = near_copies(k)
    got = nj.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), k, percent)
    assert rows_of(got) == brute(data, k, percent)
    got = rows_of(nj.jaccard_components(odd, k, percent))
    assert got == brute([(r["doc_id"], r["text"]) for r in odd.collect()], k, percent)


def test_small_chunks_and_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nj, "CHUNK", 3)
    monkeypatch.setattr(nj, "BLOCK", 7)
    monkeypatch.setattr(nj, "SHORT", 4)
    data = near_copies(11, 4, 20)
    got = nj.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"))
    assert rows_of(got) == brute(data, 3, 90)


@pytest.mark.parametrize("short", [0, 4, 64])
def test_search_alone_finds_every_component(spark, monkeypatch, short):
    """Without first links the full search must find all by itself."""
    monkeypatch.setattr(nj, "SHORT", short)
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(nj, "forest", lambda rows, percent: none)
    data = near_copies(12, 5, 12)
    got = nj.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"))
    assert rows_of(got) == brute(data, 3, 90)


def test_prefix_property():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(3, 80))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = x[rng.random(len(x)) < 0.95]
        y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]))
        crowd = lambda s: (1 + s % np.uint64(7) * (s % np.uint64(3))).astype(np.uint32)
        inter = len(np.intersect1d(x, y))
        if len(y) and nj.linked(inter, len(x), len(y), 90):
            (l, p), (m, q) = nj.prefix_of(x, crowd(x), 90), nj.prefix_of(y, crowd(y), 90)
            assert len(np.intersect1d(p, q)) >= min(l, m)


def test_keep_one_and_empty(spark, odd, nothing):
    assert nj.jaccard_components(nothing).count() == 0
    kept = nj.keep_one(spark, odd, "")
    assert kept.columns == odd.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and ids.count(12) == 1 and 4 in ids and 5 in ids


def test_written_steps_pass_arrow_batches_of_bounded_bytes(spark):
    import pyarrow as pa

    from pointweave.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    rows = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('a b ', 1500) AS t")
    before = spark.conf.get(common._BATCH)
    got = common.materialise(rows.mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()
    assert sum(r["rows"] for r in got) == 3000
    assert max(r["bytes"] for r in got) < 2 * common.BATCH_BYTES
    assert spark.conf.get(common._BATCH) == before
