import math
import zlib
from collections import Counter

import numpy as np
import pytest

from odd_rows import nothing, odd  # noqa: F401
from pointweave.llm import lm
from pointweave.llm.elias_fano import EliasFano, pack, unpack


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 1 << 60), (100, 50), (5000, 1 << 40), (70_000, 10**6)])
def test_elias_fano_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n).astype(np.uint64))
    s = EliasFano.load("x", unpack(np.frombuffer(pack(EliasFano.of(values).arrays("x")), np.uint8)))
    assert (s.access(np.arange(n)) == values).all() if n else True
    asked = np.concatenate([values, rng.integers(0, top + 5, 500).astype(np.uint64)])
    found = s.find(asked)
    for v, i in zip(asked.tolist(), found.tolist(), strict=True):
        assert (values[i] == v) if i >= 0 else (v not in values)


def split(text):
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return [*low.split(), b""]


def brute(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    train = [split(t) for i, t in rows if not held(i)]
    c = Counter(w for d in train for w in d)
    total, size = sum(c.values()), len(c)
    pairs = Counter((a, b) for d in train for a, b in zip([b"", *d], d))
    whole, kinds = Counter(), Counter()
    for (a, _), n in pairs.items():
        whole[a] += n
        kinds[a] += 1
    p1 = lambda w: (c[w] + 0.5) / (total + 0.5 * (size + 1))
    q = lambda x: min(255, round(-math.log10(x) * lm.STEPS)) / -lm.STEPS

    def p2(a, b):
        if not whole[a]:
            return math.log10(p1(b))
        spare = lm.DISCOUNT * kinds[a] / whole[a]
        if pairs[a, b]:
            return q((pairs[a, b] - lm.DISCOUNT) / whole[a] + spare * p1(b))
        return q(spare) + math.log10(p1(b))

    for i, t in rows:
        d = split(t)
        yield i, held(i), len(d), sum(c[w] > 0 for w in d), total, sum(math.log10(p1(w)) for w in d), sum(p2(a, b) for a, b in zip([b"", *d], d))


def test_scores_against_brute_force(spark, odd):
    got = [tuple(r) for r in lm.lm_scores(odd, shards=5).collect()]
    want = list(brute([(r["doc_id"], r["text"]) for r in odd.collect()]))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        # a value halfway between two codes may be rounded either way
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], abs=0.5 / lm.STEPS * 4, rel=1e-6)


def test_empty_and_untrained(spark, odd, nothing):
    assert lm.lm_scores(nothing, shards=3).count() == 0
    only = odd.where("doc_id is not null and crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 = 1")
    rows = lm.lm_scores(only, shards=3).collect()
    assert rows and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in rows)


def test_bigrams_help_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = lm.lm_scores(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > r["b"]
