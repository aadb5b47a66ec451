import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import SF, nothing, odd, ordered  # noqa: F401

from pointweave.llm import spelling


def brute(rows, least_length=5, least_count=3):
    """Words, near words and forms by direct definitions: all single edits are looked up in a dictionary."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    masks = {}
    for w in words:
        for i in range(len(w)):
            masks.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= masks[w[:i], w[i + 1 :]] - {w}
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        out[w] = [best if best and words[best] >= 2 * n else None, n, len(near[w])]
    rows = []
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, out[form][1] if form else None))
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


COLS = ("word", "form", "root", "n", "n_near", "form_n")


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute((r["doc_id"], r["text"]) for r in docs.collect())
    assert want and ordered(spelling.op13(spark, SF), *COLS) == want


def test_odd_rows_and_empty_table(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert ordered(spelling.spelling_variants(odd, least_length=2), *COLS) == brute(rows, 2)
    assert spelling.spelling_variants(nothing).count() == 0


def test_chains_ties_and_very_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 3)
    rng = random.Random(3)
    base = [("spelling", 40), ("speling", 12), ("spelin", 5), ("spolling", 40), ("élégance", 30), ("elégance", 9), ("élegance", 4), ("a" * 5000, 6), ("a" * 5001, 3)]
    base += [("".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 8))), rng.randrange(3, 30)) for _ in range(400)]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(base, 10)]
    got = ordered(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")), *COLS)
    want = brute(rows)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of two forms


@pytest.mark.parametrize("seed", range(5))
def test_products_find_every_edit(seed):
    rng = np.random.default_rng(seed)
    short = np.unique(rng.integers(97, 101, (60, 6)).astype("<u4"), axis=0)
    longer = np.unique(rng.integers(97, 101, (60, 7)).astype("<u4"), axis=0)

    def one_edit(u, v):
        if len(u) == len(v):
            return (u != v).sum() == 1
        return any((np.delete(v, k) == u).all() for k in range(len(v)))

    for a, b, same in ((short, short, True), (short, longer, False)):
        got = set(zip(*map(np.ndarray.tolist, spelling.near_in_blocks(a, b, same)), strict=True))
        assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if (not same or i < j) and one_edit(a[i], b[j])}
