import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from odd_rows import SF, nothing, odd, ordered  # noqa: F401

import public_tokenizers
from pointweave.llm import align
from pointweave.llm.token_counts import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    """Whole texts through both libraries; byte ranges compared token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    names = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    byte = {c: b for b, c in enumerate(byte_symbols())}
    done, counts = [], Counter()
    for doc_id, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        spell_a = [bytes(byte[c] for c in names[i]) if all(c in byte for c in names[i]) else names[i].encode() for i in a]
        spell_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(spell_a) != want or b"".join(spell_b) != want:
            done.append((doc_id, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (spell_a, spell_b)]
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            u, v = ends[0][i], ends[1][j]
            i, j = i + (u <= v), j + (v <= u)
        counts.update(links)
        shared, groups, p, q = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for e in shared:
            u, v = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, a[p:u])) + "|" + ",".join(map(str, b[q:v])))
            p, q = u, v
        done.append((doc_id, a, b, groups, links))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(
        ((d, len(a), len(b), len(g), len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
         for d, a, b, g, x in done), key=lambda r: tuple((x is not None, x) for x in r))


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ordered(align.op12(spark, SF), *COLS) == brute((r["doc_id"], r["text"]) for r in docs.collect())


def test_odd_rows_and_empty_table(spark, odd, nothing, monkeypatch):  # noqa: F811
    short = odd.where("text is null or length(text) < 5000")
    strange = [
        (900, " leading  and   many    spaces "), (901, "tabs\tand\nlines \n x\r\n y"), (902, "literal ▁ mark"), (903, "a b 　 c d"), (904, "<s> </s> <unk> <|endoftext|> <0x41>"),
        (905, "日本語 テキスト 🎉 emoji👩‍👩‍👧"), (906, "\x00 \x01nul"), (907, "é combining ﬁ ligature"), (908, "don't we'll I'M 12 3rd x--y"), (909, " "), (910, "  "), (911, "a \x1cb \x85c"), (912, "​zero width ﻿bom"),
    ]
    monkeypatch.setattr(align, "ALIGN_BYTES", 3000)
    monkeypatch.setattr(align, "FRAME", 50)
    monkeypatch.setattr(align, "HELD_PAIRS", 500)
    monkeypatch.setattr(align, "MERGE_BYTES", 3000)
    frame = short.select("doc_id", "text").unionByName(spark.createDataFrame(strange, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = ordered(align.align_tokenizers(frame.withColumn("radix", frame["doc_id"]).withColumn("kind", frame["text"]), A, B), *COLS)
    assert got == brute(rows)
    assert align.align_tokenizers(nothing, A, B).count() == 0


@pytest.mark.parametrize("frame", [3, 1000])
def test_runs_merge_in_order(monkeypatch, frame):
    monkeypatch.setattr(align, "FRAME", frame)
    rng = np.random.default_rng(1)
    want, runs = Counter(), []
    for n in (0, 1, 40, 300):
        keys, counts = align.fold(rng.integers(0, 200, n), rng.integers(1, 1 << 40, n))
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        runs.append(align.pack([keys, counts]))
        assert [x for f in align.unpack(runs[-1], 2) for x in f[1].tolist()] == counts.tolist()
    got = [(k, n) for keys, counts in align.merged(runs) for k, n in zip(keys.tolist(), counts.tolist(), strict=True)]
    assert got == sorted(want.items())
