import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from odd_rows import nothing, odd  # noqa: F401
from pointweave.llm import records, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def wild(seed, n=300):
    """Texts that mix marks, controls, scripts, combining marks and special tokens."""
    rng = random.Random(seed)
    pool = [*"abcXYZ019.,;:!?'#$%&*|<>()-_ \n\t\r\x0b\x0c\x1c\x85 　́İßéÉçñžŁσΣςعπ中文字한국🙂👩‍👩‍👧", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "  ", "hello", "World", "!!", " ", "﻿", "é"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_word_pieces_give_the_librarys_ids(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(records, "REMEMBERED", 50)
    enc, lib = records.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    for seed in range(6):
        texts = wild(seed) + ["", "It's THE end.", "word" * 500, "don't stop'll!! a.b,c"]
        offsets, ids = enc.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_remembered_pieces_stay_small(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    enc, lib = records.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    rows = pa.array([" ".join(f"{i * 7919:x}" for i in range(at, at + 1000)) for at in range(0, 60_000, 1000)])
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    for i in range(len(rows)):
        enc.encode(rows.slice(i, 1))
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert len(enc.known) > 60_000
    # strings and numbers of a dictionary took over 150 bytes a piece
    assert kept < 80 * len(enc.known)
    assert kept < 1.1 * enc.remembered_bytes() + 1_000_000
    # a few long pieces count by their bytes
    monkeypatch.setattr(records, "REMEMBERED_BYTES", enc.remembered_bytes() + 100_000)
    long = ["ab1" * 30_000, "word", "ab1" * 40_000 + " word word"]
    offsets, ids = enc.encode(pa.array(long))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [lib.encode(t, add_special_tokens=False).ids for t in long]
    assert len(enc.known) == 1 and enc.remembered_bytes() < 1000


def test_merging_gives_the_librarys_counts():
    bpe, lib = token_counts.ByteBpe(BYTES), Tokenizer.from_file(BYTES)
    for seed in range(6):
        texts = wild(seed) + ["", "aaaaaaaaaaaaa", "a" * 3001, "ab" * 2000, " " * 300, "\n" * 50 + "x", "<|endoftext|>" * 3]
        assert bpe.counts(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_code_point_splits_as_in_the_library():
    bpe, lib = token_counts.ByteBpe(BYTES), Tokenizer.from_file(BYTES)
    points = [*range(0x3100), *range(0xA000, 0xB000), *range(0x1F000, 0x1F700)]
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}b" for c in points if not 0xD800 <= c < 0xE000]
    want = [len(e.ids) for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    off = [t for t, a, b in zip(texts, bpe.counts(texts), want, strict=True) if a != b]
    assert not off, off[:5]


def test_token_counts_rows(spark, odd, nothing):
    lib = Tokenizer.from_file(BYTES)
    got = token_counts.token_counts(odd, BYTES).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([tuple(r[:3]) for r in got], key=key) == sorted(want, key=key)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.token_counts(nothing, BYTES).count() == 0


def test_records_round_trip(spark, odd, nothing, tmp_path):
    lib = Tokenizer.from_file(WORDS)
    folder = str(tmp_path / "records")
    manifest = records.write_records(odd, folder, WORDS, files=3)
    got = sorted(records.read_records(manifest, folder).collect(), key=lambda r: r["start"])
    rows = [tuple(r)[:2] for r in odd.selectExpr("doc_id", "text", "xxhash64(text) h").orderBy("doc_id", "h").collect()]
    start = 0
    for g, (i, t) in zip(got, rows, strict=True):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    m = sorted(manifest.collect(), key=lambda r: r["part"])
    name, n = m[-1]["file"], m[-1]["records"]
    order = list(range(n))[::-1]
    back = [ids for _, ids in records.fetch(folder, name, order)]
    mine = [g for g in got if g["part"] == m[-1]["part"]][::-1]
    assert [zlib.crc32(x.tobytes()) for x in back] == [g["ids_crc32"] for g in mine]
    empty = str(tmp_path / "none")
    assert records.read_records(records.write_records(nothing, empty, WORDS, files=2), empty).count() == 0


def test_damage_is_noticed():
    data = bytearray(records.frame(records.pack(7, np.array([1, 2, 3], np.uint32), 2)) * 2)
    payload, after = records.unframe(memoryview(bytes(data)), 0)
    assert records.unpack(payload)[1].tolist() == [1, 2, 3] and after * 2 == len(data)
    for at in range(len(data)):
        bad = bytes(data[:at]) + bytes([data[at] ^ 4]) + bytes(data[at + 1 :])
        with pytest.raises(ValueError):
            records.unframe(memoryview(bad), records.unframe(memoryview(bad), 0)[1])
