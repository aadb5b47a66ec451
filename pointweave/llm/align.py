"""Alignment of two tokenizers with corpus-wide pair counts (operator 12).

Texts are cut at single spaces between two other characters, where no token of either vocabulary passes; each distinct
piece is encoded and aligned once. Token ends that both sides share close a group; the pieces between neighbouring ends of
either side are the links.

Counting is external. A task folds its links into runs: for each radix of the B id the sorted pairs (B id first) with their
counts, delta coded in zstd frames, and likewise, slice by slice, the links of each document. A k-way merge by heap counts
the pairs of each radix. As it runs in the order of the B side, all pairs of a B id pass together and give its maximum.
Document runs then stream past the counts of their radix and the contributions go back to their slice. Everything travels
as rows of compressed runs; what one task holds is bounded by a slice, by one frame of each run, or by the vocabularies.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table
from .registry import llm_query
from .token_counts import byte_symbols

#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Text bytes and texts of a slice.
ALIGN_BYTES, SLICE_TEXTS = 4_000_000, 1 << 15
#: Pairs that a task counts before it hands on a run, and entries of a frame.
HELD_PAIRS, FRAME = 3_000_000, 1 << 16
#: Compressed bytes of runs that one merge takes at a time.
MERGE_BYTES = 64_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)").split
DOCS, COUNTS, LINKS = 0, 1, 2


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, .. of ``size`` places each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Side:
    """Bytes of each id of one vocabulary, and the ids of many pieces."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.names = [str(i) for i in range(len(tokens))]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[spread(self.start[ids], self.size[ids])]


class ByteLevel(Side):
    """A byte-level BPE file; the piece gets a space in front; special strings are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_symbols())}
        tokens = [b""] * (max([*vocab.values(), self.tokenizer.get_vocab_size(with_added_tokens=True) - 1]) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        super().__init__(tokens)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([f" {p}" for p in pieces], add_special_tokens=False)]


class Pieces(Side):
    """A sentencepiece model that adds the space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        super().__init__([bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)])
        # where a space may stand inside a token, pieces of a text aren't independent and texts go in whole
        self.crosses = any("▁" in s.lstrip("▁") for s in names)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return self.model.encode(pieces, num_threads=1)


class Aligner:
    """Ids, groups and links of texts, by distinct pieces."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.n_a, self.n_b = len(self.a.size), len(self.b.size)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        # for each piece: tokens of A and B, groups, links; -1 tokens where the bytes differ
        self.stats = np.zeros((0, 4), np.int64)
        self.first = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)
        self.groups: list[str] = []

    def learn(self, pieces: list[str]) -> None:
        """Encode and align new pieces; their links go to the flat pool as B id * |A| + A id."""
        ids, counts = [], []
        for side in (self.a, self.b):
            lists = side.encode(pieces)
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter((i for x in lists for i in x), np.int64, int(counts[-1].sum())))
        raw = [f" {p}".encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        want = np.frombuffer(b"".join(raw), np.uint8)
        good = np.ones(len(pieces), bool)
        for side, tokens, n in zip((self.a, self.b), ids, counts, strict=True):
            own = np.bincount(np.repeat(np.arange(len(n)), n), side.size[tokens], len(n)).astype(np.int64)
            good &= own == size
        for side, tokens, n in zip((self.a, self.b), ids, counts, strict=True):
            same = side.bytes_of(tokens[np.repeat(good, n)]) == want[np.repeat(good, size)]
            good[np.repeat(np.flatnonzero(good), size[good])[~same]] = False
        self.keep(pieces, good, ids, counts, size)

    def keep(self, pieces: list[str], good: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray], size: np.ndarray) -> None:
        a, b = (x[np.repeat(good, n)] for x, n in zip(ids, counts, strict=True))
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        pairs = b[at_b] * self.n_a + a[at_a]
        whole = np.flatnonzero(good)
        close = np.cumsum(size[good])
        of = np.searchsorted(close, ends)
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_of = np.searchsorted(close, shared)
        stats = np.full((len(pieces), 4), -1, np.int64)
        stats[whole] = np.stack([counts[0][good], counts[1][good], np.bincount(group_of, minlength=len(whole)), np.bincount(of, minlength=len(whole))], axis=1)
        n_links = np.zeros(len(pieces), np.int64)
        n_links[whole] = stats[whole, 3]
        # groups as text: ids up to each shared end
        stop_a = (np.searchsorted(ends_a, shared) + 1).tolist()
        stop_b = (np.searchsorted(ends_b, shared) + 1).tolist()
        names_a, names_b = [self.a.names[i] for i in a.tolist()], [self.b.names[i] for i in b.tolist()]
        texts, p, q = [], 0, 0
        for u, v in zip(stop_a, stop_b, strict=True):
            texts.append(f"{names_a[p] if u - p == 1 else ','.join(names_a[p:u])}|{names_b[q] if v - q == 1 else ','.join(names_b[q:v])}")
            p, q = u, v
        at, groups = 0, [""] * len(pieces)
        for i, n in zip(whole.tolist(), stats[whole, 2].tolist(), strict=True):
            groups[i] = texts[at] if n == 1 else ";".join(texts[at : at + n])
            at += n
        self.known.update(zip(pieces, range(len(self.groups), len(self.groups) + len(pieces)), strict=True))
        self.groups += groups
        self.stats = np.concatenate([self.stats, stats])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, pairs])

    def align(self, docs: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links of each text; digest; then links: pair, text, how often), sorted by pair and text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = [[] if not t else [t] if self.b.crosses else _CUT(t) for t in docs]
        flat = [p for c in cut for p in c]
        codes = np.fromiter(map(self.known.get, flat, [-1] * len(flat)), np.int64, len(flat))
        if (codes < 0).any():
            self.learn(list(dict.fromkeys(p for p, c in zip(flat, codes.tolist(), strict=True) if c < 0)))
            codes = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        doc = np.repeat(np.arange(len(cut)), size)
        bad = np.bincount(doc, self.stats[codes, 0] < 0, len(cut)) > 0
        good = ~bad[doc]
        doc, codes = doc[good], codes[good]
        totals = np.zeros((len(cut), 4), np.int64)
        for k in range(4):
            totals[:, k] = np.bincount(doc, self.stats[codes, k], len(cut)).astype(np.int64)
        digests, at, names, listed = [], 0, self.groups, codes.tolist()
        for n, wrong in zip(size.tolist(), bad.tolist(), strict=True):
            if wrong or not n:
                digests.append("")
                continue
            digests.append(hashlib.sha256(";".join([names[c] for c in listed[at : at + n]]).encode()).hexdigest())
            at += n
        # a piece that a text holds several times is expanded once
        one, often = np.unique(doc * (len(names) + 1) + codes, return_counts=True)
        doc, codes = np.divmod(one, len(names) + 1)
        n = self.first[codes + 1] - self.first[codes]
        pair = self.links[spread(self.first[codes], n)]
        key = pair * len(cut) + np.repeat(doc, n)
        order = np.argsort(key, kind="stable")
        key, often = key[order], np.repeat(often, n)[order]
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(often, fresh) if len(key) else often
        pair, doc = np.divmod(key[fresh], max(1, len(cut)))
        return totals, digests, pair, doc, times


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def pack(columns: list[np.ndarray]) -> bytes:
    """A run: frames of at most ``FRAME`` entries; the first column ascending and delta coded, each by planes of bytes."""
    out = []
    press = zstandard.ZstdCompressor(level=3)
    for at in range(0, len(columns[0]), FRAME):
        part = [c[at : at + FRAME].astype("<i8") for c in columns]
        part[0] = np.diff(part[0], prepend=0)
        planes = []
        for c in part:
            width = 8 if c.min() < 0 else max(1, (int(c.max()).bit_length() + 7) // 8)
            planes.append(bytes([width]) + np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
        data = press.compress(b"".join(planes))
        out += [len(part[0]).to_bytes(4, "little"), len(data).to_bytes(4, "little"), data]
    return b"".join(out)


def unpack(run: bytes, columns: int) -> Iterator[list[np.ndarray]]:
    """The frames of a run, one at a time."""
    at, press = 0, zstandard.ZstdDecompressor()
    while at < len(run):
        n, size = (int.from_bytes(run[at + k : at + k + 4], "little") for k in (0, 4))
        data = np.frombuffer(press.decompress(run[at + 8 : at + 8 + size]), np.uint8)
        at += 8 + size
        out, place = [], 0
        for _ in range(columns):
            width = int(data[place])
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = data[place + 1 : place + 1 + width * n].reshape(width, n).T
            out.append(wide.view("<i8").ravel())
            place += 1 + width * n
        out[0] = np.cumsum(out[0])
        yield out


def fold(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[fresh], np.add.reduceat(counts, fresh)


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of runs of (pair, count): the heap holds the open frame of each run by its last pair, and all that is
    not above the least of them leaves together."""
    frames = [unpack(r, 2) for r in runs]
    held, heap = {}, []

    def load(i: int) -> None:
        frame = next(frames[i], None)
        if frame is not None:
            held[i] = frame
            heapq.heappush(heap, (int(frame[0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while heap:
        limit, i = heap[0]
        keys, counts = [], []
        for k, (key, count) in held.items():
            stop = np.searchsorted(key, limit, side="right")
            if stop:
                keys.append(key[:stop])
                counts.append(count[:stop])
                held[k] = [key[stop:], count[stop:]]
        while heap and heap[0][0] == limit:
            _, i = heapq.heappop(heap)
            del held[i]
            load(i)
        yield fold(np.concatenate(keys), np.concatenate(counts))


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, radixes: int) -> DataFrame:
    """Rows (kind, radix, slice, data): document statistics of each slice, runs of pair counts, runs of document links."""

    def split(pair: np.ndarray, n_a: int) -> Iterator[tuple[int, np.ndarray]]:
        """Entries of each radix of the B id, in the order of the pairs."""
        radix = (pair // n_a) % radixes
        order = np.argsort(radix, kind="stable")
        stops = np.searchsorted(radix[order], np.arange(radixes + 1))
        for r in range(radixes):
            if stops[r] < stops[r + 1]:
                yield r, order[stops[r] : stops[r + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        pairs, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def row(kind: int, radix: int, name: str, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([radix], pa.int32()), pa.array([name]), pa.array([data], pa.binary())], ["kind", "radix", "slice", "data"])

        def flush() -> Iterator[pa.RecordBatch]:
            k, n = fold(np.concatenate(pairs), np.concatenate(counts))
            pairs[:], counts[:] = [], []
            for r, at in split(k, al.n_a):
                yield row(COUNTS, r, "", pack([k[at], n[at]]))

        for part in slices((b.slice(i, SLICE_TEXTS) for b in batches for i in range(0, max(1, b.num_rows), SLICE_TEXTS)), "t", ALIGN_BYTES):
            name = uuid.uuid4().hex
            totals, digests, pair, doc, times = al.align(part.column(1).to_pylist())
            stats = pa.RecordBatch.from_arrays([part.column(0), *[pa.array(totals[:, k]) for k in range(4)], pa.array(digests, pa.string())], ["k", "a", "b", "g", "l", "s"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, stats.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(stats)
            yield row(DOCS, -1, name, sink.getvalue().to_pybytes())
            for r, at in split(pair, al.n_a):
                yield row(LINKS, r, name, pack([pair[at], doc[at], times[at]]))
            k, n = fold(pair, times)
            pairs.append(k)
            counts.append(n)
            if sum(map(len, pairs)) > HELD_PAIRS:
                k, n = fold(np.concatenate(pairs), np.concatenate(counts))
                pairs[:], counts[:] = [k], [n]
                if len(k) > HELD_PAIRS // 2:
                    yield from flush()
        yield from flush() if pairs else ()

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, "kind int, radix int, slice string, data binary")


def pair_counts(runs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(radix, data): merged runs of (pair, count, 1 where the count is the highest of its B id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_a = aligner(a_path, b_path).n_a
        radix, held, size = None, [], 0

        def best(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
            side = keys // n_a
            fresh = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
            top = np.maximum.reduceat(counts, fresh)
            return counts == np.repeat(top, np.diff(np.append(fresh, len(side))))

        def done() -> Iterator[pa.RecordBatch]:
            """What is merged leaves up to the last B id, which may go on in the next frame."""
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for k, n in merged(held):
                keys, counts = np.concatenate([keys, k]), np.concatenate([counts, n])
                stop = np.searchsorted(keys, keys[-1] // n_a * n_a)
                if stop >= FRAME:
                    yield out(keys[:stop], counts[:stop])
                    keys, counts = keys[stop:], counts[stop:]
            if len(keys):
                yield out(keys, counts)

        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            data = pack([keys, counts, best(keys, counts)])
            return pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([data], pa.binary())], ["radix", "data"])

        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != radix:
                    if held:
                        yield from done()
                    radix, held, size = r, [], 0
                held.append(data)
                size += len(data)
                if size > MERGE_BYTES and len(held) > 2:
                    held = [pack(list(map(np.concatenate, zip(*merged(held), strict=True))))]
                    size = 0
        if held:
            yield from done()

    counted = runs.where(F.col("kind") == COUNTS).select("radix", "data")
    return counted.repartition("radix").sortWithinPartitions("radix").mapInArrow(run, "radix int, data binary")


def contributions(runs: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    """(slice, data): sums of counts and numbers of best links of the documents of a slice, from one radix.

    Runs of a radix are dealt to ``salts`` tasks, so a B id that stands in every text is split; the counts go to each.
    """
    links = runs.where(F.col("kind") == LINKS).select("radix", F.pmod(F.hash("slice"), F.lit(salts)).alias("salt"), F.lit(1).alias("kind"), "slice", "data")
    sides = counts.select("radix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit("").alias("slice"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, known = None, [], None
        for batch in batches:
            for r, s, kind, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (r, s) != cell:
                    cell, parts, known = (r, s), [], None
                if kind == 0:
                    parts += unpack(data, 3)
                    continue
                if known is None:
                    known = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    order = np.argsort(known[0], kind="stable")
                    known, parts = [c[order] for c in known], []
                frames = list(unpack(data, 3))
                pair, doc, times = (np.concatenate(c) for c in zip(*frames, strict=True))
                at = np.searchsorted(known[0], pair)
                if not (known[0][at] == pair).all():
                    raise ValueError("a linked pair was not counted")
                order = np.argsort(doc, kind="stable")
                fresh = np.flatnonzero(np.diff(doc[order], prepend=-1))
                sums = np.add.reduceat((times * known[1][at])[order], fresh)
                best = np.add.reduceat((times * known[2][at])[order], fresh)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack([doc[order][fresh], sums, best])], pa.binary())], ["slice", "data"])

    both = sides.unionByName(links).repartition("radix", "salt").sortWithinPartitions("radix", "salt", "kind")
    return both.mapInArrow(run, "slice string, data binary")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    ``a_path`` is a byte-level BPE file, ``b_path`` a sentencepiece model, both readable on every worker. Null and empty
    texts, and texts whose tokens do not spell the text on either side, have no tokens: zeros and an empty digest. Repeated
    rows and null keys keep their row and count each time; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    salts = math.ceil(2 * math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    runs = materialise(aligned(docs, a_path, b_path, key, text, salts), "runs")
    counts = materialise(pair_counts(runs, a_path, b_path), "pair-counts")
    back = contributions(runs, counts, salts)
    both = runs.where(F.col("kind") == DOCS).select("slice", F.lit(0).alias("kind"), "data").unionByName(back.select("slice", F.lit(1).alias("kind"), "data"))
    schema = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, sums, best = None, None, None

        def done() -> pa.RecordBatch:
            a, b, g, n, s = (stats.column(i) for i in range(1, 6))
            return pa.RecordBatch.from_arrays([stats.column(0), a, b, g, n, pa.array(best), pa.array(sums), s], ["k", *schema.names])

        for batch in batches:
            for _, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if stats is not None:
                        yield done()
                    stats = pa.ipc.open_stream(data).read_next_batch()
                    sums, best = np.zeros(stats.num_rows, np.int64), np.zeros(stats.num_rows, np.int64)
                else:
                    for doc, more, top in unpack(data, 3):
                        sums[doc] += more
                        best[doc] += top
        if stats is not None:
            yield done()

    fields = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)
    out = both.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(run, f"k {kind}, {fields}")
    return out.withColumnRenamed("k", key)


@llm_query("op12_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
