"""Removal of repeated byte strings by blockwise suffix sorting with a difference-cover sample (operator 11).

Only suffixes that share their first ``length`` bytes with another document matter, so suffixes are sorted to that depth.

Blocks. The anchor of a suffix is the gram of least hash in its first ``length`` bytes: suffixes that agree to that depth
have the same anchor at the same place and come to the same bucket. Neighbouring suffixes share an anchor and travel as one
stretch of text. ``passes`` passes over the texts each build a share of the buckets; a task sorts one bucket at a time.
Copies of a stretch in one slice, or in one bucket, are decided at once by the least id among them, so a passage that
stands in a third of all documents is one stretch for each slice. A bucket that stays too large for a task goes through
Spark, suffix by suffix.

Sorting. Positions whose distance from the anchor lies in a difference cover (modulo ``PERIOD``) are the sample. Their
suffixes are ranked first, with the length of the common prefix of neighbours. Every suffix then sorts by the few bytes
before its first sample position and by the rank there, so ties of any length cost one comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import pack, spread, unpack
from .common import combine, materialise, mix, slices, table, texts
from .registry import llm_query

LENGTH, PERIOD, PASSES = 50, 13, 2
#: Text bytes of a slice; a longer text is cut into overlapping pieces.
PIECE = 1 << 20
#: Bytes of stretches of a bucket, and suffixes, that a task sorts at a time.
BUCKET_BYTES, SORTED = 64_000_000, 500_000
_SPOT = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_ZERO = np.zeros(1, np.uint64)


def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues whose differences are all residues."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            found = (0, *rest)
            if len({(a - b) % period for a in found for b in found}) == period:
                return found
    raise ValueError(period)


COVER = difference_cover(PERIOD)
#: For each residue the distance to the next residue of the cover.
AHEAD = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes from each place on, by doubling."""
    out, done, power = None, 0, mix(np.arange(1, 257, dtype=np.uint64))[x]
    size = 1
    while True:
        if k & size:  # longer parts stand behind shorter ones
            out = power if out is None else out[: len(x) - done - size + 1] * np.uint64(pow(_BASE, size, 1 << 64)) + power[done : len(x) - size + 1]
            done += size
        if done == k:
            return mix(out)
        power = power[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size:]
        size *= 2


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def stretches(x: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring suffixes with one anchor: (start, suffixes, place of the anchor, hash of the anchor).

    ``x`` holds texts up to ``ends``; suffixes have ``length`` bytes in their text.
    """
    gram = max(1, length // 2 - 1)
    if len(x) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    hashes = rolling(x, gram)
    # least hash, then least place
    anchor = (sliding_least((hashes & ~_SPOT) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & _SPOT).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, np.int64)
    inner = ends[ends < len(x)]
    np.add.at(edge, np.clip(inner - length + 1, 0, len(anchor)), 1)
    np.subtract.at(edge, np.minimum(inner, len(anchor)), 1)
    anchor[np.cumsum(edge[:-1]) > 0] = -1
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(start, len(anchor)))
    real = anchor[start] >= 0
    start, n = start[real], n[real]
    anchor = anchor[start]
    return start, n, anchor, hashes[anchor]


class Words:
    """Eight bytes from any place of a byte array on, as a number that sorts like them."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = np.concatenate([x, np.zeros(64, np.uint8)])
        self.all = np.ndarray((len(x) + 56,), ">u8", self.x, 0, (1,))

    def __call__(self, at: np.ndarray) -> np.ndarray:
        return self.all[at].astype(np.uint64)


def prefix_words(word: Words, at: np.ndarray, length: int) -> list[np.ndarray]:
    """The ``length`` bytes from ``at`` on, eight at a time, the last ones overlapping."""
    if length < 8:
        return [word(at) >> np.uint64(8 * (8 - length))]
    return [word(at + d) for d in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]]


def copies(word: Words, start: np.ndarray, n: np.ndarray, ahead: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each stretch the first stretch with the same bytes and anchor in the order of ids (its own place if none)."""
    parts = [*prefix_words(word, start, length), *prefix_words(word, start + n - 1, length), n.astype(np.uint64) << np.uint64(32) | ahead.astype(np.uint64)]
    key = combine(parts)
    order = np.lexsort((doc, key))
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    same = np.ones(len(order), bool)
    for p in parts:
        same &= p == p[first]
    return np.where(same, first, np.arange(len(order)))


def leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit numbers."""
    return sum((x < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8)) + (x == 0)


def ranked(word: Words, group: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes from ``at`` on by group and first bytes, and the bytes each shares with the one before."""
    w = word(at)
    order = np.lexsort((w, group))
    if not len(order):
        return order, order
    g, w = group[order], w[order]
    common = np.where(np.concatenate([[True], g[1:] != g[:-1]]), 0, leading(w ^ np.concatenate([_ZERO, w[:-1]])))
    tied = (common == 8) & np.concatenate([[False], g[1:] == g[:-1]])
    for d in range(8, depth, 8):
        held = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(held):
            break
        w = word(at[order[held]] + d)
        own = np.cumsum(~tied[held])
        by = np.lexsort((w, own))
        order[held], w = order[held][by], w[by]
        equal = leading(w ^ np.concatenate([_ZERO, w[:-1]]))
        more = tied[held]
        common[held[more]] = d + equal[more]
        tied[held[more]] = equal[more] == 8
    return order, common


def repeated(word: Words, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, suffix) of every suffix whose first ``length`` bytes also start in a smaller document of its group."""
    reach = n + min(int(AHEAD.max()), length - 1)
    of = np.repeat(np.arange(len(start)), reach)
    place = spread(start, reach)
    gap = AHEAD[(place - anchor[of]) % PERIOD]
    sampled = gap == 0
    at, mine = place[sampled], of[sampled]
    # ranks of the sample, by group and distance from the anchor
    far = int(n.max()) + length
    order, common = ranked(word, group[mine] * 2 * far + (at - anchor[mine] + far), at, length)
    index = np.empty(len(at), np.int64)
    index[order] = np.arange(len(at))
    number = np.cumsum(sampled) - 1
    inside = place - start[of] < n[of]
    suffix, mine, gap = np.flatnonzero(inside), of[inside], gap[inside]
    if length <= AHEAD.max():
        raise ValueError(f"length must be above {AHEAD.max()}")
    name = np.empty(len(suffix), np.int64)
    for k in range(int(AHEAD.max()) + 1):
        names = np.cumsum(common < length - k)
        rows = gap == k
        name[rows] = names[index[number[suffix[rows] + k]]]
    shift = (8 * (8 - np.maximum(gap, 1))).astype(np.uint64)
    head = np.where(gap > 0, word(place[suffix]) >> shift, 0)
    order = np.lexsort((head, gap, name))
    keys = name[order], gap[order], head[order]
    fresh = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    owner = doc[mine[order]]
    hit = owner > np.repeat(np.minimum.reduceat(owner, fresh), np.diff(np.append(fresh, len(owner))))
    rows = np.sort(order[hit])
    return mine[rows], place[suffix[rows]] - start[mine[rows]]


def runs_of(stretch: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes of a stretch as (stretch, first, last)."""
    if not len(stretch):
        return stretch, suffix, suffix
    first = np.flatnonzero(np.concatenate([[True], (stretch[1:] != stretch[:-1]) | (suffix[1:] != suffix[:-1] + 1)]))
    last = np.append(first[1:], len(stretch)) - 1
    return stretch[first], suffix[first], suffix[last]


class Bucket:
    """Stretches of one bucket: id, text hash, place in the text, suffixes, place of the anchor, bytes."""

    def __init__(self, length: int) -> None:
        self.length, self.parts, self.bytes = length, [], 0

    def add(self, data: bytes) -> None:
        press, size = zstandard.ZstdDecompressor(), int.from_bytes(data[:8], "little")
        columns = [np.concatenate(c) for c in zip(*unpack(data[8 : 8 + size], 5), strict=True)]
        self.parts.append((*columns, np.frombuffer(press.decompress(data[8 + size :]), np.uint8)))
        self.bytes += len(self.parts[-1][-1]) + 40 * len(columns[0])

    def whole(self) -> tuple[np.ndarray, ...]:
        """All columns, and where each stretch starts in the bytes."""
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts = [tuple(columns)]
        size = columns[3] + self.length - 1
        return (*columns, np.cumsum(size) - size)

    def settle(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Decide copies of a bucket that is still growing: yields (id, hash, start, stop) to remove, keeps the rest."""
        doc, row, place, n, ahead, x, start = self.whole()
        size = n + self.length - 1
        first = copies(Words(x), start, n, ahead, doc, self.length)
        gone = doc > doc[first]
        yield doc[gone], row[gone], place[gone], (place + size)[gone]
        rest = np.flatnonzero(~gone)
        kept = doc[rest], row[rest], place[rest], n[rest], ahead[rest], gather(x, start[rest], size[rest])
        self.parts, self.bytes = [kept], len(kept[-1]) + 40 * len(rest)

    def sort(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Yields (id, hash, start, stop) to remove: anchors of one id drop out, copies are decided, the others sorted."""
        doc, row, place, n, ahead, x, start = self.whole()
        if not len(doc):
            return
        word = Words(x)
        key = combine(prefix_words(word, start + ahead, max(1, self.length // 2 - 1)))
        order, group = shared_groups(np.argsort(key, kind="stable"), key, doc)
        first = order[copies(word, start[order], n[order], ahead[order], doc[order], self.length)]
        gone = doc[order] > doc[first]
        at = order[gone]
        yield doc[at], row[at], place[at], place[at] + n[at] + self.length - 1
        order, group = shared_groups(order[~gone], key, doc)
        at = 0
        suffixes = np.cumsum(n[order])
        while at < len(order):
            before = suffixes[at - 1] if at else 0
            stop = max(int(np.searchsorted(suffixes, before + SORTED)), at + 1)
            if stop < len(order):  # whole groups
                stop = max(int(np.searchsorted(group, group[stop])), int(np.searchsorted(group, group[at], side="right")))
            own = order[at:stop]
            s, k = repeated(word, start[own], n[own], (start + ahead)[own], group[at:stop], doc[own], self.length)
            s, a, b = runs_of(s, k)
            s = own[s]
            yield doc[s], row[s], place[s] + a, place[s] + b + self.length
            at = stop


def shared_groups(order: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of ``key`` those whose key has several ids, and the number of their group."""
    if not len(order):
        return order, order
    held = doc[order]
    fresh = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    counts = np.diff(np.append(fresh, len(order)))
    shared = np.minimum.reduceat(held, fresh) < np.maximum.reduceat(held, fresh)
    return order[np.repeat(shared, counts)], np.repeat(np.arange(shared.sum()), counts[shared])


def gather(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all stretches, a part at a time: an index takes eight times the bytes it picks."""
    step = 20_000
    return np.concatenate([x[:0], *[x[spread(start[i : i + step], size[i : i + step])] for i in range(0, len(start), step)]])


def bundle(doc: np.ndarray, row: np.ndarray, place: np.ndarray, n: np.ndarray, ahead: np.ndarray, x: np.ndarray) -> bytes:
    head = pack([doc, row, place, n, ahead])
    return len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def cut_pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, hashes, place of the piece in its text, bytes, ends): slices of texts, long texts in overlapping pieces."""
    for part in slices(batches, "t", PIECE):
        part = part.filter(pa.compute.is_valid(part.column("k")))
        values = texts(part, "t")
        if not len(values):
            continue
        ids, rows = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "r"))
        offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        x = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        if len(x) <= 2 * PIECE:
            yield ids, rows, 0, x, ends
        else:  # one long text
            for at in range(0, len(x), PIECE):
                piece = x[at : at + PIECE + length - 1]
                yield ids, rows, at, piece, np.array([len(piece)])


def bucket_rows(docs: DataFrame, length: int, buckets: int, number: int, passes: int) -> DataFrame:
    """(bucket, data): the stretches of this pass by bucket; what copies within a slice decide goes to buckets from ``buckets`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for ids, rows, base, x, ends in cut_pieces(batches, length):
            start, n, anchor, h = stretches(x, ends, length)
            bucket = (h >> np.uint64(24)) % np.uint64(buckets * passes)
            mine = bucket % np.uint64(passes) == np.uint64(number)
            start, n, anchor, bucket = start[mine], n[mine], anchor[mine], (bucket[mine] // np.uint64(passes)).astype(np.int64)
            if not len(start):
                continue
            text = np.searchsorted(ends, start, side="right")
            doc, row = ids[text], rows[text]
            place = start - np.concatenate([[0], ends])[text] + base
            word = Words(x)
            first = copies(word, start, n, anchor - start, doc, length)
            gone = doc > doc[first]
            out_bucket, out = [], []
            if gone.any():
                by = np.flatnonzero(gone)[np.argsort(doc[gone], kind="stable")]
                out_bucket.append(buckets + turn % buckets)
                out.append(bundle(doc[by], row[by], place[by], n[by], (anchor - start)[by], np.zeros(0, np.uint8)))
                turn += 1
            rest = np.flatnonzero(~gone)
            rest = rest[np.lexsort((doc[rest], bucket[rest]))]
            stops = np.searchsorted(bucket[rest], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(stops)).tolist():
                at = rest[stops[b] : stops[b + 1]]
                out_bucket.append(b)
                out.append(bundle(doc[at], row[at], place[at], n[at], (anchor - start)[at], gather(x, start[at], n[at] + length - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out, pa.binary())], ["bucket", "data"])

    return docs.mapInArrow(run, "bucket int, data binary")


_FOUND = "k long, r long, start long, stop long, data binary"


def sorted_buckets(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """(k, r, start, stop, data): spans to remove; with data, stretches of a bucket that is too large for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(found: tuple[np.ndarray, ...], data: list[bytes] | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(data, pa.binary()) if data else pa.nulls(len(found[0]), pa.binary())], ["k", "r", "start", "stop", "data"])

        def late(held: Bucket) -> Iterator[pa.RecordBatch]:
            for doc, row, place, n, _, x in held.parts:
                stop = np.cumsum(n + length - 1)
                raw = x.tobytes()
                data = [raw[a:b] for a, b in zip((stop - n - length + 1).tolist(), stop.tolist(), strict=True)]
                if data:
                    yield spans((doc, row, place, place + n), data)
            held.parts, held.bytes = [], 0

        def done(held: Bucket, large: bool) -> Iterator[pa.RecordBatch]:
            if held.parts:
                yield from late(held) if large else map(spans, held.sort())

        last, held, large = None, Bucket(length), False
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != last:
                    yield from done(held, large)
                    last, held, large = b, Bucket(length), False
                held.add(data)
                if b >= buckets:  # decided within a slice
                    doc, row, place, n, _, _ = held.parts.pop()
                    yield spans((doc, row, place, place + n + length - 1))
                elif held.bytes > BUCKET_BYTES:
                    yield from map(spans, held.settle())
                    if large or held.bytes > BUCKET_BYTES // 2:
                        large = True
                        yield from late(held)
        yield from done(held, large)

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, _FOUND)


def single_suffixes(late: DataFrame, length: int) -> DataFrame:
    """(k, r, start, stop) from the stretches of oversized buckets, one row for each suffix: least id of each string, then back."""
    each = late.select("k", "r", F.posexplode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("i", "start"), "data")
    each = each.select("k", "r", "start", F.expr(f"substring(data, i + 1, {length})").alias("string"))
    least = each.groupBy("string").agg(F.min("k").alias("least"))
    return each.join(least, "string").where("k > least").select("k", "r", "start", (F.col("start") + length).alias("stop"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, passes: int = PASSES) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept (binary): texts without every byte that a string of ``length`` bytes
    covers which also starts in a document of smaller ``key`` (an integer).

    Null and empty texts have no bytes. Rows with a null key neither lose bytes nor make others lose any. Rows of equal key
    don't count as smaller than each other, so repeated rows get the same result; rows of equal key and different text are
    told apart by 32 bits of the text's hash. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("r"), F.col(text).alias("t"))
    found = None
    for number in range(passes):
        part = materialise(sorted_buckets(bucket_rows(rows, length, buckets, number, passes), length, buckets), "suffix-spans", free=True)
        found = found.unionByName(part) if found else part
    spans = found.where("data is null").drop("data")
    late = found.where("data is not null")
    if late.limit(1).count():
        spans = spans.unionByName(materialise(single_suffixes(late, length), "suffix-spans", free=True))
    lists = spans.groupBy("k", "r").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    whole = rows.join(lists, ["k", "r"], "left").select("k", "t", "starts", "stops")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            values = texts(part, "t").cast(pa.binary()).to_pylist()
            sizes, removed, spans, kept = [], [], [], []
            for raw, starts, stops in zip(values, part.column("starts"), part.column("stops"), strict=True):
                sizes.append(len(raw))
                if not starts.is_valid:
                    removed.append(0)
                    spans.append(0)
                    kept.append(raw)
                    continue
                a, b = (np.sort(c.values.to_numpy()) for c in (starts, stops))
                # all spans that begin before a place, less those that ended: the ends of the merged runs
                edge = np.flatnonzero(a[1:] > b[:-1])
                first, last = a[np.concatenate([[0], edge + 1])], b[np.append(edge, len(b) - 1)]
                at, left = 0, []
                for p, q in zip(first.tolist(), last.tolist(), strict=True):
                    left.append(raw[at:p])
                    at = q
                left.append(raw[at:])
                kept.append(b"".join(left))
                removed.append(len(raw) - len(kept[-1]))
                spans.append(len(first))
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["k", "n_bytes", "n_removed", "n_spans", "kept"])

    out = whole.mapInArrow(cut, "k long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("k", key)


@llm_query("op11_suffix_dedup")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
