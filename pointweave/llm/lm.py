"""Language-model scoring with an Elias-Fano n-gram trie (operator 9).

Level 1 holds the vocabulary: word hashes in ascending order (the rank is the word's id), exact counts and quantised
back-off weights. Level 2 holds the bigrams: per context a monotone pointer to its successors, the successors as numbers
relative to the context (``context * vocabulary + word``, non-decreasing over the level), and quantised smoothed
probabilities. Both levels are cut into shards by range; each shard is built by one task from pre-aggregated counts and
is one file in the shared folder, which scoring tasks memory-map (or read, where the storage is not mounted).

Smoothing is interpolated absolute discounting over the additive unigram model. A text starts in the context of ``end``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import codes, shared_folder, slices, table, texts, words
from .elias_fano import EliasFano, pack, unpack
from .records import file_system
from .registry import llm_query

DISCOUNT = 0.75
#: Quantised log10 values: codes of one byte, this many steps to a decade.
STEPS = 20
#: Text bytes and bigrams that a task holds before it passes them on.
SLICE, HELD = 6_000_000, 3_000_000
END = ""


def quantise(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10p * STEPS), 0, 255).astype(np.uint8)


def restore(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / -STEPS


def hashed(distinct: pa.Array, seed: int) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)).astype(np.int64) * shards) >> 24


def open_shard(folder: str, name: str) -> dict[str, np.ndarray]:
    fs, top = file_system(folder)
    if fs.type_name == "local":
        return unpack(np.memmap(f"{top}/{name}", np.uint8, "r"))
    with fs.open_input_file(f"{top}/{name}") as f:
        return unpack(np.frombuffer(f.read(), np.uint8))


def save_shard(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    fs, top = file_system(folder)
    fs.create_dir(top, recursive=True)
    own = f"{top}/{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(pack(arrays))
    fs.move(own, f"{top}/{name}")


class Trie:
    """The levels in a folder; ``meta`` has what the driver knows: seed, shards, first id of each shard, V, N."""

    def __init__(self, folder: str, seed: int, starts: tuple[int, ...], total: int) -> None:
        self.folder, self.seed, self.starts, self.total = folder, seed, np.array(starts, np.int64), total
        self.shards, self.size = len(starts) - 1, int(starts[-1])
        self.floor = 0.5 / (total + 0.5 * (self.size + 1))
        self._open: dict = {}
        self.end = int(self.ids(hashed(pa.array([END]), seed))[0])

    def level(self, kind: str, s: int) -> dict:
        if (kind, s) not in self._open:
            a = open_shard(self.folder, f"{kind}-{s:06d}")
            for name in {k.split(".")[0] for k in a if "." in k}:
                a[name] = EliasFano.load(name, a)
            self._open[kind, s] = a
        return self._open[kind, s]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary ids of word hashes, -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        order = np.argsort(h)
        own = shard_of(h[order], self.shards)
        for s in np.unique(own).tolist():
            if self.starts[s + 1] > self.starts[s]:
                at = order[np.searchsorted(own, s) : np.searchsorted(own, s, side="right")]
                a = self.level("words", s)
                found = a["hashes"].find(h[at] - a["base"][0])
                out[at] = np.where(found >= 0, found + self.starts[s], -1)
        return out

    def _of_ids(self, ids: np.ndarray, kind: str, field: str, none: float) -> np.ndarray:
        out = np.full(len(ids), none)
        own = np.searchsorted(self.starts, ids, side="right") - 1
        for s in np.unique(own[ids >= 0]).tolist():
            at = np.flatnonzero((own == s) & (ids >= 0))
            out[at] = self.level(kind, s)[field][ids[at] - self.starts[s]]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self._of_ids(ids, "words", "counts", 0)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.size + 1)))

    def backoff(self, ids: np.ndarray) -> np.ndarray:
        """log10 of the mass that a context leaves to the unigrams; 0 for a context never seen."""
        return restore(self._of_ids(ids, "pairs", "left", 0))

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 probabilities of stored bigrams, nan where not stored. ``first`` ascending, both known."""
        out = np.full(len(first), np.nan)
        own = np.searchsorted(self.starts, first, side="right") - 1
        for s in np.unique(own).tolist():
            low, high = np.searchsorted(own, [s, s + 1])
            a = self.level("pairs", s)
            context = first[low:high] - self.starts[s]
            distinct, back = np.unique(context, return_inverse=True)
            begin, stop = (a["pointers"].access(distinct + i).astype(np.int64)[back] for i in (0, 1))
            value = context.astype(np.uint64) * np.uint64(self.size) + second[low:high].astype(np.uint64)
            found = a["successors"].find(value, begin, stop)
            hit = found >= 0
            out[low + np.flatnonzero(hit)] = restore(a["codes"][found[hit]])
        return out


@lru_cache(maxsize=2)
def trie(folder: str, seed: int, starts: tuple[int, ...], total: int) -> Trie:
    return Trie(folder, seed, starts, total)


def tokens(part: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token of each text, code of each token, hash of each code); the last code is ``end``, put after each text."""
    offsets, flat = words(pc.ascii_lower(texts(part, "t")))
    index, distinct = codes(flat)
    n = part.num_rows
    out = np.full(len(index) + n, len(distinct), np.int64)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = index
    return offsets + np.arange(n + 1), out, np.append(hashed(distinct, seed), hashed(pa.array([END]), seed))


def word_counts(train: DataFrame, seed: int) -> DataFrame:
    """(word, h, n): words and ``end`` (the empty word) of all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", SLICE):
            _, flat = words(pc.ascii_lower(texts(part, "t")))
            index, distinct = codes(flat)
            distinct = pa.concat_arrays([distinct.cast(pa.string()), pa.array([END])])
            n = np.append(np.bincount(index, minlength=len(distinct) - 1), part.num_rows)
            for at in range(0, len(distinct), 50_000):
                cut = distinct.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([cut, pa.array(hashed(cut, seed).view(np.int64)), pa.array(n[at : at + 50_000])], ["word", "h", "n"])

    return train.mapInArrow(run, "word string, h long, n long").groupBy("word", "h").agg(F.sum("n").alias("n"))


def write_words(counts: DataFrame, folder: str, shards: int) -> DataFrame:
    """Level 1, one file per shard of hashes; (shard, size, total, clashes) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            h, n, s = (batch.column(c).to_numpy() for c in ("h", "n", "shard"))
            for k in np.unique(s).tolist():
                held.setdefault(k, []).append((h[s == k].view(np.uint64), n[s == k]))
        for k, parts in held.items():
            h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h)
            h, n = h[order], n[order]
            small = np.uint32 if n.max() < 1 << 32 else np.uint64
            save_shard(folder, f"words-{k:06d}", EliasFano.of(h - h[0]).arrays("hashes") | {"base": h[:1], "counts": n.astype(small)})
            yield pa.RecordBatch.from_pydict({"shard": [k], "size": [len(h)], "total": [int(n.sum())], "clashes": [int((h[1:] == h[:-1]).sum())]})

    own = F.expr(f"cast(shiftright(shiftrightunsigned(h, 40) * {shards}L, 24) as int)")
    rows = counts.select("h", "n", own.alias("shard")).repartitionById(shards, F.col("shard"))
    return rows.mapInArrow(run, "shard long, size long, total long, clashes long")


def write_pairs(train: DataFrame, model: tuple) -> DataFrame:
    """Level 2: bigram counts summed inside each task, then per shard of contexts, one file each."""
    folder, _, starts, _ = model
    shards = len(starts) - 1
    bounds = np.array(starts, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(*model)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = merged(held)
            held.clear()
            cuts = np.searchsorted(keys, bounds.astype(np.uint64) * np.uint64(t.size))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[s], cuts[s + 1]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([keys[a:b].tobytes()]), pa.array([n[a:b].tobytes()])], ["shard", "keys", "n"])

        size = 0
        for part in slices(batches, "t", SLICE):
            _, code, h = tokens(part, t.seed)
            ids = t.ids(h)[code]
            before = np.concatenate([[t.end], ids[:-1]])
            held.append(np.unique(before.astype(np.uint64) * np.uint64(t.size) + ids.astype(np.uint64), return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held[:] = [merged(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, got = trie(*model), {}
        for batch in batches:
            for s, k, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "n")), strict=True):
                got.setdefault(s, []).append((np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64)))
        for s in list(got):
            keys, n = merged(got.pop(s))
            first, second = keys // np.uint64(t.size), (keys % np.uint64(t.size)).astype(np.int64)
            context = first.astype(np.int64) - bounds[s]
            m = int(bounds[s + 1] - bounds[s])
            all_of = np.bincount(context, n, minlength=m)
            kinds = np.bincount(context, minlength=m)
            spare = np.divide(DISCOUNT * kinds, all_of, out=np.ones(m), where=all_of > 0)
            unigram = np.concatenate([10 ** t.unigram(t.counts(second[i : i + HELD])) for i in range(0, len(second), HELD)])
            p = (n - DISCOUNT) / all_of[context] + spare[context] * unigram
            save_shard(folder, f"pairs-{s:06d}", {
                **EliasFano.of(np.concatenate([[0], np.cumsum(kinds)])).arrays("pointers"),
                **EliasFano.of(keys - np.uint64(int(bounds[s]) * t.size)).arrays("successors"),
                "codes": quantise(np.log10(p)), "left": quantise(np.log10(spare)),
            })
            yield pa.RecordBatch.from_pydict({"shard": [s], "pairs": [len(keys)]})

    dealt = train.mapInArrow(count, "shard int, keys binary, n binary").repartitionById(shards, F.col("shard"))
    return dealt.mapInArrow(build, "shard long, pairs long")


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with added counts."""
    if len(parts) == 1:
        return parts[0]
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def build(train: DataFrame, shards: int) -> tuple:
    """Train on all texts of ``train`` (column t) and return (folder, seed, first ids of the shards, tokens)."""
    folder = shared_folder(train.sparkSession, "trie")
    for seed in range(16):
        built = write_words(word_counts(train, seed), f"{folder}/{seed}", shards).collect()  # one row per shard
        if not sum(r["clashes"] for r in built):  # two words with one hash: try other hashes
            break
    sizes = np.zeros(shards, np.int64)
    for r in built:
        sizes[r["shard"]] = r["size"]
    model = (f"{folder}/{seed}", seed, tuple(np.concatenate([[0], np.cumsum(sizes)]).tolist()), int(sum(r["total"] for r in built)))
    if model[3]:
        write_pairs(train, model).write.format("noop").mode("overwrite").save()
    return model


def score(rows: DataFrame, model: tuple) -> DataFrame:
    """(k, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row (k, held_out, t)."""
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(*model)
        for part in slices(batches, "t", SLICE):
            first, code, h = tokens(part, t.seed)
            ids = t.ids(h)
            counts = t.counts(ids)
            one = t.unigram(counts)
            ids, base, known = ids[code], one[code], (counts > 0)[code]
            before = np.concatenate([[t.end], ids[:-1]])
            value = base.copy()
            seen = np.flatnonzero((before >= 0) & (ids >= 0))
            opens = np.flatnonzero(before >= 0)
            context, back = np.unique(before[opens], return_inverse=True)
            value[opens] += t.backoff(context)[back]
            keys, back = np.unique(before[seen].astype(np.uint64) * np.uint64(t.size) + ids[seen].astype(np.uint64), return_inverse=True)
            stored = t.pairs((keys // np.uint64(t.size)).astype(np.int64), (keys % np.uint64(t.size)).astype(np.int64))[back]
            value[seen] = np.where(np.isnan(stored), value[seen], stored)
            n = np.diff(first)
            sums = [np.add.reduceat(x, first[:-1]) for x in (known.astype(np.int64), base, value)]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), t.total)), pa.array(sums[1]), pa.array(sums[2]),
            ], ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame, folds: int = 5, fold: int = 1, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every row.

    Rows whose crc32 of the key as text modulo ``folds`` is ``fold`` are held out of training. A null key counts as the
    empty text, a null text as empty (one token, ``end``). Repeated rows are trained on and scored as often as they occur;
    other columns are not read; an empty table gives no rows. Without training rows every probability is that of an
    unseen word. ``shards`` defaults to the session's shuffle partitions.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fold_of = F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % folds
    rows = docs.select(F.col(key).alias("k"), (fold_of == fold).alias("held_out"), F.col(text).alias("t"))
    return score(rows, build(rows.where("NOT held_out").select("t"), shards)).withColumnRenamed("k", key)


@llm_query("op9_lm_scores")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"))
