"""Spelling variants by blocked Gram matrices (operator 13).

Words meet in cells: words of one length whose letters fall alike into ``CLASSES`` classes (code point modulo the number
of classes). One inserted, deleted or replaced code point moves a word to its own cell or to one of a few adjacent ones, so
only blocks of adjacent cells are multiplied. The product of two blocks of letter counts gives all squared distances
``|a|^2 + |b|^2 - 2ab`` at once; an edit changes them by one (another length) or two (same length). What is left is
verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table, texts
from .registry import llm_query

CLASSES = 5
#: Words of a block, fewer where words are long.
BLOCK_WORDS = 2048
BLOCK_BYTES = 4_000_000
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
LEAST_LENGTH, LEAST_COUNT, DELETE_EVERY = 5, 3, 97
_RUN = re.compile("[a-zÀ-ÿ]+")


def slips(runs: Counter, doc_id: int | None, least: int) -> Iterator[tuple[str, int]]:
    """Words of one text and their counts: where ``DELETE_EVERY`` divides the hash of id and run, a code point is deleted."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        if len(run) < least:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % DELETE_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            yield run, n


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over all texts: runs of Latin letters, A-Z lower-cased, with the deletions of ``slips``.

    Null and empty texts have no words; a null key reads as an empty id; repeated rows count each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for part in slices(batches, "t"):
            for doc_id, value in zip(part.column(0).to_pylist(), pa.compute.ascii_lower(texts(part, "t")).to_pylist(), strict=True):
                for word, n in slips(Counter(_RUN.findall(value)), doc_id, least_length):
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield flush()
        if held:
            yield flush()

    counted = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def cells(codes: np.ndarray) -> np.ndarray:
    """Letters of each class, for words of one length: (words, CLASSES)."""
    return np.stack([(codes % CLASSES == c).sum(axis=1) for c in range(CLASSES)], axis=1)


def cell_name(counts: tuple[int, ...]) -> str:
    return ",".join(map(str, counts))


def partners(counts: tuple[int, ...]) -> list[str]:
    """The cell itself, half of those of the same length that a replaced letter leads to, and those of one more letter."""
    out = [cell_name(counts)]
    for i in range(CLASSES):
        more = [c + (k == i) for k, c in enumerate(counts)]
        out.append(cell_name(tuple(more)))
        out += [cell_name(tuple(c - (k == j) for k, c in enumerate(more))) for j in range(i + 1, CLASSES) if counts[j]]
    return out


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def blocks(words: DataFrame) -> DataFrame:
    """(cell, block, partners, codes, ns): words of one cell in blocks of bounded size."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            names = [""] * len(values)
            size = np.fromiter(map(len, values), np.int64, len(values))
            for length in np.unique(size):
                rows = np.flatnonzero(size == length)
                for row, counts in zip(rows.tolist(), cells(code_points([values[r] for r in rows])).tolist(), strict=True):
                    names[row] = cell_name(tuple(counts))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *batch.columns], ["cell", "word", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ns = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                codes = code_points(held)
                block = int(zlib.crc32(codes.tobytes()))
                yield pa.RecordBatch.from_pydict({
                    "cell": [cell], "block": [f"{block}:{held[0][:40]}"], "partners": [partners(tuple(map(int, cell.split(","))))],
                    "codes": pa.array([codes.tobytes()], pa.binary()), "ns": pa.array([np.array(ns, "<i8").tobytes()], pa.binary())})
                held.clear()
                ns.clear()

        for batch in batches:
            for c, w, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != cell or len(held) >= min(BLOCK_WORDS, max(1, BLOCK_BYTES // (4 * len(w)))):
                    yield from flush()
                    cell = c
                held.append(w)
                ns.append(n)
        yield from flush()

    named = words.select("word", "n").mapInArrow(name, "cell string, word string, n long")
    # a frequent cell goes to several tasks; its blocks are its words in order there
    dealt = named.repartition("cell", F.pmod(F.hash("word"), F.lit(4))).sortWithinPartitions("cell", "word")
    return dealt.mapInArrow(pack, "cell string, block string, partners array<string>, codes binary, ns binary")


def near_in_blocks(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all pairs one edit apart. Rows of ``a`` and ``b`` are code points, ``b`` as long or one longer.

    ``same``: both are one block, each pair is wanted once.
    """
    letters = np.unique(np.concatenate([a.ravel(), b.ravel()]))

    def counts(x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(letters, x) + (np.arange(len(x)) * len(letters))[:, None]
        return np.bincount(at.ravel(), minlength=len(x) * len(letters)).reshape(len(x), -1).astype(np.float32)

    x, y = counts(a), counts(b)
    # |x|^2 + |y|^2 - 2xy <= 2; exact in float32 as counts are whole and, beyond 4000 letters, float64 is taken
    if b.shape[1] > 4000:
        x, y = x.astype(np.float64), y.astype(np.float64)
    distance = x @ (-2 * y.T)
    distance += (x * x).sum(axis=1)[:, None]
    distance += (y * y).sum(axis=1)[None, :]
    i, j = np.nonzero((distance <= 2) & (distance > 0))
    if same:
        i, j = i[i < j], j[i < j]
    left, right = a[i], b[j]
    if a.shape[1] == b.shape[1]:
        good = (left != right).sum(axis=1) == 1
    else:
        head = np.cumprod(left == right[:, :-1], axis=1).sum(axis=1) if len(i) else np.zeros(0, int)
        tail = np.cumprod((left == right[:, 1:])[:, ::-1], axis=1).sum(axis=1) if len(i) else np.zeros(0, int)
        good = head + tail >= a.shape[1]
    return i[good], j[good]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): near words of every word that has any; best is (minus n, word) of the most frequent, least one."""
    held = materialise(blocks(words), "letter-blocks")
    left = held.select(F.explode("partners").alias("partner"), *[F.col(c).alias(f"l_{c}") for c in ("cell", "block", "codes", "ns")])
    pairs = left.join(held.drop("partners"), F.col("partner") == F.col("cell")).where("cell <> l_cell or block >= l_block")
    schema = "word string, n_near long, best struct<minus:long,word:string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lc, lb, lx, ln, c, b, x, n in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                size = sum(map(int, lc.split(",")))
                one = np.frombuffer(lx, "<u4").reshape(-1, size)
                two = np.frombuffer(x, "<u4").reshape(-1, sum(map(int, c.split(","))))
                ns = np.frombuffer(ln, "<i8"), np.frombuffer(n, "<i8")
                i, j = near_in_blocks(one, two, (lc, lb) == (c, b))
                if not len(i):
                    continue
                spell = [[r.tobytes().decode("utf-32-le") for r in block[np.unique(at)]] for block, at in ((one, i), (two, j))]
                ids = [np.unique(at, return_inverse=True)[1].tolist() for at in (i, j)]
                near: dict[str, list] = {}
                for p, q, m, k in zip(*ids, ns[0][i].tolist(), ns[1][j].tolist(), strict=True):
                    u, v = spell[0][p], spell[1][q]
                    for word, other in ((u, (-k, v)), (v, (-m, u))):
                        got = near.setdefault(word, [0, other])
                        got[0] += 1
                        got[1] = min(got[1], other)
                yield pa.RecordBatch.from_arrays([
                    pa.array(near.keys(), pa.string()), pa.array([x[0] for x in near.values()], pa.int64()),
                    pa.array([{"minus": x[1][0], "word": x[1][1]} for x in near.values()], pa.struct([("minus", pa.int64()), ("word", pa.string())]))],
                    ["word", "n_near", "best"])

    found = pairs.select("l_cell", "l_block", "l_codes", "l_ns", "cell", "block", "codes", "ns").mapInArrow(run, schema)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: pointers are doubled until none moves. A form is at least twice as frequent
    as its word, so no chain is longer than 63 and six rounds always suffice."""
    ends = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = ends.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = materialise(ends.join(nxt, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        ends = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return ends


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least_length`` letters that occurs ``least_count`` times.

    ``form`` is the near word of largest n (ties: the least in code-point order) where that is at least twice the word's;
    ``root`` the end of the chain of forms. Null and empty texts and an empty table give no words; ``docs`` may have any
    other columns, which are not read.
    """
    words = materialise(word_counts(docs, key, text, least_length).where(F.col("n") >= least_count), "words")
    near = near_words(words)
    strong = -F.col("best.minus") >= 2 * F.col("n")
    out = materialise(words.join(near, "word", "left").select(
        "word", F.when(strong, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(strong, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@llm_query("op13_spelling_variants")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))
