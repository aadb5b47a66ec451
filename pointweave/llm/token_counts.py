"""Token counts by rank-synchronous array merging (operator 8).

Pre-tokens are held as one ragged numpy array of symbols. Each round finds the lowest-rank adjacent pair of every
sequence and merges all its places in all sequences at once; sequences without a pair leave. What counts is how many
symbols survive. Each distinct pre-token is merged once per task and its count remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts
from .registry import llm_query

#: The split of byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a task remembers before it starts anew.
REMEMBERED = 400_000
LIMIT = 512
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class ByteBpe:
    """Merges of one byte-level BPE file as sorted arrays."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))).split if self.specials else None
        self.known: dict[str, int] = {}

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that are left of each non-empty piece."""
        counts = np.zeros(len(pieces), np.int64)
        if not pieces:
            return counts
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        who = np.arange(len(pieces))
        while len(symbols):
            starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
            keys = np.empty(len(symbols), np.int64)
            keys[:-1] = symbols[:-1] * self.size + symbols[1:]
            keys[starts + lens - 1] = -1  # the last symbol of a sequence has no partner
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            ranks = np.where(self.keys[at] == keys, self.rank[at], _NONE)
            lowest = np.minimum.reduceat(ranks, starts)
            over = lowest == _NONE
            counts[who[over]] = lens[over]
            chosen = (ranks == np.repeat(lowest, lens)) & (ranks != _NONE)
            # in a run of the same symbol every other place merges, from the left
            index = np.arange(len(symbols))
            begins = chosen.copy()
            begins[1:] &= ~chosen[:-1]
            run = np.maximum.accumulate(np.where(begins, index, 0))
            chosen &= (index - run) % 2 == 0
            symbols[chosen] = self.made[ranks[chosen]]
            stay = np.repeat(~over, lens)
            stay[1:] &= ~chosen[:-1]
            merged = np.add.reduceat(chosen.astype(np.int64), starts)
            symbols, lens, who = symbols[stay], (lens - merged)[~over], who[~over]
        return counts

    def counts(self, docs: list[str]) -> list[int]:
        cut = [self.cut(t) if self.cut else [t] for t in docs]
        parts = [[p for s in segments for p in self.split(s)] for segments in cut]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*parts) - self.known.keys())
        self.known.update(zip(new, self.count([p.encode() for p in new]).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, p)) + len(s) - 1 for p, s in zip(parts, cut, strict=True)]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) for every row.

    ``path`` is a byte-level BPE file that every worker can read. A null or empty text has no bytes and no tokens.
    Repeated rows and null keys each keep their row; other columns are not read. A special token's string inside a text
    counts as one token. The running time of one very long pre-token grows with its length times its distinct merges.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in slices(batches, "t"):
            values = texts(part, "t")
            n_bytes = pa.compute.binary_length(values).cast(pa.int64())
            n = pa.array(bpe.counts(values.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, n, pa.compute.greater(n, limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("k", key)


@llm_query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
