"""Token ids as length-delimited binary records with a separate offset index (operator 7).

A record file holds frames: length (8 bytes, little endian), masked checksum of the length (4), payload, masked
checksum of the payload (4). The payload is the document id (8 bytes, signed), a flag byte (1: the id is null), the
width of an id in bytes (2 or 4) and the ids. The checksum is CRC-32, rotated right by 15 bits plus a constant, so that
a checksum of data that holds checksums stays meaningful. The index file has 24 bytes a record: offset, frame length,
number of ids. Documents are range-partitioned by id, or by an order of the caller; file ``n`` holds range ``n`` in ascending
order.

Files are written through pyarrow's file systems (local paths, hdfs, s3, gs by URI) under a name of the attempt and
moved when complete, so a repeated or speculative task leaves the same file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, codes, materialise, shared_folder, slices, table, texts, words
from .registry import llm_query

END_ID = 1
#: Pieces that a worker remembers before it starts anew, and the bytes they may take (about 30 each).
REMEMBERED = 800_000
REMEMBERED_BYTES = 40_000_000
#: Pieces that the library encodes at a time: what it returns takes many times the ids.
LIBRARY_PIECES = 4096
READ_BYTES = 4_000_000
#: Text bytes that are encoded at a time.
ENCODE_BYTES = 5_000_000
_MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return head + masked(head).to_bytes(4, "little") + payload + masked(payload).to_bytes(4, "little")


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """(payload, offset of the next frame); raises ValueError on a damaged frame."""
    head = data[at : at + 8]
    if len(head) < 8 or masked(head) != int.from_bytes(data[at + 8 : at + 12], "little"):
        raise ValueError(f"damaged length at {at}")
    n = int.from_bytes(head, "little")
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or masked(payload) != int.from_bytes(data[at + 12 + n : at + 16 + n], "little"):
        raise ValueError(f"damaged record at {at}")
    return payload, at + 16 + n


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return (doc_id or 0).to_bytes(8, "little", signed=True) + bytes([doc_id is None, width]) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id = None if payload[8] else int.from_bytes(payload[:8], "little", signed=True)
    return doc_id, np.frombuffer(payload[10:], f"<u{payload[9]}").astype("<u4")


#: A word of ASCII letters with marks after it, which the vocabulary's split always takes apart there.
_PLAIN = r"^(?P<stem>[A-Za-z]+)(?P<marks>[.,;:!?#$%&*|]*)$"


class WordEncoder:
    """Ids of whole texts from the library's ids of their pieces.

    The vocabulary's own rules never join text across ASCII white space, nor ASCII letters with the marks after them, and
    lower-case every letter. So each distinct piece goes through the library once; pieces and ids stay in flat arrays.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([""])
        self.first, self.pool = np.zeros(2, np.int64), np.empty(0, np.uint32)

    def remembered_bytes(self) -> int:
        return self.known.nbytes + self.first.nbytes + self.pool.nbytes

    def places(self, names: pa.Array) -> np.ndarray:
        """Number of each piece; new pieces go through the library."""
        found = pc.index_in(names, value_set=self.known)
        if found.null_count:
            new = pc.unique(names.filter(found.is_null()))
            found = pc.coalesce(found, pc.add(pc.index_in(names, value_set=new), len(self.known)))
            sizes, pools = [], []
            for start in range(0, len(new), LIBRARY_PIECES):
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(new.slice(start, LIBRARY_PIECES).to_pylist(), add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                pools.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
            self.known = pa.concat_arrays([self.known, new])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])
            self.pool = np.concatenate([self.pool, *pools])
        return found.to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets per text, all ids in order)."""
        offsets, flat = words(values)
        index, distinct = codes(flat)
        plain = pc.extract_regex(distinct, _PLAIN)
        stem, marks = codes(pc.coalesce(pc.ascii_lower(pc.struct_field(plain, "stem")), distinct)), codes(pc.coalesce(pc.struct_field(plain, "marks"), ""))
        places = self.places(pa.concat_arrays([stem[1], marks[1]]))
        pieces = np.empty(2 * len(index), np.int64)
        pieces[::2] = places[: len(stem[1])][stem[0]][index]
        pieces[1::2] = places[len(stem[1]) :][marks[0]][index]
        start = self.first[pieces]
        size = self.first[pieces + 1] - start
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        if len(self.known) > REMEMBERED or self.remembered_bytes() > REMEMBERED_BYTES:
            self.forget()
        return ends[2 * offsets], ids


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", files: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Write ``docs`` to record and index files under ``folder``; return the manifest (part, file, records, tokens).

    ``key`` must be an integer. Rows go in ascending order of the columns ``order``; without it of key, null keys first, equal
    keys by the hash of their text.
    A null or empty text gives a record of the end id alone; repeated rows give repeated records; an empty table no files. Other
    columns are not read. ``files`` defaults to the session's shuffle partitions.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, (fs, top) = encoder(vocabulary), file_system(folder)
        name, attempt = f"part-{part:06d}", uuid.uuid4().hex
        place = lambda kind, own="": f"{top}/{name}{own}.{kind}"
        at = records = tokens = 0
        out = index = None
        for piece in slices(batches, "t", ENCODE_BYTES):
            if out is None:
                fs.create_dir(top, recursive=True)
                out, index = fs.open_output_stream(place("rec", f"-{attempt}")), fs.open_output_stream(place("idx", f"-{attempt}"))
            offsets, ids = enc.encode(texts(piece, "t"))
            frames, entries = [], np.empty((piece.num_rows, 3), "<u8")
            for i, doc_id in enumerate(piece.column(0).to_pylist()):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id))
                f = frame(pack(doc_id, own, enc.width))
                entries[i] = at, len(f), len(own)
                at, records, tokens = at + len(f), records + 1, tokens + len(own)
                frames.append(f)
            out.write(b"".join(frames))
            index.write(entries.tobytes())
            pa.default_memory_pool().release_unused()  # else a worker keeps the most that a step took, beside the executor's JVM
        if out is not None:
            for stream, kind in ((out, "rec"), (index, "idx")):
                stream.close()
                fs.move(place(kind, f"-{attempt}"), place(kind))
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "records": [records], "tokens": [tokens]})

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"), *[c.alias(f"o{i}") for i, c in enumerate(order or [])])
    # the hash spreads rows that share a key, and keeps texts out of the range sample
    by = [f"o{i}" for i in range(len(order))] if order else [F.col("k").asc_nulls_first(), "h"]
    ranged = rows.repartitionByRange(files, *by).sortWithinPartitions(*by)
    with bounded_batches(spark):
        ranged.mapInArrow(run, "part long, file string, records long, tokens long").write.parquet(f"{folder}/manifest")
    return spark.read.schema("part long, file string, records long, tokens long").parquet(f"{folder}/manifest")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, offset) of every record, read back from the files.

    Each file is read by its index in ranges of about ``READ_BYTES`` bytes and every checksum is verified. ``start`` is
    the number of ids before the record in the order of the files. The manifest has one row per file.
    """
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("start", F.coalesce(before, F.lit(0))).select("part", "file", "start")
    spark = manifest.sparkSession
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        for batch in batches:
            for part, file, start in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "start")), strict=True):
                with fs.open_input_stream(f"{top}/{file}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 3).astype(np.int64)
                with fs.open_input_file(f"{top}/{file}.rec") as data:
                    i = 0
                    while i < len(index):
                        j = max(i + 1, int(np.searchsorted(index[:, 0] + index[:, 1], index[i, 0] + READ_BYTES, side="right")))
                        base = int(index[i, 0])
                        block = memoryview(data.read_at(int(index[j - 1, 0] + index[j - 1, 1]) - base, base))
                        rows = []
                        for offset, _, n in index[i:j].tolist():
                            doc_id, ids = unpack(unframe(block, offset - base)[0])
                            if len(ids) != n:
                                raise ValueError(f"{file}: the index says {n} ids, the record has {len(ids)}")
                            rows.append((doc_id, start, n, zlib.crc32(ids.tobytes()), part, offset))
                            start += n
                        kinds = [pa.int64()] * 6
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "part", "offset"])
                        i = j

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part long, offset long")


def fetch(folder: str, file: str, numbers: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records ``numbers`` of one file in any order, by the index: what a shuffled reader does."""
    fs, top = file_system(folder)
    with fs.open_input_file(f"{top}/{file}.idx") as index, fs.open_input_file(f"{top}/{file}.rec") as data:
        for n in numbers:
            offset, size, _ = np.frombuffer(index.read_at(24, 24 * n), "<u8").tolist()
            yield unpack(unframe(memoryview(data.read_at(size, offset)), 0)[0])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_and_read(spark: SparkSession, docs: DataFrame, folder: str = "") -> DataFrame:
    """Pipeline stage: write all documents to a new folder of the shared storage and return what the files say."""
    out = shared_folder(spark, "records")
    manifest = write_records(docs, out, vocabulary())
    return read_records(manifest, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def as_stored(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` and the columns that order it as its Parquet files do: number and name of the file, row in the file.

    A table that does not come from files is written first, so its partitions and their rows are the order.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = materialise(docs, "ordered")
    name = F.col("_metadata.file_name")
    return docs, [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]


def write_mixed(spark: SparkSession, docs: DataFrame, folder: str = "") -> DataFrame:
    """Pipeline stage: as ``write_and_read``, but the records stay in the order of the mixed documents."""
    docs, order = as_stored(docs)
    out = shared_folder(spark, "records")
    manifest = write_records(docs, out, vocabulary(), order=order)
    return read_records(manifest, out).select("doc_id", "start", "n_tokens", "ids_crc32")


@llm_query("op7_token_records")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return write_and_read(spark, table(spark, folder, "documents"))
