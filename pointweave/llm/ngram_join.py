"""N-gram Jaccard join with adaptive multi-match prefixes (operator 6).

A document is the set of its distinct ``k``-word shingles; equal sets are one class, represented by its smallest id.
Shingles are ordered by a bound on how many documents hold them, rare first: the count of their rarest word, from a count
sketch over the words of all documents (fixed size, never too low). If two sets have Jaccard similarity of at least
``percent`` / 100, their prefixes of ``n - ceil(percent n / 100) + l`` shingles share at least ``l``. Each document picks
the ``l`` that makes its estimated candidate cost least: prefixes in crowded lists grow and demand more shared shingles
before a pair is looked at.

Pairs are not listed group by group. First each document meets, in bounded chunks, those that share its most crowded
prefix shingle; exact links there (a spanning forest of them) give first components. After that only prefix lists that
still hold several components are searched in full: pairs of different components that share enough prefix shingles and
whose bitmaps do not rule the overlap out are compared exactly. A pair inside one component needs no link of its own, so
no group is expanded into its pairs and none is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bounded_batches, codes, components, materialise, shingle_sets, slices, table, texts, word_hashes, words
from .registry import llm_query

#: Counters of the word sketch (4 bytes each): what is broadcast, whatever the input.
SKETCH_BITS = 22
CHUNKS = 64
MAX_MATCH = 4
#: Cost of looking at one candidate pair, in list entries read.
PAIR_COST = 20
#: Documents that are compared all against all at once; longer lists are cut and the cuts meet pairwise.
CHUNK, CHUNK_BYTES, BLOCK = 512, 4_000_000, 1024
#: Lists up to this length are joined pair by pair without their sets' bitmaps.
SHORT = 64
NO_ID = -(1 << 63)


def _lowered(batch: pa.RecordBatch) -> pa.Array:
    return pa.compute.ascii_lower(texts(batch, "t"))


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    import xxhash

    low = int.from_bytes(xxhash.xxh3_128_digest(shingles.tobytes()), "big")
    return (low >> 64) - (1 << 63), (low & ((1 << 64) - 1)) - (1 << 63)


def word_sketch(rows: DataFrame) -> np.ndarray:
    """Occurrences of all words in ``2**SKETCH_BITS`` counters: added up per task, then per chunk of counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for part in slices(batches, "t"):
            index, distinct = codes(words(_lowered(part))[1])
            np.add.at(sketch, _buckets(word_hashes(distinct)), np.bincount(index, minlength=len(distinct)).astype(np.uint32))
        pieces = [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(np.split(sketch, CHUNKS)) if p.any()]
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int32()), pa.array([b for _, b in pieces], pa.binary())], ["chunk", "counts"])

    def add(frame):
        total = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64) for c in frame["counts"])
        frame = frame.iloc[:1][["chunk"]].copy()
        frame["counts"] = [zlib.compress(np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes(), 1)]
        return frame

    sketch = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.uint32)
    parts = rows.mapInArrow(count, "chunk int, counts binary")
    with bounded_batches(rows.sparkSession):
        summed = parts.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()
    for r in summed:
        sketch[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return sketch.reshape(-1)


def prefix_of(shingles: np.ndarray, crowd: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """(l, prefix) of least estimated cost, from sorted shingles and the bounds on their lists; the smallest such l."""
    n = len(shingles)
    plain = n - -(-percent * n // 100)
    order = np.argsort(crowd, kind="stable")[: plain + MAX_MATCH]
    read = np.cumsum(crowd[order].astype(np.int64) - 1)
    best, least = 1, None
    for match in range(1, min(MAX_MATCH, n - plain) + 1):
        entries = read[plain + match - 1]
        cost = entries + PAIR_COST * entries / match
        if least is None or cost < least:
            best, least = match, cost
    return best, shingles[order[: plain + best]]


def prefixes(rows: DataFrame, k: int, percent: int, shared: Broadcast) -> DataFrame:
    """(id, d1, d2, n, match, prefix) of every row: number of shingles, digest of the set, and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            out = []
            for i, (s, crowd) in zip(part.column(0).to_pylist(), shingle_sets(_lowered(part), k, lambda h: shared.value[_buckets(h)]), strict=True):
                match, prefix = prefix_of(s, crowd, percent) if len(s) else (1, s)
                out.append((i, *_digest(s), len(s), match, prefix.view(np.int64)))
            cols = list(zip(*out, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in cols[5]])]), pa.int32()), pa.array(np.concatenate(cols[5])))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.int32()), lists], ["id", "d1", "d2", "n", "match", "prefix"])

    return rows.mapInArrow(run, "id long, d1 long, d2 long, n long, match int, prefix array<long>")


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit per shingle in a power of two of bits, eight times the set's size or more."""
    size = max(64, 1 << int(np.ceil(np.log2(8 * len(shingles)))))
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray, words_: int) -> np.ndarray:
    while len(bits) > words_:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def full_sets(rows: DataFrame, k: int) -> DataFrame:
    """The given columns but the text ``t``, and (n, shingles, bits) of every row with a shingle."""
    kept = [c for c in rows.columns if c != "t"]
    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("shingles", T.BinaryType()), ("bits", T.BinaryType()))]])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            sets = [s for s, _ in shingle_sets(_lowered(part), k)]
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary())]
            columns = [*[part.column(c) for c in kept], *made]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return rows.select(*kept, "t").mapInArrow(run, schema).where("n > 0")


def runs_of(batches: Iterator[pa.RecordBatch], key: int, most: int, room: int) -> Iterator[list[tuple]]:
    """Rows of sorted Arrow batches, cut where the first ``key`` columns change, after ``most`` rows, or when the last
    column's values would exceed ``room`` bytes."""
    group, held = [], 0
    for whole in batches:
        for batch in slices(iter([whole]), whole.schema.names[-1]):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (row[:key] != group[0][:key] or len(group) >= most or held + len(row[-1]) > room):
                    yield group
                    group, held = [], 0
                group.append(row)
                held += len(row[-1])
    if group:
        yield group


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a chunk of sets."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    total = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((m, width), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        total += block @ block.T
    return np.rint(total).astype(np.int64)


def linked(inter, n_a, n_b, percent: int):
    return 100 * inter >= percent * (n_a + n_b - inter)


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def dealt(rows: DataFrame, order: str, turn: int) -> DataFrame:
    """Rows of a list with their salt and place in it: by ``order`` ``n``, else shuffled; another turn deals anew."""
    mixed = F.xxhash64("id", F.lit(turn))
    place = F.col("n") if order == "n" else mixed
    return rows.withColumn("salt", 2 * F.pmod(mixed, F.expr(f"members div {4 * CHUNK} + 1")) + turn).withColumn("place", place)


def open_lists(live: DataFrame, links: DataFrame) -> DataFrame:
    """List entries with their component, of the lists that hold more than one component."""
    known = components(links, "a", "b").withColumnRenamed("node", "id")
    rows = live.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token")
    return rows.join(mixed, "token")


def forest(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links inside each chunk of rows (token, salt, place, id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, 2, CHUNK, CHUNK_BYTES):
            if len(group) < 2:
                continue
            sets = [np.frombuffer(r[4], np.uint64) for r in group]
            n = np.array([len(s) for s in sets])
            inter = overlaps(sets)
            parent, edges = list(range(len(group))), []
            for i, j in np.argwhere(np.triu(linked(inter, n[:, None], n[None, :], percent), 1)).tolist():
                a, b = _root(parent, i), _root(parent, j)
                if a != b:
                    parent[a] = b
                    edges.append((group[i][3], group[j][3]))
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sorted_rows = rows.select("token", "salt", "place", "id", "shingles").repartition("token", "salt").sortWithinPartitions("token", "salt", "place", "id")
    return sorted_rows.mapInArrow(run, "a long, b long")


def open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that may link, once each, from rows of the lists that hold several components.

    Columns: token, low, high (blocks that meet), block, n, id, component, match, live (prefix shingles in shared lists), bits.
    """

    def candidates(group: list[tuple]) -> Iterator[tuple[int, int]]:
        token, low, high = group[0][:3]
        block, n = np.array([r[3] for r in group]), np.array([r[4] for r in group])
        component, match = np.array([r[6] for r in group]), [r[7] for r in group]
        live = [np.array(r[8], np.int64) for r in group]
        bits = [np.frombuffer(r[9], np.uint64) for r in group]
        width = [len(b) for b in bits]
        folded, row_of = {}, np.zeros(len(group), np.int64)
        # a partner is no smaller, so its bitmap is at least as wide and folds to the same width
        ends = np.searchsorted(n, 100 * n // percent, side="right")
        for i in range(len(group)):
            js = np.arange(i + 1, ends[i])
            js = js[(component[js] != component[i]) & ((block[js] != block[i]) | (low == high))]
            if not len(js):
                continue
            total = n[i] + n[js]
            apart = total - 2 * -(-percent * total // (100 + percent))
            w = width[i]
            if w not in folded:
                own = [j for j in range(len(group)) if w <= width[j]]
                row_of[own] = np.arange(len(own))
                folded = {w: (np.array([fold(bits[j], w) for j in own]), row_of.copy())}
            rows_, at = folded[w]
            js = js[np.bitwise_count(rows_[at[js]] ^ rows_[at[i]]).sum(axis=1) <= apart]
            for j in js.tolist():
                both = np.intersect1d(live[i], live[j], assume_unique=True)
                if len(both) >= min(match[i], match[j]) and both[0] == token:
                    yield group[i][5], group[j][5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, 3, 1 << 62, 1 << 62):
            found = list(candidates(group)) if len(group) > 1 else []
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    names = ["token", "low", "high", "block", "n", "id", "component", "match", "live", "bits"]
    sorted_rows = rows.select(*names).repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "id")
    return sorted_rows.mapInArrow(run, "a long, b long")


def short_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that may link, from the lists of at most ``SHORT`` entries.

    A pair counts the short lists it shares; what it might share beyond them is at most what either document has in long ones.
    """
    long = rest.where(F.col("members") > SHORT).groupBy("id").agg(F.count("*").alias("beyond"))
    short = rest.where(F.col("members") <= SHORT).select("token", "id", "n", "match", "component")
    x, y = short, short.select("token", *[F.col(c).alias(f"{c}_") for c in ("id", "n", "match", "component")])
    near = (F.col("n") <= F.col("n_")) & (100 * F.col("n") >= percent * F.col("n_")) & ((F.col("n") < F.col("n_")) | (F.col("id") < F.col("id_")))
    met = x.join(y, "token").where(near & (F.col("id") != F.col("id_")) & (F.col("component") != F.col("component_")))
    counted = met.groupBy(F.col("id").alias("a"), F.col("id_").alias("b"), F.least("match", "match_").alias("asked")).agg(F.count("*").alias("shared"))
    for c in ("a", "b"):
        counted = counted.join(long.select(F.col("id").alias(c), F.col("beyond").alias(f"beyond_{c}")), c, "left")
    beyond = F.least(F.coalesce("beyond_a", F.lit(0)), F.coalesce("beyond_b", F.lit(0)))
    return counted.where(F.col("shared") + beyond >= F.col("asked")).select("a", "b")


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "x"):
            keep = []
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(bool(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (smallest key reachable by links) for every row.

    Texts are lower-cased (A-Z) and cut at ASCII white space. Fewer than ``k`` words make one shingle; no words or a null
    text make none and link with nothing. ``key`` is an integer; rows that share a key count as one document for links;
    a null key sorts before all others and shows as null. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("t"))
    sketch = rows.sparkSession.sparkContext.broadcast(word_sketch(rows))
    described = materialise(prefixes(rows, k, percent, sketch), "describe")
    sketch.destroy()
    every = described.select("id", "n", "d1", "d2")
    classes = materialise(every.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("node")), "classes")

    lists = described.where("n > 0").join(classes.withColumnRenamed("node", "id"), ["d1", "d2", "id"], "left_semi").dropDuplicates(["d1", "d2", "id"])
    # a list entry stays if the next smaller or larger set of its list is near enough in size to link
    of_token = Window.partitionBy("token")
    by_size = of_token.orderBy("n")
    live = lists.select("id", "n", "match", F.explode("prefix").alias("token"))
    live = live.withColumns({"members": F.count("*").over(of_token), "asked": F.min("match").over(of_token), "less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
    live = live.where((100 * F.col("less") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("more"))).drop("less", "more")
    live = materialise(live, "live")
    # a document that shares fewer prefix shingles than any partner in its lists could ask for links with nothing
    lure = F.col("members") * (1 + F.pmod(F.xxhash64("token"), F.lit(1000)) / 1000)
    place = F.struct("members", "token")
    per = live.groupBy("id").agg(F.max(place).alias("top"), F.max_by(place, lure).alias("other"), F.sort_array(F.collect_set("token")).alias("live"), F.least(F.min("match"), F.min("asked")).alias("asked"))
    chosen = materialise(per.where("size(live) >= asked").select("id", "top", "other", "live"), "chosen")
    live = live.join(chosen.select("id"), "id", "left_semi").drop("asked")
    sets = materialise(full_sets(rows.join(chosen, "id"), k), "sets")
    # two looks: in the longest list by size, and shuffled in another list, which joins what chunks had kept apart
    looks = [dealt(sets.select("id", "n", "shingles", f"{c}.*"), order, turn) for turn, (c, order) in enumerate((("top", "n"), ("other", "turn")))]
    links = materialise(forest(looks[0].unionByName(looks[1]), percent), "links")
    rest = materialise(open_lists(live, links), "rest")
    long = rest.where(F.col("members") > SHORT).join(sets.select("id", "live", F.col("n").alias("size"), "bits"), "id").where("n = size").drop("size")
    long = long.withColumn("blocks", F.expr(f"members div {BLOCK} + 1")).withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    long = long.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    pairs = materialise(short_pairs(rest, percent).unionByName(open_pairs(long, percent)).distinct(), "pairs")
    second = exact_links(pairs, sets, percent)

    final = components(links.unionByName(second), "a", "b").withColumnRenamed("node", "n_")
    joined = every.join(classes, ["d1", "d2"], "left").withColumn("node", F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("id")))
    out = joined.join(final, joined["node"] == final["n_"], "left").select("id", "n", F.coalesce("component", "node").alias("component"))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(shown("id").alias(key), F.col("n").alias("n_shingles"), shown("component").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, folder: str, k: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays; texts without words stay, too.

    Rows that share an id go together; of rows equal in id and text one stays. A null id is an id like others here.
    """
    part = jaccard_components(docs.select("doc_id", "text"), k, percent)
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    own = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias("id")
    stay = part.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(own("doc_id")).distinct()
    inner = inner.select("*", own(f"c{names.index('doc_id')}"), F.xxhash64(f"c{names.index('text')}").alias("text_key"))
    kept = inner.join(stay, "id", "left_semi").dropDuplicates(["id", "text_key"])
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


#: The same components for DuckDB: all links by counting shared shingles, then everything reachable.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM (SELECT doc_id FROM documents) d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc AS doc_id, min(c) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""


@llm_query("op6_ngram_join", ORACLE)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))
