"""Benchmark decontamination by SimHash windows (operator 4); DataFrame functions only.

A document leaks an item if one of its item-sized windows has a weighted Jaccard similarity of ``PERCENT`` or more with
it: five-word shingles, each weighted by how often it occurs. A window without a shingle of the benchmark has similarity
0, so windows are laid where such a shingle stands in its item. Windows and items get ``SEEDS`` fingerprints: 64 bits,
each the majority of that bit over the hashes of the shingles. At a similarity of 0.8 two fingerprints differ in about
64 acos(0.889) / pi = 9.7 bits; ``RADIUS`` is two deviations more, and one fingerprint of ``SEEDS`` within it will do.
Fingerprints are cut into blocks of bits, of which two within ``RADIUS`` agree in one but for ``FLIPS`` bits: items are
entered with every such change, so a window asks its own blocks and no pair within ``RADIUS`` is lost. Of the documents
and items found, all windows that hold enough shingles are compared exactly.

The benchmark side is broadcast when its shingles have been counted and are few; otherwise the join shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .registry import llm_query

SHINGLE, PERCENT, RADIUS, FLIPS, SEEDS = 5, 80, 15, 3, 3
#: Distinct benchmark shingles up to which they are broadcast (about 100 bytes each).
BROADCAST_SHINGLES = 200_000
#: Documents with windows up to which their hashes are broadcast (a number each).
BROADCAST_KEYS = 2_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null and blank texts have none."""
    low = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(_BLANK))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, r"[\x20\x09-\x0D]+"))


def hash_at(i: Column, n: int, w: str = "w") -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(n)])


def fingerprints(rows: DataFrame, key: str, features: Column | None = None, seeds: int = 1) -> DataFrame:
    """(key, seed, fp) from an array of ``features``, else a column of blank-separated words: 32 sums carry the counts of bits j and j + 32."""
    each = rows.select(key, F.explode(F.split("words", " ") if features is None else features).alias("word"))
    hashes = [F.struct(F.lit(i).alias("seed"), (F.xxhash64(F.lit(i), "word") if i else F.xxhash64("word")).alias("h")) for i in range(seeds)]
    h = each.select(key, F.inline(F.array(*hashes)))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"s{j}") for j in range(32)]
    counted = h.groupBy(key, "seed").agg(F.count("*").alias("n"), *sums)

    def bit(j: int) -> Column:
        field = F.col(f"s{j}").bitwiseAND(F.lit((1 << 32) - 1)) if j < 32 else F.shiftrightunsigned(f"s{j - 32}", 32)
        return F.when(2 * field > F.col("n"), F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))

    return counted.select(key, "seed", reduce(lambda a, b: a.bitwiseOR(b), [bit(j) for j in range(64)]).alias("fp"))


def blocks(fp: DataFrame, radius: int, near: int = 0, flip: bool = False) -> DataFrame:
    """A row for each block of bits, as even as 64 bits allow: two fingerprints within ``radius`` agree in one of them but for ``near`` bits.

    ``flip``: a row for every change of up to ``near`` bits of a block.
    """
    count = -(-(radius + 1) // (near + 1))
    cuts = [64 * b // count for b in range(count + 1)]
    each = [F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("fp", cuts[b]).bitwiseAND(F.lit((1 << (cuts[b + 1] - cuts[b])) - 1)).alias("bits")) for b in range(count)]
    out = fp.select("*", F.inline(F.array(*each)))
    if not flip:
        return out
    changes = fp.sparkSession.range(1 << -(-64 // count)).where(F.bit_count("id") <= near).select(F.col("id").alias("change"))
    return out.crossJoin(F.broadcast(changes)).withColumn("bits", F.col("bits").bitwiseXOR(F.col("change"))).drop("change")


def near_items(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(tid, iid): the windows (tid, words, unit) and items (iid, words, unit) of which a fingerprint over shingles lies within ``RADIUS``.

    Fingerprints are written before they meet: the driver then holds one plan with their sums at a time.
    """

    def marked(rows: DataFrame, key: str) -> DataFrame:
        rows = rows.select(key, "unit", F.split("words", " ").alias("w"))
        shingles = F.expr("transform(sequence(0, size(w) - unit), i -> array_join(slice(w, i + 1, unit), ' '))")
        return materialise(fingerprints(rows, key, shingles, SEEDS), "marks")

    left = blocks(marked(windows, "tid"), RADIUS, FLIPS)
    right = blocks(marked(items, "iid").withColumnRenamed("fp", "item_fp").withColumn("fp", F.col("item_fp")), RADIUS, FLIPS, flip=True).drop("fp")
    within = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    return left.join(right, ["seed", "block", "bits"]).where(within).select("tid", "iid").distinct()


#: Of the places ``hits`` (i: position, p: position of the place whose occurrence it would repeat beyond the item's weight) and
#: the window starts at which place ``j`` is the first inside: those with ``need`` places or more, and the shingles in common.
_LOW = "greatest(0, coalesce(get(hits, j - 1).i + 1, 0), get(hits, j + need - 1).i - a + 1)"
_HIGH = "least(get(hits, j).i, m - n_words)"
_COMMON = "size(filter(slice(hits, j + 1, a), x -> x.i < s + a AND x.p < s))"
_WINDOWS = f"transform(filter(sequence(0, size(hits) - need), j -> {_LOW} <= {_HIGH}), j -> transform(sequence({_LOW}, {_HIGH}), s -> struct({_COMMON} AS common, -s AS s)))"


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_key, item_id, start, n_words, similarity): the best window of each document for each item it leaks.

    ``items`` has item_id and text. Null and blank texts have no words and match nothing; items shorter than five words
    are one shingle. Items are told apart by their words; a null item_id is kept, and an item_id with several texts gives
    the best of them. ``text_key`` is the hash of the text, which tells rows with one key apart; equal rows give one row.
    A null key is kept. Other columns are not read. Empty tables give no rows. ``similarity`` is in whole thousandths.
    """
    named = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    named = materialise(named.select("item_id", F.array_join("w", " ").alias("words"), F.size("w").alias("n")).distinct(), "items")
    own = named.select("words", "n").distinct().select("*", F.least(F.col("n"), F.lit(SHINGLE)).alias("unit"), F.monotonically_increasing_id().alias("iid"))
    own = materialise(own, "items")
    lengths = sorted(r["unit"] for r in own.select("unit").distinct().collect())  # at most five numbers
    d = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), words_of(F.col(text)).alias("w")).withColumn("m", F.size("w"))
    found = []
    for unit in lengths:
        shingle = lambda i, unit=unit: F.array_join(F.slice("w", F.col(i) + 1, unit), " ")
        mine = own.where(F.col("unit") == unit).withColumn("w", F.split("words", " ")).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("n") - unit)))
        places = mine.select("iid", "n", "unit", "offset", hash_at(F.col("offset"), unit).alias("h"), shingle("offset").alias("shingle"))
        places = materialise(places.groupBy("iid", "n", "unit", "h", "shingle").agg(F.min("offset").alias("place"), F.count("*").cast("int").alias("weight")), "places")
        at = d.where(F.col("m") >= unit).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - unit))).withColumn("h", hash_at(F.col("i"), unit))
        if places.count() <= BROADCAST_SHINGLES:
            hit = at.join(F.broadcast(places), "h").where(shingle("i") == F.col("shingle"))
        else:  # five words a row go through the shuffle, not the text
            hit = at.select("k", "text_key", "m", "i", "h", shingle("i").alias("shingle")).join(places, ["h", "shingle"])
        found.append(hit.select("k", "text_key", "m", "iid", "n", "unit", F.struct("place", "weight", "i").alias("hit")))
    if not found:
        return docs.sparkSession.createDataFrame([], f"{key} {dict(docs.dtypes)[key]}, text_key long, item_id long, start int, n_words int, similarity long")
    pair = ["k", "text_key", "iid", "m", "n_words", "a", "b", "need"]
    hits = reduce(DataFrame.unionByName, found).groupBy("k", "text_key", "m", "iid", "n", "unit").agg(F.collect_set("hit").alias("hits"))
    hits = hits.withColumn("n_words", F.least("n", "m")).withColumn("a", F.col("n_words") - F.col("unit") + 1).withColumn("b", F.col("n") - F.col("unit") + 1)
    hits = hits.withColumn("need", F.ceil(percent * (F.col("a") + F.col("b")) / (100 + percent)).cast("int") if percent else F.lit(1))
    touched = materialise(hits.select(*pair, "unit", "hits"), "pairs")

    laid = F.explode(F.array_distinct(F.expr("transform(hits, x -> greatest(0, least(x.i - x.place, m - n_words)))"))).alias("start")
    starts = touched.select("k", "text_key", "unit", "n_words", laid).groupBy("k", "text_key").agg(F.collect_set(F.struct("unit", "n_words", "start")).alias("windows"))
    starts = materialise(starts.withColumnsRenamed({"k": "_k", "text_key": "_text_key"}), "starts")
    if starts.count() <= BROADCAST_KEYS:  # texts without a shingle of the benchmark stay out of the shuffle
        d = d.join(F.broadcast(starts.select(F.col("_text_key").alias("text_key")).distinct()), "text_key", "left_semi")
    cut = d.join(starts, F.col("k").eqNullSafe(F.col("_k")) & (F.col("text_key") == F.col("_text_key"))).select("k", "text_key", "w", F.inline("windows"))
    cut = cut.select("k", "text_key", "unit", F.array_join(F.slice("w", F.col("start") + 1, F.col("n_words")), " ").alias("words"))
    windows = materialise(cut.withColumn("tid", F.sha2(F.concat_ws(" ", "unit", "words"), 256)).distinct(), "windows")
    near = near_items(windows.select("tid", "unit", "words").distinct(), own).join(windows.select("k", "text_key", "tid"), "tid")
    near = near.select(F.col("k").alias("_k"), F.col("text_key").alias("_text_key"), F.col("iid").alias("_iid")).distinct()
    same = F.col("k").eqNullSafe(F.col("_k")) & (F.col("text_key") == F.col("_text_key")) & (F.col("iid") == F.col("_iid"))
    pairs = materialise(touched.join(near, same, "left_semi").where(F.size("hits") >= F.col("need")).select(*pair, "hits"), "pairs")

    # a place counts in a window if the one that holds the same shingle ``weight`` occurrences earlier is outside
    each = pairs.select(*pair, F.inline("hits")).groupBy(*pair, "place", "weight").agg(F.sort_array(F.collect_list("i")).alias("at"))
    each = each.select(*pair, F.expr("transform(at, (x, r) -> struct(x AS i, coalesce(get(at, r - weight), -1) AS p))").alias("hits"))
    each = each.groupBy(*pair).agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    best = each.select(*pair, F.array_max(F.flatten(F.expr(_WINDOWS))).alias("best")).where(100 * F.col("best.common") >= percent * (F.col("a") + F.col("b") - F.col("best.common")))
    best = best.select("k", "text_key", "iid", F.struct(F.expr("1000L * best.common div (a + b - best.common)").alias("similarity"), F.col("best.s").alias("s"), "n_words").alias("best"))
    best = best.join(named.join(own, "words").select("iid", "item_id"), "iid").groupBy("k", "text_key", "item_id").agg(F.max("best").alias("best"))
    return best.select(F.col("k").alias(key), "text_key", "item_id", (-F.col("best.s")).alias("start"), "best.n_words", "best.similarity")


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the documents without a benchmark passage, with their own columns."""
    names = docs.columns
    leaks = find_leaks(docs, table(spark, folder, "benchmark"))
    own = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63))).alias("id")
    bad = leaks.select(own("doc_id"), "text_key").distinct()
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    inner = inner.select("*", own(f"c{names.index('doc_id')}"), F.xxhash64(F.coalesce(F.col(f"c{names.index('text')}"), F.lit(""))).alias("text_key"))
    return inner.join(bad, ["id", "text_key"], "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


@llm_query("op4_simhash_decontamination")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_key")
