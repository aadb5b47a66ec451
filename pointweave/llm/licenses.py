"""License scans by diagonal voting (operator 10).

All rolling word k-grams of every document are joined with the positions of the same k-grams in licence templates. A hit
at word ``i`` for template position ``p`` votes for the diagonal ``i - p``. Votes are counted per diagonal, diagonals at
most ``SHIFT`` words apart (small insertions and cuts) are merged. Merged diagonals that hold a part of the template and
follow each other in both the text and the template, at most ``GAP`` words apart, form one span, so that an added clause
or a long name does not split a licence; a span counts once the k-grams in it, now compared word by word, cover enough of
the template. The template side is a fixed table of this library, a few thousand
k-grams at most, and is broadcast. Base phrases are found in the same pass over the words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .license_texts import PHRASES, TEMPLATES
from .registry import llm_query

GRAM = 4
SHIFT = 4
#: Words that may stand between two parts of one span.
GAP = 100
#: Share of a template's k-grams that a part must hold to be joined or scored; less is a chance phrase.
PART = 0.1
#: Share of a template's k-grams that a span must hold.
COVERAGE = 0.6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams(spark: SparkSession, templates: dict[str, str] = TEMPLATES, gram: int = GRAM) -> DataFrame:
    """hash -> places (template, position, words of the k-gram, number of k-grams of the template)."""
    rows = []
    for label, text in templates.items():
        words = re.findall(WORD, text.lower())
        grams = [" ".join(words[i : i + gram]) for i in range(len(words) - gram + 1)]
        rows += [(label, i, g, len(grams)) for i, g in enumerate(grams)]
    t = spark.createDataFrame(rows, "label string, pos int, gram string, total int")
    return t.groupBy(F.xxhash64("gram").alias("gram_hash")).agg(F.collect_list(F.struct("label", "pos", "gram", "total")).alias("places"))


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; code points beyond ASCII keep their case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(f"({WORD})"), F.lit(1))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, gram: int = GRAM, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per document, one row per template span).

    Documents: key, n_words, n_base (places of base phrases), first_word, last_word (null without one), base_labels,
    labels (sorted, comma-joined, empty without any) and score: 1 with a base phrase, else the best coverage of a template, also
    below the bound that a label needs. Spans, at or above the bound: key,
    text_key (hash of the text), label, first_word, last_word, coverage. A null or empty text has no words; repeated rows
    and null keys each keep their row; other columns are not read; an empty table gives empty results.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tk"), words_of(F.col(text)).alias("w"))
    d = d.withColumn("n_words", F.size("w")).withColumn("i", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)))
    at = lambda j: F.get("w", F.col("i") + j)
    base = F.lit(None).cast("string")
    for phrase, label in PHRASES.items():
        first, *rest = phrase.split(" ")
        whole = at(0) == first
        for j, word in enumerate(rest, 1):
            whole = whole & (at(j) == word)
        base = F.when(whole, F.lit(label)).otherwise(base)
    d = d.withColumn("base", F.when(F.col("i") >= 0, base))
    words = F.concat_ws(" ", *[at(j) for j in range(gram)])
    d = d.withColumn("gram_hash", F.when((F.col("i") >= 0) & (F.col("i") <= F.col("n_words") - gram), F.xxhash64(words)))
    hits = d.join(F.broadcast(template_grams(spark, templates, gram)), "gram_hash", "left").where("i < 0 OR base IS NOT NULL OR places IS NOT NULL")
    true_places = F.filter("places", lambda p: p["gram"] == words)
    events = materialise(hits.select("k", "tk", "n_words", "i", "base", F.when(F.col("places").isNotNull(), true_places).alias("places")), "licenses")

    votes = events.where("size(places) > 0").select("k", "tk", "i", F.explode("places").alias("p"))
    votes = votes.select("k", "tk", "i", "p.label", "p.pos", "p.total", (F.col("i") - F.col("p.pos")).alias("diagonal")).distinct()
    lines = votes.groupBy("k", "tk", "label", "total", "diagonal").agg(F.min("i").alias("low"), F.max("i").alias("high"), F.collect_set("pos").alias("seen"))
    order = Window.partitionBy("k", "tk", "label").orderBy("diagonal")
    lines = lines.withColumn("opens", (F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT).cast("int"))
    lines = lines.withColumn("span", F.sum(F.coalesce("opens", F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = lines.groupBy("k", "tk", "label", "total", "span").agg(
        F.min("low").alias("low"), (F.max("high") + gram - 1).alias("high"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"),
    ).drop("span").where(F.size("seen") >= PART * F.col("total"))
    # a wording that a template repeats also votes off its diagonal, so parts are ordered by their middle places
    parts = parts.withColumn("middle", F.expr("sort_array(seen)[size(seen) div 2]"))
    order = Window.partitionBy("k", "tk", "label").orderBy("low", "middle", "high")
    again = F.size(F.array_intersect("seen", F.lag("seen").over(order)))
    follows = (F.col("low") <= F.lag("high").over(order) + 1 + GAP) & (F.col("middle") > F.lag("middle").over(order)) & (2 * again < F.size("seen"))
    parts = parts.withColumn("opens", (~F.coalesce(follows, F.lit(False))).cast("int"))
    parts = parts.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    scored = parts.groupBy("k", "tk", "label", "total", "span").agg(
        F.min("low").alias("first_word"), F.max("high").alias("last_word"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"),
    ).select("k", "tk", "label", "first_word", "last_word", (F.size("seen") / F.col("total")).alias("coverage"))
    spans = scored.where(F.col("coverage") >= coverage)

    # a document's row -1 counts how often the row itself occurs
    per = events.groupBy("k", "tk", "n_words").agg(
        F.sum((F.col("i") < 0).cast("long")).alias("rows"), F.count("base").alias("n"),
        F.min(F.when(F.col("base").isNotNull(), F.col("i"))).alias("first_word"), F.max(F.when(F.col("base").isNotNull(), F.col("i"))).alias("last_word"),
        F.collect_set("base").alias("base_set"),
    )
    found = scored.groupBy("k", "tk").agg(F.collect_set(F.when(F.col("coverage") >= coverage, F.col("label"))).alias("more"), F.max("coverage").alias("best"))
    same = per["k"].eqNullSafe(found["k"]) & (per["tk"] == found["tk"])
    every = per.join(found, same, "left").select(
        per["k"].alias(key), F.col("n_words").cast("long").alias("n_words"), F.expr("n div rows").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_set"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base_set") > 0, 1.0).otherwise(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0))).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"),
    ).drop("copy")
    return every, spans.select(F.col("k").alias(key), F.col("tk").alias("text_key"), "label", "first_word", "last_word", "coverage")


@llm_query("op10_license_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))[0]
