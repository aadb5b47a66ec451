"""The corpus pipeline: quality rules, near-duplicate join, decontamination, mixing, token records.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet in the shared folder and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointweave.llm.common import materialise, table
from pointweave.llm.decontaminate import drop_leaks
from pointweave.llm.mixing import mix_documents
from pointweave.llm.ngram_join import keep_one
from pointweave.llm.quality import keep_good
from pointweave.llm.records import write_mixed

STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_documents),
    ("token records", write_mixed),
]

#: The stages fingerprint, schedule and tokenise; SQL cannot express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
