"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of docs. run() writes
each stage's rows as Parquet to the shared folder and reads them again, so a lost executor costs a part of one stage.

Rows that no stage judges stay: those with a null doc_id are in no near-duplicate group, and a table without any language
label has no model to reject by, so all of its documents go on. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, language_id, ngram_join, packing, secrets
from pagemill.llm._work import SEND_LIMIT, Scratch

#: SQL can't train the classifier of the first stage; tests/llm checks every stage against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told with enough confidence go."""
    model = language_id.fit(docs)
    return language_id.keep_identified(docs, model) if model.languages != [""] else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that n-gram Jaccard pairs connect the document with the least doc_id stays; rows that share a doc_id stay or go together."""
    extra = Scratch(spark, "near-duplicates").keep(ngram_join.links(docs).where("doc_id <> class_id").select("doc_id"), "extra")
    if extra.count() * 48 <= SEND_LIMIT:  # so long as their ids may be sent, no text is shuffled
        extra = F.broadcast(extra)
    return docs.join(extra, "doc_id", "left_anti").select(docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mark takes the place of each confirmed secret; all documents stay."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in a batch of its length bucket."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
