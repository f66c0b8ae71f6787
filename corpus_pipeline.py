"""A corpus pipeline: language ID, exact dedup, near dedup, decontamination, mixing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that keeps the columns
of ``docs``; the last one returns every row once per copy with its copy number.
``run`` writes each stage's rows as Parquet in the shared folder, reads them again
for the next stage, and deletes what the next stage has replaced.

Defined results
    null or empty text   has no language and goes in the first stage
    null doc_id          kept like any other row; of exact or near copies, rows with an id are kept first
    null lang            not learned from; null in other columns is kept as it is
    very long text       processed whole by every stage
    ties                 the smallest doc_id, then the smallest text, stays
    repeated rows        one of them stays, also where a doc_id repeats; another text of the same id is a document of its own
    empty tables         no documents: an empty result; no benchmark items: nothing is contaminated; no labelled
                         rows: the language stage keeps everything
    extra columns        kept, whatever their names; the copy number is called mix_copy_no if copy_no is taken
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import decontaminate, exact_dedup, langid, mixing, simhash
from meridia.llm.common import table
from meridia.sources.storage import remove, shared_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("source_mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs


#: The language stage applies a trained network and the near-duplicate stage finds
#: connected components, which SQL doesn't express; tests hold both to brute force.
ORACLE_SQL = None
