"""A corpus from documents to tokens: each stage works on what the one before it kept.

Nulls, empty texts, repeated rows and further columns of any name are each stage's own, as its module says: null texts count as empty ones, null and
repeated ids are rows of their own, and all columns of the documents stay until the last stage, which gives ids and decoded texts. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chunkwell.llm.bpe import bpe_stage
from chunkwell.llm.common import delete, shared_dir
from chunkwell.llm.line_dedup import line_dedup_stage
from chunkwell.llm.mixing import mix_stage
from chunkwell.llm.simhash_dedup import simhash_stage
from chunkwell.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: toxicity_stage(spark, docs, sf_dir)),
    ("line_dedup", lambda spark, docs, sf_dir: line_dedup_stage(spark, docs, sf_dir)),
    ("simhash_dedup", lambda spark, docs, sf_dir: simhash_stage(spark, docs, sf_dir)),
    ("mixing", lambda spark, docs, sf_dir: mix_stage(spark, docs, sf_dir)),
    ("bpe", lambda spark, docs, sf_dir: bpe_stage(spark, docs, sf_dir)),
]
#: Hashed models, XXH64 and merges are not in SQL's reach; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder as Parquet and read again. What no later stage reads is deleted."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{folder}/{i}-{name}.parquet"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
    return docs
