"""From raw documents to training shards: five stages over the ``documents`` table.

Each stage is one operator of ``stratlas.llm`` applied to everything that its
predecessor kept.  All but the last return the columns of ``documents``; every
stage's result is written as Parquet and read again as the next one's input, and
removed when the stage behind it has been written.

Defined cases: null and empty texts have no words and go with the quality rules;
rows that repeat an id stay or go together; null ids and sources are carried
(null is a source of its own); an empty table gives empty shards.  The mixing
stage's order is that of its files and their rows, and slots follow it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.llm import decontam, mixing, neardup, quality, sharding
from stratlas.llm.textops import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the newest policy of the rule ledger keeps."""
    return quality.quality_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (sets of five-word shingles, similarity 0.8 or more)."""
    return neardup.deduplicate(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it, sorted by training position."""
    return mixing.curriculum(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes; each row with its shard and its slot there, in training order."""
    out, name = sharding.shard(docs, docs.columns, order=sharding.file_order(docs))
    return out.select(*docs.columns, *[F.col(name)[c].alias(c) for c in ("size", "text_crc32", "shard", "slot")])


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Near-duplicate components are a fixed point over pairs of long texts, which SQL can't state at any useful cost.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
    return docs
