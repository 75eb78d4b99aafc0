"""Training corpus in stages: from ``documents`` to token ids.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written as Parquet and
read again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.llm import content_sort, fair_mix, jaccard_join, quality_pu, sentence_pieces
from voltide.session import scratch_path

#: Tokenizer model of the last stage.
PIECES = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Labels are learnt where crc32 of the id as text leaves no remainder 1 by 3."""
    learnt = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(learnt)
    return quality_pu.accepted(docs, quality_pu.fit(docs.where(learnt), labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return content_sort.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return jaccard_join.drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order; those it doesn't take go."""
    return fair_mix.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return sentence_pieces.encode(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality classifier", quality), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("mixing", mixing), ("encoding", encoding),
]

#: Classifier, similarity join and piece matching are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := scratch_path(spark, name.replace(" ", "-")))
            docs = spark.read.parquet(path)
    return docs
