"""A training corpus from raw documents, stage by stage.

Toxic documents go, then those that the quality rules reject, then all but one of each group
of near copies; sources are mixed to their target weights; what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's
result as Parquet into the shared folder and reads it back as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from termforge.config import ship_package
from termforge.llm import bytebpe, mixing, ngramjoin, quality, toxicity
from termforge.llm.common import materialize, release, written
from termforge.llm.queries import BYTE_RANKS

#: No SQL: stages compress, fit and encode. Each is tested against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier scores below 0.5."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    ship_package(spark)
    return quality.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return ngramjoin.keep_one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship_package(spark)
    return mixing.take_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix."""
    ship_package(spark)
    return bytebpe.code_documents(docs, BYTE_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself is deleted once its result stands; all
    but the last stage's result, which the returned DataFrame reads, is gone then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
            release(spark, since, keep=docs)
    return docs
