"""From raw documents to packed training sequences: quality, exact copies, near copies, packing.

Each stage works on all that the one before kept, and what it drops is gone. All but the last return the columns of
``documents``; the last returns the pieces of the remaining documents with their places in sequences. A document
without words passes the quality stage and stands for all such documents after the next one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, jaccard_join, packing, quality
from plumbline.llm.common import shared_dir

TOKENIZER = "word_bpe_49k.json"


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.score_quality(docs).where("keep").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality classifier", drop_junk),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

#: Scores of a trained model and MinHash screening are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top)  # the result is read from there until the driver ends
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
