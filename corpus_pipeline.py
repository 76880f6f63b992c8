"""The corpus pipeline: documents through the stages of STAGES, in order.

Quality classifier, MinHash near-duplicates, secret scans, mixing, packing. All stages but the last return the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlab.llm import mixing, near_dedup, packing, quality, secrets
from weftlab.session import materialise, table

#: Target token shares of the mixing stage.
TOXIC_SHARE = {"clean": 0.98, "toxic": 0.02}


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents are thinned out to their target share of tokens; clean ones keep the rate 1."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    return mixing.resample(docs, table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain")), TOXIC_SHARE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("good_quality", good_quality),
    ("near_copies", near_copies),
    ("without_secrets", without_secrets),
    ("mixed", mixed),
    ("packed", packed),
]

#: Trained models and tokenisers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
