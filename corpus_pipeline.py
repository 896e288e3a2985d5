"""The corpus pipeline: stages over documents, each written and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and works
on all that the stage before kept. All but the last return the columns of
documents; the last returns pieces of packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deliveryrisk.functions.materialize import ensure_checkpoint_dir
from deliveryrisk.llm import exact_dedup, mixing, near_copies, packing, quality
from deliveryrisk.llm.common import free_name, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    score = free_name(docs, "score_")
    return quality.with_quality(docs, model, out=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of equal texts, the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group linked by shingle similarity (five words, 0.8 or more)."""
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often as the mix takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed texts in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

# The classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
