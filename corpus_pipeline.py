"""Documents from a raw table to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before has kept; all
but the last return the columns of ``documents``. Rows that share a doc_id are told apart by their
text, except by near-dedup, for which one id is one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import lm_quality, mixing, near_dedup, packing, secrets
from sheaf.llm.common import n_words, new_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    docs = docs.select(COLUMNS)
    gone = lm_quality.judge(docs, table(spark, sf_dir, "labels")).where("not kept").select(
        F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    rejected = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (lm_quality.text_mark("text") == F.col("gone_mark"))
    return docs.join(gone, rejected, "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    docs = docs.select(COLUMNS)
    gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; no document goes."""
    return secrets.redact(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    docs = docs.select(COLUMNS)
    taken = mixing.mix_sources(docs).where("taken > 0").select(
        F.col("doc_id").alias("id"), F.col("source").alias("from"), F.col("size").alias("words"),
        (F.col("taken") / F.col("size")).cast("int").alias("times")).distinct()
    same = (F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("from"))
            & (n_words(F.col("text")) == F.col("words")))
    return docs.join(taken, same).withColumn("turn", F.explode(F.sequence(F.lit(1), "times"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents, in pieces, in training sequences of several lengths."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", classify_quality), ("near_dedup", drop_near_copies), ("secrets", hide_secrets),
    ("mixing", mix), ("packing", pack),
]

#: The stages fit models, hash texts and pack sequences, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
