"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``, whatever further ones there are and however
they are called.

In every stage a null or empty text is a text without words, texts of any length
are used whole, rows that share an id, or have none, meet the same decision in
the mixing stage, rows that repeat another in id and text are one document and
leave the exact deduplication once, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from shelfloom.llm.common import fresh, shared_folder
from shelfloom.llm.queries import ship, vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents below the score threshold go. Null ids are scored
    like others, empty texts get the score of a text without features."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = quality.fit(docs, labels, held)
    score = fresh(docs, "quality_score")
    return quality.score(docs, model, "text", score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the largest doc_id stays, once; of rows without
    an id whose text no row with an id has, all stay."""
    digest, kept_id, kept_text = (fresh(docs, n) for n in ("digest", "kept_id", "kept_text"))
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_text)).distinct()
    rows = docs.withColumn(digest, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    # repeated rows meet after each task has dropped its own; rows without an id are never compared
    once = rows.where("doc_id is not null").dropDuplicates(["doc_id", digest]).unionByName(rows.where("doc_id is null"))
    return once.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_text)), "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group of near duplicates stays, and every
    row without words or id."""
    kept_id = fresh(docs, "kept_id")
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a document occurs as often as the mix takes it, in whole
    copies (rounded; only a selection's two ends split a document). Documents
    without words are never taken."""
    taken_id, copies, copy = (fresh(docs, n) for n in ("taken_id", "copies", "copy"))
    whole = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    taken = mixing.mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias(taken_id)).agg(F.max(whole).alias(copies))
    rows = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(taken_id))).where(F.col(copies) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of every document, with the digest of what they
    decode to; other columns end here."""
    return bpe.encode_documents(docs, vocabulary(), outputs=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("bpe", encode),
]

#: The classifier, the sketches and the tokenizer are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
