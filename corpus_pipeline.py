"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, with null
text kept as it is. Rows that a stage has no evidence against stay.

Toxicity, decontamination and personal data are decided where the row is, without a join, so that null ids and ids of
several texts need no care. Near duplicates are brought back by a key of id and text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe_codec, decontam, jaccard_join, pii, toxicity
from tickloom.llm._common import shared_folder, table

#: The near-duplicate stage and the model-based ones have no SQL form; tests hold them against plain versions.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject, each row by its own text."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id; copies of a kept row go too.

    Rows are told apart by id, filled up with zeros so that numbers sort as such and before rows without one, and a digest of 128 bits of the text.
    Null texts and texts without words link with nothing, and all stay.
    """
    key = "_key"
    while key in docs.columns:
        key = f"_{key}"
    name = F.col("doc_id").cast("string")
    name = F.when(name.isNull(), "~").when(F.char_length(name) < 20, F.lpad(name, 20, "0")).otherwise(name)
    worded = F.coalesce(F.col("text").rlike(jaccard_join.WORD), F.lit(False))
    rows = docs.where(worded).withColumn(key, F.concat(name, F.lit("-"), F.md5(F.col("text").cast("binary"))))
    linked = jaccard_join.join(rows.select(F.col(key).alias("doc_id"), "text"))
    gone = linked.where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").dropDuplicates([key]).select(docs.columns).unionByName(docs.where(~worded))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data in their texts replaced by the names of its kinds, and n_chars to match."""
    return pii.redacted(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_codec.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("pii", personal_data),
    ("byte_level_bpe", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again for the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
