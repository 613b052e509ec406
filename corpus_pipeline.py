"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and
returns the columns of ``documents``; the last one returns token ids.  Results are written as
Parquet and read again between stages, and what a stage has read is removed once its own result stands.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and
extra columns, which all but the last stage keep; what becomes of them is said with each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm import bpe, mixing, neardup, pii, quality
from spanloom.llm.common import remove, shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep.

    Null and empty texts have no words, so they go; null ids stay, without a label; repeated rows stay or go together.
    """
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), with_row=True)
    return judged.where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class: that of least id, null ids last, and of its rows the one of least text hash.

    Null and empty texts are no copies of others; of rows equal in id and text one stays.
    """
    marked = docs.withColumn("__same", F.xxhash64("text"))
    # an id may have rows in several classes, so a row goes by its id and text
    row = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("__same").alias("same"))
    classes = neardup.near_duplicates(marked.select(row.alias("row"), "text"), key="row")
    stays = classes.where("row = class_id").select(F.col("row.id").alias("__id"), F.col("row.same").alias("__hash")).distinct()
    kept = marked.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__same") == F.col("__hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__same"]).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms; n_chars follows the new text.  Null texts stay null, with n_chars null."""
    hidden = pii.pseudonymize(docs)
    return hidden.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes the block of their first word; equal rows as often as all of them together.

    Null sources are one source, last in order; texts without words are never taken.
    """
    columns = [*map(F.isnull, docs.columns), *docs.columns]
    marked = docs.withColumns({f"__h{n}": F.xxhash64(F.lit(n), *columns) for n in (1, 2)})
    row = F.struct("__h1", "__h2").alias("row")
    taken = mixing.mix(marked.select(row, "text", "source"), key="row").groupBy("row.__h1", "row.__h2").agg(F.sum("repeats").alias("__n"))
    joined = marked.join(taken.where("__n > 0"), ["__h1", "__h2"]).dropDuplicates(["__h1", "__h2"])
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))
    return joined.select(*docs.columns, times.alias("__nth")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to.  Null and empty texts have no ids."""
    return bpe.encode_checked(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL cannot express MinHash areas, Feistel networks or BPE merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
