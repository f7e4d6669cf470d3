"""The corpus pipeline: quality, toxicity, line deduplication, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's `docs`; all but the last return the columns of `documents`. The classifiers
learn from the rows of `labels` that their queries learn from, joined with the stage's own input.

Cases, in each stage: a null text counts as empty; empty and very long texts are scored, cut and packed like
others. Repeated rows stay or go alike, but near_dedup keeps all rows of the staying id. Rows without an id
are scored, lose no line, are kept by near_dedup and packed. Only the columns of `documents` come along, so
clashing names don't matter. An empty table gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualake.llm import line_dedup, near_dedup, packing, quality, toxicity
from lingualake.llm.common import key_bitmap, release, staged, staged_tables, with_flag

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY, TOXIC = 0.3, 0.7
_DROP_BITS = 25


def _learned(spark: SparkSession, sf_dir: str, held_out: Column) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)


def _remainder(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY."""
    model = quality.fit(docs, _learned(spark, sf_dir, _remainder(5) == 0))
    return quality.scored(docs.select(*COLUMNS), model).filter(F.col("score") >= QUALITY).drop("score")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC."""
    model = toxicity.fit(docs, _learned(spark, sf_dir, _remainder(3) == 1))
    return toxicity.scored(docs.select(*COLUMNS), model).filter(F.col("score") < TOXIC).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across them."""
    done = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    dropped = staged(near_dedup.near_duplicates(docs).filter("not kept").select(F.col("id").alias("doc_id")).distinct())
    flagged = with_flag(docs.select(*COLUMNS), key_bitmap(dropped, F.col("doc_id"), _DROP_BITS), F.col("doc_id"), _DROP_BITS, "maybe")
    sure, maybe = flagged.filter("not maybe").drop("maybe"), flagged.filter("maybe").drop("maybe")
    return sure.unionByName(maybe.join(dropped, "doc_id", "left_anti")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's tables go when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_tables()
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        release(spark, set(staged_tables()[:-1]) - set(before))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifiers can't be expressed in SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None
