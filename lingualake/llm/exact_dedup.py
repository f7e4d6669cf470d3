"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

The first scan keeps only (length, prefix hash) of each normalised text. Lengths, then length and
prefix pairs, that occur once rule their rows out. What survives is a bitmap of bounded size, so the
second scan hashes full content only where a copy is still possible, and only those short rows are
shuffled to be grouped.

Cases: a null text counts as empty; empty texts are equal to each other. Ties in length of the
original go to the smallest id, ids before null. The id names a row: repeated rows with the staying
row's id are all marked kept. An empty table gives an empty result. Columns other than the id and the
text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, key_bitmap, salted_left_join, staged, text_or_empty, with_flag

PREFIX = 64
#: The filters of surviving keys take 2**FILTER_BITS / 8 = 4 MiB; beyond that many keys more rows are read in full, none is lost.
FILTER_BITS = 25


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per row of `df`: id, keep_id, group_size, kept, sha256.

    `sha256` is null for rows that a shorter key proved unique, unless `hash_all`.
    """
    text = text_or_empty("_text")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).withColumn("_norm", normalised(text))
    rows = rows.withColumns({"len": F.octet_length("_norm"), "head": F.xxhash64(F.substring("_norm", 1, PREFIX))})
    keys = staged(rows.groupBy("len", "head").agg(F.count("*").alias("n")))
    lengths = keys.groupBy("len").agg(F.sum("n").alias("n")).filter("n > 1")
    by_length = with_flag(keys, key_bitmap(lengths, F.col("len"), FILTER_BITS), F.col("len"), FILTER_BITS, "more").filter("more")
    pair = F.struct("len", "head")
    heads = key_bitmap(by_length.filter("n > 1"), pair, FILTER_BITS)
    flagged = with_flag(rows, heads, pair, FILTER_BITS, "open")
    digest = F.sha2(F.col("_norm").cast("binary"), 256)
    hashed = staged(flagged.select("id", F.length(text).alias("n_chars"), "open", F.when(F.lit(hash_all) | F.col("open"), digest).alias("sha256")))
    best = F.max(F.struct("n_chars", F.bitwise_not(F.col("id").cast("bigint")).alias("rank")))
    groups = hashed.filter("open").groupBy("sha256").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("sha256", F.bitwise_not(F.col("best.rank")).alias("keep_id"), "group_size")
    opened = salted_left_join(hashed.filter("open"), groups, "sha256", "id")
    alone = hashed.filter("not open").withColumns({"keep_id": F.col("id").cast("bigint"), "group_size": F.lit(1).cast("bigint")})
    out = opened.select("id", "keep_id", "group_size", "sha256").unionByName(alone.select("id", "keep_id", "group_size", "sha256"))
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha256")
