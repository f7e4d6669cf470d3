"""Translating units with a phrase table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Parts in which the units of one phrase are dealt out.
SALTS = 16


def translate(units: DataFrame, phrases: DataFrame, language: str) -> DataFrame:
    """`units` with `translation`: the phrase table's (source, target), the first of repeated ones, else `language:text`.

    The units of a frequent phrase meet it in SALTS parts.
    """
    first = phrases.groupBy(F.col("source").alias("text")).agg(F.min("target").alias("target"))
    table = first.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    spread = [c for c in ("doc_id", "seg", "ord") if c in units.columns]
    dealt = units.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    return dealt.join(table, ["text", "_salt"], "left").withColumn("translation", F.coalesce("target", F.concat(F.lit(f"{language}:"), "text"))).drop("target", "_salt")


def distinct_strings(units: DataFrame) -> DataFrame:
    """Each distinct text of the corpus with how many units and documents have it."""
    return units.groupBy("text").agg(F.count("*").alias("units"), F.count_distinct("doc_id").alias("documents"))
