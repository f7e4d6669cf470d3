"""Synchronising a template's slots with a changed set of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_set(slots: DataFrame, strings: DataFrame) -> DataFrame:
    """Rows (doc_id, placeholder, action): slots are kept or removed by whether their string exists, other strings are added."""
    s, u = slots.select("doc_id", "placeholder").distinct(), strings.select("doc_id", "placeholder").distinct()
    kept = s.join(u, ["doc_id", "placeholder"], "left_semi").withColumn("action", F.lit("keep"))
    removed = s.join(u, ["doc_id", "placeholder"], "left_anti").withColumn("action", F.lit("remove"))
    added = u.join(s, ["doc_id", "placeholder"], "left_anti").withColumn("action", F.lit("add"))
    return kept.unionByName(removed).unionByName(added)


def sync_ordered(slots: DataFrame, strings: DataFrame) -> DataFrame:
    """Rows (doc_id, place, placeholder, action) of the result in order: one pointer runs over the strings.

    A slot stays only if it is the string that the pointer is at; strings from the pointer on are appended.
    """
    ordered = lambda df, by: df.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(by).alias("o"), "placeholder"))), lambda x: x["placeholder"]).alias(by))
    both = ordered(slots, "seg").join(ordered(strings, "ord"), "doc_id", "full")
    none = F.array().cast("array<string>")
    both = both.withColumns({"seg": F.coalesce("seg", none), "ord": F.coalesce("ord", none)})
    matched = F.aggregate("seg", F.lit(0), lambda at, slot: at + F.when(F.get("ord", at) == slot, 1).otherwise(0))
    rows = both.withColumn("at", matched)
    kept = F.transform(F.slice("ord", F.lit(1), F.col("at")), lambda p: F.struct(p.alias("placeholder"), F.lit("keep").alias("action")))
    added = F.transform(F.slice("ord", F.col("at") + 1, F.size("ord")), lambda p: F.struct(p.alias("placeholder"), F.lit("add").alias("action")))
    return rows.select("doc_id", F.posexplode(F.concat(kept, added)).alias("place", "x")).select("doc_id", "place", "x.placeholder", "x.action")
