"""Plain text: every line that is not blank is a string unit; white space around it stays in the template."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def segments(files: DataFrame) -> DataFrame:
    """Rows (doc_id, seg, lead, text, tail, ord, placeholder, newline) of each line of `files` (doc_id, content); blank lines have no text."""
    unix = files.select("doc_id", T.newline_type(F.col("content")).alias("newline"), T.to_unix(F.col("content")).alias("content"))
    lines = unix.select("doc_id", "newline", F.posexplode(F.split("content", "\n")).alias("seg", "line")).withColumn("text", T.strip(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("seg")
    filled = F.col("text") != ""
    numbered = lines.withColumn("ord", F.when(filled, F.sum(filled.cast("int")).over(order) - 1).cast("int"))
    at = F.when(filled, F.position(F.substring("text", 1, 1), F.col("line"))).otherwise(F.length("line") + 1)
    lead = F.substring("line", F.lit(1), at - 1)
    tail = F.substring("line", at + F.length("text"), F.length("line"))
    return numbered.select("doc_id", "seg", lead.alias("lead"), F.when(filled, F.col("text")).alias("text"), tail.alias("tail"), "ord", F.when(filled, T.placeholder(T.string_hash(F.col("ord").cast("string")))).alias("placeholder"), "newline")


def units(files: DataFrame) -> DataFrame:
    """Rows (doc_id, ord, key, text, string_hash, placeholder)."""
    found = segments(files).filter("text is not null")
    return found.select("doc_id", "ord", F.col("ord").cast("string").alias("key"), "text", T.string_hash(F.col("ord").cast("string")).alias("string_hash"), "placeholder")
