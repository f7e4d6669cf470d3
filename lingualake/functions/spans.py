"""Places in texts, counted in code points: cutting many spans out of one text in time that grows with its length.

A text is cut once into blocks of equal length; a span then takes its blocks by number, so no span is counted from
the text's start.

Cases: a null text has no spans; spans that reach beyond the end are cut off there, empty ones are empty texts. Files
without spans have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import dealt

#: Code points of a block.
BLOCK = 256
#: A placeholder, and its length.
MARK, MARK_LENGTH = r"[0-9a-f]{32}_(?:tr|pl)", 35


def blocks(text: Column) -> Column:
    """A text as an array of blocks; the last one may be shorter."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """The code points from `start` to before `end` of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.floor((F.greatest(end, start + 1) - 1) / BLOCK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(cut, first + 1, count), ""), (start - first * BLOCK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def texts(files: DataFrame, spans: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Rows (key, start, end, text) of the distinct `spans` (key, start, end) of files (key, content).

    A file meets its spans as one row, so its text isn't copied to each of them.
    """
    listed = spans.select(key, F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("_s")).groupBy(key).agg(F.array_sort(F.collect_set("_s")).alias("_spans"))
    rows = files.select(key, blocks(F.col(content)).alias("_blocks")).join(dealt(listed), key)
    found = F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), piece(F.col("_blocks"), s["start"], s["end"]).alias("text")))
    return rows.select(key, F.explode(found).alias("_x")).select(key, "_x.start", "_x.end", "_x.text")


def with_text(rows: DataFrame, files: DataFrame, start: Column, end: Column, name: str, key: str = "doc_id", content: str = "content") -> DataFrame:
    """`rows` with the text of their span of the file as column `name`."""
    placed = rows.withColumns({"_start": start.cast("int"), "_end": end.cast("int")})
    found = texts(files, placed.select(key, F.col("_start").alias("start"), F.col("_end").alias("end")), key, content)
    return placed.join(dealt(found.select(key, F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("text").alias(name))), [key, "_start", "_end"], "left").drop("_start", "_end")


def marks(files: DataFrame) -> DataFrame:
    """Rows (doc_id, seg, start, end, placeholder) of the placeholders in files (doc_id, content), `seg` their number in the file."""
    lengths = F.transform(F.split("content", MARK), lambda x: F.length(x))
    rows = files.select("doc_id", F.posexplode(F.arrays_zip(lengths.alias("n"), F.regexp_extract_all("content", F.lit(MARK), F.lit(0)).alias("placeholder"))).alias("seg", "x"))
    before = F.sum("x.n").over(Window.partitionBy("doc_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("start", (before + MARK_LENGTH * F.col("seg")).cast("int")).filter("x.placeholder is not null")
    return placed.select("doc_id", "seg", "start", (F.col("start") + MARK_LENGTH).alias("end"), "x.placeholder")
