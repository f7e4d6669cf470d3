"""SRT and WebVTT subtitles: blocks between blank lines, split, checked and numbered with column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_ARROW = r"^\s*(\S+)\s+-->\s+(\S+)(?:\s+(.*))?$"


def blocks(files: DataFrame) -> DataFrame:
    """Rows (doc_id, seg, block, start): each part between empty lines and the code point where it starts."""
    parts = files.select("doc_id", F.posexplode(F.split(T.to_unix(F.col("content")), "\n\n")).alias("seg", "block"))
    before = Window.partitionBy("doc_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum(F.length("block") + 2).over(before), F.lit(0)))


def srt_sections(files: DataFrame) -> DataFrame:
    """Every block with its number, timings and text, and `error`, null or the first rule that it breaks."""
    rows = blocks(files).withColumn("body", T.strip(F.col("block"))).withColumn("lines", F.split("body", "\n", 3))
    part = lambda k: F.get("lines", k)
    rows = rows.withColumns({"number": F.expr("try_cast(trim(lines[0]) as int)"), "from": T.timing(F.regexp_extract(part(1), _ARROW, 1), ","), "to": T.timing(F.regexp_extract(part(1), _ARROW, 2), ","), "text": part(2)})
    before = Window.partitionBy("doc_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("highest", F.max(F.when(F.col("body") != "", F.col("number"))).over(before))
    error = (
        F.when(F.col("body") == "", None)
        .when(F.size("lines") < 3, "not enough lines")
        .when(F.col("number").isNull() | (F.col("number") <= 0), "order is not a positive number")
        .when(F.col("number") <= F.col("highest"), "order is not ascending")
        .when(~F.coalesce(part(1).rlike(_ARROW), F.lit(False)), "timings don't follow the pattern")
        .when(F.col("from").isNull(), "start is malformed")
        .when(F.col("to").isNull(), "end is malformed")
        .when(T.strip(F.col("text")) == "", "no text")
    )
    return rows.withColumns({"error": error, "line": T.line_number(F.col("block"), F.lit(0))})


def srt_units(files: DataFrame) -> DataFrame:
    """Rows (doc_id, seg, key, ord, text, occurrences, string_hash, placeholder) of the well-formed sections."""
    found = srt_sections(files).filter((F.col("body") != "") & F.col("error").isNull())
    key = F.trim(F.get("lines", 0))
    return found.select("doc_id", "seg", key.alias("key"), F.col("number").alias("ord"), "text", F.concat_ws(",", "from", "to").alias("occurrences"), T.string_hash(key).alias("string_hash"), T.placeholder(T.string_hash(key)).alias("placeholder"))


def vtt_sections(files: DataFrame) -> DataFrame:
    """Every block with an arrow: its cue line, timings and text, and `error`, null or the first rule that it breaks."""
    rows = blocks(files).withColumn("lines", F.split(T.strip(F.col("block")), "\n"))
    at = F.array_position(F.transform("lines", lambda x: x.contains("-->")), True)
    rows = rows.withColumn("at", at.cast("int")).filter("at > 0")
    cue = F.get("lines", F.col("at") - 1)
    text = F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), "\n")
    rows = rows.withColumns({"key": T.strip(cue), "text": text, "from": T.timing(F.regexp_extract(cue, _ARROW, 1), "."), "to": T.timing(F.regexp_extract(cue, _ARROW, 2), ".")})
    error = F.when(~F.col("key").rlike(_ARROW), "timings don't follow the pattern").when(F.col("from").isNull(), "start is malformed").when(F.col("to").isNull(), "end is malformed")
    return rows.withColumn("error", error)


def vtt_units(files: DataFrame) -> DataFrame:
    """Rows (doc_id, seg, key, ord, text, occurrences, string_hash, placeholder); blocks without timings or text are none, nor are those of files that don't start with WEBVTT."""
    named = files.filter(F.col("content").startswith("WEBVTT"))
    rows = vtt_sections(named).filter("error is null and trim(text) <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")) - 1
    return rows.select("doc_id", "seg", "key", number.alias("ord"), "text", F.concat_ws(",", "from", "to").alias("occurrences"), T.string_hash(F.col("key")).alias("string_hash"), T.placeholder(T.string_hash(F.col("key"))).alias("placeholder"))


def vtt_problems(files: DataFrame) -> DataFrame:
    """Rows (doc_id, rule, places): sections that break a rule, files that don't start with WEBVTT, and files without a string."""
    sections = vtt_sections(files)
    broken = sections.filter("error is not null").groupBy("doc_id", F.col("error").alias("rule")).agg(F.count("*").alias("places"))
    one = F.lit(1).cast("bigint").alias("places")
    heads = files.filter(~F.coalesce(F.col("content").startswith("WEBVTT"), F.lit(False))).select("doc_id", F.lit("no WEBVTT at the start").alias("rule"), one)
    empty = files.select("doc_id").join(sections.filter("error is null and trim(text) <> ''").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("no strings").alias("rule"), one)
    return broken.unionByName(heads).unionByName(empty)


def template_parts(files: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (doc_id, seg, head, tail, placeholder): each block around its unit's text; blocks without a unit have only a head."""
    both = blocks(files).join(units.select("doc_id", "seg", "text", "placeholder"), ["doc_id", "seg"], "left")
    before = F.length(F.regexp_replace("block", r"(?U)\s+$", "")) - F.length("text")
    head = F.when(F.col("text").isNull(), F.col("block")).otherwise(F.substring("block", F.lit(1), before))
    tail = F.when(F.col("text").isNotNull(), F.substring("block", before + F.length("text") + 1, F.length("block"))).otherwise("")
    return both.select("doc_id", "seg", head.alias("head"), tail.alias("tail"), "placeholder")
