"""Format rules as rows: what is wrong where, instead of exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import json_files, subtitles


def srt_report(files: DataFrame) -> DataFrame:
    """Rows (doc_id, rule, places): how many sections break each rule."""
    return subtitles.srt_sections(files).filter("error is not null").groupBy("doc_id", F.col("error").alias("rule")).agg(F.count("*").alias("places"))


def without_units(files: DataFrame, units: DataFrame) -> DataFrame:
    """The documents that have no unit."""
    return files.select("doc_id").join(units.select("doc_id").distinct(), "doc_id", "left_anti")


def duplicate_json_keys(files: DataFrame) -> DataFrame:
    return json_files.duplicate_keys(files)


def plural_gaps(units: DataFrame) -> DataFrame:
    """Plural units some of whose forms are blank and some not."""
    blank = F.filter(F.map_values("strings"), lambda x: F.trim(x) == "")
    return units.filter("pluralized").withColumn("_b", F.size(blank)).filter((F.col("_b") > 0) & (F.col("_b") < F.size("strings"))).drop("_b")


def failfast(problems: DataFrame) -> DataFrame:
    """`problems` if it is empty, which a job of its own looks up; a ValueError that names the first one otherwise."""
    first = problems.first()
    if first is not None:
        raise ValueError(f"a file breaks the rules of its format: {first.asDict()}")
    return problems
