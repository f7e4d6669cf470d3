"""What the queries are built with: the registry, tables, and files made from rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..storing import stored  # noqa: F401  what the queries keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Keys whose parts are joined at once.
PIECE = 16384
#: Keys of a table that may share a file.
FILE_KEYS = 500
#: By the name that the SQL gives them: tables whose brand or nation is that of a file, so files stay bounded as the tables grow.
_IN_FILES = {"parts": ("part", "p_brand", "p_partkey"), "customers": ("customer", "c_nationkey", "c_custkey"), "suppliers": ("supplier", "s_nationkey", "s_suppkey")}


def _with_files(sql: str) -> str:
    """`sql` behind the tables in files that it reads."""
    views = [f"{name} AS (SELECT * REPLACE ({group} || '-' || {key} // {FILE_KEYS} AS {group}) FROM {source})" for name, (source, group, key) in _IN_FILES.items() if re.search(rf"\b(FROM|JOIN) {name}\b", sql)]
    return f"WITH {', '.join(views)}{', ' + sql.removeprefix('WITH ') if sql.startswith('WITH ') else ' ' + sql}" if views else sql


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _with_files(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, group, key = _IN_FILES[name]
    return table(spark, sf_dir, source).withColumn(group, F.concat(F.col(group).cast("string"), F.lit("-"), F.floor(F.col(key) / FILE_KEYS).cast("string")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, their brand that of a file."""
    return _in_files(spark, sf_dir, "parts")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, their nation that of a file."""
    return _in_files(spark, sf_dir, "customers")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers, their nation that of a file."""
    return _in_files(spark, sf_dir, "suppliers")


def filled(template: str, **columns: str | Column) -> Column:
    """`template` with `<<name>>` replaced by the column of that name."""
    parts: list[Column] = []
    for piece in template.split("<<"):
        name, mark, rest = piece.partition(">>")
        parts += [columns[name] if isinstance(columns[name], Column) else F.col(columns[name]).cast("string"), F.lit(rest)] if mark else [F.lit(piece)]
    return F.concat(*parts)


def file_rows(rows: DataFrame, doc: Column, order: str, part: Column, separator: str, head: str = "", tail: str = "") -> DataFrame:
    """One file for each `doc`: the parts in order between head and tail.

    Parts are joined by pieces of the order first, so no task holds the parts of files other than its own, or a file's parts one by one.
    """
    piece = F.floor(F.col(order) / PIECE) if isinstance(rows.schema[order].dataType, IntegralType) else F.lit(0)
    each = rows.select(doc.alias("doc_id"), piece.alias("piece"), F.struct(F.col(order).alias("o"), part.alias("p")).alias("x")).repartition("doc_id")
    found = F.filter(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"]), lambda p: p.isNotNull())
    pieces = each.groupBy("doc_id", "piece").agg(found.alias("ps")).select("doc_id", F.struct("piece", F.when(F.size("ps") > 0, F.array_join("ps", separator)).alias("p")).alias("x"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"]), separator)
    return pieces.groupBy("doc_id").agg(F.concat(F.lit(head), whole, F.lit(tail)).alias("content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


def _filed(rows: DataFrame, template: str, separator: str, head: str, tail: str) -> DataFrame:
    return file_rows(rows, F.col("p_brand"), "p_partkey", filled(template, k="p_partkey", name="p_name", type="p_type", size="p_size", brand="p_brand"), separator, head, tail)


def part_files(spark: SparkSession, sf_dir: str, template: str, separator: str = ", ", head: str = "{", tail: str = "}") -> DataFrame:
    """Files of at most FILE_KEYS keys of a brand, with a piece for each part."""
    return _filed(parts(spark, sf_dir), template, separator, head, tail)


def brand_files(spark: SparkSession, sf_dir: str, template: str, separator: str = ", ", head: str = "{", tail: str = "}") -> DataFrame:
    """Files of all parts of a brand, with a piece for each part."""
    return _filed(table(spark, sf_dir, "part"), template, separator, head, tail)


#: Separator, head and tail of an Android file.
XML = ("\n", '<?xml version="1.0" encoding="utf-8"?>\n<resources>\n', "\n</resources>\n")
