"""Parsing as a stream: files are parsed alone, so the batch sources run on each micro-batch as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def parse_stream(spark: SparkSession, path: str, schema: str, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Parses what lies at `path` (Parquet of doc_id, content) as a stream and returns the units it wrote to `out`.

    Each micro-batch replaces its own folder, so a repeated one leaves no repeated units.
    """

    def write(batch: DataFrame, number: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")
