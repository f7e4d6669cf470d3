"""Tables written to the folder that a cluster shares and read again: files, templates and node rows that several plans read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: list[str] = []
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all of a cluster shares; where it is unset one temporary folder if all runs on this machine, else one in the warehouse."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.split("[")[0] == "local":
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="lingualake-"))
        path = _OWN[0]
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir')}/_lingualake").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


def stored(rows: DataFrame) -> DataFrame:
    """`rows` written and read again; the lineage ends here, and lost executors lose nothing."""
    spark = rows.sparkSession
    path = new_folder(spark, "table")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@atexit.register
def _remove_stored() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)
    spark = SparkSession.getActiveSession() if _STORED else None
    for path in _STORED if spark else ():
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may have ended first
            return
