"""What several corpus operators share: whitespace, the shared folder, staged tables and key bitmaps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
_OWN: dict[str, str] = {}
_STAGED: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where none is set, a temporary folder serves if all of Spark runs on this machine (tests), else one in the warehouse.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.split("[")[0] == "local":
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="lingualake-")
        path = _OWN["dir"]
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir')}/_lingualake").rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended first
        pass
    _STAGED.pop(path, None)


def staged(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.

    It cuts the lineage in a way that survives lost executors. The files go with release() or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lingualake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED[path] = None
    return spark.read.schema(df.schema).parquet(path)


def staged_tables() -> list[str]:
    """The folders of the tables that stand, the latest last."""
    return list(_STAGED)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Removes staged tables that nothing reads any more."""
    for path in paths:
        _remove(spark, path)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _STAGED else None
    if spark:
        release(spark, staged_tables())
    for path in _OWN.values():
        shutil.rmtree(path, ignore_errors=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def key_bitmap(keys: DataFrame, key: Column, log2_bits: int) -> DataFrame:
    """A one-hash Bloom filter over `key` as rows (slot, bits) of 1024 numbers of 32 bits each.

    Its size is at most 2**log2_bits / 8 bytes however many keys there are, so it may be broadcast.
    """
    at = F.pmod(F.xxhash64(key), F.lit(1 << log2_bits))
    packed = keys.groupBy(F.bitmap_bucket_number(at).alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bytes"))
    number = lambda i: F.conv(F.hex(F.substring(F.col("bytes"), i * 4 + 1, F.lit(4))), 16, 10).cast("bigint")
    signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")
    # two steps, so that each number is made once
    return packed.select("slot", F.transform(F.transform(F.sequence(F.lit(0), F.lit(1023)), number), signed).alias("bits"))


def with_flag(df: DataFrame, bitmap: DataFrame, key: Column, log2_bits: int, flag: str) -> DataFrame:
    """`df` with a boolean `flag`: false only if `key` is in no row that `bitmap` was built from."""
    at = F.pmod(F.xxhash64(key), F.lit(1 << log2_bits))
    keyed = df.withColumns({"_slot": F.bitmap_bucket_number(at), "_at": F.bitmap_bit_position(at).cast("int")})
    bits = bitmap.select(F.col("slot").alias("_slot"), F.col("bits").alias("_bits"))
    # The numbers' bytes are big-endian, the bits of each byte are counted from its lowest.
    bit = F.getbit(F.get("_bits", F.shiftright("_at", 5)), 24 - F.col("_at").bitwiseAND(24) + F.col("_at").bitwiseAND(7))
    return keyed.join(F.broadcast(bits), "_slot", "left").withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop("_slot", "_at", "_bits")


def salted_left_join(rows: DataFrame, groups: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """`rows` left join `groups` on `key`, each key's rows dealt to `salts` tasks by their `spread` column.

    `groups` has one row for a key, so copying it `salts` times costs little beside a hot key's rows.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable):
    """What `make` gives, kept in a worker from task to task.

    It takes the place of what other operators kept, so a worker holds the state of one operator at a time.
    """
    if key not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


class Remembered(dict):
    """The values of a function by argument, `2 * size` at most; those not asked for lately go first."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = self.copy()
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found
