"""What the training-data operators share: shared-folder tables, bounded key bitmaps, whole-text helpers."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = "[\\x20\\x09-\\x0D]"
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _local
    _local = _local or tempfile.mkdtemp(prefix="skarn-")
    return f"file://{_local}"


_local = ""


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages neither recompute it nor lose it with an executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(*tables: DataFrame) -> None:
    """Delete tables that durable() wrote and that nothing will read again; others are left alone."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def trimmed(run):
    """run for mapInArrow; when its task ends, freed memory goes back to the system, as the idle worker would keep it."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
            if trim:
                trim(0)

    return whole


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


RUN = 256


def running(values: Column, step=lambda a, x: a + x) -> Column:
    """array<int> -> for each place the sum (or another step from 0) of the values before it.

    A fold copies its array at every step, so values go in runs of RUN: the work grows with the array, not its square.
    """

    def scan(a):
        add = lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(a, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])

    def joined(runs):
        whole = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: step(a, x)))
        return F.flatten(F.zip_with(runs, let(whole, scan), lambda r, at: F.transform(scan(r), lambda x: step(at, x))))

    last = F.greatest(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int"))
    return let(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * RUN + 1, F.lit(RUN))), joined)


def without_white(text: Column) -> Column:
    """text with every contract white-space character deleted (byte-level replace, no regex)."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """Contract words of a non-null text."""
    return F.filter(F.split(text, WHITE_RE + "+"), lambda w: w != "")


def key_bitmap(df: DataFrame, key: Column, bits: int) -> DataFrame:
    """The keys of df as a bitmap of 2**bits bits in rows of 4 KiB: (bucket, bitmap).

    It is a one-hash Bloom filter: it may mark other keys too, never miss one. Duplicate keys are merged map-side.
    """
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    slots = df.select(F.floor(at / 32768).cast("int").alias("bucket"), (at % 32768).cast("long").alias("bit"))
    return slots.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


#: The largest bitmap that is broadcast: 2**28 bits are 32 MiB.
MOST_BITS = 28


def mark_keys(df: DataFrame, key: Column, keys: DataFrame, name: str, most_bits: int = MOST_BITS) -> DataFrame:
    """df with boolean `name`: true where key is among those of keys, and for few others. key is a column of both.

    keys is counted first (give a written table). A bitmap of 16 bits a key is broadcast while it has at most
    2**most_bits bits, so df isn't shuffled; for more keys df is joined with them, which grows with the data.
    """
    n = keys.count()
    if 16 * n > 1 << most_bits:
        found = keys.select(F.xxhash64(key).alias("__hash")).distinct().withColumn("__hit", F.lit(True))
        joined = df.withColumn("__hash", F.xxhash64(key)).join(found, "__hash", "left")
        return joined.withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hash", "__hit")
    bits = max(15, math.ceil(math.log2(16 * n + 1)))
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    probe = df.withColumn("__bucket", F.floor(at / 32768).cast("int")).withColumn("__bit", (at % 32768).cast("int"))
    small = key_bitmap(keys, key, bits).select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap"))
    joined = probe.join(F.broadcast(small), "__bucket", "left")
    byte = F.expr("cast(conv(hex(substring(__bitmap, cast(floor(__bit / 8) as int) + 1, 1)), 16, 10) as int)")
    hit = F.coalesce(F.expr("shiftright(__byte, __bit % 8) & 1") == 1, F.lit(False))
    return joined.withColumn("__byte", byte).withColumn(name, hit).drop("__bucket", "__bit", "__bitmap", "__byte")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_by_key(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of docs whose key is surely not in keys, the other rows with column __key), by mark_keys().

    keys has one column __key of key's type. The second part holds all rows whose key is in keys and few others; the
    caller settles it by an exact join, so only that part is shuffled.
    """
    marked = mark_keys(docs.withColumn("__key", key), F.col("__key"), keys, "__maybe")
    return marked.filter(~F.col("__maybe")).drop("__maybe", "__key"), marked.filter("__maybe").drop("__maybe")
