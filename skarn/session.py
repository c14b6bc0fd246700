"""Session defaults shared by tests, benchmarks and ad-hoc use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the test-suite and the benchmark use."""
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", f"--driver-memory {memory} pyspark-shell")
    builder = SparkSession.builder.master(f"local[{cpus or '*'}]").appName("skarn")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Catalyst pushes filters and prunes columns into the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir), or a temporary one in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        path = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    elif spark.sparkContext.master.startswith("local"):
        path = f"file://{tempfile.mkdtemp(prefix='skarn-')}/{label}"
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def lasting_folder(spark: SparkSession, label: str) -> str:
    """A new path as of shared_folder() whose files stay when the application ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or f'file://{tempfile.mkdtemp(prefix="skarn-")}').rstrip('/')}/{label}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as the session shuffles into: rows of a small file are one task's, however much is
    made of each. AQE leaves a number that is asked for as it is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, however often it is read, and kept when an executor is lost."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
