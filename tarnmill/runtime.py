"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a local or test session. A cluster's own settings are left alone.
LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the engine's defaults."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tarnmill")
    for key, value in (LOCAL_DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set a local session gets a temporary one; a cluster is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarnmill-"))
        named = sc.getCheckpointDir()
    return str(named).rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tarnmill-{uuid.uuid4().hex}"


def expire(spark: SparkSession, path: str) -> None:
    """Let what was written go when the application ends."""
    target, files = _files(spark, path)
    files.deleteOnExit(target)


def spread(df: DataFrame) -> DataFrame:
    """A scan of few, small files dealt to all cores; one that has work for them as it is stays untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() > cores else df.repartition(cores)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without recomputing what came before, and values
    that depend on the run (partition numbers) are fixed. The files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    expire(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _files(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing unfinished reads any more."""
    if path := getattr(df, "_written", None):
        target, files = _files(df.sparkSession, path)
        files.delete(target, True)
