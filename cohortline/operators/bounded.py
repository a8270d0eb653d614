"""Hand over small intermediate results, and cut lineage, without assuming they are small."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 10_000
#: Passes of `in_passes`, and the rows up to which one pass takes them all.
PASSES, ONE_PASS_ROWS = 4, 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, or the one set on the context; else an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later passes read files instead of running the plan again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have the files of those shuffles removed that no frame refers to any longer.

    Spark removes them when the driver's collector finds them, which may be never while a job runs. The
    listeners hold on to the query that ended last, so that has to be another one.
    """
    spark.sql("select 1").collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as compressed columns in the shared folder; a later pass reads the columns it needs."""
    spark, path = df.sparkSession, _new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def in_passes(df: DataFrame, key: Column, job: Callable[[DataFrame], DataFrame],
              stored: bool = False) -> DataFrame:
    """The rows of ``job(df)``, stored, for a job that treats the rows of each value of ``key`` by themselves.

    The job runs over one hash range of the key after another, so that its shuffles hold only a part of
    the rows at a time. df is read once and stored by ranges, which go when their pass is done, unless it
    comes from storage itself; few rows make one pass.
    """
    spark, path, done = df.sparkSession, _new_folder(df.sparkSession), _new_folder(df.sparkSession)
    rows = df.withColumn("_pass", F.pmod(F.xxhash64(key), F.lit(PASSES)).cast("int"))
    if not stored:
        rows.write.option("compression", "zstd").partitionBy("_pass").parquet(path)
        release(spark)
        rows = spark.read.schema(rows.schema).parquet(path)
    few = rows.count() <= ONE_PASS_ROWS
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for k in range(1 if few else PASSES):
        part = job((rows if few else rows.filter(F.col("_pass") == k)).drop("_pass"))
        part.write.mode("append").option("compression", "zstd").parquet(done)
        if not (few or stored):
            system.delete(files.suffix(f"/_pass={k}"), True)
        release(spark)
    if not stored:
        system.delete(files, True)
    return spark.read.schema(part.schema).parquet(done)


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """The same rows as a local relation if there are at most ``max_rows``, else checkpointed.

    The local relation carries a broadcast hint, as its size is proven.  Beyond the bound the
    rows stay distributed and joins fall back to shuffles that AQE can split.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return cut(df)
    return F.broadcast(df.sparkSession.createDataFrame(head, schema=df.schema))
