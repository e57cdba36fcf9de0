"""Incremental enrichment: what is new is processed once, batch by batch, and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.config import setting


def state_folder(spark: SparkSession, job: str) -> str:
    """Where a job's progress and output live from session to session: under the setting state.dir, else under spark.checkpoint.dir."""
    home = setting(spark, "state.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not home:
        raise KeyError("set spark.citeloom.state.dir or spark.checkpoint.dir to a folder that all executors share")
    return f"{home.rstrip('/')}/jobs/{job}"


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Wanted rows whose key isn't done; null keys are not wanted."""
    return wanted.where(F.col(key).isNotNull()).join(done.select(key).distinct(), key, "left_anti")


def run_incrementally(spark: SparkSession, source: str, schema: str, output: str, state: str, work: Callable[[DataFrame], DataFrame], files_per_batch: int | None = None, fmt: str = "parquet") -> None:
    """Process the files of a folder that haven't been, as a stream that ends when it has caught up.

    Each batch's result is written under batch_id=N, replacing what a failed attempt left, so that every input row is in
    the output once. state holds the progress; both folders must be shared by all executors.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    # a stream reads folders; a single file is its folder, filtered to its name
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        reader, source = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    query = reader.load(source).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
