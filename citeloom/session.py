"""Spark session and the engine's small runtime helpers."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", app: str = "citeloom", **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; conf overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # checkpoints that no table refers to any more are removed
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_code(spark: SparkSession) -> None:
    """Let Python workers find this package at the path where the driver has it, whatever their working directory.

    On a cluster whose nodes don't share that path, distribute the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that shares the code first."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        share_code(spark)
        return query(spark, folder)

    return run


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; set a folder only where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="citeloom-checkpoint-")
    sc.setCheckpointDir(named)


def spread(df: DataFrame) -> DataFrame:
    """A scan, repartitioned only if it has fewer partitions than the cluster has cores: for work that is heavy per row.

    Large inputs have more partitions than that and are left alone, so that nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files.

    A lost executor costs nothing that was written; a table that is used several times is computed once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions in here are removed as each action ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share, for files that outlive a job."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; counts no further than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64_000_000) -> DataFrame:
    """df with a broadcast hint if its checked size, in rows and as text in bytes, allows; else df: the join then shuffles."""
    some = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if some["n"] <= max_rows and some["size"] <= max_bytes else df
