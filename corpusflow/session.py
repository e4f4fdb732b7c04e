"""Session set-up and the few settings the jobs depend on."""

from __future__ import annotations

import functools
import tempfile
import uuid

import corpusflow
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Task functions travel with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(corpusflow)

RUNTIME_CONF = {
    # All event times are compared in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalescing, skew-join splitting, broadcast switch.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "corpusflow") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made by somebody else."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


# Rows of one Arrow batch between the JVM and a Python worker: texts may be long.
BATCH_ROWS = 1000


def with_small_batches(spark: SparkSession) -> SparkSession:
    """The session, handing few rows at a time to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    A session on one machine may leave ``spark.checkpoint.dir`` unset and gets a
    temporary folder; a cluster may not.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, so a lost executor costs a re-read instead of a recompute,
    and gives later steps real sizes, column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusflow-stage/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
