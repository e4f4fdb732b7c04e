"""Running streams over folders of files to a parquet sink."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from corpusflow.session import shared_dir

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROGRESS_KEY = "spark.sql.streaming.numRecentProgressUpdates"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_file_stream(spark: SparkSession, folder: str, glob: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Files of ``folder`` matching ``glob`` as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", str(files_per_batch))
        .parquet(folder)
    )


def _fresh(spark: SparkSession) -> tuple[str, str]:
    base = f"{shared_dir(spark)}/corpusflow-stream/{uuid.uuid4().hex}"
    return f"{base}/data", f"{base}/checkpoint"


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings for queries started inside; the session gets its own back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_to_files(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available, write parquet, return what was written."""
    return run_counting_late(stream, mode)[0]


def run_counting_late(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, int]:
    """As ``run_to_files``, with the number of rows that came behind the watermark and were dropped."""
    spark = stream.sparkSession
    data, checkpoint = _fresh(spark)
    with _settings(spark, **{PROVIDER_KEY: STATE_PROVIDER, PROGRESS_KEY: str(2**31 - 1)}):
        query = (
            stream.writeStream.format("parquet").outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(data)
        )
        query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(data), late


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch that is new since ``checkpoint`` to ``handle(batch, batch_id)``."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
