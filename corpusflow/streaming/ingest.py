"""Streams that keep stores up to date: new documents, conversation marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.memory import COMPACTION_TRIGGER, HISTORY_LIMIT, compaction_slice
from corpusflow.plans.ingest import store_batch
from corpusflow.session import staged
from corpusflow.sources import store as st
from corpusflow.streaming.sinks import run_batches

LOG_BUCKETS = 64


def ingest_stream(files: DataFrame, folder: str, checkpoint: str | None = None, **options) -> None:
    """Every micro-batch of files becomes searchable in the store.

    The checkpoint lies beside the store, so a later call goes on where the
    last one ended.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        store_batch(staged(batch), folder, **options)

    run_batches(files, handle, checkpoint or f"{folder}/checkpoint")


def compaction_stream(
    messages: DataFrame, folder: str, limit: int = HISTORY_LIMIT, trigger: int = COMPACTION_TRIGGER,
    checkpoint: str | None = None,
) -> None:
    """Move each conversation's high-water mark as messages arrive.

    The message log grows by one folder per batch, written by batch number, so
    a repeated batch changes nothing; the checkpoint beside it makes later
    calls go on. Only the log's buckets that hold conversations of the batch
    are read, and a mark never moves back.
    """
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(LOG_BUCKETS)).cast("int").alias("bucket")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = staged(batch)
        batch.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/messages/batch={batch_id}")
        touched = batch.select("conv_id", bucket).distinct()
        buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most LOG_BUCKETS
        log = spark.read.parquet(f"{folder}/messages").filter(F.col("bucket").isin(buckets))
        log = log.join(touched, ["conv_id", "bucket"], "left_semi").select(*batch.columns)
        stored = st.read_store(spark, f"{folder}/marks", "conv_id")
        marks = spark.createDataFrame([], "conv_id bigint, covered_through_id bigint") if stored is None else stored
        moved = compaction_slice(log, marks, limit, trigger).groupBy("conv_id").agg(
            F.max("msg_id").alias("covered_through_id")
        )
        st.append(moved, f"{folder}/marks")

    run_batches(messages, handle, checkpoint or f"{folder}/checkpoint")
