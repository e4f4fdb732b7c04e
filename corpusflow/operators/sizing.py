"""Size checks that decide whether a side may be broadcast or collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast hint behind a row check; a larger side joins by shuffle.

    The shuffle join leaves skewed keys to adaptive skew-join splitting.
    """
    return F.broadcast(df) if at_most(df, rows) else df


# Bytes of text that one task works on: what windows and sorts hold is in proportion to it.
TASK_BYTES = 8 << 20


def spread(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Hash-partition an input that is read in fewer splits than its text and the cores ask for.

    The number of partitions grows with the bytes of the column ``text``, so a
    task's share does not. (Sizes of files tell little: repeated texts take no
    room in parquet.) A table with splits enough is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    wanted = max(cores, -(-size // TASK_BYTES))
    if df.rdd.getNumPartitions() >= max(2 * cores, wanted):
        return df
    return df.repartition(wanted, *keys)
