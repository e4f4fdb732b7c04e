"""Small helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of one slice of an Arrow batch hold at most so many bytes (a single
# longer text is a slice of its own), so that a task's memory has a bound.
SLICE_BYTES = 8 << 20
# Rows of one Arrow batch between the JVM and a Python worker: texts may be long.
BATCH_ROWS = 1_000


def worker_state(name: str, make: Callable[[], object]) -> object:
    """A value kept by a Python worker from task to task.

    Task functions travel by value, so their own globals are new in each task;
    vocabularies and caches hang on a module object of the worker instead.
    Only values that can be made again belong here.
    """
    holder = sys.modules.setdefault("_corpusflow_worker", types.ModuleType("_corpusflow_worker"))
    if name not in holder.__dict__:
        setattr(holder, name, make())
    return getattr(holder, name)


def forget_worker_state() -> None:
    """Drop what earlier operators keep in this worker; operators that need much memory of their own begin with it.

    Whoever still wants a value makes it again.
    """
    held = vars(sys.modules.get("_corpusflow_worker", types.ModuleType("_corpusflow_worker")))
    names = [name for name in held if not name.startswith("__")]
    for name in names:
        del held[name]
    if names:
        gc.collect()
        released()


def with_small_batches(spark: SparkSession) -> SparkSession:
    """Sessions of the text operators hand over few rows at once, which bounds the memory of workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def released() -> None:
    """Give memory of finished batches back; workers live on and others share the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def whole_text(text: str | Column = "text") -> Column:
    """The text column, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the values of one string or binary column stay below ``limit`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        values = batch.column(column)
        lengths = pa.compute.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    released()


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for every length, one after another."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(starts, lengths)


def mix64(values: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """A seeded 64-bit mixer over unsigned 64-bit values; seeds may differ by value."""
    with np.errstate(over="ignore"):
        step = (np.asarray(seed, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = values.astype(np.uint64) + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def scaled(values: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values spread evenly over 0..size-1 (size below 2**31)."""
    return ((values >> np.uint64(32)) * np.asarray(size, dtype=np.uint64) >> np.uint64(32)).astype(np.int64)


def sorted_by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key together in one partition, in the given order."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by ``key``; one key is held at a time.

    Cheaper than a grouped function call per key when keys are many and small.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        keys = table[key].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.concat_tables(held)
