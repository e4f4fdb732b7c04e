"""Named queries over the supplied tables, each next to its SQL statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpusflow.operators.sizing import spread
from corpusflow.session import prepare

# Tables whose rows are costly to process, with their text and the key they are spread on.
SPREAD_KEYS = {"documents": ("text", "doc_id"), "pages": ("html", "page_id")}


@dataclass(frozen=True)
class Entry:
    run: Callable[["Tables"], DataFrame]
    sql: str | None


class Tables:
    """Lazy access to one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(self.path(name))
        return spread(df, *SPREAD_KEYS[name]) if name in SPREAD_KEYS else df


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name!r} is already registered")
        ENTRIES[name] = Entry(fn, sql)
        return fn

    return register


# Positions and counts leave every query as 64-bit numbers.
WIDE = frozenset(
    "rank list_no found_by_variant variant_no block_no level raw_level first_block chunk_index n_chars line_no "
    "piece_no chunk_no pos prop_no longest recency stated total".split()
)


def widened(df: DataFrame) -> DataFrame:
    narrow = [f.name for f in df.schema if f.name in WIDE and f.dataType.simpleString() == "int"]
    return df.withColumns({name: df[name].cast("bigint") for name in narrow}) if narrow else df


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return widened(entry.run(Tables(prepare(spark), sf_dir)))

    return run
