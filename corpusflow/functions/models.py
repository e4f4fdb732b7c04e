"""Model seams: measure, embed, score. Each has an offline default.

A model is any function from Columns to a Column, so a ``pandas_udf`` that
loads weights once per worker drops in without changing a job. Replies of a
language model are input tables (see ``operators.replies``); nothing here calls
a service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.scalars import sigmoid

Scorer = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Measure:
    """How long a text is, and how to take a slice of a given length."""

    name: str
    count: Callable[[Column], Column]
    suffix: Callable[[Column, Column], Column]


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{tx.SPACE}+"), lambda w: w != ""))


def _word_suffix(text: Column, budget: Column) -> Column:
    space, other = tx.SPACE, tx.SPACE.replace("[", "[^", 1)
    # Each piece is a word with the space in front of it.
    pieces = F.regexp_extract_all(text, F.lit(f"{space}*{other}+|{space}+$"), F.lit(0))
    trailing = F.when(text.rlike(f"{space}$"), 1).otherwise(0)
    n = F.least(F.size(pieces), budget + trailing)
    return F.array_join(F.slice(pieces, F.size(pieces) - n + 1, n), "")


CHARACTERS = Measure("characters", F.length, F.right)
WORDS = Measure("words", _words, _word_suffix)


def hashed_embedding(df: DataFrame, text: str = "text", dimensions: int = 256) -> DataFrame:
    """Default ``embedding``: hashed term counts scaled to length one."""
    counted = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions).transform(
        df.withColumn("_tokens", tx.tokens(F.col(text)))
    )
    scaled = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return scaled.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
        "_tokens", "_tf", "_unit"
    )


def batch_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """A pandas UDF around a model that is loaded once per Python worker."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.tolist()))

    return embed


def overlap_score(question: Column, passage: Column) -> Column:
    """Default relevance in (0, 1): share of question terms found, as a logit."""
    wanted = F.array_distinct(tx.tokens(question))
    found = F.size(F.array_intersect(wanted, tx.tokens(passage)))
    share = found / F.greatest(F.size(wanted), F.lit(1))
    return sigmoid(share * 12.0 - 6.0)
