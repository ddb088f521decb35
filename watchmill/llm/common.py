"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.sources.scratch import materialize

Query = Callable[[SparkSession, str], DataFrame]

#: Rows given to a function at once.
AT_ONCE = 500

__all__ = ["Query", "WordCache", "let", "map_frames", "materialize", "table", "texts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the whole text, a null text as the empty one; other columns, of whatever name, are left out."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def map_frames(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a function to all rows of a frame, some hundred at a time, so that what it makes of them stays small."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), AT_ONCE):
                yield function(frame.iloc[start : start + AT_ONCE].reset_index(drop=True))

    return df.mapInPandas(over, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once for all its uses in an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


class WordCache(dict):
    """What a function gives for words met before.

    Words repeat, so a worker meets most of them again. When ``limit`` words are kept, they become the old ones and those not
    met again are let go with the next change, so at most twice as many are held. The result never depends on what is kept.
    """

    def __init__(self, function: Callable, limit: int = 500_000):
        super().__init__()
        self.function, self.limit, self.old = function, limit, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.function(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value
