"""Embedding with a stored memo: each distinct text is embedded once, in whatever run it first occurs.

The memo is a Parquet table (memo_key, vec). Texts whose key it lacks are found by an anti-join, embedded and appended
as a folder of their own, which a repeated run of the same name writes again. A model is loaded once by a worker and
called with batches of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import exists, written
from .vectors import Embedder, Features, unit_rows

BATCH = 100  #: texts that a model is called with
MEMO = "memo_key string, vec array<float>, run string"

Model = Callable[[list[str]], np.ndarray]
_models: dict[str, Model] = {}


def model_embedder(name: str, load: Callable[[], Model], batch: int = BATCH) -> Embedder:
    """An embedder of texts; ``load`` is called once in each worker process, under ``name``."""
    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _models:
            _models[name] = load()
        model = _models[name]
        for part in parts:
            texts = part.fillna("").tolist()
            rows = [model(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series([v for r in rows for v in np.asarray(r, dtype=np.float32)], dtype=object)

    return lambda text: embed(text)


def word_model(dim: int) -> Model:
    """Unit vectors of hashed words, word pieces and pairs: a model without files."""
    known = Features(dim, "md5")
    return lambda texts: unit_rows(pa.array([t.lower().split() for t in texts], pa.list_(pa.string())), known)


def memo_key(text: Column, model: str, dim: int) -> Column:
    """The same text under another model or width is another entry; a null text is the empty one."""
    return T.content_hash(F.lit(model), F.lit(str(dim)), F.coalesce(text, F.lit("")))


class Memo:
    def __init__(self, spark: SparkSession, path: str, model: str, dim: int, embed: Embedder):
        self.spark, self.path, self.model, self.dim, self.embed = spark, path.rstrip("/"), model, dim, embed

    def stored(self) -> DataFrame:
        """(memo_key, vec) of everything embedded so far."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], "memo_key string, vec array<float>")
        return self.spark.read.schema(MEMO).parquet(self.path).select("memo_key", "vec")

    def misses(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """(memo_key, text): the distinct texts that are not stored yet."""
        keyed = texts.select(memo_key(F.col(text), self.model, self.dim).alias("memo_key"), F.coalesce(text, F.lit("")).alias("text"))
        once = keyed.groupBy("memo_key").agg(F.min("text").alias("text"))  # equal keys have equal texts
        return once.join(self.stored().select("memo_key"), "memo_key", "left_anti")

    def fill(self, texts: DataFrame, run: str, text: str = "text") -> int:
        """Embed what is missing; returns how many texts were embedded."""
        folder = f"{self.path}/run={run}"
        new = written(self.misses(texts, text).select("memo_key", self.embed(F.col("text")).cast("array<float>").alias("vec")), "embedded")
        count = new.count()
        if count:
            new.write.mode("overwrite").parquet(folder)
        return count

    def vectors(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """texts with their stored vectors as ``vec``; texts that were never filled have none."""
        keyed = texts.withColumn("memo_key", memo_key(F.col(text), self.model, self.dim))
        return keyed.join(self.stored(), "memo_key", "left").drop("memo_key")
