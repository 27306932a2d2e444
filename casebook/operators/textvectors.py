"""Vectors of texts, computed once a distinct text and kept by model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import text_key, trimmed
from casebook.operators.search import with_vectors


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """(text_key, text, n_rows) of the different texts without outer white space; blank ones are left out."""
    rows = df.select(trimmed(F.col(text)).alias("text")).where("text <> ''")
    return rows.groupBy("text").agg(F.count("*").alias("n_rows")).select(text_key(F.col("text")).alias("text_key"), "text", "n_rows")


def missing_texts(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The texts whose key isn't known yet."""
    return texts.join(known.select("text_key"), "text_key", "left_anti")


def still_used(vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """The vectors whose text still exists."""
    return vectors.join(texts.select("text_key"), "text_key", "left_semi")


def encoded(texts: DataFrame, encode: Callable[[list[str]], np.ndarray], model: str) -> DataFrame:
    """(model, text_key, vec) with unit vectors; a batch of texts a call, an all-zero vector stays zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(encode(batch.column("text").to_pylist()), float).reshape(batch.num_rows, -1)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)
            width = unit.shape[1] if batch.num_rows else 0
            offsets = np.arange(0, batch.num_rows * width + 1, width or 1, dtype=np.int32)[: batch.num_rows + 1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([model] * batch.num_rows), batch.column("text_key"), lists], ["model", "text_key", "vec"])

    return texts.select("text_key", "text").mapInArrow(run, "model string, text_key string, vec array<float>")


def pair_cosines(pairs: DataFrame, a: str, b: str, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """``pairs`` with the cosine of the texts ``a`` and ``b``, 0 where one has an all-zero vector.

    A text is encoded once however many pairs it stands in; its vector is
    looked up for both sides by its key.
    """
    keyed = pairs.withColumn("__a", text_key(F.col(a))).withColumn("__b", text_key(F.col(b)))
    texts = keyed.select(F.explode(F.array(F.struct(F.col("__a").alias("text_key"), F.col(a).alias("text")), F.struct(F.col("__b").alias("text_key"), F.col(b).alias("text")))).alias("t")).select("t.*")
    vectors = with_vectors(texts.dropDuplicates(["text_key"]), "text", encode)
    side = lambda k, v: vectors.select(F.col("text_key").alias(k), F.col("vec").alias(v))
    both = keyed.join(side("__a", "__u"), "__a").join(side("__b", "__v"), "__b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot("__u", "__u") * dot("__v", "__v"))
    return both.withColumn("cosine", F.when(norm > 0, dot("__u", "__v") / norm).otherwise(0.0)).drop("__a", "__b", "__u", "__v")
