"""Keeping the text vectors of a growing history up to date, micro-batch by micro-batch."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.operators.search import hashed_counts
from casebook.operators.textvectors import distinct_texts, encoded, missing_texts, still_used
from casebook.storage import remove, shared_dir

VECTORS = "model string, text_key string, vec array<float>, batch string"


def stored_vectors(spark: SparkSession, root: str, model: str) -> DataFrame:
    """(model, text_key, vec, batch): the vectors of ``model`` kept under ``root``; none if nothing is."""
    return spark.read.schema(VECTORS).option("ignoreMissingFiles", "true").option("recursiveFileLookup", "false").parquet(_folder(spark, root)).where(F.col("model") == model)


def _folder(spark: SparkSession, root: str) -> str:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/vectors")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return f"{root}/vectors"


def ingest(
    spark: SparkSession, path: str, text: str, root: str | None = None, model: str = "hashed-256", encode: Callable[[list[str]], np.ndarray] = hashed_counts, files_per_batch: int = 4,
) -> DataFrame:
    """(model, text_key, vec, batch) of the different texts of the files under ``path``, read as a stream until there are no more.

    Vectors are kept under ``root`` by model, and so is how far the stream has
    come: a later run with the same ``root`` reads new files only and encodes
    only texts that the model has no vector of.  Each micro-batch is written
    under its own name, so that a repeated one replaces itself.  Without
    ``root`` a new folder of the shared one is taken.
    """
    root = root or f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"

    def add(rows: DataFrame, batch: int) -> None:
        mine = f"{batch:012d}"
        known = stored_vectors(rows.sparkSession, root, model).where(F.col("batch") != mine)
        fresh = missing_texts(distinct_texts(rows, text), known)
        encoded(fresh, encode, model).drop("model").write.mode("overwrite").parquet(f"{_folder(rows.sparkSession, root)}/model={model}/batch={mine}")

    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    # a stream reads folders; a single file is picked out of its own
    stream = reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path)) if os.path.isfile(path) else reader.parquet(path)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{root}/progress/model={model}").trigger(availableNow=True).start().awaitTermination()
    return stored_vectors(spark, root, model)


def prune(spark: SparkSession, root: str, model: str, texts: DataFrame) -> DataFrame:
    """Keep only the vectors of ``model`` whose text is among ``texts`` (text_key), and no other model's; gives what is kept.

    The vectors that stay are written to a batch of their own before the old
    batches are removed, so that a run that ends early loses none.  Texts that
    come back later are encoded again with the files that bring them.
    """
    kept = f"kept-{uuid.uuid4().hex}"
    vectors = f"{_folder(spark, root)}/model={model}"
    old = [r["batch"] for r in stored_vectors(spark, root, model).select("batch").distinct().collect()]
    still_used(stored_vectors(spark, root, model), texts).dropDuplicates(["text_key"]).drop("model", "batch").write.parquet(f"{vectors}/batch={kept}")
    for batch in old:
        remove(spark, f"{vectors}/batch={batch}")
    drop_other_models(spark, root, model)
    return stored_vectors(spark, root, model)


def drop_other_models(spark: SparkSession, root: str, model: str) -> None:
    """Remove the vectors, and the progress, of all models but ``model``."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    for part in ("vectors", "progress"):
        folder = place(f"{root}/{part}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.listStatus(folder) if files.exists(folder) else ():
            if found.getPath().getName().startswith("model=") and found.getPath().getName() != f"model={model}":
                files.delete(found.getPath(), True)
