"""Session helpers."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and the benchmark; ``shared`` is the folder of intermediate tables."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true",
    } | ({"spark.checkpoint.dir": shared} if shared else {})
    return SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application.

    Workers of a local session don't get the driver's module path either, so
    they are sent the archive as well.
    """
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="spark-")) / here.name), "zip", here.parent, here.name)
    sc.addPyFile(archive)
    _sent.add(sc.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent to the executors before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
