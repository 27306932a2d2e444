"""Calling a model for each row, with failures as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def called(df: DataFrame, factory: Callable[[], Callable[[list[dict]], list[dict]]], answer: StructType, batch_rows: int = 2048) -> DataFrame:
    """``df`` with the fields of ``answer`` and error.

    ``factory`` makes a client once a task; the client takes up to
    ``batch_rows`` rows and gives an answer for each, in order.  If a batch
    fails its rows are asked for one by one, and one that fails again has null
    answers and the error's text, so that a bad row or an outage never fails
    the job nor passes for an answer.
    """
    names = df.columns
    out = StructType([*df.schema, *answer, StructField("error", StringType())])
    arrow = {f.name: f.dataType for f in answer}

    def ask(client, rows: list[dict]) -> list[tuple[dict, str | None]]:
        try:
            answers = client(rows)
            if len(answers) != len(rows):
                raise ValueError(f"{len(answers)} answers to {len(rows)} rows")
            return [(a, None) for a in answers]
        except Exception as e:  # noqa: BLE001
            if len(rows) > 1:
                return [x for row in rows for x in ask(client, [row])]
            return [({}, f"{type(e).__name__}: {e}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        client = factory()
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_rows):
                part = batch.slice(lo, batch_rows)
                got = ask(client, part.to_pylist())
                columns = [pa.array([a.get(n) for a, _ in got], to_arrow_type(t)) for n, t in arrow.items()]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns, pa.array([e for _, e in got], pa.string())], [*names, *arrow, "error"])

    return df.mapInArrow(run, out)


def accepted(df: DataFrame, least: float, score: str = "intent") -> DataFrame:
    """The rows that were answered and whose score, limited to 0..100, is ``least`` or more; an outage is never an acceptance."""
    limited = F.least(F.greatest(F.col(score), F.lit(0)), F.lit(100))
    return df.where(F.col("error").isNull() & F.col(score).isNotNull()).withColumn(score, limited).where(F.col(score) >= least)


#: What a failure names that comes from what the model can't do, not from an outage.
CAPABILITY = ("json_schema", "response_format", "structured output")


def failure_kind(error: Column) -> Column:
    """``capability`` if the model can't do what was asked of it, so that asking again is of no use, else ``outage``; null without an error."""
    can_not = F.lower(error).rlike("|".join(CAPABILITY)) | error.rlike("^(TypeError|NotImplementedError)\\b")
    return F.when(error.isNotNull(), F.when(can_not, "capability").otherwise("outage"))


def joined_scores(answers: DataFrame, candidates: DataFrame, query: str, item: str, scores: str = "scores", score: str = "intent") -> DataFrame:
    """``candidates`` with the score that an answer gives to each, limited to 0..100.

    ``answers`` (query, scores array<struct<item, score>>).  Scores of items
    that were never candidates are dropped, and so are candidates without a
    score; of several scores of an item the largest counts.
    """
    given = answers.select(query, F.explode(scores).alias("s")).select(query, F.col(f"s.{item}").alias(item), F.col(f"s.{score}").alias(score))
    given = given.where(F.col(item).isNotNull() & F.col(score).isNotNull()).groupBy(query, item).agg(F.max(F.least(F.greatest(score, F.lit(0)), F.lit(100))).alias(score))
    return candidates.join(given, [query, item])
