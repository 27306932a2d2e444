"""Ranking scored candidates: one row an item, gates, shortlists and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limited(score: Column) -> Column:
    """The score within 0..1; null and NaN stay null."""
    return F.when(score.isNotNull() & ~F.isnan(score), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def best_items(df: DataFrame, query: str, item: str, order: list[Column], out: str = "place") -> DataFrame:
    """The best row of each item within each query, with its place among them from 1.

    Both windows are cut by their filters, which Spark does before the shuffle
    as well where a caller keeps the first places only.
    """
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(query, item).orderBy(*order))).where("__n = 1").drop("__n")
    return first.withColumn(out, F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def shortlist(df: DataFrame, query: str, item: str, score: str, order: list[Column], k: int, least: float) -> DataFrame:
    """The ``k`` best items of each query whose score is ``least`` or more, with their places."""
    return best_items(df.where(F.col(score) >= least), query, item, order).where(F.col("place") <= k)


def counters(df: DataFrame, query: str, item: str, score: Column, least: float) -> DataFrame:
    """(query, matched, considered, qualified, top_score): rows, scored rows, items with a score of ``least`` or more, the largest score."""
    return df.groupBy(query).agg(
        F.count("*").alias("matched"), F.count(score).alias("considered"),
        F.count_distinct(F.when(score >= least, F.col(item))).alias("qualified"), F.max(score).alias("top_score"),
    )
