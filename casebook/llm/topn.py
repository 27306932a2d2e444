"""The N best items of every group by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_n(group: str, distinct: str | None, n: int):
    """Passes over sorted batches and keeps the first n rows of each group.

    Only the group at hand, how many rows it has given and their distinct
    values (n at most) are kept between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = object()
        count, seen = 0, set()
        for batch in batches:
            keys = batch.column(group)
            # a run of equal keys at a time
            last = batch.num_rows - 1
            if last < 0:
                continue
            differs = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, last)), True).to_pylist() if last else []
            starts = [0, *(i + 1 for i, d in enumerate(differs) if d), batch.num_rows]
            ids = batch.column(distinct).to_pylist() if distinct else None
            take: list[int] = []
            for start, stop in zip(starts, starts[1:]):
                key = keys[start].as_py()
                if key != current:
                    current, count, seen = key, 0, set()
                for i in range(start, stop):
                    if count >= n:
                        break
                    if ids is not None:
                        if ids[i] in seen:
                            continue
                        seen.add(ids[i])
                    count += 1
                    take.append(i)
            if take:
                yield batch.take(pa.array(take, pa.int32()))

    return run


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int, distinct: str | None = None) -> DataFrame:
    """The first ``n`` rows of each ``group`` in ``order``; with ``distinct``, the first row of each of its values only.

    Each input partition is sorted by group and order and cut to n rows a
    group before anything is shuffled, so that a group of many millions of rows
    sends only n from each partition.  What is left is hash-partitioned by
    group, sorted again and streamed as Arrow batches, n rows out a group.

    A null group is a group of its own; a null ``distinct`` is one value.  Rows
    equal in all of ``order`` are interchangeable: end it with a unique column.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = _first_n(group, distinct, n)
    near = df.sortWithinPartitions(F.col(group).asc_nulls_first(), *order).mapInArrow(rows, df.schema)
    return near.repartition(F.col(group)).sortWithinPartitions(F.col(group).asc_nulls_first(), *order).mapInArrow(rows, df.schema)
