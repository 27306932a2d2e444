"""Running sums and order statistics that never pass a whole group through one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, within: list[str], block: str, order: list[str], amount: str, out: str) -> DataFrame:
    """``rows`` with the running sum of ``amount`` by ``block`` and ``order``, within ``within``.

    Blocks must follow the order.  Each is summed up in one task; the table of
    the blocks' totals, a row a block, is summed up on top and joined back.
    """
    inside = Window.partitionBy(*within, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*within).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*within, block).agg(F.sum(amount).alias("__total"))
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    return rows.withColumn(out, F.sum(amount).over(inside)).join(offsets, [*within, block]).withColumn(out, F.col(out) + F.col("__before")).drop("__before")


def floor_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float], slices: int = 64) -> DataFrame:
    """(group, n, <name> ...): for each group and share f the value at place int(f * (n - 1)) of its sorted values.

    Null and NaN values and null groups are left out.  Values are counted
    first, so that a group enters with its different values only; those are
    cut for the running sum at approximate quantiles, of which there are
    ``slices`` or as many as the session has shuffle partitions if those are
    more, so that values close together don't end up in one task.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)).select(group, F.col(value).cast("double").alias("v"))
    counts = rows.groupBy(group, "v").agg(F.count("*").alias("c"))
    cuts = max(slices, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    span = counts.groupBy(group).agg(F.sum("c").alias("n"), F.percentile_approx("v", [i / cuts for i in range(1, cuts)], 20 * cuts).alias("cuts"))
    cut = counts.join(span, group).withColumn("slice", F.size(F.filter("cuts", lambda x: x < F.col("v"))))
    placed = running_sum(cut.drop("cuts"), [group], "slice", ["v"], "c", "through")
    at = lambda f: F.floor(F.lit(float(f)) * (F.col("n") - 1))
    hit = lambda f: (F.col("through") > at(f)) & (F.col("through") - F.col("c") <= at(f))
    return placed.groupBy(group).agg(F.max("n").alias("n"), *(F.max(F.when(hit(f), F.col("v"))).alias(name) for name, f in shares.items()))


def longest_runs(df: DataFrame, group: str, order: list[str], hit: Column) -> DataFrame:
    """(group, longest_run): the most rows in a row, in ``order``, for which ``hit`` holds; 0 if none, null hits being none.

    A null group is a group.  Rows that are equal in all of ``order`` have no
    order.  Rows are sorted into ranges of group and order, so a group of any
    size is spread over tasks; each task gives one row for a group, and those
    are put together: at most as many as there are ranges.
    """
    kind = df.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, starts, *columns = _stretches(batch)
            found = [tuple(x) for x in np.stack(columns, 1).tolist()]
            names = keys.take(pa.array(starts))
            if held is not None:
                if held[0].equals(names[0]):
                    found[0] = _joined(held[1], found[0])
                else:
                    yield _runs(held[0].type, [held[0].as_py()], [held[1]], part)
            if len(found) > 1:
                yield _runs(names.type, names[:-1], found[:-1], part)
            held = names[-1], found[-1]
        if held is not None:
            yield _runs(held[0].type, [held[0].as_py()], [held[1]], part)

    marked = df.select(F.col(group).alias("group"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(order)), F.coalesce(hit, F.lit(False)).alias("__hit"))
    keys = ["group", *(f"__{i}" for i in range(len(order)))]
    ranges = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).select("group", "__hit")
    parts = ranges.mapInArrow(run, f"group {kind}, part int, n bigint, head bigint, tail bigint, best bigint")
    listed = parts.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("part", "n", "head", "tail", "best"))).alias("parts"))
    # the longest run so far, and the one that reaches to the end so far
    none = F.struct(F.lit(0).cast("bigint").alias("best"), F.lit(0).cast("bigint").alias("tail"))
    both = lambda a, x: F.struct(
        F.greatest(a["best"], x["best"], a["tail"] + x["head"]).alias("best"),
        F.when(x["head"] == x["n"], a["tail"] + x["n"]).otherwise(x["tail"]).alias("tail"),
    )
    return listed.select(F.col("group").alias(group), F.aggregate("parts", none, both)["best"].alias("longest_run"))


def _stretches(batch: pa.RecordBatch) -> tuple:
    """(keys, where each key's rows begin, their number, the hits at their beginning, at their end, the longest run) of sorted rows."""
    keys = batch.column(0)
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    miss = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
    at = np.arange(len(codes))
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    ends = np.append(starts[1:], len(codes))
    last = np.where(miss, at, -1)
    last[starts] = np.maximum(last[starts], starts - 1)
    run = at - np.maximum.accumulate(last)
    head = np.minimum(np.minimum.reduceat(np.where(miss, at, len(at)), starts), ends) - starts
    return keys, starts, ends - starts, head, run[ends - 1], np.maximum.reduceat(run, starts)


def _joined(a: tuple, b: tuple) -> tuple:
    """(n, head, tail, best) of two stretches, one after the other."""
    return a[0] + b[0], a[0] + b[1] if a[1] == a[0] else a[1], a[2] + b[0] if b[1] == b[0] else b[2], max(a[3], b[3], a[2] + b[1])


def _runs(kind: pa.DataType, keys: list | pa.Array, found: list[tuple], part: int) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*found)]
    keys = keys if isinstance(keys, pa.Array) else pa.array(keys, kind)
    return pa.RecordBatch.from_arrays([keys, pa.array([part] * len(found), pa.int32()), *columns], ["group", "part", "n", "head", "tail", "best"])
