"""Exact nearest records within a scope."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TOKENS = re.compile("[a-z0-9]+")
#: Single precision decides which rows can be among the best; whatever lies this close to them is scored again in double.
_MARGIN = 1e-4


class _Buckets(dict):
    """token -> one of 256 buckets, by its MD5 digest; kept for the tokens seen."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[token] = found = hashlib.md5(token.encode()).digest()[0]
        return found


_buckets = _Buckets()


def hashed_counts(texts: list[str]) -> np.ndarray:
    """For each text the counts of its tokens in 256 buckets: a stand-in for an embedding."""
    out = np.zeros((len(texts), 256), np.float32)
    for i, t in enumerate(texts):
        if found := [_buckets[x] for x in _TOKENS.findall((t or "").lower())]:
            out[i] = np.bincount(found, minlength=256)
    return out


def cosine(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each query with each row, limited to 0..1; 0 where a vector is all zeros."""
    queries, rows = queries.astype(float), rows.astype(float)
    norms = (queries * queries).sum(1)[:, None] * (rows * rows).sum(1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        scores = np.where(norms > 0, (queries @ rows.T) / np.sqrt(norms), 0.0)
    return scores.clip(0.0, 1.0)


def with_vectors(df: DataFrame, content: str, encode: Callable[[list], np.ndarray], out: str = "vec") -> DataFrame:
    """``df`` with the vector of ``content`` as ``out`` (array<float>) in its place; rows without content are left out.

    A content that stands several times in a batch is encoded once.
    """
    kept = [f for f in df.schema if f.name != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column(content)
                if pa.types.is_string(column.type):
                    coded = column.dictionary_encode()
                    vectors = np.asarray(encode(coded.dictionary.to_pylist()), np.float32)[coded.indices.to_numpy()]
                else:
                    vectors = np.asarray(encode(column.to_pylist()), np.float32)
                lists = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32), pa.array(vectors.ravel()))
                yield batch.drop_columns([content]).append_column(out, lists)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` array<float>"])
    return df.where(F.col(content).isNotNull()).mapInArrow(run, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _numbers(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """The texts of several columns as numbers in the order of the texts; -1 is null."""
    texts = [np.array([x or "" for x in c.to_pylist()], object) for c in columns]
    codes = np.unique(np.concatenate(texts), return_inverse=True)[1]
    split = np.split(codes, np.cumsum([len(t) for t in texts])[:-1])
    return [np.where(c.is_null().to_numpy(), -1, part) for c, part in zip(columns, split)]


def _best(scores: np.ndarray, rescore: Callable[[np.ndarray], np.ndarray], exact: np.ndarray, names: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best rows of different names, looking at more and more of the best scores."""
    most = 4 * k
    while True:
        some = np.arange(len(ids)) if most >= len(ids) else np.flatnonzero(scores >= np.partition(scores, -most)[-most] - _MARGIN)
        sure = rescore(some)
        order = np.lexsort((ids[some], -names[some], ~exact[some], -sure))
        first = np.sort(np.unique(names[some[order]], return_index=True)[1])
        if len(first) >= k or len(some) == len(ids):
            return some[order[first[:k]]], sure[order[first[:k]]]
        most *= 8


def nearest_in_scope(
    queries: DataFrame, rows: DataFrame, encode: Callable[[list], np.ndarray], k: int, least: float = 0.0,
    bucket_rows: int = 20_000, block_queries: int = 2_000,
) -> DataFrame:
    """(query_id, row_id, item, score, exact, place): each query's ``k`` best items among the rows of its scope.

    ``queries`` (query_id, scope, own, content), ``rows`` (row_id, scope, own,
    item, content).  Every query meets every row of its scope; exact says that
    both have the same ``own``.  Order: score, exact and item descending, then
    row_id ascending; an item counts once, with its best row; scores below
    ``least`` are left out afterwards.  Queries and rows without content are
    left out; a null item is an empty one.

    Each row is encoded once, before it is dealt, and travels as its vector.  A
    scope's rows are dealt to buckets of about ``bucket_rows`` and its queries
    to blocks of about ``block_queries``, so that no task holds a whole scope
    however large.  A bucket and a block give the k best items of each query,
    128 queries at a time; a window over those gives the result.  Scopes
    without a query end at the first join.
    """
    asked = queries.where(F.col("scope").isNotNull()).groupBy("scope").agg(F.count("*").alias("__nq"))
    sizes = rows.join(asked, "scope").groupBy("scope").agg(F.count("*").alias("__nr"), F.first("__nq").alias("__nq"))
    sizes = sizes.select("scope", F.ceil(F.col("__nr") / bucket_rows).alias("__buckets"), F.ceil(F.col("__nq") / block_queries).alias("__blocks"))
    met_rows = with_vectors(rows.join(sizes, "scope").select("scope", "__buckets", "__blocks", "row_id", "own", "item", "content"), "content", encode)
    met_queries = with_vectors(queries.join(sizes, "scope").select("scope", "__buckets", "__blocks", "query_id", "own", "content"), "content", encode)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    dealt_rows = met_rows.withColumn("__bucket", F.pmod(F.xxhash64("row_id"), "__buckets")).withColumn("__block", every("__blocks"))
    dealt_queries = met_queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), "__blocks")).withColumn("__bucket", every("__buckets"))
    keys = ["scope", "__bucket", "__block"]

    def best(asked: pa.Table, given: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        if asked.num_rows and given.num_rows:
            vectors, of = _matrix(given.column("vec")), _matrix(asked.column("vec"))
            length, of_length = (np.sqrt((m.astype(float) ** 2).sum(1)) for m in (vectors, of))
            unit = vectors / np.where(length > 0, length, 1).astype(np.float32)[:, None]
            ids, query_ids = given.column("row_id").to_numpy(), asked.column("query_id").to_pylist()
            items = given.column("item").to_pylist()
            names, (own, mine) = _numbers(given.column("item").fill_null(""))[0], _numbers(given.column("own"), asked.column("own"))
            for lo in range(0, len(of), 128):
                near = of[lo : lo + 128] / np.where(of_length[lo : lo + 128] > 0, of_length[lo : lo + 128], 1).astype(np.float32)[:, None] @ unit.T
                for q, scores in enumerate(near, lo):

                    def rescore(some: np.ndarray, q=q) -> np.ndarray:
                        norms = length[some] * of_length[q]
                        return np.where(norms > 0, vectors[some].astype(float) @ of[q].astype(float) / np.where(norms > 0, norms, 1), 0.0).clip(0.0, 1.0)

                    exact = (own == mine[q]) & (own >= 0)
                    places, sure = _best(scores, rescore, exact, names, ids, k)
                    for i, score in zip(places.tolist(), sure.tolist()):
                        for to, value in zip(columns, (query_ids[q], int(ids[i]), items[i] or "", score, bool(exact[i]))):
                            to.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "row_id", "item", "score", "exact"])

    near = dealt_queries.select(*keys, "query_id", "own", "vec").groupBy(*keys).cogroup(dealt_rows.select(*keys, "row_id", "own", "item", "vec").groupBy(*keys))
    found = near.applyInArrow(best, "query_id bigint, row_id bigint, item string, score double, exact boolean")
    order = [F.col("score").desc(), F.col("exact").desc(), F.col("item").desc(), F.col("row_id").asc()]
    once = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "item").orderBy(*order))).where("place = 1")
    top = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k)
    return top.where(F.col("score") >= least)
