"""Mixing sources to target shares by weighted fair queueing.

Each source's texts are put in a random order.  A text's virtual finish time is
the source's tokens up to and with it, over the source's share; the texts of
all sources in the order of that time keep to the shares at every point, and
the mixture is what comes before the total budget is used up.

Running sums never pass through one task: a source is split into blocks of its
random order and the mixture into blocks of virtual time, each block is summed
up by itself, and the small table of the blocks' totals is summed up on top.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.operators.sums import running_sum
from casebook.storage import materialise

#: Where the tokenizer's ranks are; a parameter of everything below.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of these ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER, out: str = "tokens") -> DataFrame:
    """``df`` with the number of tokens of ``text`` in ``out`` and without the text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            coded = batch.column(text).dictionary_encode()  # copies in a batch are counted once
            n = pa.array([len(encode(t)) for t in coded.dictionary.to_pylist()], pa.int64())
            yield batch.drop_columns([text]).append_column(out, n.take(coded.indices).fill_null(0))

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text]
    return df.mapInArrow(run, ", ".join([*kept, f"`{out}` bigint"]))


def source_name(source: Column) -> Column:
    """One spelling: lower case, without outer blanks, words joined by low lines."""
    return F.lower(F.regexp_replace(F.trim(source), r"[\s_-]+", "_"))


def source_texts(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): each different text of a targeted source, once.

    Of copies, within and across sources, the one with the smallest doc_id
    stays; texts without a token, null ones among them, are left out.
    """
    wanted = targets.select(source_name(F.col("source")).alias("source")).where(F.col("source").isNotNull()).distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.unhex(F.md5(text)).alias("key"), F.col(text).alias("text"))
    rows = with_tokens(rows.where(F.col("text").isNotNull()).join(_small(wanted), "source"), "text", tokenizer)
    first = rows.where("tokens > 0").groupBy("key").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("first"))
    return materialise(first.select("first.*"), "source-texts")


def _small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Marked for broadcast if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def mixture(texts: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, block_rows: int | None = None, most_sources: int = 100_000) -> DataFrame:
    """(place, doc_id, source, copy, tokens, finish): the mixture in its order.

    ``texts`` as from source_texts; ``targets`` (source, target_share,
    max_repeats) one row a source.  copy counts a text's uses from 0, below its
    source's max_repeats; each pass over a source has its own random order.
    Shares are taken over the targeted sources that have texts.  Without a
    ``budget``, it is the largest at which every such source can fill its
    share; beyond that, sources that run out end and the others go on.  Of
    targets whose share or repeats are null or not positive, no text is used.
    place is the number of tokens before the text.  More than ``most_sources``
    sources with texts are an error.

    A block has about ``block_rows`` texts, by default 20,000 or the root of
    their number if that is more, so that the blocks' totals are as few.
    """
    spark = texts.sparkSession
    goal = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("bigint").alias("repeats"))
    goal = goal.where("source IS NOT NULL AND share > 0 AND repeats > 0").groupBy("source").agg(F.max("share").alias("share"), F.max("repeats").alias("repeats"))
    # one row a targeted source, with its texts' totals
    sizes = texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).join(goal, "source").limit(most_sources + 1).collect()
    if len(sizes) > most_sources:
        raise ValueError(f"more than {most_sources:,} targeted sources with texts; their shares are planned on the driver")
    schema = "place bigint, doc_id bigint, source string, copy bigint, tokens bigint, finish double"
    if not sizes:
        return spark.createDataFrame([], schema)
    whole = sum(r["share"] for r in sizes)
    if budget is None:
        budget = math.floor(min(r["repeats"] * r["tokens"] / (r["share"] / whole) for r in sizes))
    plan = []
    end = float(budget)
    if any(r["repeats"] * r["tokens"] < r["share"] / whole * budget for r in sizes):
        end = math.inf
    for r in sizes:
        need = min(r["repeats"], math.floor(r["share"] / whole * end / r["tokens"]) + 1) if end < math.inf else r["repeats"]
        plan.append((r["source"], r["share"] / whole, need, max(1, math.ceil(r["n"] / (block_rows or max(20_000, math.isqrt(r["n"])))))))
    planned = spark.createDataFrame(plan, "source string, weight double, passes bigint, blocks bigint")
    uses = texts.join(_small(planned), "source").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)))
    uses = uses.withColumn("u", F.xxhash64(F.lit(seed), "copy", "doc_id")).withColumn("block", F.col("copy") * F.col("blocks") + F.pmod(F.shiftright("u", 8), "blocks"))
    queued = running_sum(uses, ["source"], "block", ["u", "doc_id"], "tokens", "through").withColumn("finish", F.col("through") / F.col("weight"))
    queued = queued.where(F.col("finish") <= end) if end < math.inf else queued
    queued = materialise(queued.select("doc_id", "source", "copy", "tokens", "finish"), "queued")
    n = queued.count()
    slices = max(1, math.ceil(n / (block_rows or max(20_000, math.isqrt(n)))))
    # ranges of the order with about as many texts each, written so that they stay as they are
    order = ["finish", "source", "doc_id", "copy"]
    cut = materialise(queued.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()), "sliced")
    placed = running_sum(cut, [], "slice", order, "tokens", "through")
    placed = placed.where(F.col("through") <= budget).withColumn("place", F.col("through") - F.col("tokens"))
    return placed.orderBy("finish", "source", "doc_id", "copy").select("place", "doc_id", "source", "copy", "tokens", "finish")


def reached_shares(mixed: DataFrame, texts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, n_uses, n_texts, most_uses, tokens, actual_share) of every target."""
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    used = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    used = used.groupBy("source").agg(F.sum("uses").alias("n_uses"), F.count("*").alias("n_texts"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("tokens"))
    there = texts.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    every = goal.join(there, "source", "left").join(used, "source", "left").fillna(0, ["available_tokens", "n_uses", "n_texts", "most_uses", "tokens"])
    total = mixed.agg(F.sum("tokens")).first()[0] or 1
    return every.withColumn("actual_share", F.col("tokens") / F.lit(float(total)))
