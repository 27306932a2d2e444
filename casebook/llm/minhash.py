"""Near-duplicate records by circulant MinHash, banding and exact verification.

Words are runs of a-z and 0-9 of the lower-cased text; a record's set holds its
different sequences of ``words`` consecutive words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.storage import materialise

# Mixing constants of the public MurmurHash3 and splitmix64 finalisers, and odd multipliers.
_MIX64 = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_MIX32 = (np.uint32(0x7FEB352D), np.uint32(0x846CA68B))
_BASE = 0x9E3779B97F4A7C15
_RUNS = re.compile("[a-z0-9]+")
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True
#: Bytes hashed, and shingles sketched, at a time: small enough for a core's cache.
_BYTES, _BLOCK = 1 << 18, 1 << 15


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX64[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX64[1]
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=np.uint64)
    return _powers


def shingle_hashes(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word sequences of adjoining texts, and each text's number of them.

    ``data`` holds the texts' UTF-8 bytes, ``ends`` where each text ends.
    """
    starts = np.concatenate([[0], ends[:-1]])
    inside = _ALNUM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
    token = mix64((total[last] - total[first]) * inverse[first])
    text_of = np.searchsorted(ends, first, side="right")
    n = len(token) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    mixed = np.zeros(n, np.uint64)
    for i in range(words):
        mixed = mixed * np.uint64(_BASE) + token[i : i + n]
    whole = text_of[:n] == text_of[words - 1 :]
    return mix64(mixed[whole]), np.bincount(text_of[:n][whole], minlength=len(ends))


def _shingled(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first text, hashes, counts) of a batch's texts, some of them at a time."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _BYTES, side="right")) - 1)
        yield lo, *shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo], words)
        lo = hi


def circulant_signatures(items: np.ndarray, counts: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Signatures of ``length`` coordinates for sets given end to end; no set may be empty.

    One permutation, sigma, scatters the 32-bit universe; coordinate k is the
    set's least value under one other permutation, pi, of sigma shifted
    circularly by k.
    """
    out = np.empty((length, len(counts)), np.uint32)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        begin = ends[lo] - counts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + _BLOCK, side="right")))
        block = items[begin : ends[hi - 1]]
        at = ends[lo:hi] - counts[lo:hi] - begin
        sigma = block * np.uint32(2 * seed * 0x3C6EF372 + 1 & 0xFFFFFFFF)
        sigma ^= sigma >> np.uint32(15)
        sigma *= np.uint32(0x2C1B3C6D)
        pi, low = np.empty_like(sigma), np.empty_like(sigma)
        for k in range(length):
            np.add(sigma, np.uint32(k), out=pi)
            np.right_shift(pi, 16, out=low)
            np.bitwise_xor(pi, low, out=pi)
            np.multiply(pi, _MIX32[0], out=pi)
            np.right_shift(pi, 15, out=low)
            np.bitwise_xor(pi, low, out=pi)
            np.multiply(pi, _MIX32[1], out=pi)
            np.minimum.reduceat(pi, at, out=out[k, lo:hi])
        lo = hi
    return out


def _band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each set its ``bands`` keys of 32 bits."""
    out = np.empty((signatures.shape[1], bands), np.uint32)
    for b in range(bands):
        key = np.full(signatures.shape[1], b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key * np.uint64(_BASE) + signatures[b * rows + r])
        out[:, b] = key >> np.uint64(32)
    return out


def _runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, sizes) of the runs of equal keys, once sorted."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(keys)))


def _sketcher(words: int, bands: int, rows: int, buckets: int, longest: int):
    """From (slot, text) to (bucket, keys, slots, hot): a batch's band keys and the slots that have them, dealt to buckets by the key.

    The slots of a key that more than ``longest`` texts of the batch have
    follow under a negative bucket, so that no bucket grows with a hot key; its
    own bucket only gets the key, in ``hot``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, pick = np.unique(batch.column("slot").to_numpy(), return_index=True)
            found, owners = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
            for lo, hashes, counts in _shingled(batch.column("text").take(pa.array(pick)), words):
                some = counts > 0
                if some.any():
                    keys = _band_keys(circulant_signatures((hashes >> np.uint64(32)).astype(np.uint32), counts[some], bands * rows), bands, rows)
                    found.append(keys.ravel())
                    owners.append(np.repeat(slots[lo : lo + len(counts)][some], bands))
            key, slot = np.concatenate(found), np.concatenate(owners)
            order, starts, sizes = _runs_of(key)
            key, slot, many = key[order], slot[order], np.repeat(sizes > longest, sizes)
            bucket = (key.astype(np.int64) * buckets) >> 32
            hot = starts[sizes > longest]
            of = np.unique(np.concatenate([bucket, -1 - bucket[hot]]))
            columns = []
            for mine, values in ((np.where(many, -1 - bucket, bucket), key.view(np.int32)), (np.where(many, -1 - bucket, bucket), slot), (bucket[hot], key[hot].view(np.int32))):
                order = np.argsort(mine, kind="stable")
                columns.append(pa.ListArray.from_arrays(np.append(np.searchsorted(mine[order], of), len(mine)).astype(np.int32), values[order]))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *columns], ["bucket", "keys", "slots", "hot"])

    return run


def _bucket_pairs(longest: int):
    """The pairs of slots that share a band key of a bucket, as (a, b, null), a < b.

    Keys that are hot or have more than ``longest`` slots aren't paired here;
    their slots are passed on as (slot, null, key).
    """

    def run(bucket: pa.Table) -> pa.Table:
        key, slot, hot = (bucket.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "slots", "hot"))
        order = np.lexsort((slot, key))
        key, slot = key[order], slot[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])
        key, slot = key[fresh], slot[fresh]
        _, starts, sizes = _runs_of(key)
        big = (sizes > longest) | np.isin(key[starts], hot)
        if bucket.num_rows and bucket.column("bucket")[0].as_py() < 0:
            big[:] = True
        rest = np.repeat(big, sizes)
        a, b = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for n in np.unique(sizes[~big & (sizes > 1)]):
            at = starts[~big & (sizes == n)][:, None]
            i, j = np.triu_indices(n, 1)
            a.append(slot[at + i].ravel())
            b.append(slot[at + j].ravel())
        both = np.unique((np.concatenate(a).astype(np.int64) << 32) | np.concatenate(b).view(np.uint32))
        a, b = (both >> 32).astype(np.int32), both.astype(np.int32)
        is_rest = np.arange(len(a) + rest.sum()) >= len(a)
        columns = (np.concatenate([a, slot[rest]]), np.concatenate([b, slot[rest]]), np.concatenate([np.zeros(len(a), np.int32), key[rest]]))
        return pa.table([pa.array(columns[0]), pa.array(columns[1], mask=is_rest), pa.array(columns[2], mask=~is_rest)], ["a", "b", "band"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once a batch."""
    for batch in batches:
        _, pick = np.unique(batch.column("h").to_numpy(), return_index=True)
        yield batch.take(pa.array(np.sort(pick)))


def _verifier(words: int, threshold: float, together: int = 1000):
    """Pairs of texts to those that are similar enough, with their Jaccard similarity, ``together`` pairs at a time.

    The sequences stand as 64-bit hashes; a pair within 0.02 of the threshold
    is decided by the sequences themselves.
    """

    def sequences(text: str) -> set[tuple[str, ...]]:
        w = _RUNS.findall(text)
        return set(zip(*(w[i:] for i in range(words))))

    def hashed(texts: pa.Array) -> list[set[int]]:
        out: list[set[int]] = []
        for _, hashes, counts in _shingled(texts, words):
            ends = np.cumsum(counts).tolist()
            values = hashes.tolist()
            out += [set(values[i:j]) for i, j in zip([0, *ends], ends)]
        return out

    def similarity(x: set, y: set) -> float:
        both = len(x & y)
        return both / (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, together):
                batch = whole.slice(lo, together)
                sides = [batch.column(c).dictionary_encode() for c in ("text_a", "text_b")]
                (of_a, of_b), (at_a, at_b) = ([hashed(s.dictionary) for s in sides], [s.indices.to_pylist() for s in sides])
                value = np.array([similarity(of_a[p], of_b[q]) for p, q in zip(at_a, at_b)])
                for i in np.flatnonzero(abs(value - threshold) < 0.02).tolist():
                    value[i] = similarity(*(sequences(batch.column(c)[i].as_py()) for c in ("text_a", "text_b")))
                keep = np.flatnonzero(value >= threshold)
                if len(keep):
                    kept = batch.select(["a", "a2", "b", "b2"]).take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(value[keep])], ["a", "a2", "b", "b2", "similarity"])

    return run


def near_duplicates(
    df: DataFrame, id_col: str, text: Column, words: int = 5, threshold: float = 0.8, bands: int = 44, rows: int = 5, longest: int = 256, bucket_entries: int = 1 << 21,
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the records of ``df`` whose similarity is ``threshold`` or more.

    members (id, h, h2): each record with at least ``words`` words and its
    class; records with the same lower-cased text share a class.  links (a, a2,
    b, b2, similarity): classes, a < b, with the exact Jaccard similarity of
    their word sequences.  Records with fewer words, null and empty texts among
    them, have no sequence and are in no class.

    Bands of ``rows`` coordinates only propose links; pick ``bands`` so that
    (1 - threshold ** rows) ** bands, the chance to miss a pair right at the
    threshold, is as small as needed: 3e-8 for 44 bands at 0.8.  A class is
    sketched once a batch of records however many copies it has.  Texts travel
    through the bands as slots, 32-bit hashes of theirs; texts that share a
    slot are told apart when they are compared.

    Band keys are dealt to as many buckets as hold about ``bucket_entries``
    each and paired there.  A key with more than ``longest`` texts goes
    through a join, which Spark splits where it is skewed.
    """
    base = df.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    base = base.where(F.col("text").rlike("[a-z0-9]" + "+[^a-z0-9]+[a-z0-9]" * (words - 1)))
    base = base.select("id", F.xxhash64("text").alias("h"), F.hash("text").alias("h2"), "text")
    members = materialise(base.select("id", "h", "h2"), "members")
    buckets = max(64, math.ceil(members.count() * bands / bucket_entries))

    keys = base.select(F.col("h2").alias("slot"), "text").mapInArrow(_sketcher(words, bands, rows, buckets, longest), "bucket bigint, keys array<int>, slots array<int>, hot array<int>")
    met = keys.groupBy("bucket").applyInArrow(_bucket_pairs(longest), "a int, b int, band int").distinct()
    met = materialise(met, "met")
    over = met.where("b IS NULL")
    pairs = met.where("b IS NOT NULL").select("a", "b")
    if not over.isEmpty():
        rest = over.select("a", "band").hint("merge").join(over.select(F.col("a").alias("b"), "band"), "band").where("a < b").select("a", "b")
        pairs = pairs.unionByName(rest).distinct()
    # one shuffle of the texts: partitioned by slot, they are grouped by class where they lie
    texts = base.select("h", "h2", "text").mapInArrow(_once, "h bigint, h2 int, text string").repartition("h2").groupBy("h", "h2").agg(F.min("text").alias("text"))
    side = lambda k: texts.select(F.col("h").alias(k), F.col("h2").alias(f"{k}2"), F.col("text").alias(f"text_{k}"))
    pairs = pairs.select(F.col("a").alias("a2"), F.col("b").alias("b2")).join(side("a"), "a2").join(side("b"), "b2")
    links = pairs.select("a", "a2", "b", "b2", "text_a", "text_b").mapInArrow(_verifier(words, threshold), "a bigint, a2 int, b bigint, b2 int, similarity double")
    turned = F.col("a") > F.col("b")
    links = links.select(*(F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("a2", "b2"), ("b", "a"), ("b2", "a2"))), "similarity")
    return members, links


def row_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(row_a, row_b) with row_a < row_b: the links as pairs of records, and the pairs within each class."""
    one = members.select(F.col("id").alias("x"), F.col("h").alias("a"), F.col("h2").alias("a2"))
    two = members.select(F.col("id").alias("y"), F.col("h").alias("b"), F.col("h2").alias("b2"))
    across = links.join(one, ["a", "a2"]).join(two, ["b", "b2"]).select("x", "y")
    within = one.join(two, (F.col("a") == F.col("b")) & (F.col("a2") == F.col("b2")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))


def duplicate_groups(members: DataFrame, links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, group_id, n_links): the group of each record, named by its smallest id, and its links to other texts.

    Groups are the connected components of the links, found by label spreading
    with pointer jumping: classes without a link never enter the rounds.
    """
    pair = lambda h, h2: F.struct(F.col(h).alias("h"), F.col(h2).alias("h2"))
    linked = materialise(links.select(pair("a", "a2").alias("a"), pair("b", "b2").alias("b")), "links")
    edges = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    classes = members.groupBy(pair("h", "h2").alias("c")).agg(F.min("id").alias("label"))
    degree = edges.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("n_links"))
    labels = materialise(classes.join(degree, "c", "left_semi"), "labels")
    first = labels.select("c", F.col("label").alias("own"))
    for _ in range(max_rounds):
        near = edges.join(labels, edges["b"] == labels["c"]).groupBy(F.col("a").alias("c")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "c").select("c", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        jump = first.join(lower, "c").select(F.col("own").alias("label"), F.col("label").alias("next"))
        spread = materialise(lower.join(jump, "label", "left").select("c", F.least("label", "next").alias("label"), "moved"), "labels")
        labels = spread.select("c", "label")
        if spread.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"groups not settled after {max_rounds} rounds")
    named = classes.withColumnRenamed("label", "own").join(labels, "c", "left").join(degree, "c", "left")
    named = named.select("c.h", "c.h2", F.coalesce("label", "own").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(named, ["h", "h2"]).select("id", "group_id", "n_links")
