import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from casebook.llm import minhash

SCHEMA = "id long, text string"


def grams(t, words):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return set(zip(*(w[i:] for i in range(words))))


def brute(rows, words, threshold):
    sets = {i: grams(t, words) for i, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def made(n=60):
    random.seed(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(n):
        base = [random.choice(words) for _ in range(40)]
        rows.append(" ".join(base))
        if g % 2:
            edited = base[:]
            edited[random.randrange(40)] = "edit"
            rows.append(" ".join(edited).upper() + "!")
        if g % 5 == 0:
            rows += [" ".join(base)] * 2
    return [(i, t) for i, t in enumerate([*rows, None, "", "one two", "é ü ß", "one two three"])]


@pytest.mark.parametrize("longest", [2, 256])
def test_pairs_and_groups_against_brute_force(spark, longest):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    members, links = minhash.near_duplicates(df, "id", F.col("text"), words=3, threshold=0.6, bands=40, rows=4, longest=longest)
    got = [(r.row_a, r.row_b) for r in minhash.row_pairs(members, links).collect()]
    expected = brute(rows, 3, 0.6)
    assert len(got) == len(set(got)) and set(got) == expected
    parent = {i: i for i, t in rows if grams(t, 3)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in expected:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    groups = {r.id: r.group_id for r in minhash.duplicate_groups(members, links).collect()}
    assert groups == {i: root(i) for i in parent}


def test_chain_of_links_is_one_group(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 40])) for i in range(12)]
    members, links = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", F.col("text"), words=3, threshold=0.8, bands=60, rows=3)
    assert {r.group_id for r in minhash.duplicate_groups(members, links).collect()} == {0}


@pytest.mark.parametrize("longest", [1, 9, 50])
def test_every_shared_key_gives_a_pair(longest):
    random.seed(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(random.choice(words) for _ in range(5)) for _ in range(90)] + ["w1 w2 w3 w4 w5"] * 3
    bands, rows, every = 6, 2, {}
    sketched = []
    for size in (7, 30, 93):
        batches = [pa.RecordBatch.from_arrays([pa.array(range(i, min(i + size, 93)), pa.int32()), pa.array(texts[i : i + size])], ["slot", "text"]) for i in range(0, 93, size)]
        sketched.append(pa.Table.from_batches(minhash._sketcher(3, bands, rows, 5, longest)(iter(batches))))
    keyed = pa.Table.from_batches(minhash._sketcher(3, bands, rows, 1, 1000)(iter([pa.RecordBatch.from_arrays([pa.array(range(93), pa.int32()), pa.array(texts)], ["slot", "text"])])))
    for key, slot in zip(keyed["keys"].combine_chunks().flatten().to_pylist(), keyed["slots"].combine_chunks().flatten().to_pylist()):
        every.setdefault(key, set()).add(slot)
    for table in sketched:
        out = []
        for bucket in sorted(set(table["bucket"].to_pylist())):
            out += minhash._bucket_pairs(longest)(table.filter(pa.compute.equal(table["bucket"], bucket))).to_pylist()
        pairs = {(r["a"], r["b"]) for r in out if r["b"] is not None}
        over: dict = {}
        for r in out:
            if r["b"] is None:
                over.setdefault(r["band"], set()).add(r["a"])
        for key, slots in every.items():
            if len(slots) > longest:
                assert over[key] == slots
            else:
                assert key not in over and {(a, b) for a in slots for b in slots if a < b} <= pairs


def test_hot_copies_stay_one_class(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("the same six words once more")).otherwise(F.concat_ws(" ", F.lit("a b c d e"), "id")).alias("text"))
    members, links = minhash.near_duplicates(df, "id", F.col("text"))
    groups = minhash.duplicate_groups(members, links)
    assert groups.where("group_id = 1").count() == 2000 and links.where("a = b").count() == 0


def test_signature_estimates_similarity():
    random.seed(1)
    x, y = set(range(400)), set(range(200, 600))
    items = np.array([*(hash((v, "s")) & 0xFFFFFFFF for v in x), *(hash((v, "s")) & 0xFFFFFFFF for v in y)], np.uint32)
    s = minhash.circulant_signatures(items, np.array([400, 400]), 1024)
    assert abs((s[0::1, 0] == s[:, 1]).mean() - 1 / 3) < 0.06


def test_hashes_follow_words_only():
    def one(texts):
        data = [t.encode() for t in texts]
        return minhash.shingle_hashes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]), 3)

    items, counts = one(["a b c d", "a-b, c.d", "ab", "", "x a b c d"])
    assert counts.tolist() == [2, 2, 0, 0, 3] and (items[:2] == items[2:4]).all() and (items[-2:] == items[:2]).all()


def test_empty_table(spark):
    members, links = minhash.near_duplicates(spark.createDataFrame([], SCHEMA), "id", F.col("text"))
    assert members.count() == links.count() == minhash.duplicate_groups(members, links).count() == 0


def test_no_link_of_the_real_table_is_lost(spark):
    from casebook.llm import queries
    from tests.conftest import against_sql

    for name in ("p4_found", "p4_groups"):
        assert against_sql(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name])
