import pytest
from pyspark.sql import functions as F

from casebook.llm import mixing


def setting(spark):
    docs = [(i, "big", f"text number {i} of the big source") for i in range(400)]
    docs += [(1000 + i, " Small" if i % 2 else "small", f"a small text, number {i}") for i in range(30)]
    docs += [(2000, "big", "text number 1 of the big source"), (2001, "big", None), (2002, "big", ""), (2003, None, "no source"), (2004, "other", "no target")]
    targets = [("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")



def test_shares_repeats_and_order(spark):
    docs, targets = setting(spark)
    texts = mixing.source_texts(docs, targets)
    assert texts.count() == 430 and {r["source"] for r in texts.select("source").distinct().collect()} == {"big", "small"}
    for block_rows in (20_000, 7):
        rows = mixing.mixture(texts, targets, block_rows=block_rows).collect()
        uses: dict = {}
        for r in rows:
            uses.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
        assert all(len(c) == len(set(c)) <= (1 if s == "big" else 4) for (s, _), c in uses.items())
        place = 0
        for a, b in zip(rows, rows[1:]):
            assert a["finish"] <= b["finish"]
        for r in rows:  # gapless running sum
            assert r["place"] == place
            place += r["tokens"]
        got = {s: sum(r["tokens"] for r in rows if r["source"] == s) / place for s in ("big", "small")}
        assert abs(got["big"] - 2 / 3) < 0.02 and abs(got["small"] - 1 / 3) < 0.02


def test_same_mixture_for_any_block_size(spark):
    docs, targets = setting(spark)
    texts = mixing.source_texts(docs, targets)
    one = texts.groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    total = sum(r["t"] for r in one)
    rows = mixing.mixture(texts, targets, budget=10 * total).collect()  # more than there is: every use of every text
    assert len(rows) == 400 + 4 * 30
    few = mixing.mixture(texts, targets, budget=300).collect()
    assert 250 < sum(r["tokens"] for r in few) <= 300


def test_finish_times_follow_the_definition(spark):
    docs, targets = setting(spark)
    rows = mixing.mixture(mixing.source_texts(docs, targets), targets, block_rows=11).collect()
    for source, weight in (("big", 0.6 / 0.9), ("small", 0.3 / 0.9)):
        through = 0
        for r in rows:
            if r["source"] == source:
                through += r["tokens"]
                assert abs(r["finish"] - through / weight) < 1e-6 * r["finish"]


def test_reached_shares_and_empty_tables(spark):
    docs, targets = setting(spark)
    texts = mixing.source_texts(docs, targets)
    rows = {r["source"]: r for r in mixing.reached_shares(mixing.mixture(texts, targets), texts, targets).collect()}
    assert rows["absent"]["tokens"] == 0 and abs(sum(r["actual_share"] for r in rows.values()) - 1) < 1e-9 and rows["small"]["most_uses"] <= 4
    none = mixing.source_texts(docs.where("false"), targets)
    assert mixing.mixture(none, targets).count() == 0
    assert {r["actual_share"] for r in mixing.reached_shares(mixing.mixture(none, targets), none, targets).collect()} == {0.0}


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "id int, text string")
    got = {r["id"]: r["tokens"] for r in mixing.with_tokens(df, "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_no_source_is_lost_above_the_bound(spark):
    texts = spark.createDataFrame([(i, f"s{i}", 5) for i in range(4)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(f"s{i}", 0.25, 1) for i in range(4)], "source string, target_share double, max_repeats int")
    assert {r["source"] for r in mixing.mixture(texts, targets, most_sources=4).collect()} == {"s0", "s1", "s2", "s3"}
    with pytest.raises(ValueError, match="more than 3 targeted sources"):
        mixing.mixture(texts, targets, most_sources=3)


def test_a_budget_above_supply_leaves_no_large_slice(spark, monkeypatch):
    from casebook.llm import mixing

    texts = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "rare").otherwise("plenty").alias("source"), F.when(F.col("id") < 2000, 1).otherwise(50).cast("bigint").alias("tokens"))
    targets = spark.createDataFrame([("rare", 0.99, 1), ("plenty", 0.01, 1)], "source string, target_share double, max_repeats int")
    seen = {}
    kept = mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda df, label: seen.setdefault(label, kept(df, label)))
    mixed = mixing.mixture(texts, targets, budget=500_000, block_rows=100)
    assert mixed.count() == 4000
    assert max(r["count"] for r in seen["sliced"].groupBy("slice").count().collect()) < 300
