import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.operators import chunks, families, ranking, search, sums, textvectors
from casebook.sources.headers import MissingColumns, header_map


def test_families_conflicts_and_scopes(spark):
    groups = spark.createDataFrame([("ab1", "Lids "), ("AB2", "lids"), ("AB2", "Lids"), ("X1", "Lids"), ("x1", "Springs"), ("", "Lids"), ("Y", None), (None, " ")], "commodity_code string, group_name string")
    codes = families.grouped_codes(groups)
    assert [(r["group_key"], r["members"]) for r in families.family_members(groups).collect()] == [("lids", ["AB1", "AB2"])]
    assert [tuple(r) for r in families.conflicts(codes).collect()] == [("X1", ["lids", "springs"])]
    parts = spark.createDataFrame([(1, "ab1-7"), (2, "X1-7"), (3, "Q-1"), (4, "777"), (5, "--"), (6, None)], "id int, part_number string")
    got = {r["id"]: (r["scope_kind"], r["scope"]) for r in families.with_scope(parts, codes).collect()}
    assert got == {1: ("family", "f:lids"), 2: ("conflict", "p:X1-7"), 3: ("unmapped", "p:Q-1"), 4: ("part", "p:777"), 5: ("none", None), 6: ("none", None)}


@pytest.mark.parametrize("bucket_rows,block_queries", [(20_000, 2_000), (7, 3)])
def test_nearest_in_scope_against_brute_force(spark, bucket_rows, block_queries):
    random.seed(6)
    text = lambda: " ".join(random.choice("red green blue lid box nut".split()) for _ in range(random.randrange(0, 5)))
    queries = [(i, random.choice(["s", "t", "none", None]), random.choice(["p", "q", None]), text()) for i in range(25)]
    rows = [(i, random.choice(["s", "s", "t", "u"]), random.choice(["p", "q"]), f"item{random.randrange(25)}", text()) for i in range(150)]
    asked, given = spark.createDataFrame(queries, "query_id long, scope string, own string, content string"), spark.createDataFrame(rows, "row_id long, scope string, own string, item string, content string")
    expected = set()
    for q, scope, own, content in queries:
        mine = [r for r in rows if r[1] == scope]
        scores = search.cosine(search.hashed_counts([content]), search.hashed_counts([r[4] for r in mine]))[0] if mine else []
        seen: list = []
        for s, exact, item, r in sorted(((float(s), r[2] == own, r[3], r[0]) for s, r in zip(scores, mine)), key=lambda x: (x[0], x[1], x[2], -x[3]), reverse=True):
            if item not in seen and len(seen) < 4:
                seen.append(item)
                if s >= 0.3:
                    expected.add((q, r, item, round(s, 9), exact, len(seen)))
    found = search.nearest_in_scope(asked, given, search.hashed_counts, 4, 0.3, bucket_rows, block_queries)
    assert {(r["query_id"], r["row_id"], r["item"], round(r["score"], 9), r["exact"], r["place"]) for r in found.collect()} == expected


def test_percentiles_and_running_sums(spark):
    random.seed(9)
    rows = [(random.choice("abc"), random.choice([None, float("nan"), random.gauss(0, 1), 0.5])) for _ in range(500)] + [("one", 3.0), (None, 1.0)]
    got = {r["g"]: r for r in sums.floor_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"lo": 0.0, "mid": 0.5, "p90": 0.9, "hi": 1.0}, slices=5).collect()}
    for g in "abc":
        values = sorted(v for k, v in rows if k == g and v is not None and v == v)
        assert [got[g][c] for c in ("lo", "mid", "p90", "hi")] == [values[int(f * (len(values) - 1))] for f in (0.0, 0.5, 0.9, 1.0)] and got[g]["n"] == len(values)
    assert got["one"]["mid"] == 3.0 and None not in got


def test_longest_runs(spark):
    rows = [("a", i, t) for i, t in enumerate("eexeeexx")] + [("b", 1, "x"), ("c", 1, None), ("c", 2, "e"), (None, 1, "e")]
    df = spark.createDataFrame(rows, "u string, i int, t string")
    got = {r["u"]: r["longest_run"] for r in sums.longest_runs(df, "u", ["i"], F.col("t") == "e").collect()}
    assert got == {"a": 3, "b": 0, "c": 1, None: 1}
    assert sums.longest_runs(df.limit(0), "u", ["i"], F.col("t") == "e").collect() == []


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_longest_runs_over_tasks_and_batches(spark, batch):
    rng = random.Random(batch)
    rows = [(None if u == 3 else u, i, rng.random() < rng.choice([0.5, 0.95])) for u, n in enumerate([400, 30, 1, 5]) for i in range(n)]
    expected = {}
    for u, hits in itertools.groupby(rows, lambda r: r[0]):
        runs = [len(list(g)) for hit, g in itertools.groupby(r[2] for r in hits) if hit]
        expected[u] = max(runs, default=0)
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df = spark.createDataFrame(rows, "u int, i int, h boolean")
        assert {r["u"]: r["longest_run"] for r in sums.longest_runs(df, "u", ["i"], F.col("h")).collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_counters_with_nulls(spark):
    df = spark.createDataFrame([(1, "x", 0.5), (1, "x", 1.7), (1, "y", None), (1, "z", float("nan")), (2, None, -1.0)], "q int, item string, s double")
    got = {r["q"]: tuple(r)[1:] for r in ranking.counters(df, "q", "item", ranking.limited(F.col("s")), 0.3).collect()}
    assert got == {1: (4, 2, 1, 1.0), 2: (1, 1, 0, 0.0)}


def test_packing():
    sizes = lambda counts: [len(p.split()) for _, p in chunks.packed_parts([(0, "w " * n, None) for n in counts], 300, 350, 12)]
    assert sizes([100, 150, 60, 40]) == [310, 40] and sizes([200, 200]) == [200, 200]
    assert sizes([200, 140, 5]) == [345] and sizes([5]) == [] and sizes([]) == []


def test_passages_stay_within_sections(spark):
    text = "One two three four five six seven eight nine ten eleven twelve. And more.\n\n \nshort\n\n" + "word " * 400
    rows = chunks.passages(spark.createDataFrame([("d", text), ("e", None), ("f", " ")], "doc_id string, text string"), "doc_id", "text").collect()
    assert [(r["section"], r["chunk"], r["n_words"]) for r in rows] == [(0, 0, 14), (2, 1, 350), (2, 2, 50)]


def test_all_words_come_out_across_blank_lines(spark):
    random.seed(4)
    sections = lambda: [" ".join(random.choice(["lid", "box.", "nut"]) for _ in range(random.choice([1, 3, 11, 40, 200, 340, 349, 400, 900]))) for _ in range(random.randrange(1, 9))]
    texts = {i: "\n\n".join(sections()) for i in range(200)} | {200: "a short line\n\n" + "word " * 400 + "\n \nclosing line", 201: "only five words in all", 202: None}
    rows = chunks.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text", across=True).orderBy("doc_id", "chunk").collect()
    for i, text in texts.items():
        words = (text or "").split()
        mine = [r for r in rows if r["doc_id"] == i]
        assert [w for r in mine for w in r["passage"].split()] == (words if len(words) >= 12 else [])
        assert all(12 <= r["n_words"] <= 350 + 22 for r in mine) and [r["chunk"] for r in mine] == list(range(len(mine)))
    # a short paragraph stands with its neighbours, on its own line
    two = list(chunks.packed_parts([(0, "one two", None), (1, "w " * 30, None), (2, "end", None)], 300, 350, 12))
    assert [(s, p.split("\n")[0], p.split("\n")[-1]) for s, p in two] == [(0, "one two", "end")]


def test_document_passages_lose_no_words(spark, tmp_path):
    from casebook.plans import queries

    text = "A heading\n\n" + "One sentence of six words here. " * 60 + "\n\n- first item\n\n- second item\n\nThe end."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.queries()["document_passages"](spark, str(tmp_path)).orderBy("chunk").collect()
    assert [w for r in rows for w in r["passage"].split()] == text.split()


def test_vectors_once_a_text(spark):
    df = spark.createDataFrame([("a lid",), (" a lid ",), ("",), (None,), ("a box",)], "t string")
    texts = textvectors.distinct_texts(df, "t")
    assert sorted((r["text"], r["n_rows"]) for r in texts.collect()) == [("a box", 1), ("a lid", 2)]
    vectors = textvectors.encoded(texts, search.hashed_counts, "m").collect()
    assert all(abs(np.linalg.norm(v["vec"]) - 1) < 1e-6 for v in vectors)
    known = spark.createDataFrame([(vectors[0]["text_key"],)], "text_key string")
    assert textvectors.missing_texts(texts, known).count() == 1 and textvectors.still_used(known, texts).count() == 1


def test_header_map():
    assert header_map(["SPS ID", "Part-Number", "Problem", "Solution_Text", "part_number"])["part_number"] == "Part-Number"
    with pytest.raises(MissingColumns, match="solution_text"):
        header_map(["sps_id", "partno", "problem"])


def test_model_calls_isolate_failures(spark):
    from pyspark.sql.types import IntegerType, StructField, StructType

    from casebook.operators.models import accepted, called

    def factory():
        def client(rows):
            return [{"intent": 100 // r["n"] if r["n"] < 50 else 300} for r in rows]

        return client

    df = spark.createDataFrame([(n,) for n in (1, 2, 0, 4, 60)], "n int").coalesce(1)
    got = called(df, factory, StructType([StructField("intent", IntegerType())]), batch_rows=3)
    rows = {r["n"]: (r["intent"], r["error"] and r["error"].split(":")[0]) for r in got.collect()}
    assert rows == {1: (100, None), 2: (50, None), 0: (None, "ZeroDivisionError"), 4: (25, None), 60: (300, None)}
    assert sorted((r["n"], r["intent"]) for r in accepted(got, 50).collect()) == [(1, 100), (2, 50), (60, 100)]


def test_cells_and_lists(spark):
    from casebook.functions import text as T

    df = spark.createDataFrame([("a\x0bb\x00c\td",), (None,), ("x" * 40_000,)], "t string")
    cells = [r[0] for r in df.select(T.cell(F.col("t"))).collect()]
    assert cells[:2] == ["a\nbc\td", ""] and len(cells[2]) == T.CELL and cells[2].endswith(T.CUT)
    assert df.limit(1).select(T.numbered(F.array(F.lit("a"), F.lit("b")))).first()[0] == "[1] a\n[2] b"


def test_scores_join_their_candidates(spark):
    from casebook.operators.models import failure_kind, joined_scores

    answers = spark.createDataFrame([(1, [("a", 150), ("b", -5), ("x", 90), ("a", 20), (None, 3), ("c", None)]), (2, [("a", 40)]), (3, None)], "q int, scores array<struct<item: string, intent: int>>")
    candidates = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (3, "a"), (4, "a")], "q int, item string")
    assert sorted(tuple(r) for r in joined_scores(answers, candidates, "q", "item").collect()) == [(1, "a", 100), (1, "b", 0)]
    errors = spark.createDataFrame([("TypeError: no such parameter",), ("ValueError: Response_Format is not known",), ("TimeoutError: read",), (None,), ("ValueError: 503 TypeError",)], "e string")
    assert [r[0] for r in errors.select(failure_kind(F.col("e"))).collect()] == ["capability", "capability", "outage", None, "outage"]


def test_pair_cosines(spark):
    rows = [(1, "red lid", "red lid"), (2, "red lid", "blue box"), (3, "...", "red lid"), (4, "red lid", "lid red lid")]
    got = {r["i"]: r["cosine"] for r in textvectors.pair_cosines(spark.createDataFrame(rows, "i int, a string, b string"), "a", "b", search.hashed_counts).collect()}
    assert got[1] == pytest.approx(1) and got[3] == 0 and got[4] == pytest.approx(3 / 10**0.5)


def test_percentiles_of_values_close_together(spark):
    values = [1e9, *(i / 1e6 for i in range(5000))]
    row = sums.floor_percentiles(spark.createDataFrame([("g", v) for v in values], "g string, v double"), "g", "v", {"mid": 0.5, "hi": 1.0}, slices=50).first()
    assert (row["n"], row["mid"], row["hi"]) == (5001, sorted(values)[2500], 1e9)


def test_intermediate_tables_can_be_removed(spark):
    from casebook import storage

    storage.remove_intermediate(spark)
    kept = storage.materialise(spark.range(3).toDF("x"), "some")
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    import os

    assert kept.count() == 3 and os.path.isdir(path)
    assert storage.remove_intermediate(spark) == 1 and not os.path.isdir(path) and storage.remove_intermediate(spark) == 0
