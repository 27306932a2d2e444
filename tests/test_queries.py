import pytest

from casebook.plans import queries
from tests.conftest import against_sql

#: Queries whose small table gives no row.
EMPTY = {"p2_loaded_bulk_tickets", "resolve_tickets", "transferability_findings", "commodity_conflicts", "missing_ticket_texts"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, small, name):
    assert against_sql(spark, small, queries.queries()[name], queries.oracle_sql()[name]) or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0 or name in EMPTY


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_streamed_vectors_are_those_of_one_pass(spark, small):
    key = lambda name: sorted((r["text_key"], tuple(r["vec"])) for r in queries.queries()[name](spark, small).select("text_key", "vec").collect())
    assert key("streamed_vectors") == key("problem_vectors")


@pytest.mark.parametrize("bucket_rows", [2_000, 7])
def test_tickets_meet_every_passage(spark, small, bucket_rows):
    from casebook.operators.search import cosine, hashed_counts
    from casebook.plans import resolve
    from casebook.storage import table

    passages = queries.document_passages(spark, small)
    known = sorted((r["doc_id"], r["chunk"], r["passage"]) for r in passages.collect())
    tickets = table(spark, small, "incoming_tickets")
    asked = [(r["ticket_id"], (r["issue_type"] or "").strip(), r["problem"]) for r in resolve.askable_tickets(tickets).collect()]
    scores = cosine(hashed_counts([f"Issue Type: {i} | Defect: {p}" if i else f"Defect: {p}" for _, i, p in asked]), hashed_counts([f"[{d}] \n{p}" for d, _, p in known]))
    expected = set()
    for (ticket, _, _), row in zip(asked, scores):
        best = sorted(zip(-row, known))[: resolve.PASSAGES]
        expected |= {(ticket, d, c, round(-s, 9), place) for place, (s, (d, c, _)) in enumerate(best, 1) if -s >= resolve.PASSAGE_GATE}
    found = resolve.nearest_passages(tickets, passages, bucket_rows=bucket_rows).collect()
    assert expected and {(r["ticket_id"], r["doc_id"], r["chunk"], round(r["score"], 9), r["place"]) for r in found} == expected


def test_nearest_of_all_crosses_labels(spark, tmp_path):
    rows = [(20, [1.0, 0.0], 1), (21, [1.0, 0.1], 2), (22, [0.3, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [(r["row_id"], r["place"]) for r in queries.queries()["nearest_embeddings_of_all"](spark, str(tmp_path)).orderBy("place").collect()] == [(21, 1), (22, 2)]


def test_evidence_has_500_characters(spark, tmp_path):
    rows = [(1, "a" * 450), (2, "b" * 500), (3, "c " * 400), (4, None)]
    spark.createDataFrame(rows, "row_id long, solution_text string").write.parquet(str(tmp_path / "boilerplate_history.parquet"))
    got = {r["row_id"]: r["evidence"] for r in queries.queries()["whole_evidence_extracts"](spark, str(tmp_path)).collect()}
    assert got == {1: "a" * 450, 2: "b" * 500, 3: ("c " * 250)[:499] + "…", 4: ""}
