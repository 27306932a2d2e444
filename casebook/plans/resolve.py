"""Answering tickets from recorded precedent, as one plan over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.text import canonical_part, collapsed, extract, jaccard, percent, strip_invisible, tokens, trimmed
from casebook.operators import chunks
from casebook.operators.families import grouped_codes, with_scope
from casebook.operators.search import hashed_counts, nearest_in_scope
from casebook.storage import materialise

#: Production parameters: the least cosine, the shortlist, the least intent in percent, the answers a ticket gets.
#: Intent is the Jaccard similarity of the tokens here, for which 30 is far; a model that scores intent itself wants 75.
GATE, SHORTLIST, INTENT, ANSWERS = 0.30, 5, 30, 3
#: The second tier's: the least cosine of a passage, and the passages that a ticket gets.
PASSAGE_GATE, PASSAGES = 0.35, 5


def usable_history(history: DataFrame, least: int = 15) -> DataFrame:
    """History rows with an id and texts of at least ``least`` characters, texts and ids without outer white space."""
    rows = history.select("row_id", F.upper(trimmed(F.col("sps_id"))).alias("sps_id"), "part_number", trimmed(F.col("problem_description")).alias("problem"), trimmed(F.col("solution_text")).alias("solution"))
    return rows.where((F.col("sps_id") != "") & (F.length("problem") >= least) & (F.length("solution") >= least))


def askable_tickets(tickets: DataFrame, least: int = 10) -> DataFrame:
    """Tickets whose problem has at least ``least`` characters."""
    problem = collapsed(strip_invisible(F.col("problem_description")))
    return tickets.withColumn("problem", problem).where(F.length("problem") >= least)


def scoped_rows(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Each row once for its own part and, if its code has a family, once for the family."""
    scoped = with_scope(rows, codes)
    keys = F.array_distinct(F.array_compact(F.array(F.when(F.col("scope_kind") != "none", F.concat(F.lit("p:"), "canonical_part")), F.col("scope"))))
    return scoped.withColumn("scope", F.explode(keys))


def shortlisted(tickets: DataFrame, history: DataFrame, groups: DataFrame, k: int = SHORTLIST, least: float = GATE) -> DataFrame:
    """(query_id, row_id, item, score, exact, place): the precedent of each ticket, by exact cosine within its scope."""
    codes = grouped_codes(groups)
    asked = with_scope(askable_tickets(tickets), codes).select(F.col("ticket_id").alias("query_id"), "scope", F.col("canonical_part").alias("own"), F.col("problem").alias("content"))
    rows = scoped_rows(usable_history(history), codes).select("row_id", "scope", F.col("canonical_part").alias("own"), F.col("sps_id").alias("item"), F.col("problem").alias("content"))
    return nearest_in_scope(asked, rows, hashed_counts, k, least)


def nearest_passages(tickets: DataFrame, passages: DataFrame, k: int = PASSAGES, least: float = PASSAGE_GATE, bucket_rows: int = 10_000) -> DataFrame:
    """(ticket_id, doc_id, chunk, score, place): each ticket's ``k`` most similar passages of the corpus, by exact cosine, from ``least`` on.

    ``passages`` (doc_id, chunk, passage).  There is one scope for all: every
    ticket meets every passage.  A ticket's issue type stands before its
    problem, a document's id before its passage.  Ties go to the smaller doc_id
    and chunk.
    """
    issue = trimmed(F.col("issue_type"))
    query = F.concat(F.when(issue != "", F.concat(F.lit("Issue Type: "), issue, F.lit(" | "))).otherwise(""), F.lit("Defect: "), "problem")
    asked = askable_tickets(tickets).select(F.col("ticket_id").alias("query_id"), F.lit("all").alias("scope"), F.lit(None).cast("string").alias("own"), query.alias("content"))
    content = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] \n"), "passage")
    # larger items go first among equals: they count down from the largest id, so that the first passages do
    down = lambda c, most: F.lpad((F.lit(str(most)).cast("decimal(20,0)") - F.col(c).cast("decimal(20,0)")).cast("string"), 20, "0")
    item = F.concat(down("doc_id", 2**63 - 1), F.lit(":"), down("chunk", 2**31 - 1))
    given = passages.select(F.col("doc_id").alias("row_id"), F.lit("all").alias("scope"), F.lit(None).cast("string").alias("own"), item.alias("item"), content.alias("content"))
    found = nearest_in_scope(asked, given, hashed_counts, k, least, bucket_rows)
    chunk = (F.lit(2**31 - 1) - F.substring_index("item", ":", -1).cast("bigint")).cast("int")
    return found.select(F.col("query_id").alias("ticket_id"), F.col("row_id").alias("doc_id"), chunk.alias("chunk"), "score", "place")


def document_passages(documents: DataFrame) -> DataFrame:
    """(doc_id, section, chunk, passage, n_words): the passages of documents (doc_id, text)."""
    return chunks.passages(documents, "doc_id", "text", across=True)


def resolved(tickets: DataFrame, history: DataFrame, groups: DataFrame) -> DataFrame:
    """(ticket_id, solution_rank, sps_id, confidence, intent, exact_part, solution_text): up to three verbatim answers a ticket."""
    return answers(shortlisted(tickets, history, groups), tickets, history)


def evidence(tickets: DataFrame, history: DataFrame, groups: DataFrame, documents: DataFrame) -> DataFrame:
    """(ticket_id, tier, place, source, chunk, score, evidence): what both tiers hold on each ticket.

    Tier 1 is the ticket's shortlist, tier 2 the passages nearest to it, which
    only tickets without an answer are compared with.  Texts are fetched for the
    rows found, and only the documents found are cut again.  Tickets without
    evidence have no row.
    """
    found = materialise(shortlisted(tickets, history, groups), "shortlists")
    unanswered = tickets.join(answers(found, tickets, history).select("ticket_id").distinct(), "ticket_id", "left_anti")
    near = materialise(nearest_passages(unanswered, document_passages(documents)), "near")
    texts = usable_history(history).select("row_id", "solution")
    first = found.join(texts, "row_id").select(F.col("query_id").alias("ticket_id"), F.lit(1).alias("tier"), "place", F.col("item").alias("source"), F.lit(None).cast("int").alias("chunk"), "score", extract(F.col("solution")).alias("evidence"))
    cut = document_passages(documents.join(near.select("doc_id").distinct(), "doc_id", "left_semi")).select("doc_id", "chunk", "passage")
    second = near.join(cut, ["doc_id", "chunk"]).select("ticket_id", F.lit(2).alias("tier"), "place", F.col("doc_id").cast("string").alias("source"), "chunk", "score", extract(F.col("passage")).alias("evidence"))
    return first.unionByName(second)


def answers(found: DataFrame, tickets: DataFrame, history: DataFrame) -> DataFrame:
    """(ticket_id, solution_rank, sps_id, confidence, intent, exact_part, solution_text): up to three verbatim answers a ticket, out of the shortlists ``found``.

    The shortlist's texts are fetched after the ranking, for its few rows only.
    """
    problems = askable_tickets(tickets).select(F.col("ticket_id").alias("query_id"), F.col("problem").alias("asked"))
    texts = usable_history(history).select("row_id", F.col("problem").alias("known"), "solution")
    both = found.join(problems, "query_id").join(texts, "row_id")
    scored = both.withColumn("intent", F.floor(100 * jaccard(F.array_distinct(tokens(F.col("asked"))), F.array_distinct(tokens(F.col("known")))) + 0.5).cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("intent"), F.desc("exact"), F.desc("score"), F.desc("item"))
    top = scored.where(F.col("intent") >= INTENT).withColumn("solution_rank", F.row_number().over(order)).where(F.col("solution_rank") <= ANSWERS)
    return top.select(F.col("query_id").alias("ticket_id"), "solution_rank", F.col("item").alias("sps_id"), percent(F.col("score")).alias("confidence"), "intent", F.col("exact").alias("exact_part"), F.col("solution").alias("solution_text"))

