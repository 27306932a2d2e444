"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions.text import trimmed
from casebook.llm import leaks, minhash, mixing, quality, survivor, topn, unify
from casebook.storage import materialise, table


def _typed_parts(spark: SparkSession, d: str) -> DataFrame:
    tickets = table(spark, d, "incoming_tickets").select(F.lit("incoming_tickets").alias("src_table"), F.col("ticket_id").alias("row_id"), "part_number")
    history = table(spark, d, "boilerplate_history").select(F.lit("boilerplate_history").alias("src_table"), "row_id", "part_number")
    return tickets.unionByName(history)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    typed = _typed_parts(spark, d)
    looks = unify.match_catalogue(typed, table(spark, d, "part_catalog"), "part_number")
    return typed.join(looks.withColumnRenamed("text", "part_number"), "part_number").select("src_table", "row_id", F.col("part").alias("part_number"))


def p1_canonical_parts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows and spellings each consistent form stands for."""
    forms = unify.unify_text(_typed_parts(spark, d), "part_number")
    return forms.where("canonical <> ''").groupBy("src_table", "canonical").agg(F.count("*").alias("n_rows"), F.count_distinct("part_number").alias("n_spellings"))


def _history_order() -> list:
    limited = F.greatest(F.least("composite_score", F.lit(1.0)), F.lit(0.0))
    return [limited.desc(), F.coalesce("exact_part", F.lit(False)).desc(), F.desc_nulls_last("sps_id"), F.col("cand_id").desc()]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("part_number", "cand_id", "sps_id", "composite_score", "exact_part")
    return rows.where(F.col("part_number").isNotNull() & F.col("composite_score").isNotNull() & ~F.isnan("composite_score"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(_scored(spark, d), "part_number", _history_order(), 5, distinct="sps_id").select("part_number", "cand_id")


def p3_best_per_ticket(spark: SparkSession, d: str) -> DataFrame:
    """The three best history records of each ticket."""
    rows = table(spark, d, "candidates").select("ticket_id", "cand_id", "sps_id", "composite_score", "exact_part")
    rows = rows.where(F.col("composite_score").isNotNull() & ~F.isnan("composite_score"))
    return topn.top_n_per_group(rows, "ticket_id", _history_order(), 3, distinct="sps_id").select("ticket_id", "cand_id")


def _history_text() -> F.Column:
    return F.concat_ws(" ", F.coalesce("problem_description", F.lit("")), F.coalesce("solution_text", F.lit("")))


def _history_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # no similarity lies between 0.5 and 0.7, so bands are set for 0.7: a pair of that similarity is missed with a chance of 8e-8
    return minhash.near_duplicates(table(spark, d, "boilerplate_history"), "row_id", _history_text(), words=3, threshold=0.6, bands=88, rows=5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return minhash.row_pairs(*_history_links(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record: its group, and its links to other texts."""
    return minhash.duplicate_groups(*_history_links(spark, d)).withColumnRenamed("id", "row_id")


def _exports(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "boilerplate_history")
    return rows.withColumn("sps_id", F.nullif(F.upper(trimmed(F.col("sps_id"))), F.lit("")))


def _long(column: str, least: int) -> F.Column:
    return F.length(trimmed(F.col(column))) >= least


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    fields = {"problem": _long("problem_description", 10), "solution": _long("solution_text", 15)}
    rows = _exports(spark, d).select("sps_id", "row_id", "problem_description", "solution_text", survivor.instant(F.col("last_modified_date")).alias("modified"))
    best = survivor.surviving_fields(rows, "sps_id", fields, F.col("modified"), F.lit(0), "row_id")
    return best.select("sps_id", "problem_row_id", "solution_row_id")


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Each sps_id's surviving record, built field by field from its latest row; only the part number yields to a better written one."""
    rows = _exports(spark, d).withColumn("modified", survivor.instant(F.col("last_modified_date")))
    fields = {
        "part": _long("part_number", 1), "issue": _long("issue_type", 1),
        "problem": _long("problem_description", 10), "solution": _long("solution_text", 15), "date": F.col("modified").isNotNull(),
    }
    trust = F.col("part_number").rlike(r"^\p{Lu}?[A-Z0-9]+[-/._][A-Z0-9]+$").cast("int")
    names = {"part": "part_number", "issue": "issue_type", "problem": "problem_description", "solution": "solution_text", "date": "last_modified_date"}
    values = {k: F.col(c) for k, c in names.items()}
    best = survivor.surviving_fields(rows, "sps_id", fields, F.col("modified"), {"part": F.coalesce(trust, F.lit(0))}, "row_id", min_rows=1, values=values)
    return best.select("sps_id", "n_rows", *(F.col(k).alias(c) for k, c in names.items()))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_leak_report(spark: SparkSession, d: str) -> DataFrame:
    """For each test item: in how many documents it was found, and how much of it at most."""
    found = leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("most_words"), F.max("coverage").alias("most_coverage"))


def p6_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents without leaked passages."""
    return leaks.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture in its order."""
    targets = table(spark, d, "mix_targets")
    return mixing.mixture(mixing.source_texts(table(spark, d, "documents"), targets), targets)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    targets = table(spark, d, "mix_targets")
    texts = mixing.source_texts(table(spark, d, "documents"), targets)
    mixed = materialise(mixing.mixture(texts, targets), "mixture")
    return mixing.reached_shares(mixed, texts, targets)


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_kinds(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).where("kind <> 'prose'").select("doc_id")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Each document's statistics and kind."""
    return _kinds(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    scored = """SELECT *, row_number() OVER (PARTITION BY {g}, sps_id ORDER BY {o}) AS again FROM
        (SELECT *, greatest(least(composite_score, 1.0), 0.0) AS s, coalesce(exact_part, false) AS e FROM candidates
         WHERE {g} IS NOT NULL AND composite_score IS NOT NULL AND NOT isnan(composite_score))"""
    order = "s DESC, e DESC, sps_id DESC NULLS LAST, cand_id DESC"
    best = "WITH t AS ({t}) SELECT {g}, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {o}) AS place FROM t WHERE again = 1) WHERE place <= {n}"
    p3 = lambda g, n: best.format(t=scored.format(g=g, o=order), g=g, o=order, n=n)
    exports = """SELECT upper(trim(sps_id, ' \t')) AS sps_id, row_id, length(trim(problem_description)) >= 10 AS p, length(trim(solution_text)) >= 15 AS s,
        try_cast(CASE WHEN regexp_matches(last_modified_date, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN last_modified_date ELSE last_modified_date || 'Z' END AS TIMESTAMPTZ) AS m FROM boilerplate_history"""
    pick = "(arg_max(row_id, coalesce(epoch_us(m), -9000000000000000)::HUGEINT * 1000000000000 + row_id) FILTER (WHERE {c}))"
    grams = """w AS (SELECT row_id, t, regexp_extract_all(t, '[a-z0-9]+') AS w FROM (SELECT row_id, lower(coalesce(problem_description, '') || ' ' || coalesce(solution_text, '')) AS t FROM boilerplate_history)),
        g AS (SELECT DISTINCT row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        n AS (SELECT row_id, count(*) AS n FROM g GROUP BY 1),
        shared AS (SELECT a.row_id AS row_a, b.row_id AS row_b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.row_id < b.row_id GROUP BY 1, 2),
        pairs AS (SELECT row_a, row_b FROM shared JOIN n x ON row_a = x.row_id JOIN n y ON row_b = y.row_id WHERE shared.n >= 0.6 * (x.n + y.n - shared.n))"""
    groups = f"""WITH RECURSIVE {grams}, two_way AS (SELECT row_a, row_b FROM pairs UNION ALL SELECT row_b, row_a FROM pairs),
        near AS (SELECT row_id, row_id AS other FROM n UNION SELECT near.row_id, row_b FROM near JOIN two_way ON other = row_a),
        links AS (SELECT row_a AS row_id, count(DISTINCT y.t) AS n_links FROM two_way JOIN w x ON row_a = x.row_id JOIN w y ON row_b = y.row_id WHERE x.t <> y.t GROUP BY 1)
        SELECT row_id, group_id, coalesce(n_links, 0) AS n_links FROM (SELECT row_id, min(other) AS group_id FROM near GROUP BY 1) LEFT JOIN links USING (row_id)"""
    seen = r"[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{b}]"
    long = {"part_number": f"regexp_matches(part_number, '{seen}')", "issue_type": f"regexp_matches(issue_type, '{seen}')", "problem_description": "p", "solution_text": "s", "last_modified_date": "m IS NOT NULL"}
    trust = {"part_number": "CASE WHEN regexp_full_match(part_number, '\\p{Lu}?[A-Z0-9]+[-/._][A-Z0-9]+') THEN 1 ELSE 0 END DESC, "}
    field = lambda c: f"(SELECT sps_id, {c} FROM (SELECT *, row_number() OVER (PARTITION BY sps_id ORDER BY {trust.get(c, '')}m DESC NULLS LAST, row_id DESC) AS place FROM e WHERE {long[c]}) WHERE place = 1)"
    survivors = f"""WITH e AS (SELECT x.*, part_number, issue_type, problem_description, solution_text, last_modified_date FROM ({exports}) x JOIN boilerplate_history USING (row_id) WHERE x.sps_id <> '')
        SELECT * FROM (SELECT sps_id, count(*) AS n_rows FROM e GROUP BY 1) {' '.join(f'LEFT JOIN {field(c)} USING (sps_id)' for c in long)}"""
    # a word: letters and digits once unseen signs are dropped and typographic forms are plain
    plain = "lower(nfc_normalize(replace(replace(replace(replace(replace(replace(translate(regexp_replace({c}, '[\\p{{Cf}}\\x{{34f}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g'), {wide}), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ß', 'ss')))"
    wide = f"'{''.join(chr(n) for n in range(0xFF10, 0xFF5B) if chr(n).isalnum())}', '{''.join(chr(n - 0xFEE0) for n in range(0xFF10, 0xFF5B) if chr(n).isalnum())}'"
    words = lambda t, key: f"SELECT {key}, regexp_extract_all({plain.format(c='text', wide=wide)}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {t}"
    leaked = f"""WITH d AS ({words('documents', 'doc_id')}), e AS ({words('eval_items', 'item_id')}),
        dw AS (SELECT doc_id, i, list_aggregate(w[i:i + 11], 'string_agg', ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
        ew AS (SELECT DISTINCT item_id, list_aggregate(w[i:i + 11], 'string_agg', ' ') AS t FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
        hit AS (SELECT doc_id, item_id, count(DISTINCT i + k) AS n_words FROM dw JOIN ew USING (t), range(12) r(k) GROUP BY 1, 2)"""
    return {
        "p5_survivors": survivors,
        "p6_found": f"{leaked} SELECT doc_id, item_id FROM hit",
        "p6_leak_report": f"{leaked} SELECT item_id, count(*) AS n_docs, max(n_words) AS most_words, max(least(1.0, n_words / len(w))) AS most_coverage FROM hit JOIN e USING (item_id) GROUP BY 1",
        "p4_found": f"WITH {grams} SELECT * FROM pairs",
        "p4_groups": groups,
        "p3_found": p3("part_number", 5),
        "p3_best_per_ticket": p3("ticket_id", 3),
        "p5_found": f"WITH e AS ({exports}) SELECT sps_id, {pick.format(c='p')} AS problem_row_id, {pick.format(c='s')} AS solution_row_id FROM e WHERE sps_id <> '' GROUP BY sps_id HAVING count(*) >= 2",
    }
