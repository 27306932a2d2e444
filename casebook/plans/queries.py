"""The registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casebook.functions import gates
from casebook.functions import text as T
from casebook.operators import families, models, ranking, records, sums, textvectors
from casebook.operators.search import hashed_counts, nearest_in_scope
from casebook.plans import resolve
from casebook.sources.headers import with_fields
from casebook.sources.sheets import read_sheet, write_csv
from casebook.storage import table
from casebook.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# What several statements share: white space, canonical parts, group keys.
_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{b}]+"
_flat = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{_WS}', ' ', 'g'))"
_trim = lambda c: f"regexp_replace(regexp_replace(coalesce({c}, ''), '^{_WS}', ''), '{_WS}$', '')"
_part = lambda c: f"upper(regexp_replace(regexp_replace(coalesce({c}, ''), '\\p{{Cf}}', '', 'g'), '{_WS}', '', 'g'))"
_code = lambda p: f"CASE WHEN contains({p}, '-') THEN split_part({p}, '-', 1) ELSE '' END"
_groups = f"""g AS (SELECT {_part('commodity_code')} AS commodity_code, {_flat('group_name')} AS spelling FROM commodity_groups),
    codes AS (SELECT DISTINCT commodity_code, lower(spelling) AS group_key FROM g WHERE commodity_code <> '' AND spelling <> ''),
    names AS (SELECT lower(spelling) AS group_key, min(spelling) AS group_name FROM g WHERE commodity_code <> '' AND spelling <> '' GROUP BY 1),
    twice AS (SELECT commodity_code, list_sort(list(group_key)) AS groups FROM codes GROUP BY 1 HAVING count(*) > 1),
    fam AS (SELECT * FROM codes WHERE commodity_code NOT IN (SELECT commodity_code FROM twice))"""


# ---------------------------------------------------------------- loading


_field = r"""(?:"(?:[^"]|"")*"|[^",\r\n]*)"""
_value = lambda i: f"""CASE WHEN starts_with(f[{i}], '"') THEN replace(f[{i}][2:-2], '""', '"') ELSE f[{i}] END"""
_unseen = "".join(f"\\x{{{ord(c):x}}}" for c in sorted(records.UNSEEN))
# a record's fields each follow a comma, once one stands before the first; a line break behind them is no record
_p2_found = f"""WITH r AS (SELECT record_id, coalesce(feed, '') AS feed, regexp_extract(coalesce(raw_text, ''), '^({_field}(?:,{_field})*)(?:[\\r\\n]|\\z)', 1) AS first, coalesce(raw_text, '') AS t,
      regexp_matches(coalesce(raw_text, ''), '^{_field}(?:,{_field})*(?:[\\r\\n]|\\z)') AS formed FROM raw_records),
    f AS (SELECT *, regexp_extract_all(',' || first, ',({_field})', 1) AS f, CASE feed WHEN 'bulk_tickets' THEN 5 WHEN 'boilerplate_history' THEN 6 END AS width,
      substr(t, length(first) + 1) NOT IN ('', chr(10), chr(13), chr(13) || chr(10)) AS goes_on FROM r),
    v AS (SELECT *, {', '.join(f"{_value(i)} AS v{i}" for i in range(1, 7))} FROM f),
    dated AS (SELECT *, regexp_full_match(v6, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])') AND NOT starts_with(v6, '0000') AND try_cast(v6[:10] AS DATE) IS NOT NULL AS dated FROM v),
    reasons AS (SELECT record_id, CASE WHEN NOT formed THEN 'quoting' WHEN width IS NULL OR len(f) <> width THEN 'columns'
      WHEN NOT regexp_full_match(v1, '[A-Z]{{1,4}}-[0-9]+') OR NOT regexp_matches(v2, '[^\\p{{C}}\\p{{Z}}/_.{_unseen}-]') OR length({_trim('v4')}) < 10 OR width = 6 AND (length({_trim('v5')}) < 15 OR NOT dated)
        OR len(list_filter([v1, v2, v3, v4, v5, coalesce(v6, '')], lambda x: regexp_matches(x, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}\\x{{fffd}}]'))) > 0 THEN 'value'
      WHEN goes_on THEN 'columns' END AS reason FROM dated)
    SELECT record_id, reason FROM reasons WHERE reason IS NOT NULL"""


@_query(_p2_found)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return records.failures(records.parse_records(table(spark, d, "raw_records")))


@_query()
def p2_loaded_bulk_tickets(spark: SparkSession, d: str) -> DataFrame:
    """The valid bulk tickets as typed rows."""
    return records.loaded(records.parse_records(table(spark, d, "raw_records")), "bulk_tickets")


@_query()
def p2_loaded_history(spark: SparkSession, d: str) -> DataFrame:
    """The valid history records as typed rows."""
    return records.loaded(records.parse_records(table(spark, d, "raw_records")), "boilerplate_history")


@_query()
def p2_located_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every failing record with what is wrong and where."""
    failed = records.parse_records(table(spark, d, "raw_records")).where(F.col("reason").isNotNull())
    raw = table(spark, d, "raw_records").select("record_id", "file_name", "line_no")
    return failed.join(raw, "record_id").select("record_id", "record_no", "file_name", (F.col("line_no") + F.col("error_line") - 1).alias("file_line"), "error_column", "reason", "message")


#: The fields of a history export, and the headers that two systems might give them.
_EXPORTED = {
    "sps_id": ("SPS_ID", "SPS-ID"), "part_number": ("Part_Number", "PartNo"), "issue_type": ("Issue_Type", "issue type"), "problem_description": ("Problem_Description", "Problem"),
    "solution_text": ("Solution_Text", "Actual Solution"), "last_modified_date": ("Last_Modified_Date", "Modified"),
}


@_query(f"""SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in _EXPORTED)} FROM boilerplate_history""")
def history_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The history as read from sheets of two systems, which name and order the columns in their own ways: dated rows come from one, the others from the other."""
    history = table(spark, d, "boilerplate_history")
    dated = F.coalesce(F.trim("last_modified_date"), F.lit("")) != ""
    first = history.where(dated).select(*(F.col(c).alias(names[0]) for c, names in _EXPORTED.items()))
    second = history.where(~dated).select(*(F.col(c).alias(names[1]) for c, names in reversed(_EXPORTED.items())))
    return with_fields(read_sheet(spark, write_csv({"first": first, "second": second}, "sheets"))).select(*_EXPORTED)


# ---------------------------------------------------------------- text columns


@_query(f"""SELECT src, canonical_part, count(*) AS n_rows, {_code('canonical_part')} AS commodity_code, canonical_part = '' OR regexp_full_match(canonical_part, '[-/_.]*') AS invalid
    FROM (SELECT 'tickets' AS src, {_part('part_number')} AS canonical_part FROM incoming_tickets UNION ALL SELECT 'history', {_part('part_number')} FROM boilerplate_history) GROUP BY ALL""")
def canonical_parts(spark: SparkSession, d: str) -> DataFrame:
    """The canonical parts of tickets and history, with their codes."""
    rows = table(spark, d, "incoming_tickets").select(F.lit("tickets").alias("src"), "part_number").unionByName(table(spark, d, "boilerplate_history").select(F.lit("history").alias("src"), "part_number"))
    counts = rows.groupBy("src", T.canonical_part(F.col("part_number")).alias("canonical_part")).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("commodity_code", T.commodity_code(F.col("canonical_part"))).withColumn("invalid", ~T.valid_part(F.col("canonical_part")))


@_query(f"""SELECT row_id, substr(sha256(t), 1, 32) AS text_key, length(t) AS n_characters, length(t) >= 15 AS usable FROM (SELECT row_id, {_trim('solution_text')} AS t FROM boilerplate_history)""")
def solution_keys(spark: SparkSession, d: str) -> DataFrame:
    """Each solution's key, and whether it is long enough to be used."""
    rows = table(spark, d, "boilerplate_history").select("row_id", T.trimmed(F.col("solution_text")).alias("t"))
    return rows.select("row_id", T.text_key(F.col("t")).alias("text_key"), F.length("t").alias("n_characters"), (F.length("t") >= 15).alias("usable"))


@_query(f"""SELECT ticket_id, CASE WHEN p = '' OR regexp_full_match(p, '[-/_.]*') THEN 'part' WHEN length(t) < 10 THEN 'problem' END AS invalid_field
    FROM (SELECT ticket_id, {_part('part_number')} AS p, {_flat("regexp_replace(coalesce(problem_description, ''), '\\p{Cf}', '', 'g')")} AS t FROM incoming_tickets)""")
def validated_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Which field of a ticket is invalid, the part first."""
    rows = table(spark, d, "incoming_tickets").select("ticket_id", T.canonical_part(F.col("part_number")).alias("p"), T.collapsed(T.strip_invisible(F.col("problem_description"))).alias("t"))
    return rows.select("ticket_id", F.when(~T.valid_part(F.col("p")), "part").when(F.length("t") < 10, "problem").alias("invalid_field"))


@_query(f"""SELECT row_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 199) || '…' ELSE t END AS evidence FROM (SELECT row_id, {_flat('solution_text')} AS t FROM boilerplate_history)""")
def evidence_extracts(spark: SparkSession, d: str) -> DataFrame:
    """Each solution on one line, cut to 200 characters."""
    return table(spark, d, "boilerplate_history").select("row_id", T.extract(F.col("solution_text"), 200).alias("evidence"))


@_query(f"""SELECT row_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 499) || '…' ELSE t END AS evidence FROM (SELECT row_id, {_flat('solution_text')} AS t FROM boilerplate_history)""")
def whole_evidence_extracts(spark: SparkSession, d: str) -> DataFrame:
    """Each solution on one line, cut to the 500 characters that evidence has."""
    return table(spark, d, "boilerplate_history").select("row_id", T.extract(F.col("solution_text")).alias("evidence"))


@_query(f"""SELECT doc_id, CASE WHEN f = '' THEN 0 ELSE len(string_split(f, ' ')) END AS n_words, CASE WHEN t = '' THEN 0 ELSE 1 + len(regexp_extract_all(t, '[.!?]{_WS}')) END AS n_sentences
    FROM (SELECT doc_id, {_flat('text')} AS f, {_trim('text')} AS t FROM documents)""")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words and sentences of each document."""
    return table(spark, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("bigint").alias("n_words"), F.size(T.sentences(F.col("text"))).cast("bigint").alias("n_sentences"))


@_query("""SELECT row_id, epoch_us(try_cast(CASE WHEN regexp_matches(last_modified_date, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN last_modified_date ELSE last_modified_date || 'Z' END AS TIMESTAMPTZ)) AS modified_us FROM boilerplate_history""")
def modified_instants(spark: SparkSession, d: str) -> DataFrame:
    """The history's dates as microseconds since 1970."""
    return table(spark, d, "boilerplate_history").select("row_id", F.unix_micros(T.instant(F.col("last_modified_date"))).alias("modified_us"))


@_query("""SELECT percent, count(*) AS n FROM (SELECT CAST(trunc((least(greatest(composite_score, 0.0), 1.0) + 1e-6) * 100) AS INT) AS percent FROM candidates WHERE NOT isnan(composite_score)) GROUP BY 1""")
def score_percents(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates have which score in percent."""
    rows = table(spark, d, "candidates").where(F.col("composite_score").isNotNull() & ~F.isnan("composite_score"))
    return rows.groupBy(T.percent(F.col("composite_score")).alias("percent")).agg(F.count("*").alias("n"))


def _scan_sql(patterns: tuple, c: str) -> str:
    flat = lambda p: p.replace("(?iU)", "(?i)").replace("(?U)", "")
    lists = [f"list_transform(regexp_extract_all(coalesce({c}, ''), '{flat(p)}'), lambda x: {{'kind': '{k}', 'fragment': {_flat('x')}}})" for k, p in patterns]
    return " || ".join(lists)


@_query(f"""SELECT row_id, place, finding['kind'] AS kind, finding['fragment'] AS fragment FROM (
    SELECT row_id, CAST(generate_subscripts(every, 1) - 1 AS INT) AS place, unnest(every) AS finding FROM (
      SELECT row_id, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y.fragment)), lower(x.fragment)) = i) AS every FROM (
        SELECT row_id, {_scan_sql(gates.REFERENCES, 'solution_text')} AS e FROM boilerplate_history)))""")
def transferability_findings(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of solutions that belong to their own record."""
    rows = table(spark, d, "boilerplate_history").select("row_id", F.posexplode(gates.references(F.col("solution_text"))).alias("place", "f"))
    return rows.select("row_id", "place", "f.kind", "f.fragment")


_in = lambda words: "(" + ", ".join(f"'{w.lower()}'" for w in words) + ")"
_word = lambda i: f"lower(regexp_extract(coalesce(p[{i}], ''), '^\\w+'))"
_apart = lambda i: f"regexp_full_match(coalesce(p[{i}], ''), '\\w+\\s+')"
_orders = f"""list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN {_word('i')} IN {_in(gates.CUSTOMER_VERBS)} AND {_apart('i')} THEN
    CASE WHEN {_word('i + 1')} IN {_in(gates.INSTRUMENTS)} THEN p[i] || p[i + 1] WHEN {_word('i + 1')} IN {_in(gates.ARTICLES)} AND {_apart('i + 1')} AND {_word('i + 2')} IN {_in(gates.INSTRUMENTS)} THEN p[i] || p[i + 1] || p[i + 2] END END), lambda x: x IS NOT NULL)"""
_first_of = lambda l: f"list_filter({l}, lambda x, i: list_position(list_transform({l}, lambda y: lower(y.fragment)), lower(x.fragment)) = i)"


@_query(f"""WITH s AS (SELECT coalesce(solution_text, '') AS solution_text, regexp_extract_all(coalesce(solution_text, ''), '\\w+\\W*') AS p FROM boilerplate_history),
    found AS (SELECT {_scan_sql(gates.REFERENCES, 'solution_text')} AS r, list_transform({_orders}, lambda x: {{'kind': '{gates.ACTION}', 'fragment': {_flat("regexp_replace(x, '[^0-9A-Za-z_]+$', '')")}}}) ||
      list_transform(list_filter(list_transform(string_split(solution_text, chr(10)), lambda x: {_flat('x')}), lambda x: regexp_matches(x, '(?i)^([0-9]+[.)] ?)?(please )?waive([^0-9a-z_]|$)')), lambda x: {{'kind': '{gates.ACTION}', 'fragment': regexp_extract(x, '(?i)^.*?waive')}}) AS a FROM s),
    once AS (SELECT {_first_of('r')} || {_first_of('a')} AS f FROM found)
    SELECT CASE WHEN len(f) = 0 THEN '' ELSE 'Contains: ' || array_to_string(list_transform(f, lambda x: x.kind || ': ' || chr(39) || x.fragment || chr(39)), '; ') END AS warning, count(*) AS n_rows FROM once GROUP BY 1""")
def solution_warnings(spark: SparkSession, d: str) -> DataFrame:
    """How often which warning would stand beside a solution."""
    return table(spark, d, "boilerplate_history").groupBy(gates.warning(F.col("solution_text")).alias("warning")).agg(F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- families and scopes


@_query(f"WITH {_groups} SELECT group_key, group_name, list_sort(list(commodity_code)) AS members FROM fam JOIN names USING (group_key) GROUP BY 1, 2")
def commodity_families(spark: SparkSession, d: str) -> DataFrame:
    return families.family_members(table(spark, d, "commodity_groups"))


@_query(f"WITH {_groups} SELECT * FROM twice")
def commodity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return families.conflicts(families.grouped_codes(table(spark, d, "commodity_groups")))


_scope = lambda t: f"""(SELECT *, CASE WHEN scope_kind = 'family' THEN 'f:' || group_key WHEN scope_kind <> 'none' THEN 'p:' || part END AS scope FROM (
    SELECT x.*, group_key, CASE WHEN part = '' OR regexp_full_match(part, '[-/_.]*') THEN 'none' WHEN code = '' THEN 'part' WHEN code IN (SELECT commodity_code FROM twice) THEN 'conflict'
      WHEN group_key IS NULL THEN 'unmapped' ELSE 'family' END AS scope_kind FROM (SELECT *, {_code('part')} AS code FROM (SELECT *, {_part('part_number')} AS part FROM {t})) x LEFT JOIN fam ON code = fam.commodity_code))"""  # noqa: E731


@_query(f"WITH {_groups} SELECT ticket_id, scope_kind, scope FROM {_scope('incoming_tickets')}")
def ticket_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Where each ticket looks for precedent."""
    return families.with_scope(table(spark, d, "incoming_tickets"), families.grouped_codes(table(spark, d, "commodity_groups"))).select("ticket_id", "scope_kind", "scope")


_usable = f"""usable AS (SELECT * FROM (SELECT row_id, upper({_trim('sps_id')}) AS sps_id, part_number, {_trim('problem_description')} AS problem, {_trim('solution_text')} AS solution FROM boilerplate_history)
    WHERE sps_id <> '' AND length(problem) >= 15 AND length(solution) >= 15)"""
_scoped = f"""scoped AS (SELECT DISTINCT * FROM (SELECT row_id, part, sps_id, problem, solution, scope FROM {_scope('usable')} WHERE scope IS NOT NULL
    UNION ALL SELECT row_id, part, sps_id, problem, solution, 'p:' || part FROM {_scope('usable')} WHERE scope IS NOT NULL))"""


@_query(f"""WITH {_groups}, {_usable}, {_scoped}, n AS (SELECT scope, count(*) AS n FROM scoped GROUP BY 1)
    SELECT ticket_id, coalesce(n, 0) AS usable_rows FROM {_scope('incoming_tickets')} LEFT JOIN n USING (scope)""")
def precedent_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many usable history rows each ticket's scope holds: scopes are counted before they meet the tickets."""
    codes = families.grouped_codes(table(spark, d, "commodity_groups"))
    counts = resolve.scoped_rows(resolve.usable_history(table(spark, d, "boilerplate_history")), codes).groupBy("scope").agg(F.count("*").alias("usable_rows"))
    tickets = families.with_scope(table(spark, d, "incoming_tickets"), codes)
    return tickets.join(counts, "scope", "left").select("ticket_id", F.coalesce("usable_rows", F.lit(0)).alias("usable_rows"))


# ---------------------------------------------------------------- vectors and search


@_query(f"SELECT substr(sha256(t), 1, 32) AS text_key, count(*) AS n_rows FROM (SELECT {_trim('problem_description')} AS t FROM boilerplate_history) WHERE t <> '' GROUP BY t")
def distinct_problem_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that need a vector."""
    return textvectors.distinct_texts(table(spark, d, "boilerplate_history"), "problem_description").select("text_key", "n_rows")


@_query(f"""WITH h AS (SELECT DISTINCT {_trim('problem_description')} AS t FROM boilerplate_history) SELECT substr(sha256(t), 1, 32) AS text_key, n_rows
    FROM (SELECT {_trim('problem_description')} AS t, count(*) AS n_rows FROM incoming_tickets GROUP BY 1) WHERE t <> '' AND t NOT IN (SELECT t FROM h)""")
def missing_ticket_texts(spark: SparkSession, d: str) -> DataFrame:
    """Ticket texts whose vectors the history's can't supply."""
    known = textvectors.distinct_texts(table(spark, d, "boilerplate_history"), "problem_description")
    return textvectors.missing_texts(textvectors.distinct_texts(table(spark, d, "incoming_tickets"), "problem_description"), known).select("text_key", "n_rows")


_vectors = f"""WITH texts AS (SELECT DISTINCT {_trim('problem_description')} AS t FROM boilerplate_history WHERE {_trim('problem_description')} <> ''),
    v AS (SELECT t, substr(md5(x), 1, 2) AS b, count(*) AS n FROM (SELECT t, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS x FROM texts) GROUP BY 1, 2),
    m AS (SELECT t, map(list(b), list(n)) AS m, sqrt(sum(n * n)::DOUBLE) AS length FROM v GROUP BY 1)
    SELECT 'hashed-256' AS model, substr(sha256(t), 1, 32) AS text_key, list_transform(range(256), lambda i: coalesce(m[lower(lpad(to_hex(i), 2, '0'))]::DOUBLE / length, 0)::FLOAT) AS vec FROM texts LEFT JOIN m USING (t)"""


@_query(_vectors)
def problem_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of the history's different problems."""
    return textvectors.encoded(textvectors.distinct_texts(table(spark, d, "boilerplate_history"), "problem_description"), hashed_counts, "hashed-256")


@_query(_vectors)
def streamed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The same, kept up to date by a stream of history files."""
    return ingest(spark, f"{d}/boilerplate_history.parquet", "problem_description").select("model", "text_key", "vec")


def _as_given(vectors: list) -> np.ndarray:
    return np.array(vectors, float)


_dot = "greatest(0.0, least(1.0, list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]))))"


def _nearest_embeddings(spark: SparkSession, d: str, scope: Column) -> DataFrame:
    vectors = lambda name: table(spark, d, "embeddings").select(F.col("vec_id").alias(name), scope.alias("scope"), F.lit(None).cast("string").alias("own"), F.col("embedding").alias("content"))
    asked = vectors("query_id").where(F.col("query_id") % 20 == 0)
    given = vectors("row_id").withColumn("item", F.col("row_id").cast("string"))
    found = nearest_in_scope(asked, given, _as_given, 6, 0.1).where(F.col("query_id") != F.col("row_id"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("item")))
    return found.withColumn("score", F.round("score", 6)).withColumn("place", order).where("place <= 5").select("query_id", "row_id", "score", "place")


@_query(f"""SELECT query_id, row_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id::VARCHAR DESC) AS place FROM (
    SELECT q.vec_id AS query_id, r.vec_id AS row_id, round({_dot}, 6) AS score FROM embeddings q JOIN embeddings r ON q.label = r.label AND q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)) WHERE place <= 5 AND score >= 0.1""")
def nearest_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of the same label, for every vector whose id is divisible by 20."""
    return _nearest_embeddings(spark, d, F.col("label").cast("string"))


@_query(f"""SELECT query_id, row_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id::VARCHAR DESC) AS place FROM (
    SELECT q.vec_id AS query_id, r.vec_id AS row_id, round({_dot}, 6) AS score FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)) WHERE place <= 5 AND score >= 0.1""")
def nearest_embeddings_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of any label, for every vector whose id is divisible by 20."""
    return _nearest_embeddings(spark, d, F.lit("all"))


_tok = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
_search = f"""{_groups}, {_usable}, {_scoped},
    asked AS (SELECT ticket_id, part, scope, problem FROM (SELECT *, {_flat("regexp_replace(coalesce(problem_description, ''), '\\p{Cf}', '', 'g')")} AS problem FROM {_scope('incoming_tickets')})
      WHERE scope IS NOT NULL AND length(problem) >= 10 AND ticket_id % 20 = 0),
    qv AS (SELECT ticket_id, substr(md5(t), 1, 2) AS b, count(*) AS n FROM (SELECT ticket_id, unnest({_tok('problem')}) AS t FROM asked) GROUP BY 1, 2),
    rv AS (SELECT row_id, substr(md5(t), 1, 2) AS b, count(*) AS n FROM (SELECT row_id, unnest({_tok('problem')}) AS t FROM (SELECT DISTINCT row_id, problem FROM scoped)) GROUP BY 1, 2),
    qn AS (SELECT ticket_id, sum(n * n)::DOUBLE AS nn FROM qv GROUP BY 1), rn AS (SELECT row_id, sum(n * n)::DOUBLE AS nn FROM rv GROUP BY 1),
    met AS (SELECT DISTINCT ticket_id, row_id, sps_id, asked.part = scoped.part AS exact FROM asked JOIN scoped USING (scope)),
    dots AS (SELECT met.ticket_id, met.row_id, sps_id, exact, sum(qv.n * rv.n)::DOUBLE AS dot FROM met JOIN qv ON met.ticket_id = qv.ticket_id JOIN rv ON met.row_id = rv.row_id AND qv.b = rv.b GROUP BY ALL),
    scores AS (SELECT dots.*, least(1.0, dot / sqrt(qn.nn * rn.nn)) AS score FROM dots JOIN qn USING (ticket_id) JOIN rn USING (row_id)),
    once AS (SELECT *, row_number() OVER (PARTITION BY ticket_id, sps_id ORDER BY score DESC, exact DESC, row_id) AS again FROM scores),
    best AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, exact DESC, sps_id DESC, row_id) AS place FROM once WHERE again = 1)"""


@_query(f"WITH {_search} SELECT ticket_id, row_id, sps_id, round(score, 6) AS score, exact, place FROM best WHERE place <= 5 AND score >= 0.3")
def ticket_shortlists(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar history records of each ticket whose id is divisible by 20, among all of its scope."""
    tickets = table(spark, d, "incoming_tickets").where(F.col("ticket_id") % 20 == 0)
    found = resolve.shortlisted(tickets, table(spark, d, "boilerplate_history"), table(spark, d, "commodity_groups"))
    return found.select(F.col("query_id").alias("ticket_id"), "row_id", F.col("item").alias("sps_id"), F.round("score", 6).alias("score"), "exact", "place")


_jaccard = "len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct({a} || {b}))"


@_query(f"""WITH {_search}, top AS (SELECT best.*, problem AS asked FROM best JOIN asked USING (ticket_id) WHERE place <= 5 AND score >= 0.3),
    scored AS (SELECT top.*, usable.solution, CAST(floor(100 * {_jaccard.format(a=_tok('asked'), b=_tok('usable.problem'))} + 0.5) AS INT) AS intent FROM top JOIN usable USING (row_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY intent DESC, exact DESC, score DESC, sps_id DESC) AS solution_rank FROM scored WHERE intent >= {resolve.INTENT})
    SELECT ticket_id, solution_rank, sps_id, CAST(trunc((score + 1e-6) * 100) AS INT) AS confidence, intent, exact AS exact_part, solution AS solution_text FROM placed WHERE solution_rank <= {resolve.ANSWERS}""")
def resolve_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Up to three verbatim, recorded solutions for each ticket whose id is divisible by 20."""
    tickets = table(spark, d, "incoming_tickets").where(F.col("ticket_id") % 20 == 0)
    return resolve.resolved(tickets, table(spark, d, "boilerplate_history"), table(spark, d, "commodity_groups"))


@_query(f"""WITH {_search}, top AS (SELECT best.*, problem AS asked FROM best JOIN asked USING (ticket_id) WHERE place <= 5 AND score >= 0.3),
    scored AS (SELECT top.*, CAST(floor(100 * {_jaccard.format(a=_tok('asked'), b=_tok('usable.problem'))} + 0.5) AS INT) AS intent FROM top JOIN usable USING (row_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY intent DESC, exact DESC, score DESC, sps_id DESC) AS solution_rank FROM scored WHERE intent >= {resolve.INTENT}),
    answers AS (SELECT * FROM placed WHERE solution_rank <= {resolve.ANSWERS})
    SELECT t.ticket_id, t.sps_id, t.part_number, t.issue_type, solution_rank, answers.sps_id AS found_sps_id, intent, answers.ticket_id IS NOT NULL AS answered
    FROM incoming_tickets t LEFT JOIN answers ON t.ticket_id = answers.ticket_id WHERE t.ticket_id % 20 = 0""")
def answered_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Every ticket whose id is divisible by 20, as it came in, with each of its answers, or once without any."""
    tickets = table(spark, d, "incoming_tickets").where(F.col("ticket_id") % 20 == 0)
    found = resolve.resolved(tickets, table(spark, d, "boilerplate_history"), table(spark, d, "commodity_groups"))
    answers = found.select("ticket_id", "solution_rank", F.col("sps_id").alias("found_sps_id"), "intent", F.lit(True).alias("answered"))
    both = tickets.select("ticket_id", "sps_id", "part_number", "issue_type").join(answers, "ticket_id", "left")
    return both.withColumn("answered", F.coalesce("answered", F.lit(False)))


# Cutting one document after another: sections between blank lines; those of more than 350 words into sentences, and these into runs of 350, packed again; all packed to passages.
_n_words = lambda c: f"len(string_split({c}, ' '))"
_passages = f"""sections AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS section, unnest(s) AS s FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n'), lambda x: {_flat('x')} <> '') AS s FROM documents)),
    section_words AS (SELECT doc_id, section, s, string_split({_flat('s')}, ' ') AS w FROM sections),
    cut_sentences AS (SELECT doc_id, section, generate_subscripts(l, 1) AS i, string_split({_flat('unnest(l)')}, ' ') AS w FROM (
      SELECT doc_id, section, string_split(regexp_replace({_trim('s')}, '([.!?]){_WS}', '\\1' || chr(1), 'g'), chr(1)) AS l FROM section_words WHERE len(w) > 350)),
    runs AS (SELECT doc_id, section, i, unnest(range(0, len(w), 350)) AS lo, w FROM cut_sentences),
    refilled AS (SELECT doc_id, section, list_reduce(list({{'done': []::VARCHAR[], 'cur': array_to_string(w[lo + 1 : lo + 350], ' '), 'n': least(350, len(w) - lo)}} ORDER BY i, lo), lambda a, x: CASE WHEN a.n + x.n > 350
      THEN {{'done': list_append(a.done, a.cur), 'cur': x.cur, 'n': x.n}} ELSE {{'done': a.done, 'cur': a.cur || ' ' || x.cur, 'n': a.n + x.n}} END) AS g FROM runs GROUP BY 1, 2),
    parts AS (SELECT doc_id, section, 1 AS i, array_to_string(w, ' ') AS t FROM section_words WHERE len(w) <= 350
      UNION ALL SELECT doc_id, section, generate_subscripts(l, 1), unnest(l) FROM (SELECT doc_id, section, list_append(g.done, g.cur) AS l FROM refilled)),
    packed AS (SELECT doc_id, list_reduce(list({{'done': []::STRUCT(mark BIGINT, t VARCHAR)[], 'mark': section, 'cur': t, 'n': {_n_words('t')}}} ORDER BY section, i), lambda a, x: CASE WHEN a.n >= 12 AND (a.n >= 300 OR a.n + x.n > 350)
      THEN {{'done': list_append(a.done, {{'mark': a.mark, 't': a.cur}}), 'mark': x.mark, 'cur': x.cur, 'n': x.n}} ELSE {{'done': a.done, 'mark': a.mark, 'cur': a.cur || chr(10) || x.cur, 'n': a.n + x.n}} END) AS g FROM parts GROUP BY 1),
    closed AS (SELECT doc_id, CASE WHEN g.n >= 12 THEN list_append(g.done, {{'mark': g.mark, 't': g.cur}})
      WHEN len(g.done) > 0 THEN list_append(g.done[:-2], {{'mark': g.done[-1].mark, 't': g.done[-1].t || chr(10) || g.cur}}) END AS l FROM packed),
    passages AS (SELECT doc_id, CAST(p.mark AS INT) AS section, CAST(chunk AS INT) AS chunk, p.t AS passage, CAST(len(regexp_split_to_array(p.t, '[ \\n]')) AS INT) AS n_words
      FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS chunk, unnest(l) AS p FROM closed))"""
_near = lambda which: f"""{_passages}, seeking AS (SELECT ticket_id, CASE WHEN issue <> '' THEN 'Issue Type: ' || issue || ' | ' ELSE '' END || 'Defect: ' || problem AS content FROM (
      SELECT ticket_id, {_trim('issue_type')} AS issue, {_flat("regexp_replace(coalesce(problem_description, ''), '\\p{Cf}', '', 'g')")} AS problem FROM incoming_tickets WHERE ticket_id % 20 = 0) WHERE length(problem) >= 10 AND {which}),
    sv AS (SELECT ticket_id, substr(md5(t), 1, 2) AS b, count(*) AS n FROM (SELECT ticket_id, unnest({_tok('content')}) AS t FROM seeking) GROUP BY 1, 2),
    pv AS (SELECT doc_id, chunk, substr(md5(t), 1, 2) AS b, count(*) AS n FROM (SELECT doc_id, chunk, unnest({_tok("'[' || doc_id || '] ' || passage")}) AS t FROM passages) GROUP BY 1, 2, 3),
    sn AS (SELECT ticket_id, sum(n * n)::DOUBLE AS nn FROM sv GROUP BY 1), pn AS (SELECT doc_id, chunk, sum(n * n)::DOUBLE AS nn FROM pv GROUP BY 1, 2),
    passage_dots AS (SELECT ticket_id, doc_id, chunk, sum(sv.n * pv.n)::DOUBLE AS dot FROM sv JOIN pv USING (b) GROUP BY 1, 2, 3),
    near AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, doc_id, chunk) AS place FROM (
      SELECT ticket_id, doc_id, chunk, least(1.0, dot / sqrt(sn.nn * pn.nn)) AS score FROM passage_dots JOIN sn USING (ticket_id) JOIN pn USING (doc_id, chunk)))"""  # noqa: E731


@_query(f"WITH {_passages} SELECT * FROM passages")
def document_passages(spark: SparkSession, d: str) -> DataFrame:
    """The documents cut into passages: all their words, but for documents with fewer than 12."""
    return resolve.document_passages(table(spark, d, "documents"))


@_query(f"WITH {_near('true')} SELECT ticket_id, doc_id, chunk, round(score, 6) AS score, place FROM near WHERE place <= {resolve.PASSAGES} AND score >= {resolve.PASSAGE_GATE}")
def ticket_passages(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar passages, among those of all documents, of each ticket whose id is divisible by 20."""
    tickets = table(spark, d, "incoming_tickets").where(F.col("ticket_id") % 20 == 0)
    return resolve.nearest_passages(tickets, document_passages(spark, d)).withColumn("score", F.round("score", 6))


_cut = lambda c: f"CASE WHEN length({_flat(c)}) > 500 THEN substr({_flat(c)}, 1, 499) || '…' ELSE {_flat(c)} END"


@_query(f"""WITH {_search}, top AS (SELECT best.*, usable.solution, {_jaccard.format(a=_tok('asked.problem'), b=_tok('usable.problem'))} AS alike FROM best JOIN asked USING (ticket_id) JOIN usable USING (row_id) WHERE place <= 5 AND score >= 0.3),
    done AS (SELECT ticket_id FROM top WHERE floor(100 * alike + 0.5) >= {resolve.INTENT}), {_near('ticket_id NOT IN (SELECT ticket_id FROM done)')}
    SELECT ticket_id, 1 AS tier, place, sps_id AS source, NULL AS chunk, round(score, 6) AS score, {_cut('solution')} AS evidence FROM top
    UNION ALL SELECT ticket_id, 2, place, doc_id::VARCHAR, chunk, round(score, 6), {_cut('passage')} FROM near JOIN passages USING (doc_id, chunk) WHERE place <= {resolve.PASSAGES} AND score >= {resolve.PASSAGE_GATE}""")
def ticket_evidence(spark: SparkSession, d: str) -> DataFrame:
    """All evidence of each ticket whose id is divisible by 20: its shortlist and, if that answers nothing, its passages."""
    tickets = table(spark, d, "incoming_tickets").where(F.col("ticket_id") % 20 == 0)
    found = resolve.evidence(tickets, *(table(spark, d, t) for t in ("boilerplate_history", "commodity_groups", "documents")))
    return found.withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- ranking and tallies

_clean = "SELECT *, least(greatest(composite_score, 0.0), 1.0) AS score, coalesce(exact_part, false) AS exact FROM candidates WHERE NOT isnan(composite_score) AND sps_id IS NOT NULL"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("cand_id", "ticket_id", "sps_id", "composite_score", F.coalesce("exact_part", F.lit(False)).alias("exact"))
    return rows.withColumn("score", ranking.limited(F.col("composite_score"))).where(F.col("score").isNotNull() & F.col("sps_id").isNotNull())


_ORDER = [F.desc, "score"], [F.desc, "exact"], [F.desc, "sps_id"], [F.asc, "cand_id"]


def _order() -> list:
    return [f(c) for f, c in _ORDER]


_placed = f"""WITH c AS ({_clean}), once AS (SELECT *, row_number() OVER (PARTITION BY ticket_id, sps_id ORDER BY score DESC, exact DESC, cand_id) AS again FROM c {{w}}),
    best AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, exact DESC, sps_id DESC, cand_id) AS place FROM once WHERE again = 1)"""


@_query(_placed.format(w="WHERE score >= 0.3") + " SELECT ticket_id, cand_id, sps_id, place FROM best WHERE place <= 5")
def candidate_shortlists(spark: SparkSession, d: str) -> DataFrame:
    """Each ticket's five best candidates above the gate, a record once."""
    return ranking.shortlist(_candidates(spark, d), "ticket_id", "sps_id", "score", _order(), 5, 0.3).select("ticket_id", "cand_id", "sps_id", "place")


@_query(_placed.format(w="") + " SELECT ticket_id, cand_id, CAST(trunc((score + 1e-6) * 100) AS INT) AS percent, place FROM best WHERE place <= 3")
def near_misses(spark: SparkSession, d: str) -> DataFrame:
    """Each ticket's three best candidates, whatever their scores."""
    return ranking.best_items(_candidates(spark, d), "ticket_id", "sps_id", _order()).where("place <= 3").select("ticket_id", "cand_id", T.percent(F.col("score")).alias("percent"), "place")


_shortlist = _placed.format(w="WHERE score >= 0.3") + ", short AS (SELECT * FROM best WHERE place <= 5)"


def _stand_in():
    """A client that scores a shortlist as a model might: out of range, for an id nobody gave it, and not at all."""

    def score(rows: list[dict]) -> list[dict]:
        scored = [[{"sps_id": x["sps_id"], "intent": int(x["percent"]) * 2 - 60} for x in r["asked"] if x["percent"] % 7] for r in rows]
        return [{"scores": [*s, {"sps_id": "nobody's", "intent": 99}]} for s in scored]

    return score


@_query(_shortlist + """, scored AS (SELECT *, CAST(trunc((score + 1e-6) * 100) AS INT) AS percent FROM short)
    SELECT ticket_id, sps_id, CAST(least(greatest(percent * 2 - 60, 0), 100) AS INT) AS intent, row_number() OVER (PARTITION BY ticket_id ORDER BY least(greatest(percent * 2 - 60, 0), 100) DESC, exact DESC, score DESC, sps_id DESC) AS place
    FROM scored WHERE percent % 7 <> 0""")
def intent_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each ticket's shortlist as a model scores it, one call a ticket: ids that weren't asked about are dropped, scores limited, candidates ranked anew."""
    short = ranking.shortlist(_candidates(spark, d), "ticket_id", "sps_id", "score", _order(), 5, 0.3).withColumn("percent", T.percent(F.col("score")))
    asked = short.groupBy("ticket_id").agg(F.array_sort(F.collect_list(F.struct("place", "sps_id", "percent"))).alias("asked"))
    answers = models.called(asked, _stand_in, StructType.fromDDL("scores array<struct<sps_id: string, intent: int>>"))
    joined = models.joined_scores(answers.where("error IS NULL"), short.drop("place"), "ticket_id", "sps_id")
    order = Window.partitionBy("ticket_id").orderBy(F.desc("intent"), F.desc("exact"), F.desc("score"), F.desc("sps_id"))
    return joined.select("ticket_id", "sps_id", "intent", F.row_number().over(order).alias("place"))


@_query(_placed.format(w="") + f""", h AS (SELECT upper({_trim('sps_id')}) AS sps_id, arg_max({_trim('problem_description')}, row_id) AS text_b FROM boilerplate_history WHERE {_trim('problem_description')} <> '' GROUP BY 1),
    pairs AS (SELECT ticket_id, best.sps_id, exact, {_trim('problem_description')} AS text_a, text_b FROM best JOIN incoming_tickets USING (ticket_id) JOIN h ON best.sps_id = h.sps_id WHERE place = 1 AND {_trim('problem_description')} <> ''),
    texts AS (SELECT text_a AS t FROM pairs UNION SELECT text_b FROM pairs),
    v AS (SELECT t, substr(md5(x), 1, 2) AS b, count(*) AS n FROM (SELECT t, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS x FROM texts) GROUP BY 1, 2), norms AS (SELECT t, sum(n * n)::DOUBLE AS nn FROM v GROUP BY 1),
    dots AS (SELECT ticket_id, sum(x.n * y.n)::DOUBLE AS dot FROM pairs JOIN v x ON text_a = x.t JOIN v y ON text_b = y.t AND x.b = y.b GROUP BY 1)
    SELECT ticket_id, pairs.sps_id, CASE WHEN exact THEN 'match' ELSE 'no-match' END AS expect, round(coalesce(dot / sqrt(p.nn * q.nn), 0), 6) AS cosine
    FROM pairs LEFT JOIN dots USING (ticket_id) LEFT JOIN norms p ON text_a = p.t LEFT JOIN norms q ON text_b = q.t""")
def pair_probe(spark: SparkSession, d: str) -> DataFrame:
    """How similar each ticket's problem is to its best candidate's latest one; own-part pairs are expected to match.  The most similar first."""
    problem = T.trimmed(F.col("problem_description"))
    best = ranking.best_items(_candidates(spark, d), "ticket_id", "sps_id", _order()).where("place = 1").select("ticket_id", "sps_id", F.when(F.col("exact"), "match").otherwise("no-match").alias("expect"))
    asked = table(spark, d, "incoming_tickets").select("ticket_id", problem.alias("text_a")).where("text_a <> ''")
    known = table(spark, d, "boilerplate_history").select(F.upper(T.trimmed(F.col("sps_id"))).alias("sps_id"), "row_id", problem.alias("text_b")).where("text_b <> ''")
    known = known.groupBy("sps_id").agg(F.max_by("text_b", "row_id").alias("text_b"))
    scored = textvectors.pair_cosines(best.join(asked, "ticket_id").join(known, "sps_id"), "text_a", "text_b", hashed_counts)
    return scored.select("ticket_id", "sps_id", "expect", F.round("cosine", 6).alias("cosine")).orderBy(F.desc("cosine"), "ticket_id")


@_query("""SELECT ticket_id, count(*) AS matched, count(s) AS considered, count(DISTINCT CASE WHEN s >= 0.3 THEN sps_id END) AS qualified, max(s) AS top_score
    FROM (SELECT *, CASE WHEN NOT isnan(composite_score) THEN least(greatest(composite_score, 0.0), 1.0) END AS s FROM candidates) GROUP BY 1""")
def ticket_counters(spark: SparkSession, d: str) -> DataFrame:
    """What each ticket's candidates come to."""
    return ranking.counters(table(spark, d, "candidates"), "ticket_id", "sps_id", ranking.limited(F.col("composite_score")), 0.3)


@_query("""SELECT issue_type, count(*) AS n, min(row_id) AS first_row FROM (SELECT lower(trim(coalesce(issue_type, ''))) AS issue_type, row_id FROM bulk_tickets) GROUP BY 1""")
def issue_tally(spark: SparkSession, d: str) -> DataFrame:
    """Bulk tickets by issue type; ties are told apart by the first row."""
    rows = table(spark, d, "bulk_tickets").select(F.lower(F.trim(T.text(F.col("issue_type")))).alias("issue_type"), "row_id")
    return rows.groupBy("issue_type").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row")).orderBy(F.desc("n"), "first_row")


@_query("""SELECT lower(trim(coalesce(issue_type, ''))) AS issue_type, count(*) AS n, count(*) FILTER (WHERE problem_reason_code IS NULL OR trim(problem_reason_code) = '') AS n_without_reason,
    count(*) FILTER (WHERE regexp_matches(problem_reason_code, '^RC-[1-3][0-9]*$')) AS n_of_first_kinds FROM incoming_tickets GROUP BY 1""")
def reason_tally(spark: SparkSession, d: str) -> DataFrame:
    """Tickets by issue type, and how many of them have no reason code or one that begins with 1 to 3."""
    rows = table(spark, d, "incoming_tickets").select(F.lower(F.trim(T.text(F.col("issue_type")))).alias("issue_type"), F.col("problem_reason_code").alias("reason"))
    return rows.groupBy("issue_type").agg(F.count("*").alias("n"), F.count_if(F.trim(T.text(F.col("reason"))) == "").alias("n_without_reason"), F.count_if(F.col("reason").rlike("^RC-[1-3][0-9]*$")).alias("n_of_first_kinds"))


_pick = lambda f: f"l[1 + CAST(trunc({f}::DOUBLE * (n - 1)) AS INT)]"


@_query(f"""SELECT issue_type, n, l[1] AS lowest, {_pick(0.25)} AS p25, {_pick(0.5)} AS median, {_pick(0.75)} AS p75, {_pick(0.9)} AS p90, l[n] AS highest
    FROM (SELECT issue_type, count(*) AS n, list_sort(list(composite_score)) AS l FROM candidates WHERE issue_type IS NOT NULL AND NOT isnan(composite_score) GROUP BY 1)""")
def score_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the candidates' scores by issue type."""
    shares = {"lowest": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "highest": 1.0}
    return sums.floor_percentiles(table(spark, d, "candidates"), "issue_type", "composite_score", shares)


@_query("""WITH m AS (SELECT user_id, event_type = 'error' AS hit, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
    SELECT user_id, max(run) AS longest_run FROM (SELECT user_id, island, count(*) FILTER (WHERE hit) AS run FROM m GROUP BY 1, 2) GROUP BY 1""")
def error_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each user's longest run of errors."""
    return sums.longest_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@_query("""SELECT min(cosine_similarity) FILTER (WHERE exact_part) AS least_match, max(cosine_similarity) FILTER (WHERE NOT exact_part) AS most_other,
    count(*) FILTER (WHERE exact_part) AS n_match, count(*) FILTER (WHERE NOT exact_part) AS n_other FROM candidates WHERE NOT isnan(cosine_similarity)""")
def score_separation(spark: SparkSession, d: str) -> DataFrame:
    """Whether a gate could tell own-part candidates from others."""
    rows = table(spark, d, "candidates").where(F.col("cosine_similarity").isNotNull() & ~F.isnan("cosine_similarity"))
    own, score = F.col("exact_part"), F.col("cosine_similarity")
    return rows.agg(F.min(F.when(own, score)).alias("least_match"), F.max(F.when(~own, score)).alias("most_other"), F.count_if(own).alias("n_match"), F.count_if(~own).alias("n_other"))


@_query("WITH h AS (SELECT DISTINCT upper(" + _trim('sps_id') + ") AS sps_id FROM boilerplate_history), t AS (SELECT DISTINCT upper(" + _trim('sps_id') + """) AS sps_id FROM incoming_tickets)
    SELECT sps_id, t.sps_id IS NOT NULL AS asked, h.sps_id IS NOT NULL AS recorded FROM h FULL JOIN t USING (sps_id) WHERE sps_id <> ''""")
def record_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Ids that only tickets, only the history or both have."""
    ids = lambda t, c: table(spark, d, t).select(F.upper(T.trimmed(F.col("sps_id"))).alias("sps_id")).where("sps_id <> ''").distinct().withColumn(c, F.lit(True))
    both = ids("incoming_tickets", "asked").join(ids("boilerplate_history", "recorded"), "sps_id", "full")
    return both.select("sps_id", F.coalesce("asked", F.lit(False)).alias("asked"), F.coalesce("recorded", F.lit(False)).alias("recorded"))


@_query(f"""SELECT part_number AS canonical_part, n_tickets, n_history FROM (SELECT {_part('part_number')} AS part_number, count(*) AS n_tickets FROM incoming_tickets GROUP BY 1)
    JOIN (SELECT {_part('part_number')} AS part_number, count(*) AS n_history FROM boilerplate_history GROUP BY 1) USING (part_number) WHERE part_number IN (SELECT part_number FROM part_catalog)""")
def part_activity(spark: SparkSession, d: str) -> DataFrame:
    """Tickets and history rows of each catalogue part that has both; both sides are counted before they are joined."""
    count = lambda t, c: table(spark, d, t).groupBy(T.canonical_part(F.col("part_number")).alias("canonical_part")).agg(F.count("*").alias(c))
    both = count("incoming_tickets", "n_tickets").join(count("boilerplate_history", "n_history"), "canonical_part")
    return both.join(table(spark, d, "part_catalog").select(F.col("part_number").alias("canonical_part")), "canonical_part", "left_semi")


# ---------------------------------------------------------------- joins and reports


@_query(f"""SELECT group_key, count(*) AS n_parts, count(DISTINCT code) AS n_codes FROM (SELECT part_number, {_code(_part('part_number'))} AS code FROM part_catalog) JOIN (WITH {_groups} SELECT * FROM fam) fam ON code = fam.commodity_code GROUP BY 1""")
def family_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue parts and codes of each family: parts are counted by code before they meet the families."""
    codes = table(spark, d, "part_catalog").groupBy(T.commodity_code(T.canonical_part(F.col("part_number"))).alias("commodity_code")).agg(F.count("*").alias("n"))
    known = families.families(families.grouped_codes(table(spark, d, "commodity_groups")))
    return codes.join(known, "commodity_code").groupBy("group_key").agg(F.sum("n").alias("n_parts"), F.count("*").alias("n_codes"))


@_query(f"""WITH own AS (SELECT upper({_trim('sps_id')}) AS sps_id, max(row_id) AS row_id FROM boilerplate_history GROUP BY 1), part AS (SELECT {_part('part_number')} AS p, max(row_id) AS row_id FROM boilerplate_history GROUP BY 1)
    SELECT ticket_id, coalesce(own.row_id, part.row_id) AS row_id, CASE WHEN own.row_id IS NOT NULL THEN 'own' WHEN part.row_id IS NOT NULL THEN 'part' ELSE 'none' END AS found_by
    FROM incoming_tickets LEFT JOIN own ON upper({_trim('incoming_tickets.sps_id')}) = own.sps_id AND own.sps_id <> '' LEFT JOIN part ON {_part('incoming_tickets.part_number')} = part.p AND part.p <> ''""")
def latest_records(spark: SparkSession, d: str) -> DataFrame:
    """Each ticket's latest history row: under its own id, else of its part.  Both sides are one row a key before the joins."""
    history = table(spark, d, "boilerplate_history").select("row_id", F.upper(T.trimmed(F.col("sps_id"))).alias("sps"), T.canonical_part(F.col("part_number")).alias("part"))
    own = history.where("sps <> ''").groupBy("sps").agg(F.max("row_id").alias("own"))
    part = history.where("part <> ''").groupBy("part").agg(F.max("row_id").alias("of_part"))
    tickets = table(spark, d, "incoming_tickets").select("ticket_id", F.upper(T.trimmed(F.col("sps_id"))).alias("sps"), T.canonical_part(F.col("part_number")).alias("part"))
    found = tickets.join(own, "sps", "left").join(part, "part", "left")
    by = F.when(F.col("own").isNotNull(), "own").when(F.col("of_part").isNotNull(), "part").otherwise("none")
    return found.select("ticket_id", F.coalesce("own", "of_part").alias("row_id"), by.alias("found_by"))


@_query(_placed.format(w="") + """ SELECT ticket_id, string_agg('[' || place || '] ' || sps_id || ' (' || CAST(trunc((score + 1e-6) * 100) AS INT) || '%)', chr(10) ORDER BY place) AS sources FROM best WHERE place <= 3 GROUP BY 1""")
def source_lists(spark: SparkSession, d: str) -> DataFrame:
    """Each ticket's three best records as a numbered list."""
    best = ranking.best_items(_candidates(spark, d), "ticket_id", "sps_id", _order()).where("place <= 3")
    line = F.concat("sps_id", F.lit(" ("), T.percent(F.col("score")).cast("string"), F.lit("%)"))
    ordered = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return best.groupBy("ticket_id").agg(T.numbered(F.transform(ordered, lambda x: x["line"])).alias("sources"))


@_query("""SELECT issue_type, least_match, most_other, round(least_match - most_other, 4) AS margin, least_match > most_other AS separable, round(greatest(least_match - 0.01, 0), 4) AS suggested_gate FROM (
    SELECT issue_type, min(composite_score) FILTER (WHERE exact_part) AS least_match, max(composite_score) FILTER (WHERE NOT exact_part) AS most_other FROM candidates WHERE NOT isnan(composite_score) GROUP BY 1)""")
def gate_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """By issue type, whether a gate could tell own-part candidates from others, and which."""
    rows = table(spark, d, "candidates").where(F.col("composite_score").isNotNull() & ~F.isnan("composite_score"))
    own, score = F.col("exact_part"), F.col("composite_score")
    found = rows.groupBy("issue_type").agg(F.min(F.when(own, score)).alias("least_match"), F.max(F.when(~own, score)).alias("most_other"))
    gate = F.when(F.col("least_match").isNotNull(), F.round(F.greatest(F.col("least_match") - 0.01, F.lit(0.0)), 4))
    return found.select("*", F.round(F.col("least_match") - F.col("most_other"), 4).alias("margin"), (F.col("least_match") > F.col("most_other")).alias("separable"), gate.alias("suggested_gate"))


@_query("""SELECT row_id, CASE WHEN length(t) > 32767 THEN substr(t, 1, 32744) || ' […truncated for Excel]' ELSE t END AS cell FROM (
    SELECT row_id, regexp_replace(translate(coalesce(problem_description, ''), chr(11) || chr(12), chr(10) || chr(10)), '[\\x00-\\x08\\x0e-\\x1f]', '', 'g') AS t FROM bulk_tickets)""")
def sheet_cells(spark: SparkSession, d: str) -> DataFrame:
    """The bulk tickets' problems as a sheet takes them."""
    return table(spark, d, "bulk_tickets").select("row_id", T.cell(F.col("problem_description")).alias("cell"))


@_query("""SELECT lower(trim(coalesce(source, ''))) AS source, count(*) AS n_docs, CAST(sum(('0x' || substr(md5(doc_id || ':' || coalesce(text, '')), 1, 8))::BIGINT) AS BIGINT) AS digest FROM documents GROUP BY 1""")
def corpus_digests(spark: SparkSession, d: str) -> DataFrame:
    """A number for each source that changes with any of its documents, in whatever order they are read."""
    one = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), T.text(F.col("text")))), 1, 8), 16, 10).cast("bigint")
    return table(spark, d, "documents").groupBy(F.lower(F.trim(T.text(F.col("source")))).alias("source")).agg(F.count("*").alias("n_docs"), F.sum(one).alias("digest"))


_part_of = lambda k: f"CAST(sum(('0x' || substr(md5(doc_id || ':' || coalesce(text, '')), {8 * k + 1}, 8))::BIGINT) AS BIGINT) AS digest_{k}"


@_query(f"SELECT lower(trim(coalesce(source, ''))) AS source, count(*) AS n_docs, {', '.join(map(_part_of, range(4)))} FROM documents GROUP BY 1")
def whole_corpus_digests(spark: SparkSession, d: str) -> DataFrame:
    """As corpus_digests, from all 128 bits of each document's digest."""
    one = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), T.text(F.col("text"))))
    parts = [F.sum(F.conv(F.substring(one, 8 * k + 1, 8), 16, 10).cast("bigint")).alias(f"digest_{k}") for k in range(4)]
    return table(spark, d, "documents").groupBy(F.lower(F.trim(T.text(F.col("source")))).alias("source")).agg(F.count("*").alias("n_docs"), *parts)


@_query(f"""SELECT ticket_id, first_ticket FROM (SELECT ticket_id, min(ticket_id) OVER (PARTITION BY s, p, t) AS first_ticket FROM (
    SELECT ticket_id, upper({_trim('sps_id')}) AS s, {_part('part_number')} AS p, {_flat('problem_description')} AS t FROM incoming_tickets)) WHERE ticket_id <> first_ticket""")
def repeated_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Tickets that an earlier one repeats: same id, part and problem.  Keys are counted first; only repeated ones are joined back."""
    rows = table(spark, d, "incoming_tickets").select("ticket_id", F.xxhash64(F.upper(T.trimmed(F.col("sps_id"))), T.canonical_part(F.col("part_number")), T.collapsed(F.col("problem_description"))).alias("key"))
    first = rows.groupBy("key").agg(F.min("ticket_id").alias("first_ticket"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "key").where("ticket_id <> first_ticket").select("ticket_id", "first_ticket")


@_query(f"""SELECT lower(trim(coalesce(issue_type, ''))) AS issue_type, count(*) AS n_rows, count(*) FILTER (WHERE {_trim('problem_description')} <> '') AS n_with_vector FROM boilerplate_history GROUP BY 1""")
def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many history rows find their text's vector, by issue type."""
    rows = table(spark, d, "boilerplate_history").select(F.lower(F.trim(T.text(F.col("issue_type")))).alias("issue_type"), T.text_key(T.trimmed(F.col("problem_description"))).alias("text_key"))
    vectors = problem_vectors(spark, d).select("text_key", F.lit(True).alias("there"))
    return rows.join(vectors, "text_key", "left").groupBy("issue_type").agg(F.count("*").alias("n_rows"), F.count("there").alias("n_with_vector"))
