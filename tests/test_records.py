import csv
import io
import random

import pytest

from casebook.operators import records
from casebook.operators.records import Grammar

GOOD = 'RX-1,0012-43951,Quality,"A lid, with ""quotes""\nand a line break",Supplier'
HISTORY = "RX-1,0012-43951,Quality,The lid was cracked,Replace the lid at once,2024-02-29T10:00:00+05:30"


def fields(text, width=5):
    return [(r.reason, r.fields, r.at) for r in Grammar(text).chunk(width)]


def test_well_formed_as_the_csv_module_reads_it():
    random.seed(2)
    for _ in range(300):
        row = ["".join(random.choice('ab ,"\n\r') for _ in range(random.randrange(6))) for _ in range(random.randrange(1, 6))]
        out = io.StringIO()
        csv.writer(out, quoting=random.choice((csv.QUOTE_ALL, csv.QUOTE_MINIMAL)), lineterminator="").writerow(row)
        (reason, got, _), = fields(out.getvalue())
        assert reason is None and got == row


@pytest.mark.parametrize("text,at", [('RX-1,a"b,c,d,e', 6), ('RX-1,"a"b,c,d,e', 8), ('RX-1,"abc,d,e', 5), ('RX-1,"a" ,c', 8), ('RX-1,a\\"b,c', 7), ('"', 0)])
def test_broken_quotes_are_located(text, at):
    assert fields(text)[0][::2] == ("quoting", at)


def test_resumes_at_the_next_record():
    text = f'RX-1,p1,Quality,"never closed, Supplier\nRX-2,p-2,Quality,the second one,S\n{GOOD}\nRX-9,x"y,Quality,broken too,S\nRX-10,p,Quality,the last one,S'
    got = fields(text)
    assert [r for r, _, _ in got] == ["quoting", None, None, "quoting", None]
    assert [f[0] for _, f, _ in got if f] == ["RX-2", "RX-1", "RX-10"]


def test_an_anchor_must_read_as_a_whole_record():
    text = 'RX-1,p,Quality,"broken\nRX-2,only three,fields\nRX-3,p,Quality,five of them,S'
    assert [f and f[0] for _, f, _ in fields(text)] == [None, "RX-3"]


CASES = [
    (GOOD, "bulk_tickets", None), (HISTORY, "boilerplate_history", None), (HISTORY + "\r\n", "boilerplate_history", None),
    ("RX-1,  0012-43951 ,Quality,The lid was cracked,", "bulk_tickets", None),
    ("RX-1,p,Quality,The lid was cracked", "bulk_tickets", "columns"), ("", "bulk_tickets", "columns"), (None, "bulk_tickets", "columns"),
    ("RX-1,p,Q,The lid was cracked,S,more", "bulk_tickets", "columns"), (GOOD, "no such feed", "columns"), (GOOD, None, "columns"),
    ("RX-1,p,Q,The lid was\ncracked,S", "bulk_tickets", "columns"),
    ("rx-1,p,Q,The lid was cracked,S", "bulk_tickets", "value"), ("ABCDE-1,p,Q,The lid was cracked,S", "bulk_tickets", "value"), (" RX-1,p,Q,The lid was cracked,S", "bulk_tickets", "value"),
    ("RX-1,-/_.,Q,The lid was cracked,S", "bulk_tickets", "value"), ("RX-1,​ ️,Q,The lid was cracked,S", "bulk_tickets", "value"),
    ("RX-1,p,Q,   The lid    ,S", "bulk_tickets", "value"), ("RX-1,p,Q,The lid was cracked,S�", "bulk_tickets", "value"), ("RX-1,p,Q\x1b,The lid was cracked,S", "bulk_tickets", "value"),
    ("RX-1,p,Q,The lid\twas cracked,S\x85", "bulk_tickets", "value"), ('RX-1,"p"x,Q,short', "bulk_tickets", "quoting"),
    (HISTORY.replace("Replace the lid at once", "Too short"), "boilerplate_history", "value"),
    *((HISTORY.replace("2024-02-29T10:00:00+05:30", d), "boilerplate_history", "value") for d in ("2023-02-29T10:00:00Z", "2024-02-29T24:00:00Z", "2024-02-29 10:00:00Z", "2024-02-29T10:00:00", "2024-02-29T10:00:00+0530", "2024-02-29T10:00:61Z", "2024-02-29T10:00:00+05:75", "", "0000-01-01T00:00:00Z")),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, t, f, "x") for i, (t, f, _) in enumerate(CASES)], "record_id long, raw_text string, feed string, reason string")
    got = {r["record_id"]: r["reason"] for r in records.failures(records.parse_records(df)).collect()}
    assert [got.get(i) for i in range(len(CASES))] == [r for _, _, r in CASES]
    assert records.failures(records.parse_records(df.where("false"))).count() == 0


def test_typed_rows_and_places(spark):
    df = spark.createDataFrame([(1, HISTORY, "boilerplate_history"), (2, f'RX-5,"p\nq"z,\n{GOOD}', "bulk_tickets"), (2, GOOD, "bulk_tickets")], "record_id long, raw_text string, feed string")
    parsed = records.parse_records(df)
    row = records.loaded(parsed, "boilerplate_history").first()
    assert row["last_modified_date"].isoformat() == "2024-02-29T04:30:00" and row["part_number"] == "0012-43951"
    assert records.loaded(parsed, "bulk_tickets").count() == 2
    bad = parsed.where("reason IS NOT NULL").first()
    assert (bad["error_line"], bad["error_column"]) == (2, 3)


def test_errors_are_located_at_their_fields(spark):
    rows = [(1, "RX-1,-/_.,Q,The lid was cracked,S"), (2, 'RX-2,"p\n1",Q,short,S'), (3, "RX-3,p,Q,The lid was cracked,S,more"), (4, "RX-4,p,Q"), (5, f'RX-5,"p\nq"z,\n{GOOD}\nRX-6,p,Q,The lid was cracked,S\x1b')]
    parsed = records.parse_records(spark.createDataFrame([(i, t, "bulk_tickets") for i, t in rows], "record_id long, raw_text string, feed string"))
    got = sorted((r["record_id"], r["reason"], r["error_line"], r["error_column"]) for r in parsed.where("reason IS NOT NULL").collect())
    assert got == [(1, "value", 1, 6), (2, "value", 2, 6), (3, "columns", 1, 32), (4, "columns", 1, 8), (5, "quoting", 2, 3), (5, "value", 5, 30)]


def test_other_layouts_rules_and_anchors(spark):
    text = 'order 1;,"broken\norder 2;,7,fine\norder 3;,x,not a number\nno order,1,2'
    df = spark.createDataFrame([(1, text, "orders")], "record_id long, raw_text string, feed string")
    layouts = {"orders": ("Name", "Amount", "Note")}
    parsed = records.parse_records(df, layouts, rules={"Amount": lambda v: not v.isdigit()}, anchor=r"order \d+;,")
    assert [(r["reason"], r["error_line"]) for r in parsed.orderBy("record_no").collect()] == [("quoting", 1), (None, None), ("value", 3), (None, None)]
    assert [tuple(r)[2:] for r in records.loaded(parsed, "orders", layouts, {"Amount": "int"}).orderBy("record_no").collect()] == [("order 2;", 7, "fine"), ("no order", 1, "2")]


def test_many_breaks_take_linear_time():
    import time

    def seconds(n):
        text = "\n".join(f'RX-{i},x"y,Quality,broken' for i in range(n))
        began = time.process_time()
        assert sum(r.reason == "quoting" for r in Grammar(text).chunk(5)) == 1
        good = "\n".join(f'RX-{i},x"y,Quality,broken\n{GOOD}' for i in range(n))
        assert sum(r.reason == "quoting" for r in Grammar(good).chunk(5)) == n
        return time.process_time() - began

    seconds(200)
    assert seconds(16_000) < 24 * max(seconds(2_000), 0.01)
