from pyspark.sql import functions as F

from casebook.functions import gates
from casebook.functions import text as T


def each(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonical_parts(spark):
    assert each(spark, ["ab 1", "a b​-1", "﻿a­b⁠", None, "  ", "a/b", "a_b", "a.b", "a-b", "a\x1fb"], T.canonical_part) == ["AB1", "AB-1", "AB", "", "", "A/B", "A_B", "A.B", "A-B", "AB"]
    assert each(spark, ["", "---", "-/_.", "A-"], T.valid_part) == [False, False, False, True]
    assert each(spark, ["ABC1-X-2", "0022", "-43951", ""], T.commodity_code) == ["ABC1", "", "", ""]


def test_percent_keeps_whole_percents(spark):
    assert each(spark, [n / 100 for n in range(101)], T.percent, "double") == list(range(101))
    assert each(spark, [0.99999988, 0.8899, 1.3, -0.2, None], T.percent, "double") == [100, 88, 100, 0, None]


def test_white_space_and_extracts(spark):
    assert each(spark, ["  a \n b \x1c", None], T.collapsed) == ["a b", ""]
    assert each(spark, ["  a \n b \x1c"], T.trimmed) == ["a \n b"]
    assert each(spark, ["x" * 600, "x" * 500], lambda c: F.length(T.extract(c))) == [500, 500]
    assert each(spark, ["One. Two!  Three? four", "", None, "3.5 mm. End."], lambda c: F.size(T.sentences(c))) == [4, 0, 0, 2]
    assert each(spark, ["a  b\nc", "", None], lambda c: F.size(T.words(c))) == [3, 0, 0]


def test_instants(spark):
    got = each(spark, ["2024-01-02T03:04:05+01:00", "2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "20240102", "2024", "unknown", None], lambda c: F.unix_seconds(T.instant(c)))
    assert got == [1704161045, 1704164645, 1704164645, None, None, None, None]


def kinds(spark, texts, scanner):
    return [[(f["kind"], f["fragment"]) for f in x] for x in each(spark, texts, scanner)]


def test_references(spark):
    found = kinds(spark, ["See ESW#20033465 and NCR 5566.", "ref ab # 1234", "attach photos within 30 days", "the attached file", "see  below, as\ndiscussed", "lot 12345, PO no. 777", "on 2024-01-05 or 1/5/24", "part 0012-43951", None, "Enclosed and ENCLOSED"], gates.references)
    assert found[0] == [("internal tracking identifier", "ESW#20033465"), ("internal tracking identifier", "NCR 5566")]
    assert found[1] == [("tracking identifier", "ab # 1234")] and found[2] == []
    assert found[3] == [("reference to an attachment", "attached")]
    assert found[4] == [("reference to something not included", "see below"), ("reference to a prior conversation", "as discussed")]
    assert [k for k, _ in found[5]] == ["lot, batch or purchase-order number"] * 2 and [k for k, _ in found[6]] == ["a specific date"] * 2
    assert found[7] == found[8] == [] and len(found[9]) == 1


def test_actions_and_warning(spark):
    assert kinds(spark, ["1. Issue an ESW.", "the ESW is approved", "1. Waive the requirement", "we will waive it", "request a waiver"], gates.actions) == [
        [("instruction to perform an internal action", "Issue an ESW")], [], [("instruction to perform an internal action", "1. Waive")], [], []]
    assert each(spark, ["clean", None, "see above"], gates.warning) == ["", "", "Contains: reference to something not included: 'see above'"]
    orders = ["We approve the waiver, then grant a deviation.", "They will waive\nMRB. Issue. Waiver", "please waive", "3) Please  waive, now\nwaived", "reissue a waiver; issued the waiver", None, ""]
    assert [[f for _, f in x] for x in kinds(spark, orders, gates.actions)] == [["approve the waiver", "grant a deviation"], ["waive MRB"], ["please waive"], ["3) Please waive"], [], [], []]
