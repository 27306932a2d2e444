from datetime import datetime, timezone

from pyspark.sql import functions as F

from casebook.llm.survivor import instant, surviving_fields


def test_instants_do_not_depend_on_the_session(spark):
    cases = {"2024-01-02T03:04:05Z": 3, "2024-01-02 03:04:05": 3, "2024-01-02T03:04:05+02:00": 1, "2024-01-02 03:04:05-05:00": 8, "unknown": None, "": None, None: None, "2024-13-02T03:04:05Z": None, "2024": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for r in df.select("t", instant(F.col("t")).alias("i")).collect():
                hour = cases[r["t"]]
                expected = None if hour is None else int(datetime(2024, 1, 2, hour, 4, 5, tzinfo=timezone.utc).timestamp() * 1e6)
                assert r["i"] == expected, r["t"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_each_field_from_its_row(spark):
    rows = [
        ("A", 1, "long enough", 5, 0), ("A", 2, "x", 9, 0), ("A", 3, "long enough too", 5, 0), ("A", 4, None, None, 0),
        ("B", 5, "x", 1, 0), ("B", 6, None, 2, 0),
        ("C", 7, "only one row of it", 1, 0),
        (None, 8, "long enough", 1, 0), (None, 9, "long enough", 1, 0),
        ("D", 10, "trusted value", None, 1), ("D", 11, "later value", 7, 0), ("D", 11, "later value", 7, 0),
    ]
    df = spark.createDataFrame(rows, "k string, id long, v string, at long, t int")
    got = {r["k"]: (r["n_rows"], r["v_row_id"]) for r in surviving_fields(df, "k", {"v": F.length("v") > 5}, F.col("at"), F.col("t"), "id").collect()}
    assert got == {"A": (4, 3), "B": (2, None), "D": (3, 10)}
    assert surviving_fields(df.where("false"), "k", {"v": F.length("v") > 5}, F.col("at"), F.col("t"), "id").count() == 0


def test_key_with_a_name_used_inside(spark):
    df = spark.createDataFrame([("A", 1, "long enough"), ("A", 2, "x")], "field string, row long, place string")
    assert [tuple(r) for r in surviving_fields(df, "field", {"trust": F.length("place") > 5}, F.lit(0), F.lit(0), "row").collect()] == [("A", 2, 1)]


def test_trust_of_one_field_leaves_the_others_to_recency(spark):
    df = spark.createDataFrame([("A", 1, "x", "y", 1, 9), ("A", 2, "x", "y", 2, 0), ("A", 3, "x", None, 3, None)], "k string, id long, v string, w string, at long, t int")
    fields = {"v": F.col("v").isNotNull(), "w": F.col("w").isNotNull()}
    found = lambda trust: [tuple(r) for r in surviving_fields(df, "k", fields, F.col("at"), trust, "id").select("v_row_id", "w_row_id").collect()]
    assert found({"v": F.col("t")}) == [(1, 2)] and found({}) == [(3, 2)] and found(F.col("t")) == [(1, 1)]


def test_survivors_take_their_texts_from_the_rows_of_p5_found(spark, small, tmp_path):
    from casebook.llm import queries
    from casebook.storage import table

    texts = lambda n: (f"problem text number {n}", f"solution text number {n}")
    rows = [
        (1, "sp-1", "AB1-22", "lid", *texts(1), "2024-01-01T00:00:00Z"), (2, "SP-1 ", " ab1-22", "nut", *texts(2), "2024-03-01T00:00:00Z"), (3, "SP-1", "ab1-2", None, "short", *texts(3)[1:], "2024-02-01T00:00:00Z"),
        (4, "SP-2", "ab2-1", "lid", *texts(4), None), (5, "SP-2", "AB2-1", "lid", *texts(5), None),
    ]
    kind = "row_id long, sps_id string, part_number string, issue_type string, problem_description string, solution_text string, last_modified_date string"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "boilerplate_history.parquet"))
    got = {r["sps_id"]: r for r in queries.p5_survivors(spark, str(tmp_path)).collect()}
    assert (got["SP-1"]["part_number"], got["SP-1"]["issue_type"], got["SP-1"]["last_modified_date"]) == ("AB1-22", "nut", "2024-03-01T00:00:00Z")
    for d in (str(tmp_path), small):
        survivors = {r["sps_id"]: r for r in queries.p5_survivors(spark, d).collect()}
        known = {r["row_id"]: r for r in table(spark, d, "boilerplate_history").collect()}
        found = queries.p5_found(spark, d).collect()
        assert found
        for r in found:
            for row, field in (("problem_row_id", "problem_description"), ("solution_row_id", "solution_text")):
                assert survivors[r["sps_id"]][field] == (known[r[row]][field] if r[row] is not None else None)
