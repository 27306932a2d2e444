import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def against_sql(spark, directory, query, sql):
    """Asserts that a query and its SQL give the same columns and rows."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    frame = query(spark, directory)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    flat = lambda v: round(v, 9) if isinstance(v, float) else tuple(map(flat, v)) if isinstance(v, list) else v
    ours = sorted(str([flat(v) for v in row]) for row in frame.select(*names).collect())
    assert ours == sorted(str([flat(v) for v in row]) for row in cursor.fetchall())
    return ours
