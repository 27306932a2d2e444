"""One surviving record for each group of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """An ISO-8601 date and time as microseconds since 1970; null where it is none.

    Without an offset it is UTC.  The session's time zone plays no part.
    """
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(Z|[+-]\d\d:?\d\d)$") & t.rlike(r"\d:\d\d"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), zoned).try_cast("timestamp"))


def surviving_fields(df: DataFrame, key: str, fields: dict[str, Column], recency: Column, trust: Column | dict[str, Column], row_id: str, min_rows: int = 2, values: dict[str, Column] | None = None) -> DataFrame:
    """(key, n_rows, <field>_row_id ..., and <field> with ``values``): for each key the row that each field survives from.

    ``fields`` gives for each field what makes a row's value complete; only
    complete values survive.  Of those, the most trusted row wins, then the
    latest, then the one with the largest ``row_id``; null recency is older
    than all.  ``trust`` is one value for all fields of a row, or gives it field
    by field; fields it doesn't name have the same trust in every row, and a
    null trust is below all.  ``values`` gives each field's text, which then
    travels with its row's offer.  A field complete in no row is null.  Keys with fewer than
    ``min_rows`` rows, and null keys, are left out.

    A row enters once for each field it can give; the window keeps the first
    of each (key, field), which Spark does before the shuffle as well, so that
    a key with very many rows sends one row a partition.
    """
    named = df.where(F.col(key).isNotNull())
    counts = named.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_rows)
    trusts = {name: trust.get(name, F.lit(0)) if isinstance(trust, dict) else trust for name in fields}
    value = {name: (values or {}).get(name, F.lit(None)).cast("string").alias("value") for name in fields}
    offers = F.array_compact(F.array(*(F.when(ok, F.struct(F.lit(name).alias("field"), trusts[name].alias("trust"), value[name])) for name, ok in fields.items())))
    rows = named.select(F.col(key).alias("__key"), F.explode(offers).alias("offer"), recency.alias("recency"), F.col(row_id).alias("row")).select("__key", "offer.*", "recency", "row")
    best = Window.partitionBy("__key", "field").orderBy(F.desc_nulls_last("trust"), F.desc_nulls_last("recency"), F.desc_nulls_last("row"))
    first = rows.withColumn("place", F.row_number().over(best)).where("place = 1")
    of = lambda name, c: F.max(F.when(F.col("field") == name, F.col(c)))
    wide = first.groupBy("__key").agg(*(of(name, "row").alias(f"{name}_row_id") for name in fields), *(of(name, "value").alias(name) for name in values or ()))
    return counts.join(wide, "__key", "left").withColumnRenamed("__key", key)
