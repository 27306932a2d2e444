"""Part families: codes that share a group, and the scope in which a ticket looks for precedent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import canonical_part, collapsed, commodity_code, valid_part


def _spelled(groups: DataFrame, code: str, name: str) -> DataFrame:
    rows = groups.select(canonical_part(F.col(code)).alias("commodity_code"), collapsed(F.col(name)).alias("group_name"))
    return rows.where("commodity_code <> '' AND group_name <> ''").withColumn("group_key", F.lower("group_name"))


def grouped_codes(groups: DataFrame, code: str = "commodity_code", name: str = "group_name") -> DataFrame:
    """(commodity_code, groups): each code's different groups in order; rows with a blank code or name are left out.

    Codes compare without white space and letter case, groups without outer
    white space and letter case.
    """
    return _spelled(groups, code, name).groupBy("commodity_code").agg(F.array_sort(F.collect_set("group_key")).alias("groups"))


def conflicts(codes: DataFrame) -> DataFrame:
    """(commodity_code, groups) of the codes that stand in several groups."""
    return codes.where(F.size("groups") > 1)


def families(codes: DataFrame) -> DataFrame:
    """(commodity_code, group_key) of the codes that stand in one group only."""
    return codes.where(F.size("groups") == 1).select("commodity_code", F.col("groups")[0].alias("group_key"))


def family_members(groups: DataFrame, code: str = "commodity_code", name: str = "group_name") -> DataFrame:
    """(group_key, group_name, members): a family's codes in order, and the smallest spelling of its name."""
    names = _spelled(groups, code, name).groupBy("group_key").agg(F.min("group_name").alias("group_name"))
    members = families(grouped_codes(groups, code, name)).groupBy("group_key").agg(F.array_sort(F.collect_set("commodity_code")).alias("members"))
    return members.join(names, "group_key").select("group_key", "group_name", "members")


def with_scope(df: DataFrame, codes: DataFrame, part: str = "part_number") -> DataFrame:
    """``df`` with canonical_part, commodity_code, scope_kind and scope.

    scope_kind, the first that holds: ``none`` (no valid part number), ``part``
    (no hyphen), ``conflict`` (code in several groups), ``unmapped``,
    ``family``.  scope is the key that precedent must share: ``f:`` and the
    group for a family, else ``p:`` and the canonical part; null for none.
    One join with the codes, a row each; Spark broadcasts them if they are small.
    """
    known = codes.select(F.col("commodity_code").alias("__code"), F.col("groups").alias("__groups"))
    rows = df.withColumn("canonical_part", canonical_part(F.col(part))).withColumn("commodity_code", commodity_code(F.col("canonical_part")))
    rows = rows.join(known, rows["commodity_code"] == F.col("__code"), "left")
    kind = (
        F.when(~valid_part(F.col("canonical_part")), "none").when(F.col("commodity_code") == "", "part").when(F.size("__groups") > 1, "conflict")
        .when(F.col("__groups").isNull(), "unmapped").otherwise("family")
    )
    rows = rows.withColumn("scope_kind", kind)
    scope = F.when(F.col("scope_kind") == "family", F.concat(F.lit("f:"), F.col("__groups")[0])).when(F.col("scope_kind") != "none", F.concat(F.lit("p:"), "canonical_part"))
    return rows.withColumn("scope", scope).drop("__code", "__groups")
