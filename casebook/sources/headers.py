"""Finding fields by their headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The headers under which the fields of a history export may stand, in order of preference.
HISTORY = {
    "sps_id": ("sps_id", "spsid", "id"),
    "part_number": ("part_number", "partno"),
    "problem_description": ("problem_description", "problem"),
    "solution_text": ("solution_text", "actual_solution", "solution"),
    "issue_type": ("issue_type",),
    "problem_reason_code": ("problem_reason_code", "reason_code"),
    "part_description": ("part_description",),
    "item_status": ("item_status",),
    "last_modified_date": ("last_modified_date", "modified"),
}
REQUIRED = ("sps_id", "part_number", "problem_description", "solution_text")


class MissingColumns(ValueError):
    """Required fields that no header names."""


#: What headers may have in place of a low line.
_JOINERS = str.maketrans(dict.fromkeys(" -", "_"))


def normal(header: str) -> str:
    """A header as the aliases are written."""
    return header.strip().translate(_JOINERS).casefold()


def header_map(columns: list[str], aliases: dict[str, tuple[str, ...]] = HISTORY, required: tuple[str, ...] = REQUIRED) -> dict[str, str]:
    """field -> the column that holds it: the first alias that is there, of equal headers the first."""
    there: dict[str, str] = {}
    for c in columns:
        there.setdefault(normal(c), c)
    found = {field: there[name] for field, names in aliases.items() for name in [next((n for n in names if n in there), None)] if name}
    if lacking := [f for f in required if f not in found]:
        raise MissingColumns(f"no column for {', '.join(lacking)}; found {', '.join(columns) or 'none'}")
    return found


def with_fields(df: DataFrame, aliases: dict[str, tuple[str, ...]] = HISTORY, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The fields of ``df`` under their own names, as texts without nulls; fields that no header names are empty."""
    found = header_map(df.columns, aliases, required)
    cell = lambda f: F.coalesce(df[f"`{found[f]}`"].cast("string"), F.lit("")) if f in found else F.lit("")
    kept = [c for c in ("file_name", "row_no") if c in df.columns]
    return df.select(*kept, *(cell(f).alias(f) for f in aliases))
