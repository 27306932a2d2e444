"""Loading comma-separated records that may be broken.

A small recursive-descent grammar (RFC 4180) reads each text chunk:

    chunk  = record *(linebreak record)
    record = field *("," field)
    field  = quoted / bare
    quoted = DQUOTE *(any but DQUOTE / 2DQUOTE) DQUOTE
    bare   = *(any but DQUOTE, comma, line break)

After a broken quote it goes on at the next line that begins like a record and
reads as a whole one, so that one bad quote doesn't swallow what follows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import trimmed

#: The fields of the exports.
LAYOUTS = {
    "bulk_tickets": ("SPS_ID", "Part_Number", "Issue_Type", "Problem_Description", "Supplier"),
    "boilerplate_history": ("SPS_ID", "Part_Number", "Issue_Type", "Problem_Description", "Solution_Text", "Last_Modified_Date"),
}

_INSIDE = re.compile(r'[^"]*(?:""[^"]*)*')
_BARE = re.compile(r'[^",\r\n]*')
_BREAK = re.compile(r"\r\n|\n|\r")
#: How a record begins, a pattern that may be given instead: an id of capitals and digits, quoted or not.
ANCHOR = r'"?[A-Z]{1,4}-[0-9]+"?,'


def record_starts(anchor: str = ANCHOR) -> re.Pattern[str]:
    """A line break that stands before a record."""
    return re.compile(rf"(?:\r\n|\n|\r)(?={anchor})")


_ID = re.compile(r"[A-Z]{1,4}-[0-9]+")
_WHEN = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:Z|[+-]([0-9]{2}):([0-9]{2}))")
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]")
# Code points without a look that aren't of the categories C or Z.
UNSEEN = set("͏ᅟᅠ឴឵⠀ㅤﾠ") | {chr(n) for n in (*range(0x180B, 0x1810), *range(0xFE00, 0xFE10))}


class QuoteError(Exception):
    """A broken quote: what is wrong, and where."""

    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.at = at


@dataclass
class Record:
    """A record of a chunk: its fields, or the error and its place."""

    start: int
    fields: list[str] | None
    reason: str | None = None
    message: str | None = None
    at: int | None = None
    places: list[int] | None = None


class Grammar:
    """Reads one chunk; ``at`` is the place reached, ``places`` are where the record's fields begin."""

    def __init__(self, text: str, anchor: re.Pattern[str] | None = None) -> None:
        self.text, self.at, self.places, self.anchor = text, 0, [], anchor or record_starts()

    def chunk(self, width: int) -> Iterator[Record]:
        while True:
            start = self.at
            try:
                fields = self.record()
            except QuoteError as e:
                yield Record(start, None, "quoting", str(e), e.at)
                if not self._resume(start, width):
                    return
                continue
            yield Record(start, fields, places=self.places)
            if not (m := _BREAK.match(self.text, self.at)) or m.end() == len(self.text):
                return
            self.at = m.end()

    def record(self) -> list[str]:
        self.places = [self.at]
        fields = [self.field()]
        while self.text.startswith(",", self.at):
            self.at += 1
            self.places.append(self.at)
            fields.append(self.field())
        return fields

    def field(self) -> str:
        return self.quoted() if self.text.startswith('"', self.at) else self.bare()

    def quoted(self) -> str:
        opened = self.at
        m = _INSIDE.match(self.text, opened + 1)
        if m.end() == len(self.text):
            raise QuoteError("quote never closed", opened)
        self.at = m.end() + 1
        if self.at < len(self.text) and self.text[self.at] not in ",\r\n":
            raise QuoteError("text after a closing quote", self.at)
        return m.group().replace('""', '"')

    def bare(self) -> str:
        m = _BARE.match(self.text, self.at)
        if self.text.startswith('"', m.end()):
            raise QuoteError("quote inside an unquoted field", m.end())
        self.at = m.end()
        return m.group()

    def _resume(self, failed: int, width: int) -> bool:
        """Go to the next line that begins like a record and holds ``width`` well-formed fields."""
        for m in self.anchor.finditer(self.text, failed):
            self.at = m.end()
            try:
                if len(self.record()) == width:
                    self.at = m.end()
                    return True
            except QuoteError:
                pass
        return False


def _instant(text: str) -> bool:
    m = _WHEN.fullmatch(text)
    if not m or (m[2] and (int(m[2]) > 23 or int(m[3]) > 59)):
        return False
    try:
        datetime.fromisoformat(m[1])
    except ValueError:
        return False
    return m[1][11:13] != "24"


def _part(text: str) -> bool:
    return any(c not in "-/_." and c not in UNSEEN and unicodedata.category(c)[0] not in "CZ" for c in text)


#: What makes a field's value invalid, by field.
RULES: dict[str, Callable[[str], bool]] = {
    "SPS_ID": lambda v: _ID.fullmatch(v) is None,
    "Part_Number": lambda v: not _part(v),
    "Problem_Description": lambda v: len(v.strip()) < 10,
    "Solution_Text": lambda v: len(v.strip()) < 15,
    "Last_Modified_Date": lambda v: not _instant(v),
}


#: The type of a field's values, where it isn't text.
TYPES = {"Last_Modified_Date": "timestamp"}


def _checked(record: Record, layout: tuple[str, ...], rules: dict[str, Callable[[str], bool]]) -> Record:
    """The record, with its error if its fields break the layout or a rule."""
    if record.reason:
        return record
    n = len(record.fields)
    if n != len(layout):
        return Record(record.start, None, "columns", f"{n} fields, not {len(layout)}", record.places[len(layout) if n > len(layout) else -1])
    for name, value, at in zip(layout, record.fields, record.places):
        if (rule := rules.get(name)) and rule(value):
            return Record(record.start, None, "value", f"{name} is invalid", at)
        if m := _BAD.search(value):
            return Record(record.start, None, "value", f"{name} holds a control or replacement character, U+{ord(m.group()):04X}", at)
    return record


OUT = "record_id bigint, feed string, record_no int, fields array<string>, reason string, message string, error_line int, error_column int"


def parse_records(
    df: DataFrame, layouts: dict[str, tuple[str, ...]] = LAYOUTS, id_col: str = "record_id", feed_col: str = "feed", text_col: str = "raw_text",
    rules: dict[str, Callable[[str], bool]] = RULES, anchor: str = ANCHOR,
) -> DataFrame:
    """One row for each record in the text chunks of ``df``: its fields, or the reason it fails and where.

    Reasons, the first that holds: ``quoting`` (not well-formed), ``columns``
    (another number of fields than the feed's layout has, a feed without a
    layout, a null or empty text), ``value`` (a field that its rule of ``rules``
    calls invalid, or any that holds a control or replacement character).
    record_no counts the records of a chunk from 0; a chunk cut by the loader as
    one record gives one row unless a line break stands outside quotes or
    reading resumed after a broken quote, at a line that begins like ``anchor``.
    error_line and error_column count from 1 within the chunk and point to the
    broken quote, to the invalid field, or to the first field too many or the
    last one of a record that has too few.
    """

    begins = record_starts(anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for row_id, feed, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = text or ""
                layout = layouts.get(feed, ())
                lines: list[int] = []
                for n, r in enumerate(Grammar(text, begins).chunk(len(layout))):
                    r = _checked(r, layout, rules)
                    line = column = None
                    if r.reason:
                        lines = lines or [0, *(m.end() for m in _BREAK.finditer(text))]
                        line = bisect_right(lines, r.at)
                        column = r.at - lines[line - 1] + 1
                    for to, value in zip(out, (row_id, feed, n, None if r.reason else r.fields, r.reason, r.message, line, column)):
                        to.append(value)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32())
            names = [f.split(" ")[0] for f in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    return df.select(F.col(id_col).cast("bigint"), feed_col, text_col).mapInArrow(run, OUT)


def failures(parsed: DataFrame) -> DataFrame:
    """(record_id, reason) of the chunks that fail.

    A chunk fails for its first record's reason; one that begins with a good
    record but goes on behind a line break is not one record: ``columns``.
    """
    of = parsed.groupBy("record_id").agg(F.min_by("reason", "record_no").alias("first"), F.max("record_no").alias("last"))
    return of.select("record_id", F.coalesce("first", F.when(F.col("last") > 0, "columns")).alias("reason")).where("reason IS NOT NULL")


def loaded(parsed: DataFrame, feed: str, layouts: dict[str, tuple[str, ...]] = LAYOUTS, types: dict[str, str] = TYPES) -> DataFrame:
    """The valid records of a feed as typed rows: fields of ``types`` as such, others as texts, part numbers without outer blanks."""
    good = parsed.where((F.col("feed") == feed) & F.col("reason").isNull())
    columns = []
    for i, name in enumerate(layouts[feed]):
        value = F.col("fields")[i]
        if name == "Part_Number":
            value = F.when(value.isNotNull(), trimmed(value))
        if name in types:
            value = value.try_cast(types[name])
        columns.append(value.alias(name.lower()))
    return good.select("record_id", "record_no", *columns)
