"""Text columns: canonical forms, keys, codes and short extracts.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in Unicode's sense, with the four information separators, and a pattern for a run of it.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def text(c: Column) -> Column:
    """The text; null is empty."""
    return F.coalesce(c, F.lit(""))


def strip_invisible(c: Column) -> Column:
    """Without format characters (zero-width ones, soft hyphens, byte order marks)."""
    return F.regexp_replace(text(c), r"\p{Cf}", "")


def trimmed(c: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(text(c), F.lit(WHITE))


def collapsed(c: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(c), BLANKS, " "))


def canonical_part(c: Column) -> Column:
    """A part number without format characters and white space, upper case; separators keep their meaning."""
    return F.upper(F.regexp_replace(strip_invisible(c), BLANKS, ""))


def valid_part(canonical: Column) -> Column:
    """Whether a canonical part number has anything besides separators."""
    return ~canonical.rlike(r"^[-/_.]*$")


def commodity_code(canonical: Column) -> Column:
    """What stands before the first hyphen; empty without one."""
    return F.when(F.instr(canonical, "-") > 0, F.substring_index(canonical, "-", 1)).otherwise(F.lit(""))


def text_key(c: Column) -> Column:
    """32 hexadecimal digits that stand for the text."""
    return F.substring(F.sha2(text(c), 256), 1, 32)


def percent(score: Column) -> Column:
    """A score as a whole percentage: limited to 0..1 and cut off, so that every n/100 stays n; null stays null."""
    return F.when(score.isNotNull(), F.floor((F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) + F.lit(1e-6)) * 100).cast("int"))


def extract(c: Column, length: int = 500) -> Column:
    """The text on one line, cut to ``length`` characters with an ellipsis."""
    flat = collapsed(c)
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length - 1), F.lit("…"))).otherwise(flat)


def words(c: Column) -> Column:
    """The words between white space."""
    flat = collapsed(c)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def sentences(c: Column) -> Column:
    """The sentences: cut behind a full stop, an exclamation or a question mark that white space follows."""
    flat = trimmed(c)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, r"(?<=[.!?])" + BLANKS))


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), 0)


def jaccard(a: Column, b: Column) -> Column:
    """Different elements in both arrays over those in either; 0 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def instant(c: Column) -> Column:
    """An ISO-8601 date and time as a timestamp; UTC without an offset, null if it is none."""
    t = trimmed(c)
    zoned = F.when(t.rlike(r"\d:\d\d.*(Z|[+-]\d\d:?\d\d)$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), zoned).try_cast("timestamp")


#: The most characters a sheet's cell takes, and what stands at the end of a cut one.
CELL, CUT = 32_767, " […truncated for Excel]"


def cell(c: Column) -> Column:
    """The text as a sheet's cell takes it: vertical tabs and form feeds as line breaks, no other controls, cut to length."""
    clean = F.regexp_replace(F.translate(text(c), "\x0b\x0c", "\n\n"), r"[\x00-\x08\x0e-\x1f]", "")
    return F.when(F.length(clean) > CELL, F.concat(F.substring(clean, 1, CELL - len(CUT)), F.lit(CUT))).otherwise(clean)


def numbered(items: Column) -> Column:
    """The items of an array, each with its place in brackets before it, one a line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
