"""One consistent form for text that looks the same but holds other characters.

Every distinct text is exploded to its positioned code points.  A broadcast
table of decompositions and look-alikes replaces each code point (or drops it,
if it can't be seen); combining marks are put in the order of their classes,
letters and marks are recomposed, and the pieces are put together again.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters of other scripts and signs that are drawn like ASCII ones.
LOOK_ALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ϲ": "C", "Ϳ": "J", "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Ү": "Y", "Х": "X", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Armenian
    "Օ": "O", "Տ": "S", "Ս": "U", "օ": "o", "ս": "u", "հ": "h",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S",
    "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮍ": "Y", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N",
    "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # dashes
    "‐": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "⁃": "-", "−": "-", "˗": "-", "﹘": "-", "➖": "-",
    # slashes
    "⁄": "/", "∕": "/", "⧸": "/", "╱": "/",
    # full stops
    "․": ".", "ꓸ": ".",
    # low lines
    "ˍ": "_", "﹍": "_", "﹎": "_", "﹏": "_",
}

# Kinds of compatibility forms that are drawn like what they stand for.
# Raised, lowered, circled, squared, stacked and fractional forms are not.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<small>"}

# Default-ignorable code points that aren't format characters, and the empty braille cell.
UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

HANGUL = range(0xAC00, 0xD7A4)

SEQUENCE = "array<struct<c:string,k:int>>"


def _decompose(c: str) -> str:
    parts = unicodedata.decomposition(c).split()
    if parts and parts[0].startswith("<"):
        if parts.pop(0) not in SAME_LOOK or (len(parts) > 1 and parts[0] == "0020"):
            return c
    return "".join(_decompose(chr(int(x, 16))) for x in parts) or c


# Controls that are white space.
BREAKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"


@cache
def code_point_rows(fold_case: bool = True, keep_blanks: bool = False) -> list[tuple[str, list[tuple[str, int]]]]:
    """(code point, what replaces it with combining classes) wherever that isn't the code point itself with class 0.

    With ``fold_case`` a letter also stands for what its capital looks like.
    ``keep_blanks`` turns every blank into a space instead of nothing.
    As many as Unicode has such code points, fewer than 10,000.  Hangul
    syllables stay composed, and private and unassigned code points as they are.
    """
    rows = []
    for n in (*range(0x80, 0x30000), *range(0xE0000, 0xE1000)):
        if n in HANGUL:
            continue
        c = chr(n)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs") and n not in UNSEEN:
            continue
        if kind in ("Cf", "Cc") or kind[0] == "Z" or n in UNSEEN:
            rows.append((c, [(" ", 0)] if keep_blanks and (kind[0] == "Z" or c in BREAKS) else []))
            continue
        drawn = "".join(LOOK_ALIKES.get(x) or (fold_case and LOOK_ALIKES.get(x.upper())) or x for x in _decompose(c))
        seen = [(x, unicodedata.combining(x)) for x in drawn if unicodedata.category(x)[0] not in "ZC"]
        if seen != [(c, 0)]:
            rows.append((c, seen))
    rows += [(chr(n), [(" ", 0)] if keep_blanks and chr(n) in f" {BREAKS}" else []) for n in [*range(0x21), 0x7F]]
    return rows


@cache
def composition_rows() -> list[tuple[str, dict[str, str]]]:
    """(starter, its composed letters by the marks they add)."""
    out: dict[str, dict[str, str]] = {}
    for n in range(0xC0, 0x30000):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or n in HANGUL or unicodedata.normalize("NFC", c) != c:
            continue
        start, *marks = unicodedata.normalize("NFD", c)
        if marks and unicodedata.combining(start) == 0 and all(map(unicodedata.combining, marks)):
            out.setdefault(start, {})["".join(marks)] = c
    return sorted(out.items())


def _recompose(starter: Column, marks: Column, letters: Column) -> Column:
    """The starter with its ordered marks: canonical composition, mark by mark.

    ``used`` holds the marks that went into the letter, ``rest`` those that
    didn't; a mark is blocked by an earlier one of its own class in ``rest``.
    """
    begin = F.struct(F.lit("").alias("used"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc: Column, m: Column) -> Column:
        with_it = F.concat(acc["used"], m["c"])
        fits = (acc["last"] < m["k"]) & letters.isNotNull() & F.coalesce(F.map_contains_key(letters, with_it), F.lit(False))
        return F.struct(
            F.when(fits, with_it).otherwise(acc["used"]).alias("used"),
            F.when(fits, acc["rest"]).otherwise(F.concat(acc["rest"], m["c"])).alias("rest"),
            F.when(fits, acc["last"]).otherwise(m["k"]).alias("last"),
        )

    done = F.aggregate(marks, begin, step)
    letter = F.when(done["used"] == "", starter).otherwise(F.try_element_at(letters, done["used"]))
    return F.concat(F.coalesce(letter, F.lit("")), done["rest"])


def canonical_dictionary(texts: DataFrame, column: str, fold_case: bool = True, keep_blanks: bool = False) -> DataFrame:
    """(text, canonical) for each distinct, non-null ``column`` of ``texts``.

    ``fold_case`` gives capitals only.  Blanks are dropped, as part numbers
    want it, or with ``keep_blanks`` each run of them is one space, none at the
    ends.  Texts of visible ASCII characters are their own form, apart from
    case and blanks, and skip the code-point steps.
    """
    spark = texts.sparkSession
    values = texts.select(F.col(column).alias("text")).where(F.col("text").isNotNull()).distinct()
    case = F.upper if fold_case else (lambda c: c)
    is_plain = F.col("text").rlike(r"^[\x00-\x7f]*$")
    if keep_blanks:
        bare = F.trim(F.regexp_replace(F.regexp_replace("text", r"[\t-\r\x1c-\x20]+", " "), r"[\x00-\x08\x0e-\x1b\x7f]+", ""))
        bare = F.regexp_replace(bare, " +", " ")
    else:
        bare = F.regexp_replace("text", r"[\x00-\x20\x7f]+", "")
    plain = values.where(is_plain).withColumn("canonical", case(bare))

    key = F.when(F.length("text") <= 64, F.col("text")).otherwise(F.concat(F.lit("\x00"), F.sha2("text", 256)))
    odd = values.where(~is_plain).withColumn("key", key)
    points = odd.select("key", F.posexplode(F.split("text", "")).alias("pos", "point"))
    known = spark.createDataFrame(code_point_rows(fold_case, keep_blanks), f"point string, seq {SEQUENCE}")
    replaced = points.join(F.broadcast(known), "point", "left").withColumn("seq", F.coalesce("seq", F.array(F.struct(F.col("point").alias("c"), F.lit(0).alias("k")))))
    units = replaced.select("key", "pos", F.posexplode("seq").alias("sub", "u"))
    # a letter may have a capital of several
    units = units.select("key", "pos", "sub", "u.k", F.posexplode(F.split(case(F.col("u.c")), "")).alias("part", "c")).where("c <> ''")
    run = Window.partitionBy("key").orderBy("pos", "sub", "part").rowsBetween(Window.unboundedPreceding, 0)
    parts = units.withColumn("seg", F.count_if(F.col("k") == 0).over(run))
    starter = F.max(F.when(F.col("k") == 0, F.col("c"))).alias("starter")
    marks = F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.struct("k", "pos", "sub", "part", "c")))).alias("marks")
    segments = parts.groupBy("key", "seg").agg(starter, marks)
    letters = spark.createDataFrame(composition_rows(), "starter string, letters map<string,string>")
    pieces = segments.join(F.broadcast(letters), "starter", "left").select("key", F.struct("seg", _recompose(F.col("starter"), F.col("marks"), F.col("letters")).alias("piece")).alias("p"))
    whole = pieces.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("canonical"))
    form = F.coalesce("canonical", F.lit(""))
    rebuilt = odd.join(whole, "key", "left").select("text", (F.trim(F.regexp_replace(form, " +", " ")) if keep_blanks else form).alias("canonical"))
    return plain.unionByName(rebuilt)


def unify_text(df: DataFrame, column: str, out: str = "canonical", fold_case: bool = True, keep_blanks: bool = False) -> DataFrame:
    """``df`` with the consistent form of ``column`` in ``out``; ``fold_case`` and ``keep_blanks`` as for canonical_dictionary.

    Null stays null; an empty text, or one of unseen characters only, becomes
    empty.  All other columns are kept; ``out`` replaces a column of that name.
    """
    forms = canonical_dictionary(df, column, fold_case, keep_blanks).select(F.col("text").alias("__text"), F.col("canonical").alias("__form"))
    joined = df.drop(out) if out != column else df
    joined = joined.join(forms, joined[column] == forms["__text"], "left")
    return joined.withColumn(out, F.col("__form")).drop("__text", "__form")


def match_catalogue(typed: DataFrame, catalogue: DataFrame, column: str) -> DataFrame:
    """(text, part) for typed texts that look like a catalogue spelling without being the same string.

    The same string means: equal once ASCII spaces and tabs are dropped and
    letters are upper-cased.  If several catalogue spellings look the same, the
    smallest is taken.
    """
    plain = lambda c: F.upper(F.translate(c, " \t", ""))
    parts = canonical_dictionary(catalogue, column).where("canonical <> ''").groupBy("canonical").agg(F.min("text").alias("part"))
    looks = canonical_dictionary(typed, column).join(parts, "canonical")
    return looks.where(plain(F.col("text")) != plain(F.col("part"))).select("text", "part")
