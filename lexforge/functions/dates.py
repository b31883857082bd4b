"""Dates as legal prose writes them, in four languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in German, French, Italian and English with the forms in use, by month.
MONTHS = (
    ("januar", "jänner", "janvier", "gennaio", "january"),
    ("februar", "feber", "février", "fevrier", "febbraio", "february"),
    ("märz", "maerz", "mars", "marzo", "march"),
    ("april", "avril", "aprile"),
    ("mai", "maggio", "may"),
    ("juni", "juin", "giugno", "june"),
    ("juli", "juillet", "luglio", "july"),
    ("august", "août", "aout", "agosto"),
    ("september", "septembre", "settembre"),
    ("oktober", "octobre", "ottobre", "october"),
    ("november", "novembre"),
    ("dezember", "décembre", "decembre", "dicembre", "december"),
)
_ALL = sorted((m for names in MONTHS for m in names), key=lambda m: (-len(m), m))
# By their first letters, so that a word is tried against few.
_NAMES = "|".join(f"{a}(?:{'|'.join(m[1:] for m in _ALL if m[0] == a)})" for a in sorted({m[0] for m in _ALL}))
#: A day, a month by number or name, a year.
WORDED = rf"(?iu)(?<!\d)(\d{{1,2}})(?:(?:\.|er|°|º)\s*|\s+)(?:(\d{{1,2}})\.\s?|({_NAMES})\s+)(\d{{4}})"


def written(text: Column) -> Column:
    """The first date in a text as written, empty if it holds none; :func:`parts` reads it as it reads the text."""
    return F.regexp_extract(text, WORDED, 0)


def parts(text: Column) -> Column:
    """struct(d, m, y) of the first date in a text; null fields where it holds none."""
    got = lambda i: F.nullif(F.regexp_extract(text, WORDED, i), F.lit(""))
    by_name = F.create_map(*[F.lit(x) for i, names in enumerate(MONTHS, 1) for name in names for x in (name, i)])
    month = F.coalesce(got(2).cast("int"), F.element_at(by_name, F.lower(got(3))))
    return F.struct(got(1).cast("int").alias("d"), month.alias("m"), got(4).cast("int").alias("y"))


def stated_parts(date: Column) -> Column:
    """:func:`parts` of a date as :func:`written` gives it: read from its ends, not searched again."""
    by_name = F.create_map(*[F.lit(x) for i, names in enumerate(MONTHS, 1) for name in names for x in (name, i)])
    month = F.coalesce(F.nullif(F.regexp_extract(date, r"(\d{1,2})\.\s?\d{4}$", 1), F.lit("")).cast("int"), F.element_at(by_name, F.lower(F.regexp_extract(date, r"(\p{L}+)\s+\d{4}$", 1))))
    return F.struct(F.nullif(F.regexp_extract(date, r"^\d{1,2}", 0), F.lit("")).cast("int").alias("d"), month.alias("m"), F.nullif(F.right(date, F.lit(4)), F.lit("")).cast("int").alias("y"))


def _stated(at: Column) -> Column:
    return F.concat_ws("-", F.lpad(at["y"].cast("string"), 4, "0"), F.lpad(at["m"].cast("string"), 2, "0"), F.lpad(at["d"].cast("string"), 2, "0"))


def iso(at: Column) -> Column:
    """A date of :func:`parts` as ``yyyy-mm-dd``; null if there is none or the calendar does not have it."""
    return F.when(at["d"].isNotNull() & at["m"].isNotNull(), _stated(at).try_cast("date").cast("string"))


def impossible(at: Column) -> Column:
    """``yyyy-mm-dd`` of a date that is written but not in the calendar (31 February); null if it is possible or no date."""
    return F.when(at["d"].between(1, 31) & at["m"].between(1, 12) & _stated(at).try_cast("date").isNull(), _stated(at))
