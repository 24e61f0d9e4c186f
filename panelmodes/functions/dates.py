"""Dates written in many ways, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DROP = r"[\s\p{Z}\p{Cf}]+"
_YMD = r"^((?!0000)[0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?:[T ]?[0-9]{1,2}:.*)?$"
_DMY = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]((?!0000)[0-9]{4})(?:[T ]?[0-9]{1,2}:.*)?$"
_YM = r"^((?!0000)[0-9]{4})[-/.]([0-9]{1,2})$"
_MY = r"^([0-9]{1,2})[-/.]((?!0000)[0-9]{4})$"
_COMPACT = r"^((?!0000)[0-9]{4})([0-9]{2})([0-9]{2})$"


def real_date(raw: Column) -> Column:
    """DATE read from text, or NULL where the text names no real calendar day.

    Read are year-month-day and day-month-year with ``-``, ``/`` or ``.``, eight bare digits,
    an optional time of day, and year-month alone, which means the first of the month. White
    space and invisible characters count for nothing. NULL, empty text, words, zero days and days
    that the month lacks (30 February) give NULL; nothing raises.
    """
    text = F.regexp_replace(raw, _DROP, "")

    def parts(pattern: str, year: int, month: int, day: int | None) -> Column:
        piece = lambda i, w: F.lpad(F.regexp_extract(text, pattern, i), w, "0")
        last = piece(day, 2) if day else F.lit("01")
        return F.concat_ws("-", piece(year, 4), piece(month, 2), last).try_cast("date")

    # Most dates are plain ISO days; they take the first branch, and the others touch no regular expression twice.
    return (
        F.when(raw.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}$"), raw.try_cast("date"))
        .when(text.rlike(_YMD), parts(_YMD, 1, 2, 3))
        .when(text.rlike(_DMY), parts(_DMY, 3, 2, 1))
        .when(text.rlike(_COMPACT), parts(_COMPACT, 1, 2, 3))
        .when(text.rlike(_YM), parts(_YM, 1, 2, None))
        .when(text.rlike(_MY), parts(_MY, 2, 1, None))
    )


def month_index(day: Column) -> Column:
    """Months since year zero, so that neighbouring months differ by one."""
    return F.year(day) * 12 + F.month(day) - 1


def month_of_index(index: Column) -> Column:
    """``year_month`` text of a ``month_index``."""
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def quarter_number(raw: Column) -> Column:
    """Quarter 1..4 from Arabic, Latin-letter or Roman-sign numerals before any word; else NULL."""
    head = F.upper(F.regexp_extract(F.regexp_replace(raw, _DROP, ""), r"^([0-9IVХІ\x{2160}-\x{2163}]+)", 1))
    return (
        F.when(head.isin("1", "I", "Ⅰ", "І"), 1)
        .when(head.isin("2", "II", "Ⅱ", "ІІ"), 2)
        .when(head.isin("3", "III", "Ⅲ", "ІІІ"), 3)
        .when(head.isin("4", "IV", "Ⅳ", "ІV"), 4)
    )
