"""Names of territories and regions as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What normalisation deletes, first the phrase, then any of the words.
CITY_PHRASE = "внутригородская территория города федерального значения"
KIND_WORDS = "муниципальный район|городской округ|муниципальное образование|муниципальный округ|городское поселение|сельское поселение|район|округ|поселение|город|г\\."

# Region keys in the order in which they are tried, with their short names.
REGION_KEYS = (
    ("санкт-петербург", "СПб"),
    ("ленинградская", "ЛенОбл"),
    ("новгородская", "НовОбл"),
    ("псковская", "ПскОбл"),
    ("мурманская", "МурОбл"),
    ("архангельская", "АрхОбл"),
    ("вологодская", "ВолОбл"),
    ("калининградская", "КалОбл"),
    ("карелия", "Карелия"),
    ("коми", "Коми"),
    ("ненецкий", "НАО"),
)
REGION_WORDS = ("край", "область", "республика", "автономн", "санкт-петербург", "москва", "севастополь")
HEADER_WORDS = ("муниципальные округа", "муниципальные районы", "городские округа", "муниципальные образования", "содержание", "основные понятия", "внутригородские")
INCOME_PARTS = ("income", "dohod", "зарплат", "wage", "salary")
SHORT_PARTS = (("share_", ""), ("growth_", "g_"), ("marketplace", "mkt"), ("transport", "trans"), ("log_total", "log tot"), ("mob_logratio", "mob"))
INCOME_PARTS_OTHER = ("income", "urov", "зарплат", "доход")


def stripped(c: Column) -> Column:
    """Without white space of any Unicode kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def territory_name(name: Column, phrase: str = CITY_PHRASE, words: str = KIND_WORDS) -> Column:
    """Small letters without the phrase, the kind words (also inside words) and repeated white space; NULL stays NULL."""
    bare = F.regexp_replace(F.regexp_replace(stripped(F.lower(name)), phrase, ""), words, "")
    return stripped(F.regexp_replace(bare, r"(?U)\s+", " "))


def plain_name(name: Column) -> Column:
    """White space off both ends, small letters, ё as е."""
    return F.translate(F.lower(stripped(name)), "ё", "е")


def first_key(text: Column, keys: Sequence[tuple[str, str]] = REGION_KEYS) -> Column:
    """Short name of the first key that the text contains, in the keys' order; NULL without any."""
    low = F.translate(F.lower(text), "ё", "е")
    out = F.lit(None).cast("string")
    for key, short in reversed(keys):
        out = F.when(low.contains(key), F.lit(short)).otherwise(out)
    return out


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the small-lettered text contains any of the words; false for NULL."""
    low, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))


def looks_like_region(text: Column) -> Column:
    return contains_any(text, REGION_WORDS)


def is_header(text: Column) -> Column:
    return contains_any(text, HEADER_WORDS)


def number_or_null(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "").try_cast("double")


def digits_or_null(code: Column) -> Column:
    """A code of digits only once plain and non-breaking spaces are out; else NULL."""
    bare = F.regexp_replace(code, "[ \u00a0]", "")
    return F.when(bare.rlike("^[0-9]+$"), bare)


def short_feature(name: Column) -> Column:
    """Feature names abbreviated for figures, replaced in order."""
    for a, b in SHORT_PARTS:
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


def without_income(columns: Sequence[str], parts: Sequence[str] = INCOME_PARTS) -> list[str]:
    """Column names that mention no income, by either list of name parts."""
    return [c for c in columns if not any(p in c.lower() for p in parts)]
