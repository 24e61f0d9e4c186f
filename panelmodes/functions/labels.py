"""Category labels written in many ways, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six category names of the panel, the total first.
TOTAL = "Все категории"
CATEGORIES = (TOTAL, "Здоровье", "Маркетплейсы", "Общественное питание", "Продовольствие", "Транспорт")

#: What a folded label has to contain to count as the category; the earliest hit in the label decides.
STEMS = (("категори", TOTAL), ("здоров", "Здоровье"), ("маркет", "Маркетплейсы"), ("общепит", "Общественное питание"), ("питани", "Общественное питание"), ("прод", "Продовольствие"), ("трансп", "Транспорт"))

LATIN_TWINS = "ABCEHKMOPTXYaceopxyk"
CYRILLIC_TWINS = "АВСЕНКМОРТХУасеорхук"


def folded(raw: Column) -> Column:
    """Label without spaces, punctuation and invisible characters, Latin twins as Cyrillic, in small letters."""
    bare = F.regexp_replace(raw, r"[\s\p{Z}\p{C}\p{P}]+", "")
    return F.lower(F.translate(bare, LATIN_TWINS, CYRILLIC_TWINS))


def category_slot(raw: Column, stems: tuple[tuple[str, str], ...] = STEMS, names: tuple[str, ...] = CATEGORIES) -> Column:
    """Position of the label's category in ``names``; NULL for NULL and for labels of no category."""
    exact = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(names))):
        exact = F.when(raw == name, i).otherwise(exact)
    # Evaluated once a row, and only for labels that aren't spelled exactly.
    hit = F.regexp_extract(folded(raw), "(" + "|".join(stem for stem, _ in stems) + ")", 1)
    slots = F.create_map(*(x for stem, name in stems for x in (F.lit(stem), F.lit(names.index(name)))))
    return F.coalesce(exact, F.try_element_at(slots, hit))


def category_name(slot: Column, names: tuple[str, ...] = CATEGORIES) -> Column:
    return F.when(slot.isNotNull(), F.element_at(F.array(*map(F.lit, names)), slot + 1))
