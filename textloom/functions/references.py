"""Legal references between English and Chinese: ``Section 4(b)`` and ``第4条(b)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.patterns import ID

# How references are written in either language, and their kinds.
ENGLISH = rf"(?iU)\b(section|article|clause|paragraph|schedule)s?\s+({ID})\b"
ENGLISH_SHORT = rf"(?iU)\b(sec|art|cl|para|sch)s?\.\s+({ID})\b"
CHINESE = r"第\s*(\d+(?:\([A-Za-z0-9]+\))*)\s*(条|款|节|段|章|篇)((?:\([A-Za-z0-9]+\))*)"
CHINESE_SCHEDULE = r"附表\s*(\d+(?:\([A-Za-z0-9]+\))*)"
TO_CHINESE = ((("section", "article", "sec", "art"), "条"), (("clause", "cl"), "款"), (("paragraph", "para"), "段"))
TO_ENGLISH = ((("条", "节", "章", "篇"), "Section"), (("款",), "Clause"), (("段",), "Paragraph"))


def legal_reference(text: Column, source_lang: Column, target_lang: Column) -> Column:
    """The first reference in ``text`` in the other language; null if there is none or the pair is another."""
    full = F.regexp_extract(text, ENGLISH, 1) != ""
    kind = F.lower(F.when(full, F.regexp_extract(text, ENGLISH, 1)).otherwise(F.regexp_extract(text, ENGLISH_SHORT, 1)))
    ref = F.when(full, F.regexp_extract(text, ENGLISH, 2)).otherwise(F.regexp_extract(text, ENGLISH_SHORT, 2))
    number = F.regexp_extract(ref, r"^(\d[\d.,\-]*)((?:\([A-Za-z0-9]+\))*)$", 1)
    suffix = F.regexp_extract(ref, r"^(\d[\d.,\-]*)((?:\([A-Za-z0-9]+\))*)$", 2)
    chinese = F.when(kind.isin("schedule", "sch"), F.concat(F.lit("附表"), ref))
    for names, label in TO_CHINESE:
        own = F.when(number != "", F.concat(F.lit("第"), number, F.lit(label), suffix)).otherwise(F.concat(F.lit("第"), ref, F.lit(label)))
        chinese = chinese.when(kind.isin(*names), own)
    mark = F.regexp_extract(text, CHINESE, 2)
    place = F.concat(F.regexp_extract(text, CHINESE, 1), F.regexp_extract(text, CHINESE, 3))
    english = F.when(F.lit(False), "")
    for names, label in TO_ENGLISH:
        english = english.when(mark.isin(*names), F.concat(F.lit(label + " "), place))
    schedule = F.regexp_extract(text, CHINESE_SCHEDULE, 1)
    english = english.when(schedule != "", F.concat(F.lit("Schedule "), schedule))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.when(low(source_lang).startswith("en") & low(target_lang).startswith("zh"), chinese).when(
        low(source_lang).startswith("zh") & low(target_lang).startswith("en"), english
    )


def mapped_references(nt_map: Column, source_lang: Column, target_lang: Column) -> Column:
    """The map with every original that holds a reference turned into the other language."""
    return F.transform_values(nt_map, lambda _, v: F.coalesce(legal_reference(v, source_lang, target_lang), v))
