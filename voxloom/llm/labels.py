"""Language labels in their usual spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and names of each language (ISO 639 codes, English and own names).
SPELLINGS = {
    "nl": "nl nld dut dutch nederlands hollands flemish vlaams",
    "pt": "pt por portuguese português portugues brazilian",
    "en": "en eng english engels",
    "de": "de deu ger german deutsch",
    "es": "es spa spanish español espanol castellano castilian",
    "fr": "fr fra fre french français francais",
}
LANGUAGES = tuple(SPELLINGS)


def language_of_label(label: Column) -> Column:
    """The language a label names, in any usual spelling (case, blanks, region or script subtags); else null."""
    key = F.regexp_extract(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), r"^(\p{L}+)(?:[-_].*|\s*\(.*\))?$", 1)
    out = None
    for language, names in SPELLINGS.items():
        test = key.isin(*names.split())
        out = F.when(test, language) if out is None else out.when(test, language)
    return out
