"""Text columns: normalising, accents, encodings, replacements."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F



def _plain_letters() -> dict[str, str]:
    """Letters of the Latin blocks that decompose into one plain letter and marks, and that letter."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and all(map(unicodedata.combining, marks)):
            pairs[chr(code)] = base
    return pairs


_PLAIN = _plain_letters()


def normalise(text: Column) -> Column:
    """Lower case, white space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents, and no combining marks."""
    return F.regexp_replace(F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values())), "[\\u0300-\\u036F]", "")


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, put right. Only a text that can be such a slip is touched: all characters are Latin-1, some are
    beyond ASCII, and as bytes they are UTF-8. Every other text stays as it is, character for character."""
    # in Latin-1 a character is a byte, so only such texts reach the encoder
    slip = F.when(text.rlike(r"^[\x00-\xFF]*$") & text.rlike(r"[\x80-\xFF]"), F.encode(text, "ISO-8859-1").cast("string"))
    return F.coalesce(F.when(F.is_valid_utf8(slip), slip), text)


def replace_all(text: Column, table: Mapping[str, str]) -> Column:
    """Plain replacements, the longest pattern first, so that none eats the beginning of another."""
    for old in sorted(table, key=lambda k: (-len(k), k)):
        text = F.replace(text, F.lit(old), F.lit(table[old]))
    return text


def year_ranges(spec: str) -> list[int]:
    """``2016-2019,2022`` -> the years, ascending, once each."""
    years: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, _, last = part.partition("-")
        if int(last or first) < int(first):
            raise ValueError(f"the range {part} runs backwards")
        years.update(range(int(first), int(last or first) + 1))
    return sorted(years)


def year_list(spec: Column) -> Column:
    """The years of a text like ``2016-2019,2022``, ascending, once each; a range that runs backwards raises."""
    years = lambda part, i: F.trim(F.element_at(F.split(part, "-"), i)).cast("int")
    one = lambda part: F.when(years(part, 1) > years(part, -1), F.raise_error(F.concat(F.lit("the range runs backwards: "), part)).cast("array<int>")).otherwise(F.sequence(years(part, 1), years(part, -1)))
    parts = F.filter(F.split(spec, ","), lambda p: F.trim(p) != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))
