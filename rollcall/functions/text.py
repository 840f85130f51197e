"""Name, address and encoding column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from Unicode decomposition."""
    accented, plain = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def _cp1252_table() -> tuple[str, str]:
    """Control characters 0x80-0x9F and what windows-1252 means by those bytes."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    used = [(c, t) for c, t in pairs if t]
    return "".join(c for c, _ in used), "".join(t for _, t in used)


ACCENTED, PLAIN = _accent_table()
LATIN1_CONTROLS, CP1252_LETTERS = _cp1252_table()


def strip_accents(text: Column) -> Column:
    """Accented letters as base letters; text of single-byte letters has none to look for."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, ACCENTED, PLAIN))


def squeeze_name(name: Column) -> Column:
    """Upper case, no accents, single blanks, none at the ends; empty stays empty.

    The pattern is only applied to names that need it, most have single blanks already.
    """
    plain = F.upper(strip_accents(name))
    uneven = plain.contains("  ")
    for blank in "\t\n\v\f\r":
        uneven = uneven | plain.contains(blank)
    return F.trim(F.when(uneven, F.regexp_replace(plain, r"\s+", " ")).otherwise(plain))


def normalise_name(name: Column) -> Column:
    """``squeeze_name`` with null for empty."""
    return F.nullif(squeeze_name(name), F.lit(""))


def latin1_to_cp1252(text: Column) -> Column:
    """Text decoded as ISO-8859-1 whose bytes were windows-1252.

    ISO-8859-1 keeps every byte, so only the 0x80-0x9F characters need another letter.
    """
    return F.translate(text, LATIN1_CONTROLS, CP1252_LETTERS)


def split_fields(line: Column, sep: str) -> Column:
    """The fields of a delimited line; a quoted field may hold the delimiter and "" for one quote."""
    literal = re.escape(sep)
    outside_quotes = literal + '(?=(?:[^"]*"[^"]*")*[^"]*$)'

    def unquoted(field: Column) -> Column:
        inner = F.replace(F.regexp_extract(field, '(?s)^"(.*)"$', 1), F.lit('""'), F.lit('"'))
        return F.when(field.rlike('(?s)^".*"$'), inner).otherwise(field)

    quoted = F.transform(F.split(line, outside_quotes, -1), unquoted)
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, literal, -1))


def full_address(*parts: Column) -> Column:
    """Address parts joined by a blank, missing and empty ones left out."""
    cleaned = [F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts]
    return F.nullif(F.concat_ws(" ", *cleaned), F.lit(""))


def phone(area_code: Column, number: Column) -> Column:
    """Area code and number as one text; null without a number."""
    return F.when(number.isNotNull(), F.concat(F.coalesce(area_code, F.lit("")), number))
