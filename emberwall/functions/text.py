"""String helpers with the white space of Unicode, in built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class: what counts as white space (Java's own \\s is ASCII only), and its ASCII part.
WS = "\\s\\x1c-\\x1f\\x85\\p{Z}"
ASCII_WS = "\\t-\\r\\x1c-\\x20"
BLANK, WORD = f"[{WS}]", f"[^{WS}]"
#: The same characters, spelled out for btrim.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def by_alphabet(c: Column, make: Callable[[str, str], Column]) -> Column:
    """make(blank, word) of c, with the ASCII classes for text that is ASCII: they match several times faster."""
    return F.when(F.octet_length(c) == F.length(c), make(f"[{ASCII_WS}]", f"[^{ASCII_WS}]")).otherwise(make(BLANK, WORD))


def words(c: Column) -> Column:
    """The text between runs of white space; a blank text has none."""
    return F.filter(F.split(c, f"{BLANK}+"), lambda x: x != "")


def scrubbed(c: Column) -> Column:
    """Valid UTF-8, undecodable bytes dropped. Valid text passes as it is."""
    return F.when(F.is_valid_utf8(c), c).otherwise(F.translate(F.make_valid_utf8(c), "\ufffd", ""))


def field(fields: Column, position: int) -> Column:
    """A stripped field by position, '' where the line is short. Blanks are plain spaces here already."""
    return F.coalesce(F.trim(F.get(fields, F.lit(position))), F.lit(""))
