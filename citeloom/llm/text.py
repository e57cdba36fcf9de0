"""Column expressions and Python helpers that several operators of this package share."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Trimmed, each run of Unicode white space one space; null and blank give null."""
    # most texts have single spaces only, which is told faster than replaced
    uneven = text.rlike(r"[\p{IsWhite_Space}&&[^ ]]|  ")
    out = F.trim(F.when(uneven, F.regexp_replace(text, r"[\p{IsWhite_Space}]+", " ")).otherwise(text))
    return F.when(out != "", out)


# The characters of Unicode's property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends; null and blank give null."""
    out = F.btrim(text, F.lit(WHITE_SPACE))
    return F.when(out != "", out)


def term(text: Column) -> Column:
    """The form in which terms are compared: squeezed and lower-cased."""
    return F.lower(squeezed(text))


class _Plain(dict):
    """Code point to its letters and digits in lower case, without marks; filled as characters come."""

    def __missing__(self, point: int) -> str:
        out = unicodedata.normalize("NFKD", chr(point)).casefold()
        out = "".join(c for c in unicodedata.normalize("NFKD", out) if c.isalnum())
        self[point] = out = unicodedata.normalize("NFC", out)
        return out


_PLAIN = _Plain()


def plain(text: str) -> str:
    """The letters and digits of a text: no case, marks, width, punctuation or blanks."""
    return unicodedata.normalize("NFKC", text).translate(_PLAIN)
