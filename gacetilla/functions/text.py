"""Tokenisation (X8, X9) as native column expressions.

White space is the Unicode White_Space property.  Java has it as one class,
which it tests by the type of a character; the written-out class is the same
set for engines without it (the oracle SQL uses it) and three times slower here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space property, written out so that Java
# and RE2 agree (their ``\s`` differ from it and from each other).
WS_CLASS = (r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_RUN = f"[{WS_CLASS}]+"
WS_ONE = f"[{WS_CLASS}]"
#: the same as WS_RUN, in Java's terms
UNICODE_SPACES = r"(?U)\s+"
# the same set as characters, for character-level deletion
WS_CHARS = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_whitespace(c) -> Column:
    """Words of a text: split on runs of Unicode white space, empties dropped."""
    return F.array_remove(F.split(_col(c), UNICODE_SPACES, -1), "")


def split_commas(c) -> Column:
    """Pieces of a comma-joined field, kept as is (spaces and empties stay)."""
    return F.split(_col(c), ",", -1)


def strip_whitespace(c) -> Column:
    """Remove every white-space character (the similarity ignores them);
    a character-level ``translate``, no regular expression."""
    return F.translate(_col(c), WS_CHARS, "")


def first_line(c) -> Column:
    return F.substring_index(_col(c), "\n", 1)
