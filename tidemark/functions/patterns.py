"""Pattern parts with the meaning they have in the feeds' own rules, spelled for java.util.regex.

White space includes the Unicode spaces and U+FEFF; word boundaries see ASCII letters only, so that a
word can stand next to an accented letter; case is ignored across scripts where it is ignored at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inside of a character class of white space.
WS = r"\t-\r    -     　﻿"
S = f"[{WS}]"
#: All characters of white space.
WHITE = "".join(c for c in map(chr, range(0x10000)) if re.match(S, c))


def until_space(more: str) -> str:
    """A run of characters up to white space or one of more (ASCII, escaped for a class); each is held to one small set, and to the rest
    of the white space only behind ASCII."""
    return rf"(?:(?![\t\n\x0B\f\r {more}])(?!(?=[^\x00-\x7F])[{WS}])(?s:.))++"


#: A run of white space; most characters are told apart from it by one comparison, and classes of many parts are slow in Java.
SPACES = rf"(?![!-~]){S}+"
#: A word boundary of ASCII words; the second is for patterns that ignore case across scripts.
B = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
BU = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def trimmed(text: Column) -> Column:
    """No white space at the ends; of a text only these are read."""
    return F.btrim(text, F.lit(WHITE))


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without a match (an empty group stays empty); the text is read once."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(1))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, empty without a match; the text is read no further."""
    return F.regexp_extract(text, pattern, group)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), empty_strings())


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def filled(text: Column) -> Column:
    """Null for an empty text."""
    return F.when(text != "", text)


def literals(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once, also inside of higher-order functions."""
    return F.transform(F.array(value), body)[0]
