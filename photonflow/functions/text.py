"""Text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headers that precede a description, the more specific one first.
MARKERS = ("Verbeterde beschrijving:", "Beschrijving:")
_BLANK = r"(?U)[\s\x1c-\x1f\x85]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "^" + _BLANK, ""), _BLANK + "$", "")


def stripped_or_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def truncate(text: Column, length: int) -> Column:
    """The first ``length`` characters and dots, where there are more."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def clean_reply(text: Column) -> Column:
    """Without ``<think>`` blocks (an unclosed one stays) and white space at the ends."""
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def after_marker(text: Column) -> Column:
    """What follows the first marker, stripped; the whole text without one; null if nothing is left."""
    out = F.nullif(text, F.lit(""))
    for marker in reversed(MARKERS):
        at = F.instr(text, marker)
        rest = text.substr(at + len(marker), F.length(text))
        out = F.when(at > 0, stripped_or_null(rest)).otherwise(out)
    return out


def or_unknown(value: Column, default: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
