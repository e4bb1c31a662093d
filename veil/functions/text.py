"""Patterns and string columns. Patterns mean the same to Java and RE2."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

#: What counts as an e-mail address, a phone number, a profile link.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+\d{1,3}[-. ]?)?(?:\(\d{2,5}\)|\d{2,5})(?:[-. ]?\d{2,5}){2,4}"
LINK = r"(?i)(?:https?://)?(?:www\.)?(?:linkedin\.com/|linked\.in/)\S*"
LABEL = "REDACTED"

#: Java patterns with the same matches that don't start again inside a run that has failed as a whole: a match begins
#: where a run of the local part's characters does, or where the last match ended. A number is tried only at characters that begin one.
_QUICK = {EMAIL: r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", PHONE: r"(?=[+(0-9])" + PHONE}


#: What each match of a pattern holds.
NEEDED = {EMAIL: "@"}
#: By pattern of link_to its host, which each match holds as it is.
_HOSTS: dict[str, str] = {}


def quick(pattern: str) -> str:
    """A pattern for Spark's functions that takes time in proportion to the text, with the same matches."""
    return _QUICK.get(pattern, pattern)


def may_hold(text: Column, pattern: str | Column) -> Column:
    """Whether a text holds what each match of a pattern does, which takes a fraction of the pattern's time; true where nothing is known of a pattern."""
    if not isinstance(pattern, str):
        return F.lit(True)
    if pattern == PHONE:
        return F.regexp_like(text, F.lit("[0-9]"))
    mark = NEEDED.get(pattern) or _HOSTS.get(pattern)
    return F.contains(text, F.lit(mark)) if mark else F.lit(True)


#: Punctuation and blanks that stand for an ASCII one, character by character.
TYPESET = "‘’ʼ´“”‐‑‒–—   "
PLAIN = "''''\"\"-----   "


def link_to(host: str) -> str:
    """Like LINK, for another host."""
    pattern = r"(?:https?://)?(?:www\.)?" + re.escape(host) + r"\S*"
    _HOSTS[pattern] = host
    return pattern


def normalised(text: Column) -> Column:
    """Typeset punctuation and blanks as ASCII; lengths and places stay."""
    return F.translate(text, TYPESET, PLAIN)


def cleaned(token: Column) -> Column:
    """A token in lower case, without edge characters other than letters, digits, _, ' and -."""
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}_'-]+|[^\p{L}\p{N}_'-]+$", ""))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, start: Column, end: Column, window: int = 40) -> Column:
    """The text from `window` characters before to as many after, on one line."""
    low = F.greatest(F.lit(0), start - window)
    return squeezed(F.substring(text, (low + 1).cast("int"), (end + window - low).cast("int")))


def grid(x: Column, step: float) -> Column:
    """The nearest multiple of step, halves to even."""
    return F.rint(x / step) * step


def occurrences(text: Column, value: Column) -> Column:
    """How often a value stands in a text, at least 1. Bytes are counted, since a text knows how many it has."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) - F.octet_length(F.replace(text, value, F.lit("")))) / F.octet_length(value))).cast("bigint")


def redacted_path(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.[^./]+)$", "_REDACTED$1")


def masked(text: Column, patterns: tuple[str, ...] = (EMAIL, PHONE, LINK)) -> Column:
    """Every match of the patterns, one after another, replaced by the label; a text without what a pattern's matches hold is not searched."""

    def without(p: str) -> Callable[[Column], Column]:
        return lambda x: F.when(may_hold(x, p), F.regexp_replace(x, quick(p), LABEL)).otherwise(x)

    for p in patterns:
        text = let(text, without(p))
    return text


def natural_key(value: Column) -> Column:
    """A key by which digits sort by their value: "Item 9" before "Item 10", in any case."""
    bare = lambda x: F.regexp_replace(x, "^0+", "")
    each = lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.char_length(bare(x)).cast("string"), 4, "0"), bare(x))).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(value), F.lit("[0-9]+|[^0-9]+"), F.lit(0)), each), "")
