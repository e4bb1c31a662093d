"""Folding of case and typeset marks code point by code point: lengths and places stay, in Spark's columns and in numpy arrays alike."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PLAIN, TYPESET

#: Code points that have case lie below this one.
CASED = 0x20000


@cache
def singles() -> dict[int, int]:
    """What each code point becomes that folding changes: its upper case's lower case, where each is one code point."""
    out = {}
    for c in range(CASED):
        upper = chr(c).upper()
        low = (upper if len(upper) == 1 else chr(c)).lower()
        low = low if len(low) == 1 else low[0]  # a dotted capital I, whose lower case has the dot apart
        if ord(low) != c:
            out[c] = ord(low)
    return out


@cache
def _beside_lower() -> tuple[str, str]:
    """What is left to translate after lower(), which already gives most single code points."""
    pairs = [(c, f) for c, f in singles().items() if chr(c).lower() != chr(f)]
    rest = [(c, f) for c, f in pairs if len(chr(c).lower()) == 1]
    # lower() turns a capital sigma at a word's end into the final form; that is folded with the others.
    return "".join(chr(c) for c, _ in rest), "".join(chr(f) for _, f in rest)


def folded(text: Column) -> Column:
    """A text in one case; the n-th code point of the result is that of the text."""
    source, target = _beside_lower()
    return F.translate(F.lower(F.translate(text, "İ", "i")), source, target)


@cache
def _capitals() -> dict[str, str]:
    """By code point the others that lower() turns into it, or into it and a mark."""
    out: dict[str, str] = {}
    for c in map(chr, range(CASED)):
        if (low := c.lower()) != c:
            out[low[0]] = out.get(low[0], "") + c
    return out


def any_case(value: str) -> str:
    """A pattern for what lower() turns into a value that is in lower case."""
    return "".join("[" + "".join(f"\\x{{{ord(c):x}}}" for c in v + _capitals().get(v, "")) + "]" for v in value)


@cache
def table(typeset: bool) -> np.ndarray:
    """Folded code points by code point; if typeset, typeset punctuation and blanks as ASCII too."""
    out = np.arange(CASED, dtype=np.uint32)
    for c, f in singles().items():
        out[c] = f
    if typeset:
        for c, p in zip(TYPESET, PLAIN):
            out[ord(c)] = ord(p)
    return out


@cache
def spaces() -> np.ndarray:
    """Whether a code point is white space."""
    return np.array([chr(c).isspace() for c in range(CASED)])


@cache
def letters_or_digits() -> np.ndarray:
    """Whether a code point is, in whichever case, an ASCII letter or digit."""
    return np.array([c < 128 and chr(c).isalnum() for c in table(False).tolist()])


@cache
def word_characters() -> np.ndarray:
    """Whether a code point can be part of a word: letters, marks, digits, letter numbers, connectors."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" or unicodedata.category(chr(c)) in ("Nd", "Nl", "Pc") for c in range(CASED)])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def looked_up(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """values[code] for each code point; beyond the table, where nothing has case, what its last entry says or the code point itself."""
    if not len(codes) or int(codes.max()) < CASED:
        return values[codes]
    beyond = codes >= CASED
    out = values[np.where(beyond, CASED - 1, codes)]
    return np.where(beyond, codes, out) if values.dtype == np.uint32 else out
