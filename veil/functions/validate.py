"""What values look like. All are Boolean columns over a string column, null where the value is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EMAIL, PHONE

#: The most words and characters of a name, and characters of a name of one word.
MOST_WORDS, MOST_CHARS, MOST_IN_WORD = 4, 40, 22


def name_shape(value: Column, function_words: Sequence[str] | None = None) -> Column:
    """Whether a value can be a person's name: few capitalised words, no digits, no function words, no trailing marks.

    function_words: words that no name contains, in lower case; by default Spark's own list of English stop words.
    """
    if function_words is None:
        function_words = StopWordsRemover.loadDefaultStopWords("english")
    v = F.trim(value)
    words = F.split(v, r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"""^[.,;:()'"]+|[.,;:()'"]+$""", ""))
    known = F.array(*map(F.lit, function_words)).cast("array<string>")
    good = F.forall(
        bare,
        lambda w: (w != "") & ~w.rlike(r"\d") & ~F.array_contains(known, F.lower(w)) & (w.rlike(r"^[A-Z]{1,4}$") | w.rlike(r"^[A-Z][A-Za-z'-]*$")),
    )
    last = F.element_at(words, -1)
    ends = ~v.rlike(r"[,;():]$") & (~v.rlike(r"\.$") | (F.char_length(last) <= 4))
    full = (v != "") & (F.size(words) <= MOST_WORDS) & (F.char_length(v) <= MOST_CHARS) & ((F.size(words) > 1) | (F.char_length(v) <= MOST_IN_WORD)) & ends & good
    # Most values are capitalised words of plain letters between single blanks; of these only lengths and function words are left to see.
    plain = v.rlike(rf"^[A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*){{0,{MOST_WORDS - 1}}}\z")
    short = (F.char_length(v) <= MOST_CHARS) & (F.contains(v, F.lit(" ")) | (F.char_length(v) <= MOST_IN_WORD))
    return F.when(plain, short & ~F.arrays_overlap(F.split(F.lower(v), " "), known)).otherwise(full)


def numeric_noise(token: Column) -> Column:
    """No letter, or a digit, or a trailing colon."""
    # Plain letters at the end and otherwise letters and blanks, as most have, are none.
    return ~token.rlike(r"^[A-Za-z ]*[A-Za-z]\z") & (~token.rlike(r"\p{L}") | token.rlike(r"\p{N}") | token.rlike(r":\s*$"))


def phone_shape(value: Column) -> Column:
    """7 to 15 digits and a plus sign, a separator or 9 digits at least; not a year with a number."""
    v = F.trim(value)
    n = F.char_length(F.regexp_replace(v, r"[^0-9]", ""))
    return ~v.rlike(r"^(19|20)[0-9]{2}-[0-9]+$") & n.between(7, 15) & (v.startswith("+") | v.rlike(r"[-. ()]") | (n >= 9))


def kind_of(value: Column) -> Column:
    """email, phone or name, by full match."""
    return F.when(value.rlike(f"^(?:{EMAIL})$"), "email").when(value.rlike(f"^(?:{PHONE})$"), "phone").otherwise("name")
