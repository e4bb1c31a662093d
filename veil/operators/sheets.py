"""Pages of plain texts in a fixed-width layout, many side by side in one array of characters: what is found in them as rectangles, and the words that are left.

There a line, a span, a rectangle and a word are each a start and a stop, a
rectangle never goes beyond a line, and two things of a page have an area in
common just where they have a character in common. So a page costs time in
proportion to its characters and finds, however many words and rectangles stand
in one of its lines. Places and boxes are those of blocks.fixed, blocks.boxes and
layout.words_of.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import fold
from ..functions.geometry import SIDES
from . import substrings
from .layout import CHAR_WIDTH, LEADING
from .substrings import PART, SEARCHED

#: Characters of the pages that a task holds before it hands on what it has found in them.
HELD = 1 << 20
BOX = StructType([StructField(s, DoubleType()) for s in SIDES])
WORD = StructType([StructField("text", StringType()), *BOX])


class Sheet:
    """Texts side by side with a mark between them, and where their lines start and end; newlines and marks belong to no line."""

    def __init__(self, texts: list[str]):
        self.texts, self.text = texts, PART.join(texts)
        self.codes = fold.codes_of(self.text)
        self.begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        self.cut = self.codes == ord("\n")
        self.cut[self.begins[1:] - 1] = True
        self.ends = np.r_[np.flatnonzero(self.cut), len(self.codes)]
        self.starts = np.r_[0, self.ends[:-1] + 1]

    def of(self, place: np.ndarray) -> np.ndarray:
        """Which text each place is in."""
        return np.searchsorted(self.begins, place, "right") - 1

    def distinct(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans in order, once each."""
        return np.divmod(np.unique(start * (len(self.codes) + 1) + stop), len(self.codes) + 1)

    def pieces(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans cut at the ends of lines, without what has no character in a line."""
        first, last = np.searchsorted(self.ends, start), np.searchsorted(self.ends, stop - 1)
        n = np.maximum(last - first + 1, 0)
        line, own = substrings.ragged(first, n), np.repeat(np.arange(len(start)), n)
        a, z = np.maximum(start[own], self.starts[line]), np.minimum(stop[own], self.ends[line])
        return a[z > a], z[z > a]

    def covered(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How many characters before each place stand in one of some spans."""
        n = len(self.codes) + 1
        return np.r_[0, np.cumsum(np.cumsum(np.bincount(start, minlength=n) - np.bincount(stop, minlength=n)) > 0)]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """What stands between blanks."""
        is_in = np.r_[False, (self.codes != ord(" ")) & ~self.cut, False]
        edges = np.flatnonzero(is_in[1:] != is_in[:-1])
        return edges[::2], edges[1::2]

    def boxes(self, start: np.ndarray, stop: np.ndarray) -> list[pa.Array]:
        """The sides of pieces."""
        line = np.searchsorted(self.ends, start)
        top = (line - np.searchsorted(self.ends, self.begins)[self.of(start)]) * LEADING
        left = self.starts[line]
        return [pa.array(x) for x in ((start - left) * CHAR_WIDTH, top, (stop - left) * CHAR_WIDTH, top + LEADING)]


def _sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[Sheet, np.ndarray]]]]:
    """Rows of batches, as many as have some `HELD` characters, with sheets of their texts and the row of each text; rows without a text are on no sheet."""
    for batch in batches:
        first, held, sheets, texts, at, size = 0, 0, [], [], [], 0
        last = batch.num_rows - 1
        for k, text in enumerate(batch.column("text").to_pylist()):
            if text:
                texts.append(text)
                at.append(k - first)
                size += len(text)
            if texts and (size >= SEARCHED or k == last):
                sheets.append((Sheet(texts), np.array(at)))
                held += size
                texts, at, size = [], [], 0
            if held >= HELD or k == last:
                yield batch.slice(first, k + 1 - first), sheets
                first, held, sheets = k + 1, 0, []


def _placed(rows: pa.RecordBatch, column: str) -> Callable[[Sheet, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Where a column's spans (those with a character) are on a sheet."""
    spans = rows.column(column)
    flat, sizes = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row, start, stop = np.repeat(np.arange(len(spans)), sizes), *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
    row, start, stop = (x[stop > start] for x in (row, start, stop))

    def on(sheet: Sheet, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = slice(np.searchsorted(row, at[0]), np.searchsorted(row, at[-1], "right"))
        begin = sheet.begins[np.searchsorted(at, row[own])]
        return begin + start[own], begin + stop[own]

    return on


def _looked_for(sheet: Sheet, tables: list[Broadcast]) -> tuple[np.ndarray, np.ndarray]:
    """Where a list's values are on a sheet."""
    found = [t.value.found(sheet.texts)[1:3] for t in tables]
    return substrings.joined([f[0] for f in found]), substrings.joined([f[1] for f in found])


def _lists(rows: int, at: list[np.ndarray], names: list[str], columns: list[list[pa.Array]]) -> pa.ListArray:
    """An array of structs a row, from the row of each struct and from the columns of some structs after others."""
    ends = np.cumsum(np.bincount(substrings.joined(at), minlength=rows))
    kinds = [pa.string() if n == "text" else pa.float64() for n in names]
    flat = pa.StructArray.from_arrays([pa.concat_arrays([pa.array([], k), *[c[i] for c in columns]]) for i, k in enumerate(kinds)], names)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), flat)


def boxed(pages: DataFrame, values: DataFrame | list[str], **options) -> DataFrame:
    """doc_id, page_no, rects: of every place of a list's values in pages (doc_id, page_no, text) a rectangle for each line that it touches; a place that several values have counts once. No shuffle."""
    tables = substrings.finders(pages, values, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sheets in _sheets(batches):
            of, boxes = [], []
            for sheet, at in sheets:
                a, z = sheet.pieces(*sheet.distinct(*_looked_for(sheet, tables)))
                of.append(at[sheet.of(a)])
                boxes.append(sheet.boxes(a, z))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("page_no"), _lists(rows.num_rows, of, list(SIDES), boxes)], ["doc_id", "page_no", "rects"])

    own = pages.select("doc_id", "page_no", "text")
    return own.mapInArrow(run, StructType([*own.schema.fields[:2], StructField("rects", ArrayType(BOX))]))


def cleared(pages: DataFrame, names: DataFrame | list[str] | None = None, exceptions: DataFrame | list[str] | None = None) -> DataFrame:
    """doc_id, page_no, rects, words: of pages with their spans (a column) and the places of names the rectangles, once each, that touch no phrase of the exceptions, and the words that none of these touches. No shuffle."""
    named = [] if names is None else substrings.finders(pages, names, bounds="names")
    excepted = [] if exceptions is None else substrings.finders(pages, exceptions, blanks=False, bounds="words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sheets in _sheets(batches):
            ruled = _placed(rows, "spans")
            rects_of, rects, words_of, words = [], [], [], []
            for sheet, at in sheets:
                start, stop = (np.concatenate(x) for x in zip(ruled(sheet, at), _looked_for(sheet, named)))
                a, z = sheet.distinct(*sheet.pieces(start, stop))
                no = sheet.covered(*sheet.pieces(*_looked_for(sheet, excepted)))
                free = no[a] == no[z]
                a, z = a[free], z[free]
                rects_of.append(at[sheet.of(a)])
                rects.append(sheet.boxes(a, z))
                gone, (a, z) = sheet.covered(a, z), sheet.words()
                left = gone[a] == gone[z]
                a, z = a[left], z[left]
                words_of.append(at[sheet.of(a)])
                words.append([substrings.strings(sheet.text, a, z), *sheet.boxes(a, z)])
            columns = _lists(rows.num_rows, rects_of, list(SIDES), rects), _lists(rows.num_rows, words_of, ["text", *SIDES], words)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("page_no"), *columns], ["doc_id", "page_no", "rects", "words"])

    own = pages.select("doc_id", "page_no", "text", F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("spans"))
    return own.mapInArrow(run, StructType([*own.schema.fields[:2], StructField("rects", ArrayType(BOX)), StructField("words", ArrayType(WORD))]))
