"""Spelling variant grouping by search schemes over bidirectional FM-indexes.

Words that differ by one inserted, deleted or replaced code point agree exactly
in the first half of one of them or in its second half. So a word is searched
twice: its first half is matched exactly, backwards to the delimiter before a
word, while the interval of suffix ranks in the reversed text is kept in step;
then the search turns and goes on to the right through that interval, to the
delimiter after the word, with exactly one error allowed on the way. The second
search is the same over mirrored words. Errors are taken in one normal form (an
inserted code point is put after others like it, of a run the last is deleted),
so each pair of words turns up once; the second search leaves out what the first
has found. All words of a block are searched side by side in arrays.

The vocabulary is dealt out by half: a word is indexed under its first so many
code points, as many as half a word of its length, or of one more or less, has,
and searched under its own half, so one task meets all words it can find. Halves
are dealt to blocks; a half with more words than a block takes has blocks of its
own, one for each pair of parts of its words. Words longer than `LONGEST` are
few and are compared by hashes of what each deletion leaves, with an equi-join.

Each search returns the number of words found and the best of them, not the
pairs. Forms grow tenfold in number from one to the next, so chains end soon.

Cases: a null text has no words; a null doc_id counts as "null" in the hash;
words that are found fewer than `least_found` times, or shorter than
`least_chars`, take no part; of equal numbers the word first in code-point order
is the form; each row of the table is read whole and counted for itself, also if
doc_ids or rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, Windows, mixed, staged, texts

#: A run of letters, after A-Z have become lower case.
RUN = re.compile("[a-zÀ-ÿ]+")
#: One in so many runs of a document loses a code point.
EVERY = 31
#: Counts that a task holds before it passes them on: under 200 MB.
HELD = 500_000
#: Rows (words under a half) of a block; code points of the longest word of an index.
BLOCK, LONGEST = 16_384, 256
#: BWT characters between two rows of an index' table of counts.
STEP = 32
#: Intervals up to this size are read row by row for the characters that go on, larger ones character by character.
NARROW = 48


def shortened(word: str, doc_id: int | None) -> str:
    """The run, or what one run in 31 of a document becomes: the same without a code point."""
    h = zlib.crc32(word.encode(), zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode()))
    if h % EVERY:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _counted(least_chars: int):
    """word, n of a task's documents, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall(text.translate(LOWER).decode("utf-8", "replace"))).items():
                    if len(word) < least_chars:
                        continue
                    if zlib.crc32(word.encode(), start) % EVERY:
                        held[word] += n
                    elif len(word) > least_chars:
                        held[shortened(word, doc_id)] += n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return run


def vocabulary(docs: DataFrame, least_chars: int = 7, least_found: int = 2) -> DataFrame:
    """word, n: the words of all documents that are long and frequent enough."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(least_chars), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_found)


class Index:
    """A bidirectional FM-index over distinct words (as code points), each with a delimiter before and after it.

    The text is taken as a ring. `before` has the characters that stand before
    each suffix in order, `after` the same for the reversed text.
    """

    def __init__(self, words: list[np.ndarray]):
        lengths = np.array([len(w) for w in words])
        used = np.unique(np.concatenate(words))
        self.codes = {int(c): k + 1 for k, c in enumerate(used)}
        self.size = len(used) + 2  # the delimiter, the code points, and one for any other
        self.starts = np.cumsum(np.r_[0, lengths[:-1] + 1])  # of each word's delimiter
        text = np.zeros(int(lengths.sum()) + len(words), np.uint8 if self.size < 256 else np.int32)
        inside = np.ones(len(text), bool)
        inside[self.starts] = False
        text[inside] = np.searchsorted(used, np.concatenate(words)) + 1
        self.n = len(text)
        self.before = Column(text, self.size)
        self.after = Column(text[::-1], self.size)

    def encoded(self, word: np.ndarray) -> np.ndarray:
        return np.array([self.codes.get(c, self.size - 1) for c in word.tolist()], np.int64)

    def word_at(self, reverse_rank: np.ndarray) -> np.ndarray:
        """The word whose closing delimiter begins the suffix of the reversed text at a rank."""
        at = (self.n - 1 - self.after.order[reverse_rank]) % self.n  # that delimiter's place
        return (np.searchsorted(self.starts, at) - 1) % len(self.starts)


class Column:
    """Last column of the sorted rotations of a text, with counts of its characters."""

    def __init__(self, text: np.ndarray, size: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while True:
            key = rank * (n + size) + np.roll(rank, -width)
            order = np.argsort(key, kind="stable")
            new = np.r_[False, np.diff(key[order]) != 0]
            if new.sum() == n - 1 or width >= n:
                break
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            width *= 2
        self.order = order
        last = text[order - 1]
        blocks = n // STEP + 1
        padded = np.full(blocks * STEP, size, last.dtype if size < 256 else np.int32)
        padded[:n] = last
        self.last = padded.reshape(blocks, STEP)
        counts = np.zeros((blocks + 1, size + 1), np.int32)
        np.add.at(counts, (np.arange(n) // STEP + 1, last.astype(np.int64) + 1), 1)
        self.below = np.cumsum(np.cumsum(counts, 0), 1, dtype=np.int32)  # characters below c before a block
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]

    def counts(self, c: np.ndarray, i: np.ndarray, less: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """How often c stands before place i, and (if less) characters below it."""
        block, rest = i // STEP, i % STEP
        near, inside = self.last[block], np.arange(STEP) < rest[:, None]
        below = self.below[block, c]
        equal = self.below[block, c + 1] - below + ((near == c[:, None]) & inside).sum(1)
        return equal, below + ((near < c[:, None]) & inside).sum(1) if less else None

    def narrowed(self, c: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of what an interval's strings become with c before them."""
        a, b = self.counts(c, low)[0], self.counts(c, low + size)[0]
        return self.first[c] + a, b - a

    def going_on(self, low: np.ndarray, size: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """(interval, character) for each character but the delimiter that stands in an interval, once each."""
        wide = np.flatnonzero(size > NARROW)
        narrow = np.flatnonzero((size > 0) & (size <= NARROW))
        own = np.repeat(narrow, size[narrow])
        at = np.arange(len(own)) - np.repeat(np.cumsum(size[narrow]) - size[narrow], size[narrow]) + np.repeat(low[narrow], size[narrow])
        c = self.last[at // STEP, at % STEP].astype(np.int64)
        pairs = np.unique(own[c > 0] * symbols + c[c > 0])
        if len(wide):
            pairs = np.r_[pairs, (wide[:, None] * symbols + np.arange(1, symbols)).ravel()]
        return pairs // symbols, pairs % symbols


def near_words(index: Index, queries: list[np.ndarray], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) for each word of the index with one error against a query, which begins with its first `halves` code points."""
    lengths = np.array([len(q) for q in queries])
    pattern = np.zeros((len(queries), int(lengths.max()) + 2), np.int64)
    for k, q in enumerate(queries):
        pattern[k, : len(q)] = index.encoded(q)
    left, right = index.before, index.after
    # The half, from its end to the delimiter before it; the interval of the mirrored half in the reversed text goes along.
    low, rlow, size = (np.full(len(queries), v, np.int64) for v in (0, 0, index.n))
    for k in range(int(halves.max()), -1, -1):
        on = np.flatnonzero((halves >= k) & (size > 0))
        c = pattern[on, k - 1] if k else np.zeros(len(on), np.int64)
        (a, below_a), (b, below_b) = left.counts(c, low[on], True), left.counts(c, low[on] + size[on], True)
        low[on], rlow[on], size[on] = left.first[c] + a, rlow[on] + below_b - below_a, b - a
    main = np.flatnonzero(size > 0)
    j, mlow, msize = halves[main].copy(), rlow[main], size[main]
    nothing = np.empty(0, np.int64)
    query, at, plow, psize = nothing, nothing, nothing, nothing  # searches that have had their error
    found_q, found_w = [], []
    while len(main) or len(query):
        if len(query):
            c = pattern[query, at]
            plow, psize = right.narrowed(c, plow, psize)
            on = psize > 0
            done = on & (at == lengths[query])
            if done.any():
                found_q.append(query[done])
                found_w.append(index.word_at(plow[done]))
            on &= ~done
            query, at, plow, psize = query[on], at[on] + 1, plow[on], psize[on]
        if len(main):
            end = j == lengths[main]
            now, nxt = pattern[main, j], pattern[main, j + 1]
            own, c = right.going_on(mlow, msize, index.size)
            clow, csize = right.narrowed(c, mlow[own], msize[own])
            keep = csize > 0
            own, c, clow, csize = own[keep], c[keep], clow[keep], csize[keep]
            other = c != now[own]
            replaced = other & ~end[own]
            dropped = np.flatnonzero(~end & (now != nxt))
            query = np.concatenate([query, main[own[replaced]], main[own[other]], main[dropped]])
            at = np.concatenate([at, j[own[replaced]] + 1, j[own[other]], j[dropped] + 1])
            plow = np.concatenate([plow, clow[replaced], clow[other], mlow[dropped]])
            psize = np.concatenate([psize, csize[replaced], csize[other], msize[dropped]])
            same = ~other & ~end[own]
            main, j, mlow, msize = main[own[same]], j[own[same]] + 1, clow[same], csize[same]
    if not found_q:
        return nothing, nothing
    return np.concatenate(found_q), np.concatenate(found_w)


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)


_FOUND = "word string, n_near long, best_n long, best string"


def _searched(table: pa.Table) -> pa.Table:
    """One block: its indexed words, and the searches for those of its words that are searched here. Words of side 1 are mirrored."""
    mirrored = table.column("side")[0].as_py() == 1
    word, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    indexed, asked = table.column("indexed").to_numpy(), table.column("asked").to_numpy()
    turned = [w[::-1] for w in word] if mirrored else word
    held: dict[str, int] = {turned[k]: int(n[k]) for k in np.flatnonzero(indexed)}
    rows = np.flatnonzero(asked).tolist()
    counts: Counter[str] = Counter()
    best: dict[str, tuple[int, str]] = {}
    if held and rows:
        names = sorted(held)
        number = np.array([held[w] for w in names], np.int64)
        index = Index([_codes(w) for w in names])
        queries = [turned[k] for k in rows]
        half = np.array([len(q) // 2 if not mirrored else len(q) - len(q) // 2 for q in queries])
        for k in range(0, len(queries), BLOCK):
            part = queries[k : k + BLOCK]
            q, w = near_words(index, [_codes(x) for x in part], half[k : k + BLOCK])
            for a, b in zip(q.tolist(), w.tolist()):
                asked_word, near = part[a], names[b]
                if mirrored:
                    keep = len(asked_word) // 2  # its first half, now the last: found from the other side
                    if near.endswith(asked_word[-keep:]):
                        continue
                counts[asked_word] += 1
                this = (-int(number[b]), near[::-1] if mirrored else near)
                if asked_word not in best or this < best[asked_word]:
                    best[asked_word] = this
    own = [w[::-1] for w in counts] if mirrored else list(counts)
    return pa.table({"word": pa.array(own, pa.string()), "n_near": pa.array(list(counts.values()), pa.int64()), "best_n": pa.array([-best[w][0] for w in counts], pa.int64()), "best": pa.array([best[w][1] for w in counts], pa.string())})


def _placed(words: DataFrame, block: int) -> DataFrame:
    """Words under their halves: side, block, word, n, indexed, asked."""
    size = F.char_length("word")
    # Half of a word of this length, of one less and of one more: two lengths, of which one is its own.
    halves = [F.array_distinct(F.array(*[F.floor((size + d) / 2).cast("int") for d in (-1, 0, 1)])), F.array_distinct(F.array(*[F.ceil((size + d) / 2).cast("int") for d in (-1, 0, 1)]))]
    key = [F.substring("word", F.lit(1), F.col("h")), F.substring("word", 1 + size - F.col("h"), F.col("h"))]
    own = [F.floor(size / 2), F.ceil(size / 2)]
    sides = [words.select(F.lit(s).alias("side"), "word", "n", F.explode(halves[s]).alias("h")).select("side", "h", key[s].alias("half"), "word", "n", (F.col("h") == own[s]).alias("asked")) for s in (0, 1)]
    rows = sides[0].unionByName(sides[1])
    blocks = max(1, -(-4 * words.count() // block))
    # A half of over a block's words: as many parts as needed, and a block for each pair of parts.
    sizes = rows.groupBy("side", "h", "half").count().filter(F.col("count") > block)
    hot = staged(sizes.select("side", "h", "half", F.ceil(F.col("count") / block).cast("int").alias("parts")), "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    dealt = rows.join(hot, ["side", "h", "half"], "left").withColumn("hash", F.xxhash64("side", "h", "half"))
    cold = dealt.filter("parts IS NULL").select("side", F.concat_ws(":", "side", F.pmod("hash", F.lit(blocks))).alias("block"), "word", "n", F.lit(True).alias("indexed"), "asked")
    part = F.pmod(F.xxhash64("word"), F.col("parts"))
    pair = lambda a, b: F.concat_ws(":", "side", "h", "half", a, b)
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
    split = dealt.filter("parts IS NOT NULL").select("side", "h", "half", "word", "n", "asked", part.alias("p"), each)
    indexed = split.select("side", pair("p", "o").alias("block"), "word", "n", F.lit(True).alias("indexed"), F.lit(False).alias("asked"))
    asked = split.filter("asked").select("side", pair("o", "p").alias("block"), "word", "n", F.lit(False).alias("indexed"), "asked")
    return cold.unionByName(indexed).unionByName(asked)


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each deletion leaves of a word, as two 64-bit hashes: a row for each run of one code point, from start to stop; -1 for the whole word."""
    rolls = Windows(0x9FB21C651E98DF25), Windows(0x2545F4914F6CDD1D)
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            c = _codes(word)
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            stop = np.r_[first[1:], len(c)] - 1
            h, hashes = mixed(c.astype(np.uint64) + np.uint64(1)), []
            for roll in rolls:
                up = roll.weights(len(c) + 1)
                head, tail = (np.r_[np.uint64(0), np.cumsum(h * up[k : k + len(c)])] for k in (1, 0))
                hashes.append(np.r_[head[-1], head[stop] + (tail[-1] - tail[stop + 1])].view(np.int64))
            size = len(stop) + 1
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(word.encode())] * size), pa.array(np.full(size, n)), pa.array(np.r_[-1, first]), pa.array(np.r_[-1, stop]), *map(pa.array, hashes)], ["id", "n", "start", "stop", "a", "b"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(w.encode()) for w in words], pa.binary()), pa.array(words, pa.string())], ["id", "word"])


def one_apart(a: str, b: str) -> bool:
    """Whether two words differ by one inserted, deleted or replaced code point."""
    x, y = sorted((_codes(a), _codes(b)), key=len)
    if len(y) - len(x) > 1 or a == b:
        return False
    differ = np.flatnonzero(x != y[: len(x)])
    first = int(differ[0]) if len(differ) else len(x)
    return len(differ) == 1 if len(x) == len(y) else bool((x[first:] == y[first + 1 :]).all())


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes only propose pairs: the words are compared."""
    for batch in batches:
        yield batch.filter(pa.array([one_apart(a, b) for a, b in zip(batch.column("word").to_pylist(), batch.column("best").to_pylist())], pa.bool_()))


def _long_ones(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best for pairs of words of which one at least is too long for an index."""
    some = words.filter(F.char_length("word") >= LONGEST)
    rows = staged(some.mapInArrow(_left, "id binary, n long, start long, stop long, a long, b long"), "left")
    x, y = (rows.select(*[F.col(c).alias(f"{c}{k}") for c in rows.columns]) for k in (1, 2))
    met = x.join(y, (F.col("a1") == F.col("a2")) & (F.col("b1") == F.col("b2")) & (F.col("id1") != F.col("id2")))
    # One is what is left of the other, or the same is left of both without a code point at one place.
    near = met.filter("(start1 = -1) <> (start2 = -1) OR (start1 >= 0 AND start2 >= 0 AND start1 <= stop2 AND start2 <= stop1)").select("id1", "id2", "n2").distinct()
    names = some.mapInArrow(_named, "id binary, word string")
    named = near.join(names.select(F.col("id").alias("id1"), "word"), "id1").join(names.select(F.col("id").alias("id2"), F.col("word").alias("best")), "id2")
    new = named.filter(F.greatest(F.char_length("word"), F.char_length("best")) > LONGEST).select("word", "best", "n2").mapInArrow(_compared, "word string, best string, n2 long")
    return new.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n2").alias("best_n"), F.min(F.struct((-F.col("n2")).alias("m"), "best")).alias("x")).select("word", "n_near", "best_n", F.col("x.best").alias("best"))


def forms(words: DataFrame, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n of a vocabulary (word, n)."""
    short = words.filter(F.char_length("word") <= LONGEST)
    found = _placed(short, block).groupBy("block").applyInArrow(_searched, _FOUND)
    if not words.filter(F.char_length("word") > LONGEST).isEmpty():
        found = found.unionByName(_long_ones(words))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word"))).alias("b")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    out = words.join(near, "word", "left")
    good = -F.col("b.m") >= ratio * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("b.word")).alias("form"), F.when(good, -F.col("b.m")).alias("form_n"))


def rooted(rows: DataFrame) -> DataFrame:
    """The same with `root`: where following forms ends. A round follows twice as far as the one before."""
    now = staged(rows.select("word", F.coalesce("form", "word").alias("root")).filter("word <> root"), "roots")
    while True:
        on = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        further = staged(now.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        now = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return rows.join(now, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, least_chars: int = 7, least_found: int = 2, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all documents."""
    words = staged(vocabulary(docs, least_chars, least_found), "words")
    return rooted(staged(forms(words, ratio), "forms"))
