"""SentencePiece encoding and decoding with seeded merge-dropout.

A merge-type segmentation starts from single characters and merges neighbours
whose joined text is a piece, best score first, leftmost first among equals.
When a candidate comes up from the agenda, a keyed hash of the seed, the
document, the chunk's place in it and the candidate's turn decides whether it
is skipped; a skipped candidate does not come back, candidates made by later
merges may. So every occurrence of a word is segmented by draws of its own, one
text has many segmentations, each of which can be made again from its key, and
all of which decode to the same text.

The model is a SentencePiece model of merge type with an identity normalizer
and byte pieces. No piece has its blank mark after another character, so a
merge never crosses the start of a run of blanks, and a text's ids are those of
its chunks in order: a run of blanks and what follows it, or a character that no
piece holds. Chunks of one length take their turns side by side in numpy arrays,
a turn of all of them at a time; nothing is kept from one chunk for another.
Characters without a piece become bytes; so does a blank mark that stands in the
text itself, and decoding gives back exactly the text.

Cases: a null text is encoded as an empty one and decodes to ""; repeated
rows give equal ids (the draws follow from doc_id, those of a null doc_id from
the text); an empty table gives no rows; very long runs without a blank are
merged one at a time with a heap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

BLANK = "▁"
NEVER = (1 << 31) - 1
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


def spread(x: int) -> int:
    """Mix 64 bits (the finalizer of SplitMix64); `spread_all` is the same on arrays."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def spread_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pairs:
    """Which piece two neighbours join to: an open hash table, looked up by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        bits = max(4, (4 * len(left)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.table = np.full(1 << bits, -1, np.int64)  # left, right and joined in 20 bits each
        keys, at = self._keys(left, right), None
        todo, at = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            _, first = np.unique(at, return_index=True)
            first = first[self.table[at[first]] < 0]
            self.table[at[first]] = keys[todo[first]] << 20 | joined[todo[first]]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) & self.last

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 20 | right

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(STEP) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined piece, or -1. Ids are 0 or more; -1 stands for nothing and joins with nothing."""
        keys = self._keys(left, right)
        at = self._slots(keys)
        got = self.table[at]
        wrong = np.flatnonzero((got >> 20 != keys) & (got >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.last
            got[wrong] = self.table[at[wrong]]
            wrong = wrong[(got[wrong] >> 20 != keys[wrong]) & (got[wrong] >= 0)]
        return np.where(keys < 0, -1, np.where(got < 0, -1, got & 0xFFFFF)).astype(np.int32)


class Model:
    """Pieces of a model file, and segmentations by them."""

    SHORT = 48  # longer chunks use a heap; at most 64, for a place and a rank share 32 bits
    CHARACTERS = 1 << 21  # of texts taken together, about
    COLUMNS = 1 << 14  # chunks side by side

    def __init__(self, path: str, dropout: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n >= 1 << 20:
            raise ValueError("a model of over a million pieces")
        pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        self.id_of = {p: i for i, p in enumerate(pieces) if normal[i]}
        if any(BLANK in p.lstrip(BLANK) for p in self.id_of):
            raise ValueError("a piece has a blank mark after another character; chunks cannot be encoded apart")
        if any(c not in self.id_of for p in self.id_of for c in p):
            raise ValueError("a piece has a character that is no piece by itself")
        scores = sorted({model.get_score(i) for i in self.id_of.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}  # equal scores tie; the leftmost candidate wins
        self.rank = {p: place[model.get_score(i)] for p, i in self.id_of.items()}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            else:
                self.raw.append(p.replace(BLANK, " ").encode() if normal[i] else b"")
        self.bytes = np.array(self.byte, np.int64)
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.seed = seed
        self.below = round(dropout * 256)
        # Tables for the arrays: the piece of a character, the piece of two neighbours, where it comes on the agenda.
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")], self.symbol[ord(BLANK)] = self.symbol[ord(BLANK)], -1
        self.order = np.array([self.rank.get(p, 0) << 6 if normal[i] else 0 for i, p in enumerate(pieces)] + [NEVER], np.int32)  # -1: never
        found = [(self.id_of[p[:k]], self.id_of[p[k:]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
        self.pairs = Pairs(*np.array(found or [(0, 0, 0)], np.int64).T)

    def key(self, own: object) -> int:
        """64 bits for the draws of a document."""
        return xxhash.xxh3_64_intdigest(f"{self.seed}:{own}".encode())

    def skips(self, key: int, place: int, turn: int) -> bool:
        """Whether the candidate that comes up at this turn in the chunk at this place is skipped."""
        return spread((spread((key + place * STEP) & MASK) + turn * STEP) & MASK) >> 56 < self.below

    def _merged(self, chunk: str, key: int, place: int) -> list[int]:
        """Ids of one chunk of any length, with a heap. Parts are known by where they start."""
        rank, n, turn = self.rank.get, len(chunk), 0
        end, previous, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(chunk[i : i + 2], NEVER)) != NEVER]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            turn += 1
            if self.skips(key, place, turn - 1):
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                previous[stop] = i
                if (r := rank(chunk[i : end[stop]], NEVER)) != NEVER:
                    heappush(heap, (r, i, end[stop]))
            if i and (r := rank(chunk[previous[i] : stop], NEVER)) != NEVER:
                heappush(heap, (r, previous[i], stop))
        return [self.id_of[chunk[i : end[i]]] for i in range(n) if alive[i]]

    def _side_by_side(self, symbols: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Merge chunks of one length, a column each; what is left of a column's symbols are its ids, the others -1.

        Parts are known by the row they start in. A last row, of no symbol, is
        the neighbour of the first and last parts.
        """
        length, n = symbols.shape
        part = np.full((length + 1, n), -1, np.int32)
        part[:length] = symbols
        joined = np.full((length + 1, n), -1, np.int32)
        joined[: length - 1] = self.pairs(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(length - 1, n)
        rows = np.arange(length + 1, dtype=np.int32)
        agenda = np.where(joined < 0, NEVER, self.order[joined] + rows[:, None])
        after = np.repeat(rows + 1, n)
        before = np.repeat(np.where(rows > 0, rows - 1, length), n)
        flat, into = part.ravel(), joined.ravel()
        columns, turn = np.arange(n), 0
        while True:
            best = agenda.min(0)
            at = np.flatnonzero(best != NEVER)
            if not len(at):
                return part[:length]
            if 2 * len(at) < len(best):
                agenda, columns, best, at = np.ascontiguousarray(agenda[:, at]), columns[at], best[at], np.arange(len(at))
            width, todo = len(columns), agenda.ravel()
            row, col = best[at].astype(np.int64) & 63, columns[at]
            skip = spread_all(keys[col] + np.uint64(turn * STEP & MASK)) >> np.uint64(56) < self.below
            turn += 1
            if skip.any():
                todo[row[skip] * width + at[skip]] = NEVER
                row, col, at = row[~skip], col[~skip], at[~skip]
            here = row * n + col
            right = after[here].astype(np.int64)
            far = after[right * n + col].astype(np.int64)
            left = before[here].astype(np.int64)
            whole = into[here]
            flat[here] = whole
            flat[right * n + col] = -1
            after[here] = far
            before[far * n + col] = row
            new = self.pairs(np.concatenate([flat[left * n + col], whole]), np.concatenate([whole, flat[far * n + col]]))
            ranks = self.order[new]
            ranks = np.where(new < 0, NEVER, ranks + np.concatenate([left, row]))
            m = len(row)
            into[left * n + col], into[here] = new[:m], new[m:]
            todo[right * width + at] = NEVER
            todo[left * width + at] = ranks[:m]
            todo[row * width + at] = ranks[m:]

    def _together(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of some texts, none of them empty."""
        characters = np.frombuffer("".join([" " + t for t in texts]).encode("utf-32-le"), np.uint32)
        stops = np.cumsum([len(t) + 1 for t in texts])
        symbols = self.symbol[characters]
        blank, bare = symbols == self.symbol[ord(" ")], symbols < 0
        starting = bare.copy()
        starting[1:] |= bare[:-1] | (blank[1:] & ~blank[:-1])
        begins = np.r_[0, stops[:-1]]
        starting[begins] = True
        starts = np.flatnonzero(starting)
        lengths = np.diff(np.r_[starts, len(characters)])
        text_of = np.searchsorted(stops, starts, "right")
        places = starts - begins[text_of]
        draws = spread_all(np.array(keys, np.uint64)[text_of] + places.astype(np.uint64) * np.uint64(STEP))
        bare = bare[starts]
        counts = np.zeros(len(starts), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # chunks and their ids, all of a chunk's in order
        own = np.flatnonzero(bare)
        c = characters[starts[own]]  # each becomes its bytes
        counts[own] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        done.append((own, self.bytes[np.frombuffer(c.tobytes().decode("utf-32-le").encode(), np.uint8)]))
        by_length = np.argsort(lengths, kind="stable")
        sizes = lengths[by_length]
        for length in range(1, self.SHORT + 1):
            some = by_length[slice(*np.searchsorted(sizes, [length, length + 1]))]
            some = some[~bare[some]] if length == 1 else some
            for a in range(0, len(some), self.COLUMNS):
                own = some[a : a + self.COLUMNS]
                left = self._side_by_side(symbols[starts[own] + np.arange(length)[:, None]], draws[own]).T
                kept = left >= 0
                counts[own] = kept.sum(1)
                done.append((own, left[kept]))
        for k in np.flatnonzero(lengths > self.SHORT).tolist():
            chunk = characters[starts[k] : starts[k] + lengths[k]].tobytes().decode("utf-32-le")
            ids = self._merged(chunk.replace(" ", BLANK), keys[text_of[k]], int(places[k]))
            counts[k] = len(ids)
            done.append((np.array([k]), np.array(ids)))
        ends = np.cumsum(counts)
        out = np.empty(ends[-1], self.dtype)
        for own, ids in done:
            n = counts[own]
            firsts = np.cumsum(n) - n
            out[np.repeat((ends - counts)[own] - firsts, n) + np.arange(len(ids))] = ids
        last = np.searchsorted(starts, stops) - 1
        cuts = ends[last]
        return [out[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]

    def encode_all(self, texts: list[str], owns: list[object]) -> list[np.ndarray]:
        """Ids of texts; owns: what each one's draws are keyed by, besides the seed and the places of chunks."""
        out = [np.empty(0, self.dtype)] * len(texts)
        some: list[int] = []
        size = 0
        for k, t in enumerate([*texts, None]):
            if some and (t is None or size >= self.CHARACTERS):
                for i, ids in zip(some, self._together([texts[i] for i in some], [self.key(owns[i]) for i in some])):
                    out[i] = ids
                some, size = [], 0
            if t:
                some.append(k)
                size += len(t)
        return out

    def encode(self, text: str, own: object = 0) -> np.ndarray:
        return self.encode_all([text], [own])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text whose segmentation ids are; the blank put before it is taken off."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode()[1:]


@cache
def model(path: str, dropout: float, seed: int) -> Model:
    return Model(path, dropout, seed)


_RESULT = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean"


def segmented(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256 of the text they decode to, lossless (and ids).

    The draws are keyed by seed, doc_id and place. dropout is taken to the nearest 256th.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, dropout, seed)
        for batch in batches:
            n, crc, digest, same, kept = [], [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            owns = [i if i is not None else f"text {xxhash.xxh3_128_hexdigest(t.encode())}" for i, t in zip(batch.column("doc_id").to_pylist(), texts)]
            for text, ids in zip(texts, m.encode_all(texts, owns)):
                raw = ids.astype("<u4").tobytes()
                back = m.decode(ids)
                n.append(len(ids))
                crc.append(zlib.crc32(raw))
                digest.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
                if with_ids:
                    kept.append(raw)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, _RESULT + (", ids binary" if with_ids else ""))
