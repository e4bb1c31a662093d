"""N-gram Jaccard join over a prefix tree.

Documents are sets of word shingles. Two steps find every pair whose Jaccard
similarity is at least num / den, and keep only what connects them:

1. Candidates. One global order sorts shingles: by a fixed-size sketch of how
   often they occur, rare first, then by hash. Sets that are similar enough
   share a shingle among the first few of each (the prefix). Documents meet at
   prefix shingles, and pairs that their lengths, the place of the shingle or a
   128-bit parity signature rule out are dropped; pairs of large sets, of which
   128 bits say little, are looked at with signatures as long as they need. No
   test ever drops a similar pair. Of the rest only a spanning forest is kept.
2. The join. The documents of each connected group of candidates are brought
   together once, and their whole sets go into a trie in the same global order,
   read from its common end so that sets that are alike share long beginnings.
   Each set walks it once, level by level; the overlap with a shared beginning is
   counted once for all sets below it, and a subtree is left when what remains on
   both sides is too little, or when all its sets are connected already.

Groups over `most_ids` shingles are split into blocks, and every pair of blocks
is joined by a task of its own, so a task's memory is bounded; the links found
are then connected across tasks. Documents with equal sets are one class from
the start: one of each class goes through both steps, whatever task its copies
are in.

Cases: a null or wordless text has an empty set, is linked with nothing and is
its own component; rows that share a doc_id are one node and each keeps its
row, a null doc_id stays alone with a null component; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, Windows, mixed, staged, texts, word_hashes
from .components import components

#: Counters of the sketch of how often shingles occur, and the slices it travels in.
SKETCH, SLICE = 1 << 18, 1 << 14
#: Prefix entries that a task holds back to find common ones among them.
HELD = 1 << 20
#: A task passes on at most two entries of each run of similar lengths of a shingle with more entries than this; it connects the others itself.
COMMON = 256


class Shingles:
    """The set of a text: 64-bit hashes of its distinct k-word shingles (all its words, if they are fewer), sorted."""

    def __init__(self, k: int):
        self.k, self.roll = k, Windows(0xA0761D6478BD642F)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        return np.unique(self.roll(word_hashes(words), min(self.k, len(words))) + np.uint64(len(words) if len(words) < self.k else 0))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


# --- sets and the sketch -----------------------------------------------------

_SETS = "doc_id long, n int, s1 long, s2 long, signature binary, slice int, counts binary"


def _sets(k: int):
    """Each document's set size and 128-bit identity; at the end of a task its part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        shingles, sketch = Shingles(k), np.zeros(SKETCH, np.uint32)
        names = [c.split()[0] for c in _SETS.split(", ")]
        for batch in batches:
            n, ids, signatures = [], [], []
            for text in texts(batch):
                s = shingles(text)
                n.append(len(s))
                ids.append(identity(s))
                signatures.append(signature(s))
                sketch += np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            ids = np.array(ids, np.uint64).reshape(-1, 2)
            nothing = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int32()), _signed(ids[:, 0]), _signed(ids[:, 1]), pa.array(signatures, pa.binary()), *nothing], names)
        slices = [zlib.compress(sketch[i : i + SLICE].tobytes(), 1) for i in range(0, SKETCH, SLICE)]
        k0 = len(slices)
        yield pa.RecordBatch.from_arrays([pa.nulls(k0, pa.int64()), pa.nulls(k0, pa.int32()), pa.nulls(k0, pa.int64()), pa.nulls(k0, pa.int64()), pa.nulls(k0, pa.binary()), pa.array(range(k0), pa.int32()), pa.array(slices, pa.binary())], names)

    return run


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return int(mixed(s + np.uint64(len(s))).sum(dtype=np.uint64)), int(mixed(s ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64))


def signature(s: np.ndarray) -> bytes:
    """Parity bits like _parity(), about one for each two shingles: enough to tell sets of any size apart."""
    bits = 1 << max(7, (len(s) // 2).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two signatures differ, the longer one folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _alike(t: Fraction):
    """Of pairs with lengths and signatures, those that these don't rule out."""
    less, more = t.denominator - t.numerator, t.denominator + t.numerator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n1", "sig1", "n2", "sig2")))
            ok = pa.array([bits_apart(x, y) * more <= (n + m) * less for n, x, m, y in rows], pa.bool_())
            yield batch.filter(ok).select(["a", "b"])

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], ["slice", "counts"])


def _sketch(rows: DataFrame) -> np.ndarray:
    """The whole corpus's sketch, 1 MB; parts are summed in tasks, then for each slice."""
    import zlib

    parts = rows.select("slice", "counts").mapInArrow(_sum_slices, "slice int, counts binary")
    out = np.zeros(SKETCH, np.uint32)
    for r in parts.repartition(SKETCH // SLICE, "slice").mapInArrow(_sum_slices, "slice int, counts binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out


def in_order(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Rare first, then by hash: the same order for every set."""
    return s[np.lexsort((s, sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))]


# --- candidates --------------------------------------------------------------

#: at: place of the shingle in the set; -1: stands for a run of documents of low to high shingles.
_ENTRIES = "shingle long, doc_id long, low int, high int, at int, b1 long, b2 long"
_NAMES = [c.split()[0] for c in _ENTRIES.split(", ")]


def prefix_length(n: int, t: Fraction) -> int:
    return n - -(-n * t.numerator // t.denominator) + 1


def _parity(s: np.ndarray) -> np.ndarray:
    """128 bits, each the parity of the shingles that fall on it; sets that differ in d shingles differ in d bits at most."""
    bits = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=128) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _entries(k: int, t: Fraction, shared):
    """Prefix entries of the documents that have the set s1, s2. Rows without a shingle are edges found at once, from doc_id to b1: a run's documents and its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain, shingles, sketch = zstandard.ZstdDecompressor(), Shingles(k), shared.value
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            w = np.concatenate([x[0] for x in held])
            each = np.array([len(x[0]) for x in held])
            doc = np.repeat(np.array([x[1] for x in held], np.int64), each)
            n = np.repeat(np.array([x[2] for x in held], np.int32), each)
            at = np.concatenate([np.arange(len(x[0]), dtype=np.int32) for x in held])
            bits = np.repeat(np.stack([x[3] for x in held]), each, axis=0)
            order = np.lexsort((n, w))
            w, doc, n, at, bits = w[order], doc[order], n[order], at[order], bits[order]
            high = n.copy()
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            lengths = np.diff(np.r_[starts, len(w)])
            keep = np.ones(len(w), bool)
            edges_a, edges_b = [], []
            for s, m in zip(starts[lengths > COMMON].tolist(), lengths[lengths > COMMON].tolist()):
                own = n[s : s + m].astype(np.int64)
                cuts = [0, *(np.flatnonzero(own[1:] * t.numerator > own[:-1] * t.denominator) + 1).tolist(), m]
                # A run: neighbours in length within the threshold. Connecting it whole can only make a group larger.
                for a, b in zip(cuts, cuts[1:]):
                    keep[s + a + 1 : s + b] = False
                    high[s + a], at[s + a] = own[b - 1], -1 if b - a > 1 else at[s + a]
                    edges_a.append(doc[s + a + 1 : s + b])
                    edges_b.append(np.full(b - a - 1, doc[s + a]))
            yield pa.RecordBatch.from_arrays([_signed(w[keep]), pa.array(doc[keep]), pa.array(n[keep]), pa.array(high[keep]), pa.array(at[keep]), _signed(bits[keep, 0]), _signed(bits[keep, 1])], _NAMES)
            if edges_a:
                a, b = forest(np.concatenate(edges_a), np.concatenate(edges_b))
                none = pa.nulls(len(a), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), none, none, none, pa.array(b), pa.nulls(len(a), pa.int64())], _NAMES)
            held.clear()

        for batch in batches:
            for doc_id, raw, *of in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "s1", "s2"))):
                s = shingles(plain.decompress(raw))
                if np.array(identity(s), np.uint64).view(np.int64).tolist() != of:  # another text under a used doc_id
                    continue
                ordered = in_order(s, sketch)[: prefix_length(len(s), t)]
                held.append((ordered, doc_id, len(s), _parity(s)))
                size += len(ordered)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these edges with the smallest it is connected with, but for those themselves."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _meet(t: Fraction):
    """Edges of a spanning forest of the pairs that meet at a shingle and pass the tests. Rows come sorted by shingle and low."""
    over = t.denominator - t.numerator, t.denominator + t.numerator  # differing shingles of a similar pair <= both lengths * over[0] / over[1]

    def passed(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """i is not longer than j."""
        run = (c["at"][i] < 0) | (c["at"][j] < 0)
        both = c["low"][i] + c["low"][j]
        length = c["low"][j] * t.numerator <= c["high"][i] * t.denominator
        rest = np.minimum(c["low"][i] - c["at"][i], c["low"][j] - c["at"][j])
        place = rest * (t.denominator + t.numerator) >= both * t.numerator
        apart = np.bitwise_count(c["b1"][i] ^ c["b1"][j]).astype(np.int64) + np.bitwise_count(c["b2"][i] ^ c["b2"][j])
        return length & (run | (place & (apart * over[1] <= both * over[0])))

    def unsure(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of sets so large that 128 bits of parity say little."""
        return (c["low"][i] + c["low"][j]) * over[0] > 36 * over[1]

    def edges(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forest edges, and pairs that are still to be looked at."""
        w, found, pairs = c["shingle"], [], []
        starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        sizes = np.diff(np.r_[starts, len(w)])
        group = np.repeat(np.arange(len(starts)), sizes)
        few = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= FEW))
        for gap in range(1, FEW):  # all pairs of small groups, by their distance
            few = few[few + gap < len(w)]
            few = few[group[few] == group[few + gap]]
            if not len(few):
                break
            i = few[passed(c, few, few + gap)]
            more = unsure(c, i, i + gap)
            found.append((c["doc_id"][i[~more]], c["doc_id"][i[~more] + gap]))
            if more.any():
                i = i[more]
                both = np.stack([c["doc_id"][i], c["doc_id"][i + gap]])
                pairs.append(np.stack([both.min(0), both.max(0)]))
        for s, m in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            for a in range(s, s + m, 512):
                rows = np.arange(a, min(a + 512, s + m))
                for b in range(a, s + m, 512):
                    if c["low"][b] * t.numerator > c["high"][rows].max() * t.denominator:
                        break
                    i, j = (x.ravel() for x in np.meshgrid(rows, np.arange(b, min(b + 512, s + m)), indexing="ij"))
                    i, j = i[i < j], j[i < j]
                    ok = passed(c, i, j)
                    found.append(forest(c["doc_id"][i[ok]], c["doc_id"][j[ok]]))
        none = np.empty(0, np.int64)
        a, b = forest(np.concatenate([none, *[x[0] for x in found]]), np.concatenate([none, *[x[1] for x in found]]))
        p = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
        return np.r_[a, p[0]], np.r_[b, p[1]], np.repeat([False, True], [len(a), p.shape[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        chain = False

        def chained(table: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
            """Edges between neighbours in length, and the last row, which reaches as far as any before it."""
            doc, low, high = (table.column(k).to_numpy().astype(np.int64) for k in ("doc_id", "low", "high"))
            reach = np.maximum.accumulate(high)
            near = np.flatnonzero(low[1:] * t.numerator <= reach[:-1] * t.denominator)
            end = table.slice(len(doc) - 1).set_column(_NAMES.index("high"), "high", pa.array(reach[-1:].astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(doc[near + 1]), pa.array(doc[near]), pa.array(np.zeros(len(near), bool))], ["a", "b", "look"]), end

        def done(table: pa.Table) -> pa.RecordBatch:
            c = {k: table.column(k).to_numpy() for k in _NAMES}
            c |= {k: c[k].astype(np.int64) for k in ("low", "high", "at")} | {k: np.ascontiguousarray(c[k]).view(np.uint64) for k in ("b1", "b2")}
            return pa.RecordBatch.from_arrays([pa.array(x) for x in edges(c)], ["a", "b", "look"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([left, table]) if left is not None else table
            w = table.column("shingle").to_numpy()
            last = int(np.searchsorted(w, w[-1]))  # a shingle's rows may go on in the next batch
            if chain:  # the shingle whose rows are being connected goes on
                m = int(np.searchsorted(w, w[0], "right"))
                found, end = chained(table.slice(0, m))
                yield found
                if m == len(w):
                    left = end
                    continue
                table, last, chain = table.slice(m), last - m, False
            elif last == 0 and len(w) > MOST_MEETING:
                # More rows of one shingle than are compared in pairs: connect neighbours in length, which can only make a group larger.
                found, left = chained(table)
                yield found
                chain = True
                continue
            if last:
                yield done(table.slice(0, last))
            left = table.slice(last)
        if left is not None and not chain:
            yield done(left)

    return run


#: Entries of a shingle up to which pairs of large sets are looked at one by one; more are connected by what passes the tests.
FEW = 256
#: Rows of one shingle that a task compares in pairs (by blocks of 512); tasks send at most a few hundred each.
MOST_MEETING = 1 << 15


# --- the join within a group -------------------------------------------------


class Trie:
    """Whole sets in the global order, in a prefix tree whose edges hold up to EDGE ids.

    Sets are sorted, so the sets at or below a node are a range of places; a
    node has that range, the ids of its edge and the least and greatest size of
    its sets. Children of a node stand next to each other.
    """

    EDGE = 32

    def __init__(self, sets: list[np.ndarray]):
        """sets: ascending arrays of ranks, all different."""
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        sets = [sets[i] for i in self.order]
        sizes = np.array([len(s) for s in sets], np.int64)
        # How many ids each set shares with the one before it.
        shared = [0] * len(sets)
        for k in range(1, len(sets)):
            x, y = sets[k - 1], sets[k]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            shared[k] = int(differ[0]) if len(differ) else m
        low, high, depth, edges, first, least, most = [0], [len(sets)], [0], [np.empty(0, np.int64)], [], [int(sizes.min())], [int(sizes.max())]
        at = 0
        while at < len(low):
            a, z, d = low[at], high[at], depth[at]
            first.append(len(low))
            # Sets that end here come first in the range and make no child; the others part where neighbours share no more than d ids.
            k = a
            while k < z and sizes[k] == d:
                k += 1
            while k < z:
                stop = k + 1
                while stop < z and shared[stop] > d:
                    stop += 1
                common = min([int(sizes[k]), d + self.EDGE, *shared[k + 1 : stop]])
                low.append(k)
                high.append(stop)
                depth.append(common)
                edges.append(sets[k][d:common].astype(np.int64))
                least.append(int(sizes[k:stop].min()))
                most.append(int(sizes[k:stop].max()))
                k = stop
            at += 1
        first.append(len(low))
        self.first, self.low, self.high, self.depth = np.array(first), np.array(low), np.array(high), np.array(depth)
        self.least, self.most = np.array(least), np.array(most)
        length = np.array([len(e) for e in edges])
        self.start, self.length, self.ids = np.cumsum(length) - length, length, np.concatenate(edges)
        self.sets, self.sizes = sets, sizes


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranges one after another."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def connect(sets: list[np.ndarray], t: Fraction, sketch: np.ndarray | None = None) -> list[int]:
    """For each set (distinct arrays of 64-bit ids) the least index it is connected with.

    The trie has the commonest ids first, the global order from its other end:
    sets that are alike share long beginnings, and an overlap with one is
    counted once for all sets below it. A subtree is left when the ids that
    remain on both sides can't make the overlap large enough, or when all of
    its sets are connected with the walking one already.
    """
    m = len(sets)
    if m == 1:
        return [0]
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(flat) if sketch is None else sketch[(ids & np.uint64(SKETCH - 1)).astype(np.int64)]
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((~ids, -often.astype(np.int64)))] = np.arange(len(ids))
    trie = Trie([np.sort(x) for x in np.split(rank[flat], np.cumsum([len(s) for s in sets])[:-1])])
    num, den = t.numerator, t.denominator
    label = np.arange(m)  # by place in the trie
    run = label + 1  # where the run of equal labels that holds a place ends
    has = np.zeros(len(ids), np.int64)
    for x in range(m):
        mine, n = trie.sets[x], trie.sizes[x]
        has[mine] = 1
        hits: list[np.ndarray] = []
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            # Sets that end at these nodes have met all of their ids.
            children = trie.first[nodes + 1] - trie.first[nodes]
            low, depth = trie.low[nodes], trie.depth[nodes]
            ends = np.flatnonzero((trie.sizes[low] == depth) & (overlap * (num + den) >= num * (n + depth)))
            if len(ends):
                hits.append(low[ends])
            overlap = np.repeat(overlap, children)
            nodes = _ranges(trie.first[nodes], children)
            if not len(nodes):
                break
            other = (label[trie.low[nodes]] != label[x]) | (run[trie.low[nodes]] < trie.high[nodes])
            nodes, overlap = nodes[other], overlap[other]
            if not len(nodes):
                break
            length = trie.length[nodes]
            met = has[trie.ids[_ranges(trie.start[nodes], length)]]
            overlap = overlap + np.add.reduceat(met, np.cumsum(length) - length)
            # Left of mine: the ids after the edge's last. Of a set of some size there are size - depth left; the best size uses up just what is left of mine.
            left = n - np.searchsorted(mine, trie.ids[trie.start[nodes] + length - 1], "right")
            depth = trie.depth[nodes]
            best = np.clip(depth + left, trie.least[nodes], trie.most[nodes])
            most = overlap + np.minimum(left, best - depth)
            going = most * (num + den) >= num * (n + best)
            nodes, overlap = nodes[going], overlap[going]
        has[mine] = 0
        known = np.unique(label[np.concatenate(hits)]) if hits else ()
        known = np.union1d(known, label[x : x + 1]) if len(known) else known
        if len(known) > 1:
            label[np.isin(label, known)] = known[0]
            changes = np.flatnonzero(np.r_[label[1:] != label[:-1], True]) + 1
            run = np.repeat(changes, np.diff(np.r_[0, changes]))
    # From places in the trie to the sets as they were given.
    order = np.array(trie.order)
    least = np.full(m, m)
    np.minimum.at(least, label, order)
    out = np.empty(m, np.int64)
    out[order] = least[label]
    return out.tolist()


def _join(k: int, t: Fraction, sketch):
    """Rows of one cell (a group, or two of its blocks): doc_id and text. Gives each document with the least doc_id that it is connected with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain, shingles = zstandard.ZstdDecompressor(), Shingles(k)
        doc_ids: list[int] = []
        sets: dict[bytes, int] = {}
        member: list[int] = []
        kept: list[np.ndarray] = []
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist()):
                s = shingles(plain.decompress(raw))
                i = sets.setdefault(s.tobytes(), len(kept))
                if i == len(kept):
                    kept.append(s)
                doc_ids.append(doc_id)
                member.append(i)
        roots = np.array(connect(kept, t, sketch.value))[member]
        # Rows that share a doc_id are one node, so roots may meet once more.
        a, b = forest(np.array(doc_ids, np.int64), -1 - roots.astype(np.int64))
        least: dict[int, int] = {}
        group = dict(zip(a.tolist(), b.tolist()))
        for d in doc_ids:
            g = group[d]
            least[g] = min(least.get(g, d), d)
        docs = np.unique(doc_ids)
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array([least[group[d]] for d in docs.tolist()], pa.int64())], ["doc_id", "root"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    small = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([small.compress(b) for b in texts(batch)], pa.binary())], ["doc_id", "packed"])


def jaccard_components(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), most_ids: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), a row for each document."""
    spark, t = docs.sparkSession, Fraction(*threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = staged(docs.mapInArrow(_sets(k), _SETS), "sets")
    sketch = spark.sparkContext.broadcast(_sketch(sets.filter("slice IS NOT NULL")))
    rows = sets.filter("slice IS NULL")
    some = rows.filter("n > 0 AND doc_id IS NOT NULL")
    # One document stands for all with its set; map tasks merge copies before the shuffle.
    classes = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    classes = staged(classes, "classes")
    packed = docs.filter("doc_id IS NOT NULL").mapInArrow(_packed, "doc_id long, packed binary")

    entries = staged(packed.join(classes.select("doc_id", "s1", "s2"), "doc_id").mapInArrow(_entries(k, t, sketch), _ENTRIES), "entries")
    at_once = entries.filter("shingle IS NULL").select(F.col("doc_id").alias("a"), F.col("b1").alias("b"))
    met = entries.filter("shingle IS NOT NULL").repartition("shingle").sortWithinPartitions("shingle", "low").mapInArrow(_meet(t), "a long, b long, look boolean")
    met = staged(met, "met")
    # Pairs of large sets: their signatures are joined, a row for each pair.
    pairs = met.filter("look").select("a", "b").distinct()
    own = lambda x, i: classes.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{i}"), F.col("signature").alias(f"sig{i}"))
    alike = pairs.join(own("a", 1), "a").join(own("b", 2), "b").mapInArrow(_alike(t), "a long, b long")
    groups = components(at_once.union(met.filter("NOT look").select("a", "b")).union(alike), "a", "b")
    grouped = staged(groups.select("node", "root").union(groups.select(F.col("root").alias("node"), "root").distinct()), "groups")

    # Blocks of a group, from its shingles; only the largest groups have several. Members look up their number by a counted broadcast, not by a join that brings a group together.
    in_group = grouped.join(classes.select(F.col("doc_id").alias("node"), "n"), "node")
    blocks = staged(in_group.groupBy("root").agg(F.ceil(F.sum("n") / most_ids).cast("int").alias("blocks")).filter("blocks > 1"), "blocks")
    placed = grouped.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = staged(placed.select("node", "root", "blocks", "block", other).select("node", F.col("blocks") > 1, F.concat_ws(":", "root", F.least("block", "other"), F.greatest("block", "other"))).toDF("node", "many", "cell"), "cells")
    held = packed.join(cells, F.col("doc_id") == F.col("node")).select("doc_id", "cell", "packed")
    joined = staged(_by_cell(held, _join(k, t, sketch)), "joined")
    # A group in one cell is done. Of the others, links meet across cells.
    links = joined.filter("doc_id <> root")
    many = cells.filter("many").select(F.col("node").alias("doc_id")).distinct()
    spread = components(links.join(many, "doc_id", "left_semi"), "doc_id", "root")
    roots = links.join(many, "doc_id", "left_anti").select(F.col("doc_id").alias("node"), "root").unionByName(spread)
    named = classes.select("doc_id", "s1", "s2", "copies").join(roots, F.col("doc_id") == F.col("node"), "left").select("s1", "s2", "copies", F.coalesce("root", "doc_id").alias("component_id"))
    return _labelled(rows.select("doc_id", "n", "s1", "s2"), _one_node(some, staged(named, "named")))


def _by_cell(rows: DataFrame, join) -> DataFrame:
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from join(batches)

    return rows.groupBy("cell").applyInArrow(lambda table: pa.Table.from_batches(list(one(iter(table.to_batches())))), "doc_id long, root long")


#: Sets of more copies than a share of 1 / MOST_HOT of all rows are joined by broadcast; there can't be more than that many.
MOST_HOT = 100_000


def _one_node(some: DataFrame, named: DataFrame) -> DataFrame:
    """Classes that share a doc_id are one node, so their components are one."""
    sets = F.struct("s1", "s2")
    used = staged(some.groupBy("doc_id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).filter("low <> high").select("doc_id"), "used")
    if used.isEmpty():
        return named
    apart = some.select("doc_id", "s1", "s2").join(used, "doc_id").distinct().join(named, ["s1", "s2"]).select("doc_id", "component_id").distinct()
    least = apart.groupBy("doc_id").agg(F.min("component_id").alias("least"))
    joined = components(apart.join(least, "doc_id").select("component_id", "least"), "component_id", "least")
    return named.join(joined, F.col("component_id") == F.col("node"), "left").select("s1", "s2", "copies", F.coalesce("root", "component_id").alias("component_id"))


def _labelled(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Every row with the component of its set."""
    some = rows.filter("n > 0 AND doc_id IS NOT NULL")
    result = lambda found, c: found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), c.alias("component_id"))
    # Sets with so many copies that their rows would fill a task are MOST_HOT at most, whatever the input; the others are joined by a shuffle.
    at_least = max(1000, rows.count() // MOST_HOT)
    hot = F.broadcast(named.filter(F.col("copies") > at_least).drop("copies"))
    rest = named.filter(F.col("copies") <= at_least).drop("copies")
    empty = rows.filter("n = 0 OR doc_id IS NULL")
    common = some.join(hot, ["s1", "s2"])
    others = some.join(hot, ["s1", "s2"], "left_anti").join(rest, ["s1", "s2"])
    return result(empty, F.col("doc_id")).unionByName(result(common, F.col("component_id"))).unionByName(result(others, F.col("component_id")))
