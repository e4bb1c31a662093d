"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Entries become whole numbers, so that sums and squared distances are exact. The
fit list holds each distinct vector once; its count and sums come from one pass,
its scatter from another, in which every vector is centred at the list's mean
before it is multiplied. What a task sends is a matrix of the dimensions; these
are added up in steps. Only the scatter of d x d numbers, which the corpus
does not enlarge, reaches the driver: its pivoted Cholesky factor times its
transpose is the scatter, and rotations from the right make the factor's columns
orthogonal without changing that product. Then the columns' squared norms are
the eigenvalues and the normalised columns the components, to high relative
accuracy also where eigenvalues are small.

Cases: rows whose vector is null, empty or holds null or non-finite entries have
no results, nor do those whose length is not the commonest (the longer of
equals); repeated vectors count once in the fit list and every row has results;
a null or repeated vec_id is like any other; entries beyond 2^34 count as 2^34;
components without variance (fewer distinct vectors than dimensions, a constant
dimension) are left out, so with one distinct vector, or none, there are no
rows; a deviation that no long holds is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Vectors that a task multiplies at once.
BLOCK = 4096
#: Matrices that meet in one place.
FEW = 16
#: Largest size of an entry.
LARGEST = 2.0**34
SHIFT = 1_000_000


def whole_vectors(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """vec_id, x: the vectors with finite entries, as longs floor(64 * entry) + SHIFT."""
    v = F.transform(F.col(f"`{column}`"), lambda c: c.cast("double"))
    rows = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), v.alias("_v")).filter("_v IS NOT NULL AND size(_v) > 0")
    finite = rows.filter(F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    bounded = lambda c: F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST))
    return finite.select("vec_id", F.transform("_v", lambda c: F.floor(bounded(c) * 64) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            yield _matrix(batch.slice(k, BLOCK), d)


def _summed(d: int):
    """A task's count and sums; these are whole numbers, in parts that no sum of parts overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for x in _blocks(batches, d):
            n += len(x)
            low += (x & 0xFFFFF).sum(0)
            high += (x >> 20).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([low.tolist()]), pa.array([high.tolist()])], ["n", "low", "high"])

    return run


class Centre:
    """The mean of the fit list: a whole number near it, and what is left, so that a difference keeps all its digits."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        near = [(2 * s + n) // (2 * n) for s in sums]
        self.near = np.array(near, np.int64)
        self.left = np.array([(s - n * m) / n for s, m in zip(sums, near)])

    def off(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.left

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 of each row, exact; None where a long does not hold it."""
        off = x - self.near
        rest = [s - self.n * int(m) for s, m in zip(self.sums, self.near)]  # n * x - S = n * off - rest
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * x.shape[1] < 2**63:
            return ((self.n * off - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        sums = [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in off]
        return [s if s < 2**63 else None for s in sums]


def _products(centre: Centre, turn: np.ndarray | None):
    """A task's sum of outer products of centred vectors, turned if asked, and the sum of the vectors."""
    d = len(centre.near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = None, None
        for x in _blocks(batches, d):
            c = centre.off(x) if turn is None else centre.off(x) @ turn
            total, sums = (c.T @ c, c.sum(0)) if total is None else (total + c.T @ c, sums + c.sum(0))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([sums.tobytes()])], ["total", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sums = None
    for batch in batches:
        for a, b in zip(batch.column("total").to_pylist(), batch.column("sums").to_pylist()):
            a, b = np.frombuffer(a), np.frombuffer(b)
            total, sums = (a, b) if total is None else (total + a, sums + b)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([sums.tobytes()])], ["total", "sums"])


def scatter(fit: DataFrame, centre: Centre, turn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of outer products and of vectors; tasks' matrices are added up side by side, in steps, before the last few meet."""
    schema = "total binary, sums binary"
    some = fit.select("x").mapInArrow(_products(centre, turn), schema)
    tasks = fit.rdd.getNumPartitions()
    while tasks > FEW:
        tasks = max(FEW, int(tasks**0.5))
        some = some.repartition(tasks).mapInArrow(_added, schema)
    rows = some.collect()
    total = sum(np.frombuffer(bytes(r["total"])) for r in rows)
    sums = sum(np.frombuffer(bytes(r["sums"])) for r in rows)
    return total.reshape(len(sums), -1), sums


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G of full column rank with G @ G.T = a, a positive semidefinite matrix: the rows of a lower triangle, put back in the matrix' order."""
    a = a.copy()
    d = len(a)
    diagonal = np.diag(a).copy()
    order, g = np.arange(d), np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(diagonal.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(diagonal[order[k:]]))
        if diagonal[order[p]] <= floor:
            return g[:, :k]
        order[[k, p]] = order[[p, k]]
        at, rest = order[k], order[k + 1 :]
        g[at, k] = diagonal[at] ** 0.5
        g[rest, k] = (a[rest, at] - g[rest, :k] @ g[at, :k]) / g[at, k]
        diagonal[rest] -= g[rest, k] ** 2
    return g


def jacobi(g: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of g @ g.T, falling, and unit eigenvectors: columns are rotated in pairs until all are orthogonal.

    The pairs of a round have no column in common and are rotated at once.
    """
    r = g.shape[1]
    g = np.ascontiguousarray(g.T)  # columns as rows
    if r % 2:
        g = np.vstack([g, np.zeros((1, g.shape[1]))])
    m = len(g)
    ring = np.arange(m)
    for _ in range(most):
        largest = 0.0
        for _ in range(max(0, m - 1)):
            p, q = ring[: m // 2], ring[: m // 2 - 1 : -1]
            x, y = g[p], g[q]
            a, b, c = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            scale = np.sqrt(a * b)
            turn = (np.abs(c) > 1e-15 * scale) & (scale > 0)
            if turn.any():
                largest = max(largest, float((np.abs(c[turn]) / scale[turn]).max()))
                x, y, c = x[turn], y[turn], c[turn]
                zeta = (b[turn] - a[turn]) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                sin = cos * t
                g[p[turn]] = cos[:, None] * x - sin[:, None] * y
                g[q[turn]] = sin[:, None] * x + cos[:, None] * y
            ring = np.r_[ring[0], ring[-1], ring[1:-1]]
        if largest < 1e-14:
            break
    norms = np.sqrt((g * g).sum(1))
    order = np.argsort(-norms, kind="stable")[:r]
    return norms[order] ** 2, (g[order] / norms[order][:, None]).T


_RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(centre: Centre, turn: np.ndarray, explained: np.ndarray, error: float):
    d, k = turn.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part, d)
                n = len(x)
                columns = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, centre.n)),
                    pa.array([v for v in centre.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array((centre.off(x) @ turn).ravel()),
                    pa.array(np.tile(explained, n)),
                    pa.array(np.full(n * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened(vectors: DataFrame, components: int = 16, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, column, id_column)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {_RESULT}"
    none = spark.createDataFrame([], schema)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return none
    d = lengths["d"]
    rows = rows.filter(F.size("x") == d)
    fit = staged(rows.select("x").distinct(), "fit")
    parts = fit.mapInArrow(_summed(d), "n long, low array<long>, high array<long>")
    exact = F.sum(F.col("low").cast("decimal(38,0)") + F.col("high").cast("decimal(38,0)") * F.lit(1 << 20))
    n = parts.agg(F.sum("n")).first()[0]
    each = parts.select(F.posexplode(F.arrays_zip("low", "high")).alias("i", "x")).select("i", "x.low", "x.high")
    centre = Centre(n, [int(r["s"]) for r in sorted(each.groupBy("i").agg(exact.alias("s")).collect(), key=lambda r: r["i"])])
    total, _ = scatter(fit, centre)
    values, axes = jacobi(pivoted_cholesky(total))
    good = int((values > d * np.finfo(float).eps * values.max(initial=0.0)).sum())
    k = min(components, good)
    if not k:
        return none
    turn = axes[:, :k] / np.sqrt(values[:k] / n)
    products, sums = scatter(fit, centre, turn)
    error = float(np.abs(products / n - np.outer(sums / n, sums / n) - np.eye(k)).max())
    explained = values[:k] / np.trace(total)
    return rows.mapInArrow(_whitened(centre, turn, explained, error), schema)
