"""Whitening of embeddings from a distributed covariance and an own symmetric eigensolver.

Three passes over the vectors, each a partial result per task that Spark adds up: number and sums of the
vectors, products of the centred vectors, and products of the whitened ones. Only the tables of sums and
of products come to the driver; their size is that of the vector's dimensions, never of the rows. The
driver turns the covariance into a tridiagonal matrix by Householder reflections, finds its leading
eigenvalues by bisection with Sturm counts and their vectors by inverse iteration, made orthogonal inside
clusters of close eigenvalues. The projection goes to all tasks as a broadcast of dimensions x components.

Every entry c of a vector becomes the whole number floor(64 c) + 1000000, so sums and deviations are exact.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped, as are rows of
another length than most vectors have (ties: the longer). Entries beyond 2^46 in size count as 2^46. Components whose
eigenvalue is below ``RANK`` of the largest are none: a constant table, or a single row, has no components
and so no output. Null ids and repeated rows pass row by row and all count; input columns other than the id and
the vector are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored

SCALE, SHIFT = 64.0, 1_000_000
#: Size to which scaled entries are cut, so that sums of a slice of rows fit 64 bits.
LARGEST = 2.0**52
#: Eigenvalues below this share of the largest are rounding, not variance.
RANK = 1e-11
#: Eigenvalues closer than this share of the matrix norm are made orthogonal to each other.
CLUSTER = 1e-3
SLICE = 1000


# -- the symmetric eigenproblem ---------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal and off-diagonal of Q'AQ, and the Householder vectors that make up Q."""
    a = np.array(matrix, float)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        below = np.linalg.norm(v[1:])
        if below == 0:
            continue
        v[0] += np.copysign(np.hypot(v[0], below), v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        head = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
        a[k + 1 :, k] = head
        a[k, k + 1 :] = head
        reflectors.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each value of ``at``."""
    tiny = np.finfo(float).tiny ** 0.5 * max(1.0, float(np.abs(e).max(initial=0)))
    count, q = np.zeros(len(at), int), None
    for i in range(len(d)):
        q = d[i] - at - (0 if q is None else e[i - 1] ** 2 / q)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues in falling order, by bisection until the interval can't be halved."""
    n = len(d)
    side = np.zeros(n)
    side[:-1] += np.abs(e)
    side[1:] += np.abs(e)
    low = np.full(k, (d - side).min())
    high = np.full(k, (d + side).max())
    margin = np.finfo(float).eps * max(abs(low[0]), abs(high[0])) * n
    low -= margin
    high += margin
    wanted = n - 1 - np.arange(k)  # this many eigenvalues lie below the one sought
    while True:
        middle = (low + high) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        over = sturm_counts(d, e, middle) > wanted
        high = np.where(open_ & over, middle, high)
        low = np.where(open_ & ~over, middle, low)


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; pivots of zero become ``tiny``."""
    n = len(d)
    main, upper, second = d - shift, np.append(e, 0.0), np.zeros(n)
    x = b.astype(float).copy()
    for i in range(n - 1):
        low = e[i]
        if abs(low) > abs(main[i]):
            main[i], low = low, main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if main[i] == 0:
            main[i] = tiny
        factor = low / main[i]
        main[i + 1] -= factor * upper[i]
        upper[i + 1] -= factor * second[i]
        x[i + 1] -= factor * x[i]
    if main[n - 1] == 0:
        main[n - 1] = tiny
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= upper[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= second[i] * x[i + 2]
        x[i] /= main[i]
        big = np.abs(x[i:]).max()
        if big > 1e150:  # only the direction counts
            x /= big
    return x


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns, for eigenvalues in falling order."""
    n = len(d)
    norm = max(float(np.abs(d).max(initial=0)), float(np.abs(e).max(initial=0)), 1e-280)
    eps = np.finfo(float).eps
    random = np.random.default_rng(0)
    out = np.zeros((n, len(values)))
    start, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            start = j
        # Equal eigenvalues get slightly different shifts, so that their solutions differ.
        shift = min(value, shift - 4 * eps * norm) if j > start else value
        x = random.standard_normal(n)
        for _ in range(5):
            x = solve_shifted(d, e, shift, x / np.linalg.norm(x), eps * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, start:j] @ (out[:, start:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix and their unit vectors as columns.

    A vector's sign is such that its largest entry is positive.
    """
    if len(matrix) == 1:
        return matrix[0, :1].copy(), np.ones((1, 1))
    d, e, reflectors = tridiagonal(matrix)
    values = leading_eigenvalues(d, e, k)
    vectors = eigenvectors(d, e, values)
    for at, v in reversed(reflectors):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    vectors /= np.linalg.norm(vectors, axis=0)
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)


# -- vectors in Arrow batches -----------------------------------------------------------------------


def whole_numbers(column: pa.Array, dims: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their scaled vectors) of a list column; one pair per length, or for one length only."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null entries are NaN
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths) if dims is None else [dims]:
        rows = np.flatnonzero(lengths == size)
        if size == 0 or len(rows) == 0:
            continue
        c = flat[starts[rows, None] + np.arange(size)]
        fine = np.isfinite(c).all(1)
        with np.errstate(over="ignore"):
            x = np.floor(np.clip(c[fine] * SCALE, -LARGEST, LARGEST)).astype(np.int64) + SHIFT
        if fine.any():
            yield rows[fine], x


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


@dataclass(frozen=True)
class Whitening:
    """Exact sums of the fit list and the leading components of its covariance."""

    n: int
    sums: tuple[int, ...]
    spread: int  # largest difference of two entries of one dimension
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist() if self.trace > 0 else []

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the whole part is subtracted exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (x - whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - sums)^2, exact at any size."""
        small = (self.n * self.spread) ** 2 * len(self.sums) < 2**63 and max(map(abs, self.sums), default=0) < 2**62
        kind = np.int64 if small else object
        d = self.n * x.astype(kind) - np.array(self.sums, kind)
        return (d * d).sum(1).tolist()


def products(df: DataFrame, dims: int, width: int, shape: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors x of shape(x)' shape(x), a table of width x width, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in slices(batches):
            for _, x in whole_numbers(batch.column(0), dims):
                part = shape(x)
                total += part.T @ part
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"]
        )

    out = np.zeros((width, width))
    for i, j, v in df.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).toLocalIterator():
        out[i, j] = out[j, i] = v
    return out


def fit(df: DataFrame, vector: str = "embedding", k: int = 32) -> Whitening:
    """Leading ``k`` components of the covariance (divisor n) of all usable vectors."""
    slim = df.select(F.col(vector).cast("array<double>").alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in slices(batches):
            for _, x in whole_numbers(batch.column(0), None):
                size = x.shape[1]
                n, total, low, high = found.get(size, (0, 0, x[0], x[0]))
                found[size] = [
                    n + len(x),
                    total + x.sum(0).astype(object),
                    np.minimum(low, x.min(0)),
                    np.maximum(high, x.max(0)),
                ]
        for size, (n, total, low, high) in found.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([size] * size, pa.int32()),
                    pa.array(range(size), pa.int32()),
                    pa.array([n] * size, pa.int64()),
                    pa.array([str(t) for t in total], pa.string()),
                    pa.array(low),
                    pa.array(high),
                ],
                ["size", "i", "n", "total", "low", "high"],
            )

    parts = slim.mapInArrow(sums, "size int, i int, n bigint, total string, low bigint, high bigint")
    table = stored(
        parts.groupBy("size", "i").agg(
            F.sum("n").alias("n"),
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        ),
        "vector-sums",
    )
    most = table.filter("i = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return Whitening(0, (), 0, np.zeros(0), np.zeros((0, 0)), 0.0)
    found = table.filter(F.col("size") == most["size"]).orderBy("i").collect()
    n, dims = most["n"], most["size"]
    totals = tuple(int(r["total"]) for r in found)
    spread = max(r["high"] - r["low"] for r in found)
    base = Whitening(n, totals, spread, np.zeros(0), np.zeros((dims, 0)), 0.0)
    covariance = products(slim, dims, dims, base.centred) / n
    values, vectors = leading_components(covariance, min(k, dims))
    kept = (values > RANK * values[0]) & (values > 0)
    return Whitening(n, totals, spread, values[kept], vectors[:, kept], float(np.trace(covariance)))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, over all rows; 0 without components.

    The whitened mean is zero by construction, as vectors are centred before they are projected.
    """
    k = len(model.values)
    if k == 0:
        return 0.0
    sent = df.sparkSession.sparkContext.broadcast(model)
    slim = df.select(F.col(vector).cast("array<double>").alias("v"))
    got = products(slim, len(model.sums), k, lambda x: sent.value.whitened(x)) / model.n
    return float(np.abs(got - np.eye(k)).max())


def project(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation decimal(38,0), whitened array) of every usable row."""
    slim = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = slim.schema["id"].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(model)
    dims, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for rows, x in whole_numbers(batch.column(1), dims):
                w = sent.value.whitened(x)
                deviations = pa.array([str(v) for v in sent.value.deviations(x)], pa.string())
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), deviations, lists], ["id", "deviation", "whitened"]
                )

    out = slim.mapInArrow(run, f"id {kind}, deviation string, whitened array<double>")
    return out.select(F.col("id").alias(key), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 32) -> DataFrame:
    """One row per usable vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit(df, vector, k)
    error = identity_error(df, model, vector)
    explained = F.array(*map(F.lit, model.explained)) if model.explained else F.array().cast("array<double>")
    return project(df, model, key, vector).select(
        key, "deviation", F.posexplode("whitened").alias("_at", "whitened")
    ).select(
        key,
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
