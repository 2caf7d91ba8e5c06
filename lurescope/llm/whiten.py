"""Whitening of embeddings on a grid of whole numbers.

Method.  Spark computes the centred covariance: one pass for the sums per
dimension, a second one for the products of the centred vectors, each task
sending one partial matrix.  The d x d matrix (d is the vectors' length, never
the number of rows) is solved by the eigensolver below: Householder reflections
make it tridiagonal, bisection on Sturm counts brackets the leading eigenvalues,
inverse iteration finds their vectors, and vectors of close eigenvalues are
made orthogonal to each other between the iterations.  The components, d x 16
numbers, go back to the tasks in the closure and every row is projected.

Quantities.  Each entry ``c`` becomes ``x = floor(scale * c) + offset``, a whole
number, so that sums are exact: ``S`` per dimension, ``n`` the number of distinct
vectors (the fit list), ``n * x - S`` the centred vector times ``n``.  Centring
happens in whole numbers, before any multiplication.  The identity error is
measured, not assumed: a second centred covariance over the whitened fit list.

Results by case.  Dropped are rows whose vector is null or empty, or holds a null,
a NaN, an infinity or an entry whose ``x`` is beyond 2^62.  Vectors of different
lengths cannot share a covariance: the length that most rows have is taken (of
equally frequent ones the longest), the others are dropped.  Repeated vectors count
once in the fit and each row gets its own result, also for repeated ids.  Components
without variance (below 1e-12 of the largest eigenvalue) cannot be whitened and are
not returned; when all vectors are equal, or none is left, the result is empty.
Equal eigenvalues: any orthonormal basis of their space, the same for all rows.
A deviation beyond 2^63 - 1 is null.  Other columns are not read.

Scale.  Vectors are grouped once by value (combined in the map tasks, so a vector
that fills a third of the table is no hot task); partial matrices are summed by
row of the matrix in Spark, so the driver gets d rows of d numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import ship, stage

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Share of the largest eigenvalue below which a component has no variance.
FLAT = 1e-12
_FITS = float(1 << 62)


# --------------------------------------------------------------- eigensolver

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, off-diagonal and the reflections ``I - beta v v'`` that turn the
    symmetric ``a`` into tridiagonal form."""
    a = np.array(a, dtype=float)
    reflections = []
    for k in range(len(a) - 2):
        x = a[k + 1:, k]
        size = np.abs(x[1:]).max(initial=0.0)
        if size == 0.0:
            continue
        big = max(size, abs(x[0]))
        v = x / big
        norm = math.copysign(math.sqrt(v @ v), v[0])
        v[0] += norm
        beta = 2.0 / (v @ v)
        block = a[k + 1:, k + 1:]
        p = beta * (block @ v)
        w = p - (0.5 * beta * (p @ v)) * v
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0.0
        a[k + 1, k] = a[k, k + 1] = -norm * big
        reflections.append((k + 1, v, beta))
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflections


def count_below(d: np.ndarray, e2: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: for each ``x`` the number of eigenvalues below it, from the
    signs of the pivots of ``T - x I``."""
    q = d[0] - x
    below = (q < 0).astype(int)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - x - e2[i - 1] / q
        below += q < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, by bisection until the bracket is
    as narrow as the numbers allow."""
    n, most = len(d), min(most, len(d))
    reach = np.zeros(n)
    reach[:-1] += np.abs(e)
    reach[1:] += np.abs(e)
    size = max(np.abs(d - reach).max(), np.abs(d + reach).max(), np.finfo(float).tiny)
    tiny = np.finfo(float).eps ** 2 * size + np.finfo(float).tiny
    low = np.full(most, (d - reach).min() - 1e-12 * size)
    high = np.full(most, (d + reach).max() + 1e-12 * size)
    place = n - 1 - np.arange(most)  # eigenvalues below the wanted one
    for _ in range(200):
        middle = 0.5 * (low + high)
        if ((middle <= low) | (middle >= high)).all():
            break
        above = count_below(d, e * e, middle, tiny) <= place
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return 0.5 * (low + high)


def _factor(d: np.ndarray, e: np.ndarray, shift: float, tiny: float):
    """LU factors of ``T - shift I`` with row exchanges: three upper diagonals,
    multipliers and exchanges."""
    n = len(d)
    a, b, c = d - shift, np.append(e, 0.0), np.zeros(n)
    a, b = a.copy(), b.copy()
    factor, swap = np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        low = e[i]
        if abs(low) > abs(a[i]):
            swap[i] = True
            m = a[i] / low
            a[i], b[i], c[i], a[i + 1], b[i + 1] = (
                low, a[i + 1], b[i + 1], b[i] - m * a[i + 1], -m * b[i + 1])
        else:
            a[i] = a[i] if abs(a[i]) >= tiny else tiny
            m = low / a[i]
            a[i + 1] -= m * b[i]
        factor[i] = m
    a[-1] = a[-1] if abs(a[-1]) >= tiny else tiny
    a = np.where(np.abs(a) < tiny, tiny, a)
    return a, b, c, factor, swap


def _solve(lu, rhs: np.ndarray) -> np.ndarray:
    a, b, c, factor, swap = lu
    y = rhs.copy()
    n = len(y)
    for i in range(n - 1):
        if swap[i]:
            y[i], y[i + 1] = y[i + 1], y[i] - factor[i] * y[i + 1]
        else:
            y[i + 1] -= factor[i] * y[i]
    for i in range(n - 1, -1, -1):
        rest = (b[i] * y[i + 1] if i + 1 < n else 0.0) + (c[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = (y[i] - rest) / a[i]
        if abs(y[i]) > 1e150:  # only the direction counts
            y *= 1e-150
    return y / np.linalg.norm(y)


def tridiagonal_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of ``values`` (falling) by inverse iteration.  Vectors whose
    eigenvalues are closer than 1e-3 of the matrix's size form a cluster; within it
    each iterate is made orthogonal to the vectors before it."""
    n = len(d)
    size = max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    tiny = eps * size
    rng = np.random.default_rng(0)
    out, first, shift = np.zeros((n, len(values))), 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            first = k
        # equal shifts would repeat one direction: keep them apart by a few units
        shift = value if k == first or shift - value > 10 * tiny else shift - 10 * tiny
        lu = _factor(d, e, shift, tiny)
        z = rng.uniform(-1, 1, n)
        z /= np.linalg.norm(z)
        for _ in range(8):
            before = z
            z = _solve(lu, z)
            for _twice in range(2):
                for j in range(first, k):
                    z = z - (out[:, j] @ z) * out[:, j]
                z = z / np.linalg.norm(z)
            if min(np.abs(z - before).max(), np.abs(z + before).max()) < 8 * eps:
                break
        out[:, k] = z
    return out


def leading_eigenpairs(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of the symmetric ``a``, falling, and their unit
    vectors as columns."""
    if len(a) == 1:
        return a[:1, 0].astype(float), np.ones((1, 1))
    d, e, reflections = tridiagonal(a)
    values = leading_eigenvalues(d, e, most)
    vectors = tridiagonal_vectors(d, e, values)
    for start, v, beta in reversed(reflections):
        part = vectors[start:]
        part -= np.outer(v, beta * (v @ part))
    return values, vectors / np.linalg.norm(vectors, axis=0)


# ----------------------------------------------------------------- on Spark

def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _row_sums(column: str, dim: int, kind):
    """Per task one row: the sums per dimension, whole numbers as decimal text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(column), kind)
                if kind is np.int64 and np.abs(x).max() * float(len(x)) > 2.0 ** 62:
                    x = x.astype(object)
                total = [t + s for t, s in zip(total, x.sum(axis=0).tolist())]
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [[repr(t) for t in total]]},
                                             pa.schema([("n", pa.int64()), ("s", pa.list_(pa.string()))]))
    return run


def column_sums(rows: DataFrame, column: str, dim: int, exact: bool) -> tuple[int, list]:
    """Number of rows and sums per dimension: d rows reach the driver."""
    part = rows.select(column).mapInArrow(
        _row_sums(column, dim, np.int64 if exact else np.float64), "n bigint, s array<string>")
    kind = "decimal(38,0)" if exact else "double"
    sums = (part.select("n", F.posexplode("s").alias("i", "v")).groupBy("i")
            .agg(F.sum("n").alias("n"), F.sum(F.col("v").cast(kind)).alias("v")))
    got = {r["i"]: r for r in sums.collect()}
    if not got:
        return 0, []
    return got[0]["n"], [int(got[i]["v"]) if exact else got[i]["v"] for i in range(dim)]


def _products(column: str, centre):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                y = centre(batch.column(column))
                total = y.T @ y + (0.0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_pydict(
                {"i": np.arange(len(total), dtype=np.int32), "v": list(total)},
                pa.schema([("i", pa.int32()), ("v", pa.list_(pa.float64()))]))
    return run


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column("i").to_pylist(), _matrix(batch.column("v"), np.float64) if len(batch) else ()):
            held[i] = held[i] + v if i in held else v.copy()
    if held:
        yield pa.RecordBatch.from_pydict({"i": list(held), "v": list(held.values())}, pa.schema(
            [("i", pa.int32()), ("v", pa.list_(pa.float64()))]))


def centred_covariance(rows: DataFrame, column: str, n: int, dim: int, centre) -> np.ndarray:
    """Covariance with divisor ``n``; ``centre`` turns a column into the centred
    matrix.  Partial products are summed by matrix row in Spark."""
    part = rows.select(column).mapInArrow(_products(column, centre), "i int, v array<double>")
    whole = part.repartition("i").mapInArrow(_add_rows, "i int, v array<double>")
    out = np.zeros((dim, dim))
    for r in whole.collect():
        out[r["i"]] = r["v"]
    return (out + out.T) / (2.0 * n)


class Centre:
    """``n * x - S`` in whole numbers, as exact integers or divided by ``n``."""

    def __init__(self, n: int, sums: list):
        self.n, self.sums = n, sums

    def whole(self, column: pa.Array) -> np.ndarray:
        x = _matrix(column, np.int64)
        room = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums))
        if room >= 1 << 62:
            x = x.astype(object)
            return x * self.n - np.array(self.sums, dtype=object)
        return x * self.n - np.array(self.sums, dtype=np.int64)

    def __call__(self, column: pa.Array) -> np.ndarray:
        return self.whole(column).astype(float) / self.n


class Shift:
    """A column of doubles less its means."""

    def __init__(self, means: np.ndarray):
        self.means = means

    def __call__(self, column: pa.Array) -> np.ndarray:
        return _matrix(column, np.float64) - self.means


def _deviation(centred: np.ndarray) -> list:
    """Sum over dimensions of the squares, exact; null beyond a long."""
    if centred.dtype == object or float(np.abs(centred).max()) ** 2 * centred.shape[1] >= 2.0 ** 62:
        return [s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in centred.tolist()]
    return (centred * centred).sum(axis=1).tolist()


def _project(centre: Centre, weights: np.ndarray, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            whole = centre.whole(batch.column("x"))
            w = pa.array(list((whole.astype(float) / centre.n) @ weights), pa.list_(pa.float64()))
            cols = {"w": w}
            if keep_ids:
                cols = {"id": batch.column("id"), "deviation": pa.array(_deviation(whole), pa.int64())} | cols
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def grid(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """``(id, x)`` of the rows that are kept, staged."""
    raw = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = raw.filter(F.expr(f"""v IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL
        AND NOT isnan(c) AND abs(c) * {float(scale)!r}D < {_FITS!r}D)"""))
    x = whole.select("id", F.transform("v", lambda c: (
        F.floor(c * F.lit(float(scale))).cast("long") + F.lit(offset))).alias("x"))
    return stage(x, "whiten-grid")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           most: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """One row per kept vector: ``id, n, deviation, w`` (whitened coordinates, falling
    eigenvalues), ``explained`` (share of the trace, by component), ``identity_error``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = grid(vectors, id_col, vector_col, scale, offset)
    id_type = rows.schema["id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"id {id_type}, n bigint, deviation bigint, w array<double>, "
                                      "explained array<double>, identity_error double")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    common = lengths.orderBy(F.desc("c"), F.desc("d")).first()
    if common is None:
        return empty
    dim = common["d"]
    rows = rows.filter(F.size("x") == dim)
    fit = stage(rows.select("x").groupBy("x").agg(F.count(F.lit(1)).alias("c")).select("x"), "whiten-fit")
    n, sums = column_sums(fit, "x", dim, exact=True)
    centre = Centre(n, sums)
    cov = centred_covariance(fit, "x", n, dim, centre)
    trace = float(np.trace(cov))
    if not trace > 0.0:
        return empty
    values, vecs = leading_eigenpairs(cov, most)
    kept = values > FLAT * values[0]
    values, vecs = values[kept], vecs[:, kept]
    weights = vecs / np.sqrt(values)

    white = stage(fit.mapInArrow(_project(centre, weights, False), "w array<double>"), "whiten-white")
    _, wsums = column_sums(white, "w", len(values), exact=False)
    got = centred_covariance(white, "w", n, len(values), Shift(np.array(wsums) / n))
    error = float(np.abs(got - np.eye(len(values))).max())

    out = rows.mapInArrow(_project(centre, weights, True),
                          f"id {id_type}, deviation bigint, w array<double>")
    return out.select("id", F.lit(n).cast("long").alias("n"), "deviation", "w",
                      F.array(*[F.lit(float(v / trace)) for v in values]).alias("explained"),
                      F.lit(error).alias("identity_error"))
