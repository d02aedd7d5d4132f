"""Whitening of vectors by their leading principal components.

Tasks sum centred products of rows into one square matrix each, whose rows are then added
up by their number, so that no task or driver holds more than one matrix.  The driver turns
the covariance into a tridiagonal matrix by Householder reflections, halves intervals by
Sturm counts until they hold one eigenvalue to double precision, and finds components by
inverse iteration, kept at right angles inside a cluster.  Components are sent to all tasks, which
project their own rows.  The matrix has the square of a vector's length, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark.llm.common import read, stored

COMPONENTS = 8
#: Eigenvalues closer than this share of the matrix's norm are one cluster.
CLUSTER = 1e-3
#: Steps of inverse iteration, and rows taken together in a task.
STEPS, ROWS = 4, 4096
EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit Householder vectors (one for each column but two)."""
    a, n, turns = matrix.astype(float).copy(), len(matrix), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        v = x / size if size else x
        turns.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = 2.0 * (rest @ v)
        p -= (v @ p) * v
        rest -= np.outer(v, p) + np.outer(p, v)
        a[k + 1 :, k] -= 2.0 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues are less than each of ``at``."""
    least = EPS * max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), 1e-300)
    count, q = np.zeros(len(at), dtype=int), np.ones(len(at))
    for i, d in enumerate(diagonal):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection to the last bits."""
    n = len(diagonal)
    radius = np.abs(np.r_[0.0, off]) + np.abs(np.r_[off, 0.0])
    low, high = (diagonal - radius).min(), (diagonal + radius).max()
    pad = EPS * n * max(abs(low), abs(high), 1e-300)
    lo, hi = np.full(k, low - pad), np.full(k, high + pad)
    place = n - np.arange(k)  # the j-th largest has this many at or below it
    for _ in range(200):
        mid = (lo + hi) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            break
        under = below(diagonal, off, mid) >= place
        hi, lo = np.where(under, mid, hi), np.where(under, lo, mid)
    return (lo + hi) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(T - shift) x = right by elimination with exchange of neighbouring rows."""
    n = len(diagonal)
    least = EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), 1e-300)
    main, up, second, x = (diagonal - shift).copy(), np.r_[off, 0.0], np.zeros(n), right.copy()
    low = off.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(main[i]):
            main[i], low[i] = low[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            second[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(main[i]) < least:
            main[i] = least
        f = low[i] / main[i]
        main[i + 1] -= f * up[i]
        up[i + 1] -= f * second[i]
        x[i + 1] -= f * x[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= up[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= second[i] * x[i + 2]
        x[i] /= main[i]
        if abs(x[i]) > 1e150:  # only its direction counts
            x *= 1e-150
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns, at right angles to the earlier ones of their cluster."""
    n, rng = len(diagonal), np.random.default_rng(12)
    norm = max(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0), 1e-300)
    out, first = np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # equal eigenvalues must not give equal systems
        shift = value - (j - first) * 4 * EPS * norm
        x = rng.standard_normal(n)
        for _ in range(STEPS):
            x = _solved(diagonal, off, shift, x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
                x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    k = min(k, len(matrix))
    scale = np.abs(matrix).max(initial=0.0)
    if not scale:
        return np.zeros(k), np.eye(len(matrix), k)
    diagonal, off, turns = tridiagonal(matrix / scale)
    values = leading(diagonal, off, k)
    vectors = inverse_iteration(diagonal, off, values)
    for i in range(len(turns) - 1, -1, -1):
        part = vectors[i + 1 :]
        part -= 2.0 * np.outer(turns[i], turns[i] @ part)
    # clusters are told apart by a bound; what little two of them still share goes here
    for j in range(k):
        for _ in range(2):
            vectors[:, j] -= vectors[:, :j] @ (vectors[:, :j].T @ vectors[:, j])
        vectors[:, j] /= np.linalg.norm(vectors[:, j])
    return values * scale, vectors


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x): floor(1024 c) + 100000 for each entry c, as long.

    Rows go whose vector is null or empty or holds a null or non-finite entry, or one of 2 ** 40
    or more, of which a double keeps no such fraction.  So do vectors of another length than most
    rows have (the longer one, if two lengths are as frequent).
    """
    vec = F.col(vec_col).cast("array<double>")
    made = vectors.select(F.col(id_col).alias("id"), vec.alias("vec")).filter(
        "vec is not null and size(vec) > 0 and forall(vec, c -> c is not null and not isnan(c) and abs(c) < 1099511627776d)")
    rows = stored(made.select("id", F.expr("transform(vec, c -> floor(1024d * c) + 100000)").alias("x")), "scaled")
    lengths = rows.groupBy(F.size("x").alias("length")).count()
    common = lengths.agg(F.max_by("length", F.struct("count", "length"))).first()[0]
    return rows.filter(F.size("x") == F.lit(common))


def _matrices(batch: pa.RecordBatch, column: int, width: int) -> Iterator[np.ndarray]:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for at in range(0, len(values), ROWS):
        yield values[at : at + ROWS]


def products(rows: DataFrame, column: str, centre: np.ndarray) -> np.ndarray:
    """The matrix of sums of (x - centre) (x - centre)^T over all rows of an array column."""
    width = len(centre)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for x in _matrices(batch, 0, width):
                apart = x.astype(float) - centre
                total += apart.T @ apart
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["row", "sums"])

    sums = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)])
    parts = rows.select(column).mapInArrow(within, "row int, sums array<double>").groupBy("row").agg(sums.alias("sums"))
    out = np.zeros((width, width))
    for row, values in parts.collect():  # one square matrix, whatever the rows
        out[row] = values
    return (out + out.T) / 2


@dataclass(frozen=True)
class Whitening:
    """What a fit finds: ``n`` vectors, exact sums, eigenvalues, components as columns, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        """Nearest whole numbers, apart from what is left: their sum is the mean, unrounded."""
        return np.array([s // self.n for s in self.sums], dtype=float) + np.array([s % self.n for s in self.sums]) / self.n

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt(eigenvalue); 0 for a component that no vector moves along."""
        none = self.values <= max(self.trace, 0.0) * len(self.sums) * EPS * 8
        return np.where(none, 0.0, 1.0 / np.sqrt(np.where(none, 1.0, self.values)))


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Eigenvalues and components of the covariance (divisor n) of all rows of ``scaled``; None without any.

    Sums are exact.  Products are taken of x less the whole number nearest its mean, which keeps
    them exact sums of whole numbers below 2 ** 53; the fraction that the mean has over goes off afterwards.
    """
    first = rows.agg(F.first(F.size("x"))).first()[0]
    if first is None:
        return None
    sums = [F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")) for i in range(first)]
    n, *totals = rows.agg(F.count("*"), *sums).first()
    totals = [int(t) for t in totals]
    middle = [round(t / n) for t in totals]
    over = np.array([(t - m * n) / n for t, m in zip(totals, middle)])
    covariance = products(rows, "x", np.array(middle, dtype=float)) / n - np.outer(over, over)
    values, components = eigen(covariance, k)
    return Whitening(n, totals, np.maximum(values, 0.0), components, float(np.trace(covariance)))  # below 0 by rounding alone


def whitened(rows: DataFrame, found: Whitening) -> DataFrame:
    """(id, deviation, y): exact sum of (n x - S)^2 as long (null beyond one), and whitened values, an array."""
    n, width, scale = found.n, len(found.sums), found.scale
    whole, part = np.array([s // n for s in found.sums]), np.array([s % n for s in found.sums])
    project = found.components * scale
    mean_part = (part / n) @ project

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, y = [], []
            for x in _matrices(batch, 1, width):
                y.append((x - whole).astype(float) @ project - mean_part)
                far = int(np.abs(x - whole).max(initial=0)) + 1
                kind = np.int64 if (far * n) ** 2 * width < 1 << 62 else object
                apart = (x - whole).astype(kind) * n - part.astype(kind)
                deviation += [int(d) if int(d) < 1 << 63 else None for d in (apart * apart).sum(axis=1)]
            y = np.concatenate(y) if y else np.zeros((0, project.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation, pa.int64()), pa.array(list(y), pa.list_(pa.float64()))], ["id", "deviation", "y"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, y array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row (id, component, n, deviation, whitened, explained, identity_error) per vector and component.

    The fit takes all vectors that ``scaled`` keeps; each has ``k`` rows, or as many as it has
    entries.  A component without variance whitens to 0 and has no part in identity_error.  Repeated rows and ids, null ids
    too, give rows each.  Other columns are ignored.  A table without usable vectors gives none.
    """
    rows = scaled(vectors, id_col, vec_col)
    found = fit(rows, k)
    kind = rows.schema["id"].dataType.simpleString()
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    made = stored(whitened(rows, found), "whitened")
    used = found.scale > 0
    # values are whitened about their mean, which is 0 but for rounding
    width = len(found.values)
    mean = np.array(made.agg(*[F.avg(F.get("y", F.lit(i))) for i in range(width)]).first(), dtype=float)
    apart = products(made, "y", mean) / found.n - np.eye(width)
    error = float(np.abs(apart[np.ix_(used, used)]).max(initial=0.0))
    share = F.array(*[F.lit(float(v / found.trace) if found.trace > 0 else 0.0) for v in found.values])
    single = made.select(F.col("id").alias(id_col), "deviation", F.posexplode("y").alias("at", "whitened"))
    return single.select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
