"""Whitening of embeddings: leading principal axes by slicing the covariance's spectrum."""

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table
from docketry.llm.vectors import matrix, products, usable

EPS = float(np.finfo(np.float64).eps)
#: Bunch and Kaufman's bound on the growth of a pivot step.
ALPHA = (1 + 17**0.5) / 8
#: Eigenvalues nearer than this share of the matrix's norm are worked out as one group.
CLOSE = 1e-9


def positive_inertia(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: the positive ones of D in its pivoted LDLᵀ, whose blocks are 1 x 1 or 2 x 2."""
    a, above = np.array(a, np.float64), 0
    none = EPS * EPS * np.abs(a).max(initial=0)
    while (n := len(a)) > 0:
        size = 1
        if n > 1:
            r = 1 + int(np.argmax(np.abs(a[1:, 0])))
            most = abs(a[r, 0])
            if most > none and abs(a[0, 0]) < ALPHA * most:
                row = np.abs(a[r])
                row[r] = 0
                other = row.max()
                if abs(a[0, 0]) * other >= ALPHA * most * most:
                    pass
                elif abs(a[r, r]) >= ALPHA * other:
                    a[[0, r]] = a[[r, 0]]
                    a[:, [0, r]] = a[:, [r, 0]]
                else:
                    size = 2
                    if r != 1:
                        a[[1, r]] = a[[r, 1]]
                        a[:, [1, r]] = a[:, [r, 1]]
        if size == 1:
            pivot, column = a[0, 0], a[1:, 0].copy()
            above += pivot > 0
            a = a[1:, 1:]
            if abs(pivot) > none:
                a = a - np.sign(pivot) * np.outer(scaled := column / abs(pivot) ** 0.5, scaled)
        else:
            block, columns = a[:2, :2].copy(), a[2:, :2].copy()
            above += 1  # such a block's determinant is negative
            a = a[2:, 2:] - columns @ np.linalg.solve((block + block.T) / 2, columns.T)
            a = (a + a.T) / 2
    return int(above)


class Spectrum:
    """Counts of eigenvalues above shifts, each worked out once."""

    def __init__(self, a: np.ndarray):
        self.a, self.known = a, {}
        self.norm = float(np.abs(a).sum(axis=1).max(initial=0))

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = positive_inertia(self.a - shift * np.eye(len(self.a)))
        return self.known[shift]

    def solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        while True:
            try:
                y = np.linalg.solve(self.a - shift * np.eye(len(self.a)), x)
                if np.isfinite(y).all():
                    return y
            except np.linalg.LinAlgError:
                pass
            shift += EPS * max(abs(shift), self.norm)


def _rayleigh(s: Spectrum, lo: float, hi: float) -> tuple[float, np.ndarray] | None:
    """The eigenpair that Rayleigh quotient iteration finds from the middle of an interval; None if it ends outside."""
    x = np.random.default_rng(len(s.a)).standard_normal(len(s.a))
    shift, best = (lo + hi) / 2, None
    for step in range(40):
        x = s.solve(shift, x)
        x /= np.linalg.norm(x)
        value = float(x @ s.a @ x)
        off = float(np.linalg.norm(s.a @ x - value * x))
        if step and not lo < value <= hi:
            return None
        if best is not None and off >= best[0]:
            break
        best = (off, value, x)
        if off <= EPS * s.norm:
            break
        if step:  # one step of the fixed shift first, which leads to the interval's own vector
            shift = value
    off, value, x = best
    return (value, x) if lo < value <= hi and off <= 64 * EPS * s.norm * len(s.a) ** 0.5 else None


def _group(s: Spectrum, shift: float, size: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs of `size` values that lie close about a shift: their space by inverse iteration, then its own slices."""
    x = np.random.default_rng(len(s.a)).standard_normal((len(s.a), size))
    for _ in range(100):
        x = s.solve(shift, x)
        x, _ = np.linalg.qr(x - before @ (before.T @ x))
        image = s.a @ x - shift * x
        inner = x.T @ image
        if np.abs(image - x @ inner).max() <= 4 * EPS * s.norm:
            break
    middle = np.trace(inner) / size
    inner = (inner + inner.T) / 2 - middle * np.eye(size)
    if size == 1 or np.abs(inner).max() <= 64 * EPS * s.norm:
        values, turn = np.diag(inner), np.eye(size)
    else:
        values, turn = leading(inner, size)
    order = np.argsort(-values, kind="stable")
    return values[order] + middle + shift, x @ turn[:, order]


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Counts of eigenvalues above shifts halve an interval until it holds the next eigenvalue alone. Rayleigh quotient
    iteration starts in it; where it leaves the interval, halving goes on. Values too close to be parted are
    taken as a group. Counts on both sides of what was found certify its number.
    """
    k, d = min(k, len(a)), len(a)
    if not (norm := float(np.abs(a).max(initial=0))):
        return np.zeros(k), np.eye(d)[:, :k]
    unit = 2.0 ** np.floor(np.log2(norm))
    a = a / unit
    s = Spectrum(a)
    values, vectors = np.empty(0), np.empty((d, 0))
    least = 4 * d * EPS * s.norm
    bottom, hi = -s.norm - least, s.norm + least
    while (j := len(values)) < k:
        lo, found = bottom, None
        while True:
            while s.above(lo) - j > 1 and hi - lo > CLOSE * s.norm:
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if s.above(mid) > j else (lo, mid)
            size = s.above(lo) - j
            if hi - lo <= CLOSE * s.norm:
                found = _group(s, (lo + hi) / 2, size, vectors)
                break
            if pair := _rayleigh(s, lo, hi):
                found = np.array([pair[0]]), pair[1][:, None]
                break
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if s.above(mid) > j else (lo, mid)
        off = np.linalg.norm(a @ found[1] - found[1] * found[0], axis=0).max(initial=0)
        slack = max(2 * off, least)
        if s.above(found[0].max() + slack) > j or s.above(found[0].min() - slack) < j + size:
            raise ArithmeticError(f"eigenvalue {j + 1} could not be certified")
        values, vectors = np.concatenate([values, found[0]]), np.hstack([vectors, found[1]])
        hi = lo
    # Vectors of near values were worked out apart; mixing them by so little keeps their residuals.
    vectors, _ = np.linalg.qr(vectors[:, :k])
    return values[:k] * unit, vectors


def _summed(partial: DataFrame) -> dict[tuple[int, int], object]:
    """The sums of (i, j, value) rows by place: a row for each entry of a matrix, whatever the number of tasks."""
    return {(r.i, r.j): r.value for r in partial.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}


def _exact(i: np.ndarray, j: np.ndarray, values: list[int]) -> pa.RecordBatch:
    """Rows of integer sums, as decimals."""
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["i", "j", "value"])


EXACT = "i int, j int, value decimal(38,0)"


def covariance(rows: DataFrame, scale: float, offset: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of each dimension, and the covariance with divisor n, of the vectors floor(scale * component) + offset.

    The vectors are centred at the integers nearest to their means before they are multiplied, and sums are
    of integers, so the result is the correctly rounded one in whatever order tasks end. Each task sends one matrix.
    """
    # A count, and the longest vector.
    n, d = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if n == 0 or d == 0:
        return n, [0] * d, np.zeros((d, d))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            total = [t + int(s) for t, s in zip(total, _columns(matrix(batch.column(0), d, scale, offset)), strict=True)]
        yield _exact(np.arange(d), np.full(d, -1), total)

    summed = _summed(rows.select("vector").mapInArrow(sums, EXACT))
    s = [int(summed[i, -1]) for i in range(d)]
    centre = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    i, j = np.triu_indices(d)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            y = (matrix(batch.column(0), d, scale, offset) - centre).T
            for at in range(0, y.shape[1], 4096):
                total = total + products(y[:, at : at + 4096], y[:, at : at + 4096]).astype(object)
        yield _exact(i, j, total[i, j].tolist())

    summed = _summed(rows.select("vector").mapInArrow(squares, EXACT))
    rest = [v - n * int(c) for v, c in zip(s, centre.tolist(), strict=True)]
    v = np.zeros((d, d))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        v[a, b] = v[b, a] = (n * int(summed[a, b]) - rest[a] * rest[b]) / (n * n)
    return n, s, v


def _columns(x: np.ndarray) -> np.ndarray:
    """The sum of each column; in Python's integers where 64 bits could overflow."""
    return x.sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) < 1 << 63 else x.astype(object).sum(axis=0)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """A row for each usable row and leading component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or an entry that isn't finite are left out; a shorter vector counts as
    one with zeros at its end; repeated rows and null ids are like any other; other columns are ignored; an empty table gives no rows. A component
    whose variance is zero to double precision is left out, so vectors that are all alike give no rows. deviation is the sum of (n x - S)²,
    exact, in decimals; entries beyond 64-bit integers end the query with an error. Four scans of the vectors and no shuffle of them; the driver and each task hold matrices of
    the dimension's square. A component's largest entry is positive.
    """
    rows = usable(df, id_col, vector_col)
    kind = df.schema[id_col].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, s, v = covariance(rows, scale, offset)
    d = len(s)
    values, axes = leading(v, components)
    live = values > 4 * d * EPS * np.abs(v).sum(axis=1).max(initial=0)
    values, axes = values[live], axes[:, live]
    if not len(values):
        return rows.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])
    explained, k = values / np.trace(v), len(values)
    whole = np.array([x // n for x in s], np.int64)
    part = np.array([(x % n) / n for x in s])
    turn = axes / np.sqrt(values)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - whole).astype(np.float64) - part) @ turn

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = projected(matrix(batch.column(0), d, scale, offset))
            first += w.sum(axis=0)
            second += w.T @ w
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i.ravel(), np.arange(k)]), pa.int32()), pa.array(np.concatenate([j.ravel(), np.full(k, -1)]), pa.int32()), pa.array(np.concatenate([second.ravel(), first]))], ["i", "j", "value"])

    summed = _summed(rows.select("vector").mapInArrow(moments, "i int, j int, value double"))
    mean = np.array([summed[i, -1] / n for i in range(k)])  # zero but for rounding: the rows are centred
    second = np.array([[summed[i, j] / n for j in range(k)] for i in range(k)])
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    total = np.array(s, object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d, scale, offset)
            t = n * x.astype(object) - total if n * int(np.abs(x).max(initial=0)) >= 1 << 62 else n * x - total.astype(np.int64)
            small = int(np.abs(t).max(initial=0)) ** 2 * d < 1 << 63
            far = [Decimal(int(f)) for f in ((t * t).sum(axis=1) if small else (t.astype(object) ** 2).sum(axis=1))]
            m = len(x)
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)), pa.array(far, pa.decimal128(38, 0)).take(again),
                 pa.array(projected(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, out).withColumnRenamed("id", id_col)


def op12_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it exceeds a long."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))
