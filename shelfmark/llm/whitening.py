"""Embedding whitening by incremental eigendecomposition.

1.  Entries become whole numbers, x = floor(64 * c) + 1000000, and the fit list holds each
    different x vector once.
2.  Every partition of the fit list keeps a spectrum: count, mean, eigenvalues and
    eigenvectors of its scatter matrix. A slice of rows is centred by its mean and turned by a QR
    step into as many rows as there are dimensions, of the same scatter; each of them is one
    rank-one update, and the distance of the means is one more. An update solves the secular
    equation 1 + sum u_i^2 / (l_i - m) = 0 between neighbouring old eigenvalues; directions with a zero
    u_i and repeated eigenvalues are deflated first. The new eigenvectors come from
    weights recomputed for the solved roots, which keeps them orthogonal.
3.  Two spectra are combined by rank-one updates of one with the scaled eigenvectors of the
    other, ``FAN`` at a time in tasks, until one is left.
4.  Rayleigh-Ritz: with its basis, all partitions add up the exactly centred, projected products of
    the fit list; the small eigenproblem of the sum turns the basis. A further pass measures
    the result (and turns it again if needed): it gives eigenvalues and the identity error.

Sums of x are exact whole numbers, and centring by S / n takes the whole part off before it becomes
a double, so large common parts of the entries cost no digits. What reaches the driver is the
sums, one spectrum and one matrix: numbers of dimensions and their square.

Definitions: vectors that are null, empty, of another length than most (of equally frequent lengths the
smaller counts), or that hold a null or non-finite entry take no part; zero vectors do. Rows without an id take
part and are returned. Copies, repeated ids and ties in no way differ: each row is returned with
its own projection. 64 * c is cut at 2 ** 46 either way. Components whose eigenvalue is zero up to rounding are not
returned, so a fit list of one vector gives no rows, nor does an empty table. A deviation beyond
64 bits is null. Columns other than the id and the vector are not read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialize

OFFSET, SCALE = 1_000_000, 64
COMPONENTS = 16
#: Rows that one QR step turns into rank-one updates.
SLICE = 4096
#: Spectra that one task combines.
FAN = 16
_LIMIT = 1 << 46
_EPS = np.finfo(float).eps


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x array<long>) of the rows that take part."""
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(vec.isNotNull() & ~bad & (F.size(vec) > 0))
    size = rows.groupBy(F.size("vec").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").first()
    limit = float(_LIMIT)
    cut = lambda c: F.greatest(F.least(c * float(SCALE), F.lit(limit)), F.lit(-limit))
    x = F.transform(vec, lambda c: F.floor(cut(c)).cast("long") + OFFSET)
    return rows.filter(F.size("vec") == (size["s"] if size else 0)).select("id", x.alias("x"))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches):
    for batch in batches:
        x = _matrix(batch.column("x")) if batch.num_rows else []
        for i in range(0, len(x), SLICE):
            yield x[i : i + SLICE]


# ------------------------------------------------------------ rank-one updates


def secular_roots(poles: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots m_i of 1 + sum u_j^2 / (poles_j - m), one above each pole, as (origin, offset).

    Poles ascend and differ, no u is zero. Root i is poles[origin[i]] + offset[i], with the
    nearer end of its interval as origin, so that differences to all poles keep their digits.
    Offsets are bisected on the bits of their doubles, which are ordered like their values.
    """
    n, weight = len(poles), u * u
    upper = np.append(poles[1:], poles[-1] + weight.sum())
    middle = poles + (upper - poles) / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        left = 1 + (weight / (poles - middle[:, None])).sum(1) >= 0  # the root is in the lower half
        origin = np.where(left | (np.arange(n) == n - 1), np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
        sign = np.where(origin == np.arange(n), 1.0, -1.0)
        gap = poles - poles[origin][:, None]
        far = np.append((upper - poles)[:-1] / 2, weight.sum())
        lo, hi = np.full(n, np.nextafter(0, 1)).view(np.int64), np.maximum(far, np.nextafter(0, 1)).view(np.int64)
        while (hi - lo > 1).any():
            mid = lo + (hi - lo) // 2
            value = 1 + (weight / (gap - (sign * mid.view(float))[:, None])).sum(1)
            # the function rises towards the upper pole
            beyond = np.where(sign > 0, value >= 0, value <= 0)
            hi, lo = np.where(beyond, mid, hi), np.where(beyond, lo, mid)
    return origin, sign * hi.view(float)


@dataclass
class Spectrum:
    """Count, mean and eigendecomposition of the scatter (sum of centred products) of some rows."""

    n: int
    mean: np.ndarray
    values: np.ndarray  # ascending
    basis: np.ndarray  # eigenvectors in columns

    @classmethod
    def of_none(cls, d: int):
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add_product(self, z: np.ndarray) -> None:
        """Adds z z^T to the scatter."""
        u = self.basis.T @ z
        size = max(self.values[-1], float(u @ u))
        if size == 0:
            return
        tiny = 8 * _EPS * size
        # repeated eigenvalues: turn their eigenvectors so that one of them carries all of u
        begin = np.flatnonzero(np.append(True, np.diff(self.values) > tiny))
        for a, b in zip(begin, np.append(begin[1:], len(u)), strict=True):
            if b - a > 1 and (norm := np.linalg.norm(u[a:b])) > 0:
                v = u[a:b].copy()
                v[-1] += np.copysign(norm, v[-1])
                v /= np.linalg.norm(v)
                self.basis[:, a:b] -= 2 * np.outer(self.basis[:, a:b] @ v, v)
                end = -np.copysign(norm, u[b - 1])
                u[a:b] = 0
                u[b - 1] = end
        live = np.flatnonzero(np.abs(u) * np.sqrt(size) > tiny)
        if not len(live):
            return
        poles, w = self.values[live], u[live]
        origin, offset = secular_roots(poles, w)
        # poles_j - root_i
        away = poles - poles[origin][:, None] - offset[:, None]
        # weights for which the computed roots are exact: |w_j|^2 = prod (root_i - p_j) / prod (p_i - p_j)
        gaps = poles[:, None] - poles
        np.fill_diagonal(gaps, 1)
        n = len(live)
        ratio = -away / np.where(np.eye(n, dtype=bool), 1, gaps)
        exact = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=0))), w)
        turn = exact / away
        turn /= np.linalg.norm(turn, axis=1)[:, None]
        self.basis[:, live] = self.basis[:, live] @ turn.T
        self.values[live] = poles[origin] + offset
        order = np.argsort(self.values, kind="stable")
        self.values, self.basis = self.values[order], self.basis[:, order]

    def add(self, other: "Spectrum") -> None:
        """Combines with the spectrum of other rows, by one rank-one update after another."""
        if not other.n:
            return
        step, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.add_product(np.sqrt(value) * vector)
        self.add_product(np.sqrt(self.n * other.n / n) * step)
        self.mean, self.n = self.mean + step * (other.n / n), n

    def add_rows(self, x: np.ndarray) -> None:
        """Centred rows; a slice of many becomes as few rows of the same scatter by QR."""
        mean = x.mean(0)
        centred = x - mean
        if len(centred) > centred.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        step, n = mean - self.mean, self.n + len(x)
        for z in centred:
            self.add_product(z)
        self.add_product(np.sqrt(self.n * len(x) / n) * step)
        self.mean, self.n = self.mean + step * (len(x) / n), n


_SPECTRUM = "part long, n long, mean binary, spread binary, basis binary"


def _packed(part: int, s: Spectrum) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int64()), pa.array([s.n], pa.int64())]
    columns += [pa.array([a.tobytes()], pa.binary()) for a in (s.mean, s.values, np.ascontiguousarray(s.basis))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "n", "mean", "spread", "basis"])


def _unpacked(row) -> Spectrum:
    mean, values, basis = (np.frombuffer(row[c], float).copy() for c in ("mean", "spread", "basis"))
    return Spectrum(row["n"], mean, values, basis.reshape(len(mean), -1))


def _partition_spectrum(batches):
    found = None
    for x in _slices(batches):
        found = found or Spectrum.of_none(x.shape[1])
        found.add_rows((x - OFFSET).astype(float))
    if found:
        yield _packed(TaskContext.get().partitionId(), found)


def _combined(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total = _unpacked(rows[0])
    for row in rows[1:]:
        total.add(_unpacked(row))
    return pa.Table.from_batches([_packed(rows[0]["part"] // FAN, total)])


def spectrum(fit: DataFrame) -> Spectrum | None:
    """Spectrum of all rows of ``fit`` (x), offset taken off; None without rows."""
    parts = materialize(fit.select("x").mapInArrow(_partition_spectrum, _SPECTRUM), "spectra")
    most = parts.agg(F.max("part")).first()[0]
    while most:
        # partition numbers are divided by FAN in each round, so that they end at 0
        parts = materialize(parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_combined, _SPECTRUM), "spectra")
        most //= FAN
    row = parts.first()
    return row and _unpacked(row)


# -------------------------------------------------------------- refinement


def _sums(batches):
    total = None
    for x in _slices(batches):
        # whole numbers of less than 48 bits: a slice adds up without overflow
        total = (0 if total is None else total) + x.sum(0).astype(object)
    if total is not None:
        total = pa.array([int(v) for v in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), total], names=["dim", "total"])


@dataclass
class Centre:
    """S / n as a whole and a fractional part: x - S / n = (x - whole) - rest / n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]):
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exactly."""
        x = x - self.whole
        if len(x) and x.shape[1] * (self.n * (int(np.abs(x).max()) + 1)) ** 2 < 1 << 63:
            return ((self.n * x - self.rest) ** 2).sum(1).tolist()
        exact = ((self.n * x.astype(object) - self.rest.astype(object)) ** 2).sum(1) if len(x) else []
        return [int(v) if v < 1 << 63 else None for v in exact]


def _products(centre: Centre, basis: np.ndarray):
    def run(batches):
        total = None
        for x in _slices(batches):
            y = centre.centred(x) @ basis
            total = (0 if total is None else total) + y.T @ y
        if total is not None:
            cells = pa.array(np.arange(total.size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], names=["cell", "total"])

    return run


def _covariance(fit: DataFrame, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """Covariance of the fit list in ``basis``; its cells are added up by Spark."""
    cells = fit.select("x").mapInArrow(_products(centre, basis), "cell int, total double")
    total = np.zeros(basis.shape[1] ** 2)
    for row in cells.groupBy("cell").agg(F.sum("total").alias("total")).collect():  # dimensions squared
        total[row["cell"]] = row["total"]
    return total.reshape(basis.shape[1], -1) / centre.n


@dataclass
class Whitening:
    centre: Centre
    basis: np.ndarray  # components in columns, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the different vectors ``fit`` (x); None if they do not vary."""
    start = spectrum(fit)
    if start is None:
        return None
    sums = fit.select("x").mapInArrow(_sums, "dim int, total decimal(38,0)")
    sums = sums.groupBy("dim").agg(F.sum("total").alias("total")).collect()  # one row a dimension
    centre = Centre.of(start.n, [int(r["total"]) for r in sorted(sums, key=lambda r: r["dim"])])
    basis = np.linalg.qr(start.basis[:, ::-1])[0]
    found = None
    for _ in range(4):  # turn, measure; again only where rounding asks for it
        covariance = _covariance(fit, centre, basis)
        covariance = (covariance + covariance.T) / 2
        trace = float(np.trace(covariance))
        if found is not None:
            size = np.sqrt(found.eigenvalues)
            k = len(size)
            white = covariance[:k, :k] / np.outer(size, size)
            found.identity_error = float(np.abs(white - np.eye(k)).max())
            if found.identity_error < 1e-9:
                return found
        values, turn = np.linalg.eigh(covariance)
        values, turn = values[::-1], turn[:, ::-1]
        kept = int((values[:components] > 64 * _EPS * max(trace, 0) * len(values)).sum())
        if not kept:
            return None
        basis = np.linalg.qr(basis @ turn)[0]
        error = found.identity_error if found is not None else float("inf")
        found = Whitening(centre, basis[:, :kept], values[:kept].copy(), trace, error)
    return found


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten(w: Whitening):
    k = len(w.eigenvalues)
    turn, explained = w.basis / np.sqrt(w.eigenvalues), w.eigenvalues / w.trace

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = _matrix(batch.column("x")), batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, w.centre.n, np.int64)),
                    pa.array([v for v in w.centre.deviation(x) for _ in range(k)], pa.int64()),
                    pa.array((w.centre.centred(x) @ turn).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, w.identity_error)),
                ],
                names=[c.split()[0] for c in _OUT.split(", ")],
            )

    return run


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row for each vector that takes part and each of its first components; see the columns of ``_OUT``."""
    rows = whole_numbers(vectors, id_col, vector)
    fit = materialize(rows.select("x").distinct(), "fit_list")
    found = fit_whitening(fit, components)
    if found is None:
        return vectors.sparkSession.createDataFrame([], _OUT)
    return rows.mapInArrow(_whiten(found), _OUT)
