"""Embedding whitening from an incremental eigendecomposition.

Entries become whole numbers, floor(256 c); the covariance is over the distinct vectors (the fit list). Each partition reads
its vectors one by one and keeps count, mean and the spectrum of the scatter around the mean: a new vector x changes
the scatter by k/(k+1) (x - mean)(x - mean)', a centred rank-one update, whose eigenvalues are the roots
of a secular equation and whose eigenvectors follow from them. Before the roots are sought, directions that the
update doesn't touch are deflated, and equal eigenvalues are rotated until one of them alone is touched. The vectors are found from
weights recomputed out of the roots, which keeps them orthogonal to working precision.

The partitions' spectra are combined in a tree of ``FAN_IN``: every eigenpair of one is a rank-one update of the other,
and the difference of the means one more. Last comes a Rayleigh-Ritz refinement: one pass projects all vectors, centred by the exact
mean, on the basis and sums their products by partition, so that the components' error is that of double precision and not that
of a long chain of updates. A further pass measures the whitened covariance.

What a task or the driver holds is one spectrum: d values and d x d vectors for d dimensions, whatever the number of rows.
Copies are dropped before the fit by a hash aggregate, so that a hot vector is one row.

Defined results: vectors that are null, hold null or non-finite entries, or have another length than most of the
others (of equally frequent lengths the longer), take no part; equal rows are each returned, a null id too; components of no
variance are whitened to null; a deviation beyond 64 bits is null; a component's largest entry is positive; with fewer dimensions
than components there are as many; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmaflow.llm.kit import prepare, stage, table

COMPONENTS = 4
FAN_IN = 8
#: Vectors that one product of matrices covers.
BLOCK = 4096
EPS = np.finfo(float).eps
#: An eigenvalue below this share of the largest is no variance.
NO_VARIANCE = 1e-13


# ---------------------------------------------------------------- one rank-one update


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z2 / (d - x) = 0 for rising d, rho > 0 and no z2 of 0: (nearest pole, distance from it) of each.

    The i-th root lies between d[i] and d[i+1], the last one below d[-1] + rho sum z2. All are sought at once, each
    in distances from its nearer pole, by interpolation with the two neighbouring poles; a step out of a root's bracket is
    replaced by a halving of it.
    """
    n = len(d)
    if n == 1:
        return np.zeros(1, int), rho * z2
    w = rho * z2
    i = np.arange(n)
    gap = np.append(np.diff(d), w.sum())
    # the sign of the function in the middle of an interval tells the nearer pole
    middle = d + gap / 2
    at_middle = 1 + (w / (d[None, :] - middle[:, None])).sum(axis=1)
    left = at_middle >= 0
    left[-1] = True
    pole = np.where(left, i, np.minimum(i + 1, n - 1))
    delta = d[None, :] - d[pole][:, None]
    lo = np.where(left, 0.0, -gap / 2)
    hi = np.where(left, gap / 2, 0.0)
    lo[-1], hi[-1] = (0.0, gap[-1] / 2) if at_middle[-1] >= 0 else (gap[-1] / 2, gap[-1])
    x = (lo + hi) / 2
    below = i[:, None] >= i[None, :]
    sign = np.where(below, -1.0, 1.0)  # of the terms at a root
    low = below.astype(float)
    low[-1, -1] = 0.0  # the last root's neighbours are the last two poles
    last = i == n - 1
    side = np.where(last, 1.0, -1.0)
    a, b = np.minimum(i, n - 2), np.minimum(i, n - 2) + 1
    at_a, at_b = delta[i, a], delta[i, b]
    done = np.zeros(n, bool)
    with np.errstate(all="ignore"):
        for step in range(100):
            gapped = delta - x[:, None]
            q = w / gapped
            f = 1 + q.sum(axis=1)
            done |= np.abs(f) <= EPS * n * (1 + np.einsum("ij,ij->i", sign, q))
            lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
            done |= hi - lo <= 2 * EPS * np.abs(x)
            if done.all():
                break
            q /= gapped
            psi, both = np.einsum("ij,ij->i", low, q), q.sum(axis=1)
            ga, gb = at_a - x, at_b - x
            c = f - ga * psi - gb * (both - psi)
            s = (ga + gb) * f - ga * gb * both
            p = ga * gb * f
            root = side * np.sqrt(np.maximum(s * s - 4 * p * c, 0))
            new = x + np.where(np.where(last, s >= 0, s <= 0), (s + root) / (2 * c), 2 * p / (s - root))
            bad = ~((new > lo) & (new < hi)) if step % 8 < 7 else True
            x = np.where(done, x, np.where(bad, (lo + hi) / 2, new))
    return pole, x


def updated(d: np.ndarray, v: np.ndarray, x: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of v diag(d) v' + rho x x', rho >= 0."""
    norm2 = float(x @ x)
    if not rho * norm2 > 0:
        return d, v
    z = v.T @ (x / np.sqrt(norm2))
    rho = rho * norm2
    tol = 8 * EPS * max(abs(d[-1]), abs(d[0]), rho)
    touched = rho * np.abs(z) > tol
    at = np.flatnonzero(touched)
    if len(at) > 1:
        near = np.diff(d[at]) * np.abs(z[at][:-1] * z[at][1:]) <= tol * (z[at][:-1] ** 2 + z[at][1:] ** 2)
        if near.any():
            # rotate equal eigenvalues until one of them alone is touched
            d, v, z = d.copy(), v.copy(), z.copy()
            keep = at[0]
            for j in at[1:]:
                r = np.hypot(z[keep], z[j])
                c, s = z[j] / r, z[keep] / r
                if abs((d[j] - d[keep]) * c * s) <= tol:
                    z[j], z[keep] = r, 0.0
                    old = v[:, keep].copy()
                    v[:, keep] = c * old - s * v[:, j]
                    v[:, j] = s * old + c * v[:, j]
                    d[keep], d[j] = d[keep] * c * c + d[j] * s * s, d[keep] * s * s + d[j] * c * c
                    touched[keep] = False
                keep = j
            at = np.flatnonzero(touched)
            at = at[np.argsort(d[at], kind="stable")]
    if not len(at):
        return d, v
    dk, zk = d[at], z[at]
    pole, tau = secular_roots(dk, zk * zk, rho)
    roots = dk[pole] + tau
    away = (dk[:, None] - dk[pole][None, :]) - tau[None, :]  # pole j minus root i
    # weights whose secular equation has exactly these roots
    n = len(dk)
    if n > 1:
        between = dk[:, None] - dk[None, :]
        between[np.arange(n), np.arange(n)] = 1.0
        ratio = away / between  # row j, root i over pole i
        weight = np.sqrt(np.abs(np.prod(ratio, axis=1)))
    else:
        weight = np.sqrt(np.abs(away[:, 0]))
    u = np.copysign(weight, zk)[:, None] / away
    u /= np.sqrt((u * u).sum(axis=0))
    d, v = d.copy(), v.copy()
    d[at] = roots
    v[:, at] = v[:, at] @ u
    order = np.argsort(d, kind="stable")
    return d[order], v[:, order]


# ---------------------------------------------------------------- spectra


@dataclass
class Spectrum:
    """Count, mean, and the scatter around the mean as eigenvalues and eigenvectors."""

    n: int
    mean: np.ndarray
    d: np.ndarray
    v: np.ndarray

    @staticmethod
    def empty(dim: int) -> Spectrum:
        return Spectrum(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        if self.n > 1:
            self.d, self.v = updated(self.d, self.v, away, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.d, self.v = other.n, other.mean, other.d, other.v
            return
        away, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.d, other.v.T, strict=True):
            self.d, self.v = updated(self.d, self.v, vector, max(float(value), 0.0))
        self.d, self.v = updated(self.d, self.v, away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.n = n

    def row(self) -> dict:
        return {"n": self.n, "mean": self.mean.tobytes(), "d": self.d.tobytes(), "v": np.ascontiguousarray(self.v).tobytes()}

    @staticmethod
    def of(row: dict) -> Spectrum:
        d = np.frombuffer(row["d"])
        return Spectrum(row["n"], np.frombuffer(row["mean"]), d, np.frombuffer(row["v"]).reshape(len(d), len(d)))


SPECTRUM = "part int, n long, mean binary, d binary, v binary"


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("x"))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _per_partition(fit: DataFrame, schema: str, begin: Callable, add: Callable, end: Callable) -> DataFrame:
    """One row a partition: what ``end`` makes of the state after ``add`` of each batch's vectors. Partitions without rows give none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        state = None
        for batch in batches:
            if batch.num_rows:
                state = begin() if state is None else state
                add(state, batch)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), **end(state)}], schema=arrow)

    return fit.mapInArrow(run, schema)


def _in_one(parts: DataFrame, schema: str, combine: Callable) -> dict | None:
    """All rows combined ``FAN_IN`` at a time, level by level; only the last one comes to the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return None

    def group(rows: pa.Table) -> pa.Table:
        ordered = sorted(rows.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_pylist([{"part": ordered[0]["part"] // FAN_IN, **combine(ordered)}], schema=arrow)

    while most > 0:
        parts = stage(parts.groupBy(F.expr(f"part div {FAN_IN}").alias("_b")).applyInArrow(group, schema), "whitening-parts")
        most //= FAN_IN
    return parts.first().asDict()


def spectrum(fit: DataFrame, dim: int) -> Spectrum:
    """The fit list's spectrum by rank-one updates alone."""

    def add(state: Spectrum, batch: pa.RecordBatch) -> None:
        for x in _vectors(batch, dim).astype(float):
            state.add(x)

    def combine(rows: list[dict]) -> dict:
        whole = Spectrum.of(rows[0])
        for row in rows[1:]:
            whole.merge(Spectrum.of(row))
        return whole.row()

    parts = stage(_per_partition(fit, SPECTRUM, lambda: Spectrum.empty(dim), add, Spectrum.row), "whitening-spectra")
    row = _in_one(parts, SPECTRUM, combine)
    return Spectrum.of(row) if row else Spectrum.empty(dim)


def projected_covariance(fit: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the fit list's vectors, centred, then projected on the basis."""
    dim, k = basis.shape
    mean = np.array([s / n for s in sums])

    def add(state: dict, batch: pa.RecordBatch) -> None:
        y = (_vectors(batch, dim) - mean) @ basis
        for i in range(0, len(y), BLOCK):
            state["s"] += y[i : i + BLOCK].T @ y[i : i + BLOCK]

    schema = "part int, s binary"
    parts = stage(_per_partition(fit, schema, lambda: {"s": np.zeros((k, k))}, add, lambda s: {"s": s["s"].tobytes()}), "whitening-products")
    row = _in_one(parts, schema, lambda rows: {"s": np.sum([np.frombuffer(r["s"]) for r in rows], axis=0).tobytes()})
    return np.frombuffer(row["s"]).reshape(k, k) / n


# ---------------------------------------------------------------- the operator


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """id, x (whole numbers) of the rows that take part, and their dimension."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    kept = rows.select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("x"), good.alias("_good")).filter("_good").drop("_good")
    kept = stage(kept.filter(F.size("x") > 0), "whitening-rows")
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = lengths["d"] if lengths else 0
    return kept.filter(F.size("x") == dim), dim


@dataclass
class Whitening:
    """Exact n and sums of the fit list, components (columns) by falling eigenvalue, and what was measured."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None


def fit_whitening(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Learn from the distinct vectors; vectors: x, all of ``dim`` entries."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit = stage(vectors.groupBy("x").agg(F.count("*").alias("m")).select("x").repartition(parts), "whitening-fit").select("x")
    totals = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # a row a dimension
    if not totals:
        return Whitening(0, [], np.zeros((dim, 0)), np.zeros(0), np.zeros(0), None)
    n, sums = totals[0]["n"], [int(r["s"]) for r in totals]
    rough = spectrum(fit.repartition(parts), dim)
    basis = np.linalg.qr(rough.v[:, ::-1])[0]
    values, turn = np.linalg.eigh(projected_covariance(fit, n, sums, basis))
    trace = values.sum()
    k = min(components, dim)
    values, w = values[::-1][:k], (basis @ turn)[:, ::-1][:, :k]
    w = w / np.sqrt((w * w).sum(axis=0))
    w = w * np.where(w[np.abs(w).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    some = values > NO_VARIANCE * max(trace, 0)
    error = None
    if some.any():
        white = projected_covariance(fit, n, sums, w[:, some] / np.sqrt(values[some]))
        error = float(np.abs(white - np.eye(int(some.sum()))).max())
    return Whitening(n, sums, w, np.where(some, values, 0.0), np.where(some, values / trace if trace > 0 else 0.0, 0.0), error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row, exactly; None beyond 64 bits."""
    far = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums), default=0)
    if far * far * max(len(sums), 1) < 1 << 63:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x)
    return [e if e < 1 << 63 else None for e in exact]


WHITENED = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, dim: int, model: Whitening) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        mean = np.array([s / m.n for s in m.sums])
        scale = np.where(m.values > 0, np.sqrt(m.values), np.nan)
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _vectors(batch, dim)
            y = ((x - mean) @ m.components / scale).ravel()
            rows = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("id")).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, m.n), pa.int64()),
                pa.array([d for d in deviations(x, m.n, m.sums) for _ in range(k)], pa.int64()), pa.array(y, mask=np.isnan(y)),
                pa.array(np.tile(m.explained, rows)), pa.array([m.identity_error] * (rows * k), pa.float64())],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, WHITENED)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of all ``embeddings``."""
    prepare(spark)
    vectors, dim = whole_vectors(table(spark, sf_dir, "embeddings"))
    return whiten(vectors, dim, fit_whitening(vectors.select("x"), dim)).withColumnRenamed("id", "vec_id")
