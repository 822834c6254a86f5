"""Whitening of embeddings by QDWH spectral divide and conquer.

Spark adds up exact integer moments; the driver holds one table of dimensions x dimensions.
The polar decomposition of the covariance shifted by a value inside its spectrum tells the
invariant subspace above that value from the one below; each part is compressed and split
again until single components are left.  The components are sent to the tasks, which whiten the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallpoint.llm.common import prepared

SCALE, OFFSET = 1024, 100_000  # x = floor(SCALE * c) + OFFSET
COMPONENTS = 8
EXACT = 2.0 ** 53              # whole numbers up to here are exact as doubles
WHOLE = pa.decimal128(38, 0)


# ---------------------------------------------------------------- polar decomposition and eigenvectors


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a square matrix by dynamically weighted Halley steps in QR form."""
    n = len(a)
    norm = np.linalg.norm(a, 2)
    if norm == 0.0:
        return np.eye(n)
    x, eye = a / norm, np.eye(n)
    # A lower bound of the smallest singular value; too small a value costs a step, no accuracy.
    low = max(np.linalg.svd(x, compute_uv=False)[-1] * 0.9, 1e-16)
    for _ in range(30):
        last = x
        l2 = min(low * low, 1.0)
        d = (4.0 * (1.0 - l2) / (l2 * l2)) ** (1.0 / 3.0)
        root = math.sqrt(1.0 + d)
        wa = root + 0.5 * math.sqrt(max(8.0 - 4.0 * d + 8.0 * (2.0 - l2) / (l2 * root), 0.0))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        q, _r = np.linalg.qr(np.concatenate([math.sqrt(wc) * x, eye]))
        x = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        low = min(low * (wa + wb * l2) / (1.0 + wc * l2), 1.0)
        if np.abs(x - last).max() < 1e-15 * n and 1.0 - low < 1e-15:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces of a symmetric matrix above and below ``shift``; None if one is empty."""
    n = len(a)
    sign = polar_factor(a - shift * np.eye(n))
    projector = (sign + sign.T) / 4.0 + np.eye(n) / 2.0
    rank = int(round(np.trace(projector)))
    if not 0 < rank < n:
        return None
    # Columns of the projector by falling length span its range; a second pass makes the basis clean.
    order = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    basis = np.linalg.qr(projector[:, order])[0][:, :rank]
    for _ in range(2):
        full = np.linalg.qr(np.concatenate([projector @ basis, np.eye(n) - projector], axis=1))[0]
        basis = full[:, :rank]
    return basis, full[:, rank:n]


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and orthonormal eigenvectors (columns) of a symmetric matrix.

    Values that differ by no more than rounding make one subspace; any orthonormal basis of it is right.
    """
    n = len(a)
    size = np.linalg.norm(a, 2) if n else 0.0
    done: list[tuple[float, np.ndarray]] = []
    work = [np.eye(n)] if n else []
    while work:
        basis = work.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2.0
        k = len(part)
        if k == 1 or np.linalg.norm(part - np.trace(part) / k * np.eye(k), 2) <= 4.0 * n * np.finfo(float).eps * size:
            done += [(part[i, i], basis[:, i]) for i in range(k)]
            continue
        # The mean of the values lies strictly inside the spectrum; should it hit a value, another place does not.
        diagonal = np.sort(np.diag(part))
        mean, spread = np.trace(part) / k, np.linalg.norm(part - np.trace(part) / k * np.eye(k), 2)
        for shift in (np.median(diagonal), mean, mean + 0.1 * spread, mean - 0.1 * spread, mean + 0.37 * spread, mean - 0.37 * spread):
            halves = _split(part, shift)
            if halves is not None:
                break
        else:
            raise RuntimeError("no shift splits the spectrum")
        work += [np.linalg.qr(basis @ h)[0] for h in halves]
    vectors = np.stack([v for _, v in done], axis=1) if done else np.zeros((0, 0))
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors) if done else np.zeros(0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# ---------------------------------------------------------------- moments on Spark


def whole_vectors(column: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, x): rows of a list column whose entries are all finite, as whole numbers; with ``size`` only rows as long as that."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths().fill_null(-1))
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if size is None:
        size = int(lengths.max(initial=-1))
    starts = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))[:-1]
    places = np.flatnonzero(lengths == size)
    if size <= 0 or not len(places):
        return places[:0], np.zeros((0, max(size, 0)), dtype=np.int64)
    rows = values[starts[places][:, None] + np.arange(size)]
    good = np.isfinite(rows).all(axis=1)
    places, rows = places[good], np.floor(rows[good] * SCALE)
    if len(rows) and np.abs(rows).max() >= 2.0 ** 62:
        raise ArithmeticError("an entry is too large for a long")
    return places, rows.astype(np.int64) + OFFSET


def _products(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers, exact, as Python integers."""
    most = int(np.abs(y).max(initial=0))
    step = max(1, int(EXACT / max(most * most, 1))) if most * most < EXACT else 0
    if not step:
        y = y.astype(object)
        return y.T.dot(y)
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for at in range(0, len(y), step):
        some = y[at:at + step].astype(np.float64)
        total = total + (some.T @ some).astype(np.int64).astype(object)
    return total


def _summed(rows: DataFrame, cells) -> DataFrame:
    """(dims, cell, value): exact sums of the cells that ``cells`` forms of each batch's whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dims, part in cells(b.column(0)):
                total[dims] = total[dims] + part if dims in total else part
        for dims, part in total.items():
            yield pa.record_batch([pa.array([dims] * len(part), pa.int32()), pa.array(range(len(part)), pa.int32()),
                                   pa.array([Decimal(int(v)) for v in part], WHOLE)], names=["dims", "cell", "value"])

    return rows.mapInArrow(run, "dims int, cell int, value decimal(38, 0)").groupBy("dims", "cell").agg(F.sum("value").alias("value"))


@dataclass(frozen=True)
class Whitening:
    """n rows, exact sums per dimension, and the components (columns) with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """Columns that take n * (x - mean) to whitened values; zero for a component without variance."""
        floor = max(self.values.max(initial=0.0), 0.0) * len(self.sums) * np.finfo(float).eps
        with np.errstate(divide="ignore", invalid="ignore"):
            by = np.where(self.values > floor, 1.0 / np.sqrt(self.values), 0.0)
        return self.vectors * (by / max(self.n, 1))[None, :]


def fit_whitening(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Exact moments of all rows in two passes, then the leading components by divide and conquer."""
    prepared(rows)
    data = rows.select(F.col(f"`{vector_col}`").alias("v"))

    def sums(column):
        for dims in np.unique(np.asarray(column.value_lengths().fill_null(0))).tolist():
            x = whole_vectors(column, dims)[1]
            if len(x):
                parts = [x[at:at + 1024].astype(object).sum(axis=0) if np.abs(x).max() > 2 ** 52 else x[at:at + 1024].sum(axis=0).astype(object)
                         for at in range(0, len(x), 1024)]
                yield dims, np.concatenate([[len(x)], sum(parts)])

    found = _summed(data, sums)
    # Shorter vectors lack entries, which count as null.
    longest = found.agg(F.max("dims")).first()[0]
    if longest is None:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    cells = {r["cell"]: int(r["value"]) for r in found.where(F.col("dims") == longest).collect()}
    n, total = cells[0], [cells[i + 1] for i in range(longest)]
    middle = np.array([round(Fraction(s, n)) for s in total], dtype=np.int64)

    def centred(column):
        x = whole_vectors(column, longest)[1]
        if len(x):
            y = x - middle
            yield longest, _products(y).ravel()

    got = {r["cell"]: int(r["value"]) for r in _summed(data, centred).collect()}
    rest = [s - n * int(m) for s, m in zip(total, middle)]
    cov = np.array([[float(Fraction(n * got[i * longest + j] - rest[i] * rest[j], n * n)) for j in range(longest)] for i in range(longest)])
    values, vectors = spectral_components(cov)
    keep = min(components, longest)
    return Whitening(n, tuple(total), values[:keep], vectors[:, :keep], float(np.trace(cov)))


def _apply(fit: Whitening, column, whole: bool):
    """(places, n * x - S as whole numbers or doubles, whitened)."""
    places, x = whole_vectors(column, len(fit.sums))
    sums = np.array(fit.sums, dtype=object)
    small = len(x) == 0 or fit.n * (int(np.abs(x).max()) + OFFSET) < 2 ** 62 and max(map(abs, fit.sums)) < 2 ** 62
    gap = fit.n * x - sums.astype(np.int64) if small else x.astype(object) * fit.n - sums
    return places, gap if whole else None, gap.astype(np.float64) @ fit.scaled


def identity_error(rows: DataFrame, fit: Whitening, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components that have variance."""
    live = np.flatnonzero(np.abs(fit.scaled).max(axis=0, initial=0.0) > 0)
    k = len(live)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for b in batches:
            w = _apply(fit, b.column(0), False)[2][:, live]
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["cell", "value"])

    got = rows.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    t = np.zeros(k + k * k)
    for r in got.collect():
        t[r["cell"]] = r["value"] / fit.n
    return float(np.abs(t[k:].reshape(k, k) - np.outer(t[:k], t[:k]) - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component, n, deviation decimal(38, 0), whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out, and so are those with fewer entries than
    the longest: what they lack counts as null.  An entry c counts as x = floor(1024 c) + 100000; ``n`` counts the
    vectors, ``deviation`` is the exact sum over dimensions of (n x - S)^2, ``whitened`` the projection of x - S / n on a unit
    eigenvector of the covariance (divisor n) over the root of its value.  Components are numbered by falling value; one
    without variance has whitened 0.  Repeated rows each stay, null ids too; no vector gives no rows; other columns are
    ignored.  ``deviation`` beyond 38 digits and entries beyond a long raise an error.  The driver holds dimensions x dimensions cells.
    """
    fit = fit_whitening(rows, vector_col, components)
    error = identity_error(rows, fit, vector_col)
    shares = fit.values / fit.trace if fit.trace > 0 else np.zeros(len(fit.values))
    k = len(fit.values)
    ids: Column = F.col(f"`{id_col}`")
    data = rows.select(F.col(f"`{vector_col}`").alias("v"), ids.alias("id"))
    id_type = data.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not k:
                continue
            places, gap, w = _apply(fit, b.column(0), True)
            most = int(np.abs(gap).max(initial=0))
            far = (gap * gap).sum(axis=1) if most * most * gap.shape[1] < 2 ** 63 else (gap.astype(object) ** 2).sum(axis=1)
            m = len(places)
            yield pa.record_batch([b.column(1).take(pa.array(np.repeat(places, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                                   pa.array([Decimal(int(v)) for v in np.repeat(far, k)], WHOLE), pa.array(w.ravel())],
                                  names=["id", "component", "deviation", "whitened"])

    out = data.mapInArrow(run, f"id {id_type}, component int, deviation decimal(38, 0), whitened double")
    share = F.array(*[F.lit(float(s)) for s in shares]) if k else F.array().cast("array<double>")
    return out.select(F.col("id").alias(id_col), "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(share, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))
