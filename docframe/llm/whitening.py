"""Embedding whitening by shifted CholeskyQR.

Method: entries become ``x = floor(scale * c)``; every distinct vector counts once. With ``A`` the centred
distinct rows, each pass over them solves the triangular factors found so far, row by row, and forms the Gram matrix
of the result in Spark; its Cholesky factor ``R`` orthogonalises the rows further: ``A = Q R`` with ``R`` the
product of all factors. The first factor is shifted, ``chol(G + s I)``, so that it exists however badly the
rows are conditioned; a later one is shifted only where it does not exist otherwise. Passes end when ``Q' Q``
is the identity up to rounding (two or three passes as a rule). The SVD of ``R`` gives the components (right
singular vectors) and ``sqrt(n e)`` (singular values) without squaring the condition number, as eigenvalues of
the Gram matrix would. The last pass measures the covariance of the whitened fit rows.

Sums and deviations are exact integers. The driver holds matrices of dims x dims, whatever the rows; tasks add
their rows' Gram matrices before Spark adds those of the tasks.

Edge cases: rows whose vector is null, empty, or holds null, NaN or infinite entries are left out, and rows of
another length than the most frequent one (the longer of two); ``vec_id`` may be null or repeat; fewer
components than asked for come back where the rows span fewer dimensions (none for a single distinct vector or
an empty table); a deviation that does not fit a long is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.plans.stage import release, stage

SETTLED = 1e-12
"""Largest entry of ``Q' Q - I`` that counts as rounding, per dimension."""
PASSES = 8
EXACT = float(1 << 53)


def usable(table: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``vec_id`` and integer vectors ``__x`` of rows without null or non-finite entries, all of one length."""
    entries = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = table.filter(F.coalesce(fine, F.lit(False))).select(vec_id, F.transform(entries, lambda c: F.floor(c * scale).cast("long")).alias("__x"))
    sizes = whole.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole if sizes is None else whole.filter(F.size("__x") == sizes["d"])


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and their exact sum in every dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _rows(batch.column(0))
            if len(x):
                part = x.astype(object).sum(axis=0) if float(np.abs(x.astype(float)).max()) * len(x) > EXACT else x.sum(axis=0).astype(object)
                n, total = n + len(x), part if total is None else total + part
        if total is not None:
            yield pa.record_batch(
                {"dim": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()), "s": pa.array([int(v) for v in total]).cast(pa.decimal128(38, 0))}
            )

    found = fit.mapInArrow(add, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums = {r["dim"]: int(r["s"]) for r in found}
    return (found[0]["n"] if found else 0), [sums[k] for k in range(len(sums))]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S/n``: integer numerators, one rounding each where they fit."""
    if n * max(float(np.abs(x.astype(float)).max(initial=0.0)), 1.0) < EXACT:
        return (n * x - np.array(sums, np.int64)) / n
    return np.array([[(n * int(v) - s) / n for v, s in zip(row, sums)] for row in x], float).reshape(x.shape)


def _gram(fit: DataFrame, n: int, sums: list[int], basis: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows times ``basis``, solved by ``factors`` one after the other; Spark adds the upper halves.

    Rows are solved, not multiplied by an inverse: the error then does not grow with the factors' condition.
    """
    size = basis.shape[1]
    upper = np.triu_indices(size)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            q = _centred(_rows(batch.column(0)), n, sums) @ basis if len(batch) else np.zeros((0, size))
            for r in factors:
                q = _solved(r, q)
            total += q.T @ q
        yield pa.record_batch({"at": pa.array(np.arange(len(upper[0]), dtype=np.int32)), "v": pa.array(total[upper])})

    out = np.zeros((size, size))
    for r in fit.mapInArrow(multiply, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        i, j = upper[0][r["at"]], upper[1][r["at"]]
        out[i, j] = out[j, i] = r["v"]
    return out


def _solved(r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``b`` times the inverse of the upper triangular ``r``, column by column."""
    out = np.empty_like(b)
    for j in range(len(r)):
        out[:, j] = (b[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def shifted_factor(gram: np.ndarray, rows: int, shift: bool) -> np.ndarray:
    """Upper triangular ``R`` with ``R' R = gram`` or, where asked for or needed, ``gram + s I``."""
    d = len(gram)
    if not shift:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    size = max(np.linalg.norm(gram, 2), np.finfo(float).tiny)
    s = 11 * (rows * d + d * (d + 1)) * np.finfo(float).eps / 2 * size
    while True:
        try:
            return np.linalg.cholesky(gram + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            s *= 10


class Whitening:
    """Mean (as ``sums`` over ``n``), components (columns), eigenvalues, total variance, measured identity error."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, total: float, error: float):
        self.n, self.sums, self.components, self.values, self.total, self.error = n, sums, components, values, total, error


def fit_whitening(fit: DataFrame, components: int = 4) -> Whitening:
    """Whitening of distinct integer vectors (one column of equally long arrays)."""
    n, sums = _sums(fit)
    d = len(sums)
    nothing = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)
    if n == 0:
        return nothing
    basis, factors, factor, total = np.eye(d), [], np.eye(d), 0.0
    for k in range(PASSES):
        gram = _gram(fit, n, sums, basis, factors)
        if k == 0:
            total = float(np.trace(gram)) / n
            live = np.flatnonzero(np.diag(gram) > 0)  # a constant dimension is zero in every component
            if len(live) == 0:
                return nothing
            gram, basis, factor = gram[np.ix_(live, live)], basis[:, live], np.eye(len(live))
        elif np.abs(gram - np.eye(len(gram))).max() <= SETTLED * d:
            break
        factors.append(shifted_factor(gram, n, shift=k == 0))
        factor = factors[-1] @ factor
    _, sizes, right = np.linalg.svd(factor)
    kept = min(components, len(sizes), int((sizes > sizes[0] * 1e-13 * d).sum()))
    vectors = np.zeros((d, kept))
    vectors[live] = right[:kept].T
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    values = sizes[:kept] ** 2 / n
    covariance = _gram(fit, n, sums, vectors / np.sqrt(values), []) / n
    whole = np.diag(covariance) > 0.5  # a direction made of rounding only has no variance of its own
    kept = kept if whole.all() else int(whole.argmin())
    error = float(np.abs(covariance[:kept, :kept] - np.eye(kept)).max(initial=0.0))
    return Whitening(n, sums, vectors[:, :kept], values[:kept], total, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of ``(n x - S) ** 2`` as exact longs, null beyond."""
    size = n * np.abs(x.astype(float)).max(initial=0.0) + max(map(abs, sums), default=0)
    if x.shape[1] * size * size < float(1 << 62):
        return pa.array(np.square(n * x - np.array(sums, np.int64)).sum(axis=1))
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per usable vector and component."""
    rows = usable(table, vec_id, vector, scale)
    fit = stage(rows.select("__x").distinct(), "distinct-vectors")
    model = fit_whitening(fit, components)
    release(fit)
    kept = len(model.values)
    share = model.values / model.total if kept else model.values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not kept or not len(batch):
                continue
            x = _rows(batch.column(1))
            scores = _centred(x, model.n, model.sums) @ (model.components / np.sqrt(model.values))
            again = pa.array(np.repeat(np.arange(len(x)), kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * kept, model.n, np.int64)),
                    _deviations(x, model.n, model.sums).take(again), pa.array(scores.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(x) * kept, model.error)),
                ],
                names=schema.names,
            )

    kinds = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType())] + [(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    schema = T.StructType([rows.schema[vec_id], *[T.StructField(c, t) for c, t in kinds]])
    return rows.mapInArrow(project, schema)
