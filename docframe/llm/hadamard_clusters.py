"""Centroid clustering (Lloyd rounds) whose nearest-centroid search is a progressive Walsh-Hadamard search.

Method: every component becomes ``floor(scale * x)``, and vectors and centroids go through the exact integer
Walsh-Hadamard transform ``H`` (entries +1 and -1, ``H H = dims * I``), so that squared distances of the
coefficients are ``dims`` times those of the vectors. Coefficients are ordered coarse to fine (by sign
changes). A search adds squared coefficient differences block by block: 1, 1, 2, 4, ... of them. The centroid
that leads after the first block is finished at once and gives the bound; a centroid whose partial sum is
above the bound is strictly worse and is not looked at again; all others are carried through every
coefficient. Ties go to the smaller number.

Vectors are transformed once and written. A round is one pass over them: each task sums coefficients and
counts per cluster (the transform is linear, so the sums of the components are those of the coefficients
transformed back), and Spark adds one row per task and cluster. Only the centroids return to the driver.

Edge cases: rows whose vector is null, has another length or holds null, NaN or infinite entries are left
out; ``vec_id`` may be null or repeat (rows stay separate, a null id has no hash and is never a first
centroid unless too few others exist); fewer rows than ``clusters`` give fewer centroids; an empty table gives
an empty result; other columns are not read. Distances are exact while they fit a long; entries whose squares
do not are an error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.plans.stage import release, stage

SAFE = 1 << 62
"""Bound of a sum of squared coefficient differences; beyond it Python integers are used."""


def _natural(dims: int) -> np.ndarray:
    h = np.ones((1, 1), np.int64)
    while len(h) < dims:
        h = np.block([[h, h], [h, -h]])
    if len(h) != dims:
        raise ValueError(f"{dims} is no power of two")
    return h


def _coarse_first(natural: np.ndarray) -> np.ndarray:
    return np.argsort((natural[:, 1:] != natural[:, :-1]).sum(axis=1), kind="stable")


def hadamard(dims: int) -> np.ndarray:
    """The Walsh-Hadamard matrix, rows by number of sign changes; ``dims`` is a power of two."""
    natural = _natural(dims)
    return natural[_coarse_first(natural)]


def transform(x: np.ndarray) -> np.ndarray:
    """Coefficients of integer rows by butterflies, coarse to fine."""
    dims = x.shape[1]
    out = x.copy()
    step = 1
    while step < dims:
        pairs = out.reshape(len(x), -1, 2, step)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), dims)
        step *= 2
    return out[:, _coarse_first(_natural(dims))]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared coefficient distance of every row of coefficients."""
    n, dims = x.shape
    k = len(centroids)
    cuts = [0, 1]
    while cuts[-1] < dims:
        cuts.append(min(dims, 2 * cuts[-1]))
    partial = np.empty((n, k), x.dtype)
    partial[:] = np.square(x[:, :1] - centroids[None, :, 0])
    leader = np.argmin(partial, axis=1)
    bound = np.square(x - centroids[leader]).sum(axis=1)
    alive = [np.flatnonzero(partial[:, j] <= bound) for j in range(k)]
    for a, b in zip(cuts[1:-1], cuts[2:]):
        for j in range(k):
            rows = alive[j]
            if len(rows):
                now = partial[rows, j] + np.square(x[rows, a:b] - centroids[j, a:b]).sum(axis=1)
                partial[rows, j] = now
                alive[j] = rows[now <= bound[rows]]
    # A centroid that dropped out is above the bound; the leader never drops out.
    best, at = bound.copy(), leader.copy()
    for j in range(k):
        rows = alive[j]
        now = partial[rows, j]
        better = (now < best[rows]) | ((now == best[rows]) & (j < at[rows]))
        best[rows[better]], at[rows[better]] = now[better], j
    return at, best


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _matrices(column: pa.Array, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of longs as rows, and the centroids; as Python integers where squares could leave a long."""
    dims = centroids.shape[1]
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if dims * (_largest(x) + _largest(centroids)) ** 2 > SAFE:
        return x.astype(object), centroids.astype(object)
    return x, centroids


def assign(vectors: DataFrame, centroids: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns``, ``cluster`` and ``distance`` of every row of ``vectors`` (column ``__coef``)."""
    dims = centroids.shape[1]
    coefficients = transform(centroids)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, to = _matrices(batch.column("__coef"), coefficients)
            at, far = nearest(x, to)
            far = pa.array([int(v) // dims for v in far], pa.int64()) if far.dtype == object else pa.array(far // dims, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(at.astype(np.int32)), far], names=[*columns, "cluster", "distance"])

    fields = [vectors.schema[c] for c in columns]
    schema = T.StructType([*fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return vectors.select(*columns, "__coef").mapInArrow(search, schema)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors; empty ones stay."""
    k, dims = centroids.shape
    coefficients = transform(centroids)
    names = [f"s{i}" for i in range(dims)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in batches:
            x, to = _matrices(batch.column("__coef"), coefficients)
            at, _ = nearest(x, to)
            for j in range(k):
                total[j] += x[at == j].sum(axis=0)
            counts += np.bincount(at, minlength=k)
        some = np.flatnonzero(counts)
        exact = pa.decimal128(38, 0)
        columns = [pa.array([int(v) for v in total[some, i]], pa.int64()).cast(exact) for i in range(dims)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), *columns], names=["cluster", "n", *names])

    schema = "cluster int, n long, " + ", ".join(f"{x} decimal(38,0)" for x in names)
    parts = vectors.select("__coef").mapInArrow(sums, schema)
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).collect():
        spectrum = np.array([int(r[x]) for x in names], object)
        total = spectrum @ hadamard(dims).astype(object)  # dims times the sums of the components
        out[r["cluster"]] = [int(v) // dims // r["n"] for v in total]
    return out


def prepare(table: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``vec_id`` and the coefficients ``__coef`` of every usable row."""
    entries = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & (F.size(vector) == dims) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = table.filter(F.coalesce(fine, F.lit(False))).select(vec_id, F.transform(entries, lambda c: F.floor(c * scale).cast("long")).alias("__x"))

    def coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if _largest(x) > 1 << 56:
                raise OverflowError("entries too large for exact coefficients")
            y = transform(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * dims), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[vec_id, "__coef"])

    return whole.mapInArrow(coefficients, T.StructType([whole.schema[vec_id], T.StructField("__coef", T.ArrayType(T.LongType()))]))


def first_centroids(vectors: DataFrame, vec_id: str, clusters: int, dims: int, salt: str) -> np.ndarray:
    """Vectors with the smallest SHA-256 of ``salt`` and id; rows of one id by their coefficients."""
    rank = F.sha2(F.concat(F.lit(salt), F.col(vec_id).cast("string")), 256)
    first = vectors.select(rank.alias("h"), "__coef").orderBy(F.col("h").asc_nulls_last(), "__coef").limit(clusters).collect()
    back = hadamard(dims)
    return np.array([[int(v) // dims for v in np.array(r["__coef"], object) @ back.astype(object)] for r in first], np.int64).reshape(-1, dims)


def cluster_vectors(
    table: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    clusters: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    dims: int = 64,
    salt: str = "3:",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` of every usable row."""
    spark = table.sparkSession
    vectors = stage(prepare(table, vec_id, vector, dims, scale), "coefficients")
    centroids = first_centroids(vectors, vec_id, clusters, dims, salt)
    for _ in range(rounds if len(centroids) else 0):
        moved = _moved(vectors, centroids)
        if (moved == centroids).all():
            break  # every further round would give the same
        centroids = moved
    schema = T.StructType([vectors.schema[vec_id]] + [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if len(centroids) == 0:
        found = spark.createDataFrame([], schema)
    else:
        found = stage(assign(vectors, centroids, [vec_id]), "assigned")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    release(vectors)
    rows = [(k, sums.get(k, 0), sum(sums.values()), [int(v) for v in c]) for k, c in enumerate(centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(about), "cluster").select(vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # one row per centroid


def clusters_sql(clusters: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, salt: str = "3:", table: str = "embeddings") -> str:
    """The same by plain distances over all components, one pair of steps per round."""
    near = f"""(SELECT row_id, vec_id, cluster, d FROM (
      SELECT v.row_id, v.vec_id, c.cluster, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d
      FROM v CROSS JOIN {{c}} c) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, cluster) = 1)"""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x
  FROM {table} WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: isfinite(e))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, x) - 1)::INTEGER AS cluster, x
  FROM (SELECT sha256('{salt}' || vec_id) AS h, x FROM v) ORDER BY h NULLS LAST, x LIMIT {clusters})""",
    ]
    for k in range(1, rounds + 1):
        old = f"c{k - 1}"
        steps.append(f"a{k} AS MATERIALIZED {near.format(c=old)}")
        steps.append(
            f"""m{k} AS MATERIALIZED (SELECT cluster, list(floor_mean ORDER BY i) AS x FROM (
    SELECT cluster, i, ((s - (((s % n) + n) % n)) // n)::BIGINT AS floor_mean FROM (
      SELECT cluster, i, sum(v.x[i])::BIGINT AS s, count(*) AS n FROM a{k} JOIN v USING (row_id), range(1, {dims + 1}) t(i) GROUP BY cluster, i)) GROUP BY cluster)"""
        )
        steps.append(f"c{k} AS MATERIALIZED (SELECT o.cluster, coalesce(m.x, o.x) AS x FROM {old} o LEFT JOIN m{k} m USING (cluster))")
    last = f"c{rounds}"
    steps.append(f"a AS MATERIALIZED {near.format(c=last)}")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string({last}.x, ',')) AS centroid_sha256
FROM a JOIN {last} USING (cluster)"""
    )
