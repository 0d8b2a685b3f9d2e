"""Whitening, suffix deduplication and centroid clustering against plain Python, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import hadamard_clusters, suffix_dedup, whitening
from docframe.llm.queries import QUERIES
from docframe.plans.ship import ship

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label string, cluster string, n string, component string, __x string"


def vector_rows(n, dims, seed=1, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread * (1 + j % 5)) for j in range(dims)], None, "x", "y", None, None) for i in range(n)]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Good rows with repeats, a null id and a repeated id, and every kind of bad row."""
    ship(spark)
    rows = vector_rows(40, 64)
    rows += [rows[3], (3, rows[5][1], *[None] * 5), (None, rows[7][1], *[None] * 5)]
    bad = [None, [], [1.0] * 63, [1.0] * 63 + [None], [1.0] * 63 + [NAN], [1.0] * 63 + [INF], [-INF] + [1.0] * 63]
    return spark.createDataFrame(rows + [(100 + k, v, *[None] * 5) for k, v in enumerate(bad)], VECTORS)


def good(df):
    fine = [r for r in df.collect() if r.embedding and len(r.embedding) == 64 and all(v is not None and np.isfinite(v) for v in r.embedding)]
    return fine, np.array([r.embedding for r in fine])


def whitened_plainly(x, k):
    fit = np.unique(x, axis=0)
    n, centre = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - centre).T @ (fit - centre) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - fit.sum(axis=0)) ** 2).sum(axis=1), (x - centre) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_whitening(rows, fine, x, k=4):
    n, deviation, scores, share = whitened_plainly(x, k)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, []).append(r)
    assert len(rows) == k * len(fine) and all(r.n == n and r.identity_error < 1e-10 for r in rows)
    got = sorted((str(r.vec_id), r.component, r.deviation, abs(r.whitened)) for r in rows)
    want = sorted((str(f.vec_id), j + 1, int(deviation[i]), abs(scores[i, j])) for i, f in enumerate(fine) for j in range(k))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-8)
    assert all(abs(r.explained - share[r.component - 1]) < 1e-9 for r in rows)


def test_whitening_equals_eigenvectors(spark, odd_vectors):
    fine, v = good(odd_vectors)
    rows = whitening.whiten(odd_vectors).collect()
    check_whitening(rows, fine, np.floor(256 * v).astype(np.int64))
    # One sign per component for all rows: copies of a vector have one score.
    same = {}
    for r in rows:
        same.setdefault((r.component, r.deviation), set()).add(round(r.whitened, 9))
    assert all(len(x) == 1 for x in same.values())


def test_whitening_of_badly_conditioned_rows(spark):
    """Directions whose variances differ by 10^14: the Gram matrix alone would lose the small ones."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 4)) * np.array([2e7, 3.0, 2.5, 2.0])).astype(np.int64)
    x = x @ np.array([[1, 1, 0, 0], [0, 1, 0, 0], [0, 0, 1, 1], [0, 0, 0, 1]])
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df, scale=1).collect()
    assert max(r.component for r in rows) == 4 and max(r.identity_error for r in rows) < 1e-6
    c = x - x.mean(axis=0)
    values = np.linalg.svd(c, compute_uv=False) ** 2 / len(np.unique(x, axis=0))
    share = {r.component: r.explained for r in rows}
    assert np.allclose([share[k] for k in range(1, 5)], values / values.sum(), rtol=1e-4)


def test_whitening_with_fewer_dimensions_than_components(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 5.0, float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-10
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-9
    one = spark.createDataFrame(rows[:1] * 3, "vec_id long, embedding array<float>")
    assert whitening.whiten(one).collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(i, [float(10**12 * i), 1.0 * (i % 2)]) for i in range(9)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df, scale=1).collect()
    assert all(r.deviation is None for r in rows if r.vec_id != 4) and {r.deviation for r in rows if r.vec_id == 4} == {16}


def test_factor_and_solve():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 6))
    r = whitening.shifted_factor(a.T @ a, 50, shift=False)
    assert np.allclose(r.T @ r, a.T @ a) and np.allclose(whitening._solved(r, a) @ r, a)
    flat = np.ones((3, 3))
    shifted = whitening.shifted_factor(flat, 10, shift=False)
    assert np.allclose(shifted.T @ shifted, flat, atol=1e-10) and (np.diag(shifted) > 0).all()


def clusters_plainly(fine, x, k, rounds):
    ids = [r.vec_id for r in fine]
    key = [("z" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()) for i in ids]
    spectrum = hadamard_clusters.transform(x)
    first = sorted(range(len(ids)), key=lambda i: (key[i], spectrum[i].tolist()))[:k]
    c = x[first].astype(object)
    near = lambda: [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for v in x]
    for _ in range(rounds):
        at = near()
        for j in range(len(c)):
            mine = [v for v, (_, a) in zip(x, at) if a == j]
            if mine:
                c[j] = [sum(int(v) for v in col) // len(mine) for col in zip(*mine)]
    return ids, near(), c


@pytest.mark.parametrize("spread", [0.01, 1.0, 3e3])
def test_clusters_equal_plain_rounds(spark, spread):
    ship(spark)
    rows = vector_rows(60, 64, seed=9, spread=spread)
    rows += [rows[3], (3, rows[5][1], *[None] * 5), (None, rows[7][1], *[None] * 5)]
    df = spark.createDataFrame(rows, VECTORS)
    fine, v = good(df)
    ids, want, c = clusters_plainly(fine, np.floor(1024 * v).astype(np.int64), 8, 10)
    got = hadamard_clusters.cluster_vectors(df).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == sorted((str(i), j, d) for i, (d, j) in zip(ids, want))
    assert {r.cluster: list(r.centroid) for r in got} == {j: [int(x) for x in c[j]] for _, j in want}
    assert {r.inertia for r in got} == {sum(d for d, _ in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for d, j in want if j == r.cluster)


def test_search_is_exact_with_ties():
    rng = np.random.default_rng(3)
    assert (hadamard_clusters.hadamard(64) @ hadamard_clusters.hadamard(64).T == 64 * np.eye(64)).all()
    for spread in (1, 3, 1000):
        x, c = rng.integers(-spread, spread + 1, (500, 16)), rng.integers(-spread, spread + 1, (9, 16))
        c[7] = c[2]
        at, far = hadamard_clusters.nearest(hadamard_clusters.transform(x), hadamard_clusters.transform(c))
        plain = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (at == plain.argmin(axis=1)).all() and (far == 16 * plain.min(axis=1)).all()
        assert (hadamard_clusters.transform(x) == x @ hadamard_clusters.hadamard(16).T).all()


def test_vector_edge_cases(spark, odd_vectors):
    fine, _ = good(odd_vectors)
    got = hadamard_clusters.cluster_vectors(odd_vectors).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(r.vec_id) for r in fine)
    few = hadamard_clusters.cluster_vectors(odd_vectors.filter("vec_id < 3")).collect()
    assert {r.cluster for r in few} == {0, 1, 2} and {r.distance for r in few} == {0}
    for df in (odd_vectors.filter("false"), odd_vectors.filter("vec_id >= 100")):
        assert whitening.whiten(df.filter("vec_id < 102")).collect() == []
        assert hadamard_clusters.cluster_vectors(df).collect() == []


def cut_plainly(rows, width):
    first = {}
    for i, b in rows:
        for p in range(len(b) - width + 1):
            first[b[p : p + width]] = min(first.get(b[p : p + width], i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def byte_rows(df, **options):
    got = suffix_dedup.dedup_bytes(df, **options).collect()
    return sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)


@pytest.mark.parametrize("bucket_rows", [20, 300, 1 << 18])
def test_suffixes_against_every_window(spark, bucket_rows):
    """Passages that overlap, repeat inside a document, share borders, in two alphabets; groups cross many buckets."""
    ship(spark)
    rng = random.Random(bucket_rows)
    words = ["".join(rng.choices("abcdé中", k=rng.randint(1, 9))) for _ in range(60)]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 40))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.randrange(10**6), " ".join(parts)))
    rows += [(5, "a" * 400), (6, "a" * 300), (7, "ab" * 200), (rows[0][0], rows[1][1]), (rows[0][0], rows[0][1]), (None, rows[2][1]), (None, rows[2][1]), (3, "x" * 49)]
    rows += [(10**6 + k, passages[0] + f" {k}") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = cut_plainly([(2**63 - 1 if i is None else i, t.encode()) for i, t in rows], 50)
    assert byte_rows(df, bucket_rows=bucket_rows) == want


def test_suffix_edge_cases(spark):
    ship(spark)
    schema = "doc_id long, text string, id string, tag string, kept string, n_bytes string, runs string"
    long = " ".join(f"w{i % 900}" for i in range(20_000))
    rows = [(1, None, "a", None, "b", None, None), (2, "", None, "c", None, None, None), (None, long, "x", None, None, None, "y"), (4, long, None, None, None, None, None)]
    got = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    assert got[0].__fields__ == ["doc_id", "id", "tag", "runs", "n_bytes", "n_removed", "n_spans", "kept"]
    assert [(r.doc_id, r.id, r.n_bytes, r.n_removed) for r in got] == [(None, "x", len(long), len(long)), (1, "a", 0, 0), (2, None, 0, 0), (4, None, len(long), 0)]
    assert suffix_dedup.dedup_bytes(spark.createDataFrame([], schema)).collect() == []


def test_multikey_order_and_buckets():
    rng = np.random.default_rng(8)
    t = [rng.integers(0, 5, 400), rng.integers(0, 4, 400), rng.integers(0, 50, 400)]
    order = suffix_dedup.multikey_order(t)
    assert [tuple(x[i] for x in t) for i in order] == sorted(zip(*t))
    cut = sorted(zip(*t))[::17]
    borders = suffix_dedup.Splitters(*(np.array(x) for x in zip(*cut)))
    assert borders.bucket(*t).tolist() == [sum(c <= k for c in cut) for k in zip(*t)]


@pytest.mark.parametrize("name", ["op11_whitening"])
def test_whitening_query(spark, name):
    sf = "/root/testdata/sf0.001"
    fine, v = good(spark.read.parquet(f"{sf}/embeddings.parquet"))
    check_whitening(QUERIES[name](spark, sf).collect(), fine, np.floor(256 * v).astype(np.int64))
