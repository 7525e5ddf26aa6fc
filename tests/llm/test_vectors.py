import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from shelfwright.llm import op11_laesa, op12_nsbounds, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v string, away int, cluster int, error int, _key int"


def table(spark, n=700, dim=64, seed=3, odd=True):
    """Vectors around twenty points with hot copies, ties, repeated and null ids, unusable rows and columns of clashing names."""
    rng = np.random.default_rng(seed)
    points = rng.normal(0, 0.3, (20, dim))
    rows = [(k, (points[k % 20] + rng.normal(0, 0.1, dim)).astype(np.float32).tolist(), k % 7 or None) for k in range(n)]
    rows += [(n + k, rows[5][1], 1) for k in range(n // 2)] + [(3, rows[9][1], 2), (3, rows[4][1], None), (None, rows[8][1], 2)]
    if odd:
        rows += [(9001, None, 1), (9002, [None] * dim, 1), (9003, [math.nan] + [0.0] * (dim - 1), 1), (9004, [math.inf] + [0.0] * (dim - 1), 1), (9005, [3e38] * dim, 1), (9006, [], 1)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)


def kept(df, scale):
    """Rows with their integer vectors, worked out in Python's own integers."""
    out = []
    for r in df.collect():
        if r.embedding and all(x is not None and math.isfinite(x) and abs(x) < vectors.LIMIT / scale for x in r.embedding):
            out.append((r.vec_id, r.label, [math.floor(scale * x) for x in r.embedding]))
    return out


def away(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))


def lloyd(rows, centres, rounds):
    for n in range(rounds + 1):
        near = [min((away(x, c), j) for j, c in enumerate(centres)) for x in rows]
        if n == rounds:
            return near, centres
        sums = defaultdict(list)
        for x, (_, j) in zip(rows, near, strict=True):
            sums[j].append(x)
        centres = [[sum(c) // len(sums[j]) for c in zip(*sums[j], strict=True)] if j in sums else c for j, c in enumerate(centres)]


def test_codes_match_brute_force(spark):
    df = table(spark, n=90, dim=16)
    rows = kept(df, op11_laesa.SCALE)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    codes, errors, books = [""] * len(rows), [0] * len(rows), []
    for p in range(4):
        near, book = lloyd([v[4 * p : 4 * p + 4] for _, _, v in rows], [v[4 * p : 4 * p + 4] for _, _, v in order[:256]], 4)
        codes = [c + f"{j:02x}" for c, (_, j) in zip(codes, near, strict=True)]
        errors = [e + d for e, (d, _) in zip(errors, near, strict=True)]
        books += [x for entry in book for x in entry]
    by_label = defaultdict(int)
    for (_, label, _), e in zip(rows, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    wanted = sorted((str(i), c, e, by_label[label], digest) for (i, label, _), c, e in zip(rows, codes, errors, strict=True))
    assert wanted == sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in op11_laesa.code_report(df).collect())


def test_codes_match_sql(spark):
    df = table(spark, n=400).where("vec_id is not null and vec_id <> 3")
    embeddings = df.select("vec_id", "embedding", "label").toArrow()  # noqa: F841  DuckDB reads it by name
    ours = op11_laesa.code_report(df).toPandas()
    theirs = duckdb.sql(op11_laesa.SQL).df()[list(ours.columns)]
    assert len(ours) == 599 and sorted(map(tuple, ours.values.tolist())) == sorted(map(tuple, theirs.values.tolist()))


def test_bounds_of_pivots_prune_and_keep_ties():
    rng = np.random.default_rng(1)
    book = np.repeat(rng.integers(-900, 900, (64, 8)), 2, axis=0)  # every entry twice: the lower index is wanted
    x = np.concatenate([book[rng.integers(0, 128, 500)] + rng.integers(-40, 40, (500, 8)), book])
    pivots = op11_laesa.pivots_of(book, 8)
    seen = []
    found, best = op11_laesa.nearest(x, np.sqrt(op11_laesa.to_pivots(x, pivots)), book, np.sqrt(op11_laesa.to_pivots(book, pivots)), seen)
    full = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (found == full.argmin(1)).all() and (best == full.min(1)).all() and sum(seen) < full.size / 4
    assert len(op11_laesa.pivots_of(np.zeros((5, 3), np.int64), 8)) == 1


@pytest.mark.parametrize("odd", [False, True])
def test_clusters_match_brute_force(spark, odd):
    df = table(spark, n=150, seed=5 + odd, odd=odd)
    rows = kept(df, op12_nsbounds.SCALE)
    place = lambda i: (i is not None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    order = sorted(rows, key=lambda r: (not place(r[0])[0], place(r[0])[1], r[2]))
    near, centres = lloyd([v for _, _, v in rows], [v for _, _, v in order[:40]], 5)
    inertia = defaultdict(int)
    for d, j in near:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    wanted = sorted((str(i), j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _, _), (d, j) in zip(rows, near, strict=True))
    out = op12_nsbounds.cluster_report(df)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert wanted == sorted((str(r.vec_id), *r[1:]) for r in out.collect())


def test_clusters_match_sql(spark):
    df = table(spark, n=500).where("vec_id is not null and vec_id <> 3")
    embeddings = df.select("vec_id", "embedding").toArrow()  # noqa: F841  DuckDB reads it by name
    ours = op12_nsbounds.cluster_report(df).toPandas()
    theirs = duckdb.sql(op12_nsbounds.SQL).df()[list(ours.columns)]
    assert sorted(map(tuple, ours.values.tolist())) == sorted(map(tuple, theirs.values.tolist()))


def test_ns_bounds_hold_and_save_evaluations():
    """Bounds from the whole displacement hold for every pair and are never looser than those from summed drifts."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(-200, 200, (1, 16)) + rng.integers(-20, 20, (200, 16)) for _ in range(8)])
    history = [v[rng.choice(len(v), 8, replace=False)]]
    squares = ((v[:, None, :] - history[0][None]) ** 2).sum(2)
    cluster, rounds, seen = squares.argmin(1), np.zeros(squares.shape, np.uint8), []
    for _ in range(5):
        history.append(np.array([v[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else history[-1][j] for j in range(8)]))
        whole = np.stack(history)
        low, high = op12_nsbounds.bounds(squares, rounds, whole)
        true = np.sqrt(((v[:, None, :] - whole[-1][None]) ** 2).sum(2))
        drift = np.sqrt((np.diff(whole, axis=0) ** 2).sum(2))
        summed = np.concatenate([np.cumsum(drift[::-1], axis=0)[::-1], np.zeros((1, 8))])[rounds, np.arange(8)]
        assert (low <= true).all() and (high >= true).all() and (low >= np.sqrt(squares) - summed - 1e-6 * (1 + summed + np.sqrt(squares))).all()
        cluster = op12_nsbounds.reassigned(v, cluster, squares, rounds, whole, seen)
        assert (cluster == (true**2).round().argmin(1)).all()
    assert sum(seen) < 5 * squares.size / 2


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(1, [1.0] * 64, None), (2, [1.0] * 64, None), (5, [0.0] * 64, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in op11_laesa.code_report(few).collect()) == [(1, "0" * 8, 0, 0), (2, "0" * 8, 0, 0), (5, "02" * 4, 0, 0)]
    assert {r.vec_id: r.inertia for r in op12_nsbounds.cluster_report(few).collect()} == {1: 0, 2: 0, 5: 0}
    assert op11_laesa.code_report(few.limit(0)).count() == 0 and op12_nsbounds.cluster_report(few.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [1.0] * 4, 1)], "vec_id long, embedding array<double>, label int")
    assert [(r.vec_id, r.error) for r in op11_laesa.code_report(odd).collect()] == [(1, 0)] and op12_nsbounds.cluster_report(odd).count() == 0


def test_totals_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    rows = spark.createDataFrame([(k, None if k % 3 else k % 2, k) for k in range(60)], "id long, label int, n long")
    out = vectors.with_total(rows, "label", "n", "total").collect()
    sums = defaultdict(int)
    for r in out:
        sums[r.label] += r.n
    assert len(out) == 60 and all(r.total == sums[r.label] for r in out)
