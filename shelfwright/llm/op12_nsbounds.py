"""Exact k-means with ns-bounds: stored distances are loosened by how far a centroid has moved in all since.

Next to each vector stands, for every centroid, the exact squared distance when it was last evaluated and the round in
which that was. The driver keeps the centroids of all rounds. In a round, a stored distance to centroid j of round t gives
the bounds distance -/+ |c_j(now) - c_j(t)|: the norm of the whole displacement, which is never more than the sum of the
rounds' drifts. A vector keeps its cluster where every other centroid's lower bound is above its own upper bound; otherwise
its own distance is evaluated, and then, exactly, those of all centroids whose bounds are not above it. Tasks
return sums per cluster; the driver sees one row for each. State is written each round in the shared folder, the one
before is deleted.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import LIMIT, add_up, floors, lists, matrix, squared, usable

SCALE, DIM, CLUSTERS, ROUNDS, SEED = 256, 64, 40, 5, 2
BLOCK = 8_192
STATE = "vec_id long, v array<int>, cluster int, squares array<long>, rounds binary"


def bounds(squares: np.ndarray, rounds: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (row, centroid) of distances to the last centroids of ``history`` (round, centroid, position),
    with room for rounding; ``squares`` were exact in ``rounds``."""
    moved = np.sqrt(((history[-1] - history).astype(np.float64) ** 2).sum(2))
    known, gone = np.sqrt(squares.astype(np.float64)), moved[rounds, np.arange(history.shape[1])]
    room = 1e-9 * (1 + known + gone)
    return known - gone - room, known + gone + room


def reassigned(v: np.ndarray, cluster: np.ndarray, squares: np.ndarray, rounds: np.ndarray, history: np.ndarray, evaluated: list[int] | None = None) -> np.ndarray:
    """Each row's nearest centroid of the last round (ties to the smaller number); ``squares`` and ``rounds`` are brought up
    to date where distances were evaluated, the one to the nearest centroid always where the bounds do not settle it."""
    now, at = len(history) - 1, np.arange(len(v))
    low, high = bounds(squares, rounds, history)
    others = low.copy()
    others[at, cluster] = np.inf
    open_ = np.flatnonzero(others.min(1) <= high[at, cluster])
    own = cluster[open_]
    squares[open_, own] = squared(v[open_], history[-1][own])
    rounds[open_, own] = now
    best = np.sqrt(squares[open_, own].astype(np.float64))
    rows, js = np.nonzero(others[open_] <= (best * (1 + 1e-9) + 1e-9)[:, None])
    rows = open_[rows]
    squares[rows, js] = squared(v[rows], history[-1][js])
    rounds[rows, js] = now
    if evaluated is not None:
        evaluated.append(len(open_) + len(rows))
    out = cluster.copy()
    fresh = np.where(rounds[open_] == now, squares[open_], np.iinfo(np.int64).max)
    out[open_] = fresh.argmin(1)
    return out


def _first(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The first round: all distances are evaluated."""
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            v = matrix(batch.column("v"), centroids.shape[1])
            squares = np.stack([squared(v, np.broadcast_to(c, v.shape)) for c in centroids], 1)
            yield _state(batch, v, squares.argmin(1), squares, np.zeros(squares.shape, np.uint8))


def _next(batches: Iterator[pa.RecordBatch], history: np.ndarray) -> Iterator[pa.RecordBatch]:
    k = history.shape[1]
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            v, squares = matrix(batch.column("v"), history.shape[2]), matrix(batch.column("squares"), k)
            rounds = np.frombuffer(b"".join(batch.column("rounds").to_pylist()), np.uint8).reshape(-1, k).copy()
            cluster = reassigned(v, batch.column("cluster").to_numpy().astype(np.int64), squares, rounds, history)
            yield _state(batch, v, cluster, squares, rounds)


def _state(batch: pa.RecordBatch, v: np.ndarray, cluster: np.ndarray, squares: np.ndarray, rounds: np.ndarray) -> pa.RecordBatch:
    k = rounds.shape[1]
    edges = pa.py_buffer(np.arange(0, rounds.size + 1, k, dtype=np.int32))
    packed = pa.Array.from_buffers(pa.binary(), len(rounds), [None, edges, pa.py_buffer(np.ascontiguousarray(rounds))])
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), lists(v, pa.int32()), pa.array(cluster, pa.int32()), lists(squares, pa.int64()), packed], ["vec_id", "v", "cluster", "squares", "rounds"])


def _sums(batches: Iterator[pa.RecordBatch], k: int, dim: int) -> Iterator[pa.RecordBatch]:
    sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        add_up(batch.column("cluster").to_numpy(), matrix(batch.column("v"), dim), sums, counts)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()), lists(sums[used], pa.int64())], ["cluster", "n", "s"])


def next_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid becomes the floor of its vectors' mean. A row for each centroid and task is shuffled."""
    k, dim = centroids.shape
    partial = state.select("v", "cluster").mapInArrow(functools.partial(_sums, k=k, dim=dim), "cluster int, n long, s array<long>")
    out = centroids.copy()
    for row in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[p]).alias(f"s{p}") for p in range(dim)]).collect():  # at most one a centroid
        out[row.cluster] = [row[f"s{p}"] // row.n for p in range(dim)]
    return out


def _distances(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cluster = batch.column("cluster").to_numpy()
        distance = squared(matrix(batch.column("v"), centroids.shape[1]), centroids[cluster])
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, embedding`` -> ``vec_id, cluster, distance`` and the centroids (centroid, position).

    Vectors that are null, of another dimension than ``dim``, that hold null or non-finite components or such that reach
    LIMIT when multiplied (no long holds their distances) are left out. Rows that repeat an id all take part; among them
    the smaller vector is the first centroid's. Rows without an id come after all others in the choice of first centroids.
    Fewer rows than ``k`` give as many clusters; no rows give no rows. ``rounds`` is 255 at most.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(usable(scale) & (F.size("embedding") == dim), floors(scale)).alias("v")).where("v is not null")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = [r.v for r in rows.orderBy(F.asc_nulls_last(place), "vec_id", "v").select("v").limit(k).collect()]
    if not start:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), np.zeros((0, dim), np.int64)
    history = [np.array(start, np.int64)]
    state = materialize(rows.mapInArrow(functools.partial(_first, centroids=history[0]), STATE), "state")
    for _ in range(rounds):
        history.append(next_centroids(state, history[-1]))
        before, state = state, materialize(state.mapInArrow(functools.partial(_next, history=np.stack(history)), STATE), "state")
        discard(before)
    done = materialize(state.select("vec_id", "v", "cluster").mapInArrow(functools.partial(_distances, centroids=history[-1]), "vec_id long, cluster int, distance long"), "clusters")
    discard(state)
    return done, history[-1]


def cluster_report(vectors: DataFrame) -> DataFrame:
    """``clustered`` with sums of distances and digests: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    rows, centroids = clustered(vectors)
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one a centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values] or [F.lit(None).cast(kind)]), F.col("cluster"))
    return rows.select(
        "vec_id", "cluster", "distance", of([sums.get(j, 0) for j in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"),
    )


def _sql() -> str:
    """DuckDB SQL for cluster_report: the rounds written out, every vector held against every centroid."""
    nearest = "SELECT v.rid, min((list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, c.v) + list_dot_product(c.v, c.v))::BIGINT * 64 + c.cluster) AS nearest FROM v CROSS JOIN c{n} c GROUP BY v.rid"
    step = """
a{n} AS MATERIALIZED ({nearest}),
s{n} AS (SELECT cluster, place, ((s - ((s % n + n) % n)) // n)::BIGINT AS value FROM (SELECT cluster, place, sum(value)::BIGINT AS s, count(*) AS n FROM
  (SELECT nearest % 64 AS cluster, unnest(v.v) AS value, generate_subscripts(v.v, 1) AS place FROM v JOIN a{n} USING (rid)) GROUP BY ALL)),
c{m} AS MATERIALIZED (SELECT cluster, coalesce(y.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT cluster, list(value ORDER BY place) AS v FROM s{n} GROUP BY ALL) y USING (cluster)),"""
    rounds = "".join(step.format(n=n, m=n + 1, nearest=nearest.format(n=n)) for n in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor({SCALE} * y::DOUBLE)::BIGINT FOR y IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y) OR abs(y) >= {LIMIT / SCALE}]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), vec_id, v) - 1 AS cluster, v FROM v QUALIFY cluster < {CLUSTERS}),{rounds}
a AS MATERIALIZED ({nearest.format(n=ROUNDS)}),
r AS (SELECT vec_id, (nearest % 64)::INTEGER AS cluster, (nearest // 64)::BIGINT AS distance FROM v JOIN a USING (rid))
SELECT vec_id, r.cluster, distance, sum(distance) OVER (PARTITION BY r.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM r JOIN c{ROUNDS} c ON c.cluster = r.cluster
"""


SQL = _sql()
