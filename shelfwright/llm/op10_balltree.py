"""Exact top-k inner products: a ball tree per shard, branch and bound with k-th scores shared between waves of shards.

Vectors are dealt to cells by their nearest centre (a bounded sample of the rows), and a cell to shards of bounded size by
a hash of the id. Each shard is a ball, so q . centre + |q| radius bounds every score in it. A query's bar is its k-th score
among the sample at first; shards below it are never written down for the query. It visits the shard with the highest bound
first, then the next three, then the others; after each wave its bar rises to the k-th score that it has found, and only
(query, shard) pairs whose bound reaches the bar meet. Neither all vectors nor all queries are sent everywhere. In a shard,
nodes are visited for a block of queries at once, the more promising child first; a query leaves where a node's bound is
below its k-th score so far. The final ranking is over what all waves return.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import matrix

K, MODULUS, SCALE = 20, 20, 64
CELLS, SHARD_ROWS, BLOCK_ROWS, LEAF, SAMPLE = 24, 16_384, 8_192, 64, 2_000
#: Shards that a query visits in each wave, in the order of their bounds; 0 is the rest.
WAVES = (1, 3, 0)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` (array<long> of floor(scale * x)) of the usable vectors."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.col("embedding").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where("vec_id is not null").where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


class Tree:
    """Ball tree over distinct rows; leaves of LEAF rows, split at the median of the widest dimension."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order, self.nodes = points, np.arange(len(points)), []
        stack = [(0, len(points), -1, False)]
        while stack:
            lo, hi, parent, right = stack.pop()
            part = points[self.order[lo:hi]]
            centre = part.mean(0)
            radius = float(np.sqrt(((part - centre) ** 2).sum(1).max()))
            me = len(self.nodes)
            self.nodes.append([centre, radius, lo, hi, -1, -1])
            if parent >= 0:
                self.nodes[parent][5 if right else 4] = me
            if hi - lo > leaf:
                d = int((part.max(0) - part.min(0)).argmax())
                self.order[lo:hi] = self.order[lo:hi][np.argsort(part[:, d], kind="stable")]
                mid = (lo + hi) // 2
                stack += [(mid, hi, me, True), (lo, mid, me, False)]


def search(tree: Tree, ids: list[np.ndarray], queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """(score, vec_id) of each query's best k, best first, ties to smaller ids; ``ids`` of a point are sorted; ``floor`` is a lower bound of each query's k-th score.

    A point stands for all rows that share it, of which a query can use k at most besides itself.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    bar = floor.astype(np.float64).copy()
    norms = np.sqrt((queries**2).sum(1))
    stack = [(0, np.arange(len(queries)))]
    while stack:
        at, who = stack.pop()
        centre, radius, lo, hi, left, right = tree.nodes[at]
        bound = queries[who] @ centre + norms[who] * radius
        who = who[bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 >= bar[who]]
        if not len(who):
            continue
        if left < 0:
            rows = tree.order[lo:hi]
            scores = queries[who] @ tree.points[rows].T
            for i, q in enumerate(who):
                good = np.flatnonzero(scores[i] >= bar[q])
                if len(good):
                    new = [(int(scores[i, j]), int(v)) for j in good for v in _others(ids[rows[j]], own[q], k)]
                    best[q] = sorted(best[q] + new, key=lambda x: (-x[0], x[1]))[:k]
                    if len(best[q]) == k:
                        bar[q] = max(bar[q], best[q][-1][0])
            continue
        a, b = (queries[who] @ tree.nodes[c][0] + norms[who] * tree.nodes[c][1] for c in (left, right))
        stack += [(right, who), (left, who)] if a.mean() >= b.mean() else [(left, who), (right, who)]
    return best


def _matrix(rows: pa.Table) -> np.ndarray:
    return matrix(rows.column("v").combine_chunks(), rows.column("dim")[0].as_py()).astype(np.float64)


def _others(ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """The ``k`` smallest of the sorted ids of a point that are not the query's own."""
    left, right = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    return np.concatenate((ids[: min(left, k)], ids[right : right + k]))[:k]


def _shard(rows: pa.Table, queries: pa.Table, k: int, leaf: int) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not rows.num_rows or not queries.num_rows:
        return schema.empty_table()
    points = _matrix(rows)
    ids = rows.column("vec_id").to_numpy()
    distinct, group = np.unique(points, axis=0, return_inverse=True)
    order = np.lexsort((ids, group.ravel()))
    listed = np.split(ids[order], np.flatnonzero(np.diff(group.ravel()[order])) + 1)
    q = _matrix(queries)
    own, floor = queries.column("query_id").to_numpy(), queries.column("bar").to_numpy()
    best = search(Tree(distinct, leaf), listed, q, own, floor, k)
    flat = [(int(own[i]), v, s) for i, x in enumerate(best) for s, v in x]
    return pa.Table.from_arrays([pa.array([x[j] for x in flat], pa.int64()) for j in range(3)], schema=schema)


def _floors(batches, sample: list[tuple[int, list[int]]], k: int):
    """Adds ``bar``: the k-th best score among the sample's rows of the query's dimension, itself left out; else the lowest."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(v) for _, v in sample}:
        own = [(i, v) for i, v in sample if len(v) == d]
        by_dim[d] = np.array([i for i, _ in own]), np.array([v for _, v in own], np.float64)
    for batch in batches:
        bars = []
        for query_id, v in zip(batch.column("query_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            ids, rows = by_dim.get(len(v), (np.empty(0), np.empty((0, len(v)))))
            scores = (rows @ np.array(v, np.float64))[ids != query_id]
            bars.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bars, pa.float64())], [*batch.schema.names, "bar"])


def _by_dim(rows: list[tuple]) -> dict[int, tuple[list, np.ndarray]]:
    """Rows ``(key, v)`` by the dimension of v."""
    out: dict[int, tuple[list, list]] = {}
    for key, v in rows:
        keys, vectors = out.setdefault(len(v), ([], []))
        keys.append(key)
        vectors.append(v)
    return {d: (keys, np.array(vectors, np.float64)) for d, (keys, vectors) in out.items()}


def _cells(batches: Iterator[pa.RecordBatch], centres: list[tuple[int, list[int]]]) -> Iterator[pa.RecordBatch]:
    """Adds ``cell``, the nearest centre of the row's dimension (else -1), and ``away``, the distance to it."""
    known = _by_dim(centres)
    for batch in batches:
        cells, aways = [], []
        for v in batch.column("v").to_pylist():
            keys, points = known.get(len(v), ([-1], None))
            square = np.zeros(1) if points is None else ((points - np.array(v, np.float64)) ** 2).sum(1)
            best = int(square.argmin())
            cells.append(keys[best])
            aways.append(float(np.sqrt(square[best])) if points is not None else float(np.sqrt((np.array(v, np.float64) ** 2).sum())))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64()), pa.array(aways, pa.float64())], [*batch.schema.names, "cell", "away"])


def _bounded(batches: Iterator[pa.RecordBatch], centres: list[tuple[int, list[int]]], balls: list[tuple[int, int, float, int]]) -> Iterator[pa.RecordBatch]:
    """Adds ``shards``: each query's shards of its dimension whose bound reaches its bar, with their bounds, the highest first."""
    points = {key: np.array(v, np.float64) for key, v in centres}
    by_dim: dict[int, list[tuple[int, int, float]]] = {}
    for cell, dim, radius, shards in balls:
        by_dim.setdefault(dim, []).append((cell, shards, radius))
    kind = pa.list_(pa.struct([("cell", pa.int64()), ("salt", pa.int64()), ("bound", pa.float64())]))
    for batch in batches:
        out = []
        for v, bar in zip(batch.column("v").to_pylist(), batch.column("bar").to_pylist(), strict=True):
            q = np.array(v, np.float64)
            norm = float(np.sqrt((q**2).sum()))
            mine = by_dim.get(len(v), [])
            bounds = [(float(q @ points[c]) if c in points else 0.0) + norm * r for c, _, r in mine]
            pairs = [{"cell": c, "salt": s, "bound": top} for (c, n, _), b in zip(mine, bounds, strict=True) if (top := b + 1e-9 * abs(b) + 1e-6) >= bar for s in range(n)]
            out.append(sorted(pairs, key=lambda p: (-p["bound"], p["cell"], p["salt"])))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "shards"])


def top_k(vectors: DataFrame, is_query: Column | None = None, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF, cells: int = CELLS) -> DataFrame:
    """``vec_id, embedding`` -> ``query_id, rank, vec_id, score``: each query row's ``k`` best other rows by integer inner product.

    ``is_query`` picks the queries (default: ids divisible by 20). Null vectors, those with null or non-finite components,
    and rows without an id take no part; vectors meet only those of their own dimension. Of rows that repeat an id each is a
    candidate, and a query, of its own; their results share the id's ranks. Ties go to the smaller id. Scores are exact up to 2^53. ``cells`` (at least; one for each
    ``shard_rows`` rows) is how many centres there are, SAMPLE at most.
    """
    rows = materialize(quantized(vectors).withColumn("dim", F.size("v")), "vectors")
    sample = [(r.vec_id, r.v) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()]
    centres = [(n, v) for n, (_, v) in enumerate(sample[: min(SAMPLE, max(cells, -(-rows.count() // shard_rows)))])]
    dealt = rows.mapInArrow(functools.partial(_cells, centres=centres), "vec_id long, v array<long>, dim int, cell long, away double")
    dealt = materialize(dealt, "cells")
    discard(rows)
    sizes = dealt.groupBy("cell", "dim").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / shard_rows).alias("shards"))
    balls = [(r.cell, r.dim, r.radius, r.shards) for r in sizes.collect()]  # a row for each of SAMPLE centres and dimension at most
    shards = {(c, d): n for c, d, _, n in balls}
    salts = dealt.sparkSession.createDataFrame([(c, d, n) for (c, d), n in shards.items()], "cell long, dim int, salts long")
    placed = dealt.join(F.broadcast(salts), ["cell", "dim"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("salts"))).select("vec_id", "v", "dim", "cell", "salt")

    queries = dealt.where(F.col("vec_id") % MODULUS == 0 if is_query is None else is_query).select(F.col("vec_id").alias("query_id"), "v", "dim")
    queries = queries.mapInArrow(functools.partial(_floors, sample=sample, k=k), "query_id long, v array<long>, dim int, bar double")
    queries = queries.mapInArrow(functools.partial(_bounded, centres=centres, balls=balls), "query_id long, v array<long>, dim int, bar double, shards array<struct<cell:long,salt:long,bound:double>>")
    queries = materialize(queries, "queries")

    keys = ["cell", "salt", "dim", "block"]

    def wave(asked: DataFrame, name: str) -> DataFrame:
        """``asked`` (query_id, v, dim, bar, cell, salt) against the vectors of its shards, in blocks of queries."""
        asked = materialize(asked, "asked")
        counts = asked.groupBy("cell", "salt", "dim").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
        mine = asked.join(counts, ["cell", "salt", "dim"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks")
        theirs = placed.join(counts, ["cell", "salt", "dim"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        found = theirs.groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInArrow(lambda x, y: _shard(x, y, k, leaf), "query_id long, vec_id long, score long")
        out = materialize(found, name)
        discard(asked)
        return out

    found, at = None, 0
    for n in WAVES:
        mine = queries
        if found is not None:
            scores = found.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # WAVES times k at most
            mine = queries.join(scores.select("query_id", F.get("s", F.lit(k - 1)).cast("double").alias("kth")), "query_id", "left").withColumn("bar", F.greatest("bar", F.coalesce("kth", F.lit(float("-inf")))))
        turn = F.slice("shards", at + 1, n) if n else F.slice("shards", at + 1, F.greatest(F.size("shards"), F.lit(1)))
        asked = mine.select("query_id", "v", "dim", "bar", F.explode(turn).alias("s")).where(F.col("s.bound") >= F.col("bar"))
        hits = wave(asked.select("query_id", "v", "dim", "bar", "s.cell", "s.salt"), f"wave_{at}")
        found, at = hits if found is None else found.unionByName(hits), at + n
    discard(queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for top_k with the production parameters.
SQL = f"""
WITH v AS (SELECT vec_id, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % {MODULUS} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
