"""Product codes of vectors by k-means per part, with nearest entries found by LAESA pivots.

A few entries of each part's first codebook, far from each other, are its pivots for good. The distance of every part to
every pivot is worked out once and written next to the vectors. In each round only the distances of pivots to entries are
new; their difference to the stored ones is a lower bound of a part's distance to an entry. The entries with the lowest
bounds are evaluated first, in that order and in exact integers, and then those of the others whose bound is not above the
best distance so far, which each evaluation may lower. Tasks return sums per entry, of which
the driver sees one row for each entry; the codebooks are all that is sent to tasks.
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
from .vectors import LIMIT, add_up, floors, lists, matrix, squared, usable, with_total

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 1024, 4, 256, 4, 16
#: Rows taken up at once, and how many entries a row evaluates one by one, by their bounds, before it meets the others.
BLOCK, FIRST = 2_048, 8


def pivots_of(book: np.ndarray, n: int) -> np.ndarray:
    """``n`` entries at most, the first and then always the one that is farthest from those chosen."""
    chosen = [0]
    away = squared(book, np.broadcast_to(book[0], book.shape))
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, squared(book, np.broadcast_to(book[chosen[-1]], book.shape)))
    return book[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([squared(x, np.broadcast_to(p, x.shape)) for p in pivots], 1)


def nearest(x: np.ndarray, from_pivots: np.ndarray, book: np.ndarray, book_pivots: np.ndarray, evaluated: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The entry of ``book`` nearest to each row (ties to the lower index) and its squared distance.

    ``from_pivots`` and ``book_pivots`` are distances of rows and of entries to the pivots. An entry is left out only if
    its lower bound is above the best distance by more than rounding can be. ``evaluated`` gets the number of evaluations.
    """
    low = np.zeros((len(book), len(x)))
    for k in range(book_pivots.shape[1]):
        np.maximum(low, np.abs(from_pivots[:, k] - book_pivots[:, k, None]), out=low)
    low -= 1e-9 * (1 + low + from_pivots.max(1, initial=0))
    best, found, root = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(book)), np.full(len(x), np.inf)

    def evaluate(rows: np.ndarray, entries: np.ndarray | int) -> None:
        distance = squared(x[rows], book[entries])
        if evaluated is not None:
            evaluated.append(len(rows))
        better = (distance < best[rows]) | ((distance == best[rows]) & (entries < found[rows]))
        rows, distance = rows[better], distance[better]
        best[rows], found[rows], root[rows] = distance, entries[better] if isinstance(entries, np.ndarray) else entries, np.sqrt(distance.astype(np.float64))

    n = min(FIRST, len(book))
    first = np.argpartition(low, n - 1, axis=0)[:n] if len(x) else np.zeros((0, 0), np.int64)
    first = np.take_along_axis(first, np.argsort(np.take_along_axis(low, first, 0), axis=0, kind="stable"), 0) if len(x) else first
    for entries in first:
        rows = np.flatnonzero(low[entries, np.arange(len(x))] <= root)
        evaluate(rows, entries[rows])
        low[entries, np.arange(len(x))] = np.inf
    for entry in range(len(book)):
        rows = np.flatnonzero(low[entry] <= root)
        if len(rows):
            evaluate(rows, entry)
    return found, best


def _measured(batches: Iterator[pa.RecordBatch], pivots: list[np.ndarray], dim: int) -> Iterator[pa.RecordBatch]:
    """Fills vectors up to whole parts and adds ``away``: squared distances of each part to its pivots, part after part."""
    width = sum(p.shape[1] for p in pivots)
    for batch in batches:
        v = matrix(batch.column("v"), dim)
        v = np.pad(v, ((0, 0), (0, width - dim)))
        away = [to_pivots(x, p) for x, p in zip(np.split(v, len(pivots), axis=1), pivots, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists(v, pa.int32()), lists(np.concatenate(away, 1), pa.int64())], ["vec_id", "label", "v", "away"])


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray, pivots: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows with their parts (part, row, position), nearest entries and squared distances (part, row)."""
    edges = np.cumsum([0, *(len(p) for p in pivots)])
    book_pivots = [np.sqrt(to_pivots(b, p).astype(np.float64)) for b, p in zip(books, pivots, strict=True)]
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            v = matrix(batch.column("v"), books.shape[0] * books.shape[2])
            away = np.sqrt(matrix(batch.column("away"), edges[-1]).astype(np.float64))
            parts = np.split(v, len(books), axis=1)
            found = [nearest(x, away[:, edges[k] : edges[k + 1]], books[k], book_pivots[k]) for k, x in enumerate(parts)]
            yield batch, np.stack(parts), np.stack([f for f, _ in found]), np.stack([d for _, d in found])


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, pivots: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``place`` (part * entries + entry) ``, n, s`` of the entries that a task's parts are nearest to."""
    parts, entries, width = books.shape
    sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    for _, x, found, _ in _assigned(batches, books, pivots):
        add_up((found + np.arange(parts)[:, None] * entries).ravel(), x.reshape(-1, width), sums, counts)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()), lists(sums[used], pa.int64())], ["place", "n", "s"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, pivots: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch, _, found, distance in _assigned(batches, books, pivots):
        code = [row.tobytes().hex() for row in found.T.astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(distance.sum(0), pa.int64())], ["vec_id", "label", "code", "error"])


def next_books(table: DataFrame, books: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """One round: every used entry becomes the floor of its parts' mean. A row for each entry and task is shuffled."""
    width = books.shape[2]
    partial = table.mapInArrow(functools.partial(_sums, books=books, pivots=pivots), "place int, n long, s array<long>")
    totals = partial.groupBy("place").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)])
    out = books.copy().reshape(-1, width)
    for row in totals.collect():  # at most an entry each
        out[row.place] = [row[f"s{k}"] // row.n for k in range(width)]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, embedding, label`` -> ``vec_id, label, code, error`` and the codebooks (part, entry, position).

    Vectors that are null or empty, that hold null or non-finite components or such that reach LIMIT when multiplied (no
    long holds their distances), and vectors of another dimension than the row with the smallest id has, are left out.
    Rows that repeat an id all take part; among them the first codebook takes the smaller vector first. Rows without an id
    come after all others there. Fewer rows than ``entries`` (256 at most) give as many entries; no rows give no rows.
    Where ``parts`` does not divide the dimension, zeros fill the last part up.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.when(usable(scale), floors(scale)).alias("v")).where("size(v) > 0")
    start = [r.v for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()]
    dim = len(start[0]) if start else parts
    if any(len(v) != dim for v in start):
        start = [r.v for r in rows.where(F.size("v") == dim).orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()]
    width = -(-dim // parts)
    books = np.zeros((len(start), width * parts), np.int64)
    books[:, :dim] = np.array(start, np.int64).reshape(len(start), dim)
    books = books.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    chosen = [pivots_of(b, pivots) if len(b) else b for b in books]
    label = f"label {rows.schema['label'].dataType.simpleString()}"
    same = rows.where(F.size("v") == dim)
    table = materialize(same.mapInArrow(functools.partial(_measured, pivots=chosen, dim=dim), f"vec_id long, {label}, v array<int>, away array<long>") if start else same.withColumn("away", F.expr("cast(array() as array<long>)")), "measured")
    for _ in range(rounds if start else 0):
        books = next_books(table, books, chosen)
    out = table.mapInArrow(functools.partial(_codes, books=books, pivots=chosen), f"vec_id long, {label}, code string, error long") if start else table.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    done = materialize(out, "codes")
    discard(table)
    return done, books


def code_report(vectors: DataFrame) -> DataFrame:
    """``compressed`` with the sum of errors over each label and the digest of the codebooks: ``vec_id, code, error, label_error, codebooks_sha256``."""
    codes, books = compressed(vectors)
    return with_total(codes, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """DuckDB SQL for code_report: the rounds written out, every part held against every entry."""
    step = """
a{n} AS MATERIALIZED (SELECT x.rid, x.part, min((list_dot_product(x.x, x.x) - 2 * list_dot_product(x.x, c.x) + list_dot_product(c.x, c.x))::BIGINT * 256 + c.entry) AS nearest FROM x JOIN c{n} c USING (part) GROUP BY ALL),
s{n} AS (SELECT part, entry, place, ((s - ((s % n + n) % n)) // n)::BIGINT AS value FROM (SELECT part, entry, place, sum(value)::BIGINT AS s, count(*) AS n FROM
  (SELECT x.part, nearest % 256 AS entry, unnest(x.x) AS value, generate_subscripts(x.x, 1) AS place FROM x JOIN a{n} USING (rid, part)) GROUP BY ALL)),
c{m} AS MATERIALIZED (SELECT part, entry, coalesce(y.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT part, entry, list(value ORDER BY place) AS x FROM s{n} GROUP BY ALL) y USING (part, entry)),"""
    rounds = "".join(step.format(n=n, m=n + 1) for n in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, [floor({SCALE} * y::DOUBLE)::BIGINT FOR y IN embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y) OR abs(y) >= {LIMIT / SCALE}]) = 0),
x AS MATERIALIZED (SELECT rid, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM v, range({PARTS}) t(part)),
c0 AS MATERIALIZED (SELECT part, entry, x FROM x JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM v QUALIFY entry < {ENTRIES}) USING (rid)),{rounds}
a AS MATERIALIZED (SELECT x.rid, x.part, min((list_dot_product(x.x, x.x) - 2 * list_dot_product(x.x, c.x) + list_dot_product(c.x, c.x))::BIGINT * 256 + c.entry) AS nearest FROM x JOIN c{ROUNDS} c USING (part) GROUP BY ALL),
r AS (SELECT rid, string_agg(printf('%02x', nearest % 256), '' ORDER BY part) AS code, sum(nearest // 256)::BIGINT AS error FROM a GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN r USING (rid), h
"""


SQL = _sql()
