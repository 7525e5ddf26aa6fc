"""What the operators on integer vectors share: usable rows, flat Arrow columns, exact distances and floors, sums by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components below this size keep squared distances of up to 512 components, and their sums, within a long.
LIMIT = 1 << 26
#: Bytes of totals that may be sent to every task.
BROADCAST_BYTES = 16_000_000


def usable(scale: int) -> Column:
    """Whether ``embedding`` is there and has only finite components that stay under LIMIT when multiplied."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    return F.coalesce(F.col("embedding").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT / scale)), F.lit(False))


def floors(scale: int) -> Column:
    """``embedding`` as array<int> of floor(scale * x)."""
    return F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` items as an int64 matrix, without going through Python objects."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]) if rows.size else np.zeros(len(rows) + 1), pa.int32()), pa.array(rows.ravel(), kind))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that stand at the same place."""
    difference = x - y
    return np.einsum("ij,ij->i", difference, difference)


def add_up(groups: np.ndarray, rows: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds integer ``rows`` to ``sums``, and ones to ``counts``, at their ``groups``."""
    if len(groups):
        order = np.argsort(groups, kind="stable")
        there, starts, n = np.unique(groups[order], return_index=True, return_counts=True)
        sums[there] += np.add.reduceat(rows[order], starts, axis=0)
        counts[there] += n


def with_total(rows: DataFrame, key: str, value: str, total: str, salts: int = 16) -> DataFrame:
    """Adds ``total``, the sum of ``value`` over rows of an equal ``key`` (nulls are equal). Totals are pre-aggregated; they
    are sent to all tasks if they are small, else repeated ``salts`` times, so that a frequent key's rows go to many tasks."""
    sums = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(total))
    if 40 * sums.count() <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(sums), F.col(key).eqNullSafe(F.col("_key")))
    else:
        sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = rows.withColumn("_row_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
        joined = salted.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_row_salt") == F.col("_salt")))
    return joined.select(*rows.columns, total)
