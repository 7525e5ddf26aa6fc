"""How wide extraction plans are kept cheap: each expression once a row, and rows on all cores."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column], compiled: bool = False) -> DataFrame:
    """Adds columns that are worked out once a row, however often later steps name them: unlike a projection, a generator
    is never merged into what reads it. Each of ``columns`` should hold each pattern once. ``compiled``: a projection below
    the generator works them out, in compiled code; only for columns with a lambda among them, as Spark would else compile
    all of the wide stage into one method, too long for the JVM to optimize."""
    if not compiled:
        return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
    made = df.select("*", *[c.alias(f"made_{name}") for name, c in columns.items()])
    return made.select(*df.columns, F.inline(F.array(F.struct(*[F.col(f"made_{name}").alias(name) for name in columns]))))


def expected_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer expects of a table, from its files and plan; nothing runs for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is too small to fill the cluster's cores with splits, dealt over all of them; larger tables and streams as they are."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if expected_bytes(df) < cores * split else df


#: Bytes of a table, as the optimizer expects them, whose rows one task takes in, and tasks a core at most.
TASK_BYTES, TASKS = 2_000_000, 16


def gathered(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` over all cores at least: what later groups by it needs no shuffle, however many and wide rows
    each of these becomes on the way. Tables of unknown size are dealt over the session's shuffle partitions."""
    cores, usual, size = df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), expected_bytes(df)
    known = size < int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str(2**62)))
    return df.repartition(min(max(cores, -(-size // TASK_BYTES)), max(TASKS * cores, usual)) if known else usual, key)


#: Bytes that may be sent to every task.
BROADCAST_BYTES = 16_000_000


def bytes_of(df: DataFrame) -> int:
    """Bytes of a table of numbers and texts, counted."""
    size = lambda f: F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16 if f.dataType.typeName() == "string" else F.lit(16)
    return df.agg(F.coalesce(F.sum(sum((size(f) for f in df.schema.fields), F.lit(0))), F.lit(0))).first()[0]


def sent_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the hint to send it to every task, if its bytes allow that; else with one that keeps Spark, whose estimate
    knows neither compressed files nor exploded rows, from sending it."""
    return F.broadcast(df) if bytes_of(df) <= most else df.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that all executors share: what many branches read is worked out, and planned, once.

    The folder is the session's ``spark.checkpoint.dir``; only a local session without one gets its own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        known = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not known and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(known or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``most`` bytes of ``column`` (one longer value alone), so that a worker's memory does not follow the batch."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once a row, also where ``use`` names it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
