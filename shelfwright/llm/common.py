"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's memo holds at most; it starts afresh when full.
CACHE_LIMIT = 150_000
#: Bytes of text that a worker takes up at once (one longer text alone).
PORTION = 2_000_000
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or one of our own in a local session without it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = "/tmp/checkpoints/shelfwright"
        spark.sparkContext.setCheckpointDir(known)
    return known


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that materialize() wrote and that no later step reads."""
    for table in tables:
        path = _PATHS.pop(table, None) if table is not None else None
        if path is not None:
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def portions(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``most`` bytes of ``column``, so that a worker's memory does not follow the batch."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


class WordHash(dict):
    """Memo of a 64-bit hash per word (bytes); cleared when full, so a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: One memo a worker, whichever operator fills it.
WORD_HASH = WordHash()


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space; null counts as empty. Lone surrogates cannot occur in Spark strings."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
