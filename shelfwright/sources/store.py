"""A keyed store in hash buckets: an upsert rewrites only the buckets that it touches, and a lookup reads one.

``<store>/data/version=<n>/bucket=<b>`` holds the rows of a bucket as version ``n`` wrote it, sorted by key, with bloom
filters on the key; ``<store>/index/version=<n>`` says, for each bucket, in which version its rows are. A version exists
once its index does, so a reader never sees half of one. Versions are written by dynamic partition overwrite and worked
out from the one before: writing one again gives the same. The driver sees one row a bucket, BUCKETS at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import upsert

#: Fixed for the life of a store. A bucket should stay within some hundred MB.
BUCKETS, KEPT_VERSIONS = 256, 2


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, store: str) -> list[int]:
    """Versions that are there and whole, oldest first."""
    fs, where = _folder(spark, f"{store}/index")
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where)]
    done = [p for p in found if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def index(spark: SparkSession, store: str, version: int) -> dict[int, int]:
    """Bucket -> the version that holds its rows."""
    return {r.bucket: r.held for r in spark.read.schema("bucket int, held long").parquet(f"{store}/index/version={version}").collect()}


def _rows(spark: SparkSession, store: str, held: dict[int, int], schema=None) -> DataFrame:
    """Rows of the given buckets, each in its version: partitions that no pair names are not read."""
    by_version: dict[int, list[int]] = {}
    for bucket, version in held.items():
        by_version.setdefault(version, []).append(bucket)
    wanted = F.lit(False)
    for version, buckets in sorted(by_version.items()):
        wanted = wanted | ((F.col("version") == version) & F.col("bucket").isin(sorted(buckets)))
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{store}/data").where(wanted)


def read_store(spark: SparkSession, store: str, version: int | None = None) -> DataFrame | None:
    """All rows of a version, the latest if none is named; None if there is none."""
    known = versions(spark, store)
    if not known or (version is not None and version not in known):
        return None
    return _rows(spark, store, index(spark, store, known[-1] if version is None else version)).drop("version", "bucket")


def upsert_store(new: DataFrame, store: str, version: int, key: str, order: str | None = None, buckets: int = BUCKETS) -> None:
    """Writes ``version``: the latest one before it with ``new`` rows in place of those with the same key (of several new
    ones the last by ``order``). Only buckets of new keys are read and written; older versions than KEPT_VERSIONS go."""
    spark = new.sparkSession
    before = [v for v in versions(spark, store) if v < version]
    held = index(spark, store, before[-1]) if before else {}
    placed = new.withColumn("bucket", bucket_of(F.col(key), buckets))
    touched = [r.bucket for r in placed.select("bucket").distinct().collect()]  # at most one a bucket
    old = {b: held[b] for b in touched if b in held}
    rows = _rows(spark, store, old).drop("version") if old else spark.createDataFrame([], placed.schema)
    merged = upsert(rows, placed, key, order).withColumn("version", F.lit(version).cast("long"))
    if touched:
        writer = merged.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.option("parquet.bloom.filter.enabled#" + key, "true").partitionBy("version", "bucket").parquet(f"{store}/data")
    now = held | dict.fromkeys(touched, version)
    spark.createDataFrame(sorted(now.items()), "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{store}/index/version={version}")
    expire(spark, store, KEPT_VERSIONS)


def expire(spark: SparkSession, store: str, keep: int = KEPT_VERSIONS) -> None:
    """Deletes all but the ``keep`` latest versions, and what buckets of these no longer need."""
    known = versions(spark, store)
    needed = {(held, bucket) for v in known[-keep:] for bucket, held in index(spark, store, v).items()}
    for v in known[:-keep]:
        fs, where = _folder(spark, f"{store}/index/version={v}")
        fs.delete(where, True)
    fs, where = _folder(spark, f"{store}/data")
    for folder in fs.listStatus(where) if fs.exists(where) else []:
        name = folder.getPath().getName()
        if not name.startswith("version="):
            continue
        version = int(name.removeprefix("version="))
        parts = [s.getPath() for s in fs.listStatus(folder.getPath())]
        stale = [p for p in parts if (version, int(p.getName().removeprefix("bucket="))) not in needed] if version <= known[-1] else []
        for p in [folder.getPath()] if stale and len(stale) == len(parts) else stale:
            fs.delete(p, True)


def lookup(spark: SparkSession, store: str, value: str, key: str, buckets: int = BUCKETS) -> DataFrame | None:
    """The row of one key, from the one bucket that can hold it: its filter is pushed to the file, whose row groups are
    skipped by their sorted ranges and bloom filters. None if the store has no such bucket."""
    known = versions(spark, store)
    if not known:
        return None
    number = spark.range(1).select(bucket_of(F.lit(value), buckets).alias("b")).first().b
    held = index(spark, store, known[-1])
    if number not in held:
        return None
    return _rows(spark, store, {number: held[number]}).where(F.col(key) == value).drop("version", "bucket")
