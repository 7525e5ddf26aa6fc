"""Newly landed product texts, processed as they come and upserted into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.validate import summarize
from ..plans.flows import process_texts
from ..sources import store as stored

SCHEMA = "product_id string, raw_text string, name_hint string, category_hint string"


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def start(texts: DataFrame, store: str, checkpoint: str, buckets: int = stored.BUCKETS) -> StreamingQuery:
    """Each micro-batch's summaries become the store's next version, of which only the buckets of its products are written.

    A batch that runs again after a failure works the same version out again from the one before, so nothing is applied twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        stored.upsert_store(summarize(process_texts(batch)), store, number, "product_id", buckets=buckets)

    return texts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str, number: int | None = None) -> DataFrame | None:
    return stored.read_store(spark, store, number)
