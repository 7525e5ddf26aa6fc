"""Brand resolution: exact on a normalised key, then the nearest approved entry, else left unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import brand_key, is_placeholder, no_blank
from .similarity import best_matches, ratio
from .staging import sent_if_small

ACCEPT, SUGGEST = 0.88, 0.72
_PARTS = ["manufacturer_name", "manufacturer_code", "brand_name", "brand_code"]


def brand_index(brands: DataFrame) -> DataFrame:
    """``key`` and the approved pair: manufacturers before brands, the first row of a key."""
    text = lambda c: no_blank(F.trim(c))
    pair = F.struct(text("MANUFACTURER_NAME").alias("manufacturer_name"), text("MANUFACTURER_CODE").alias("manufacturer_code"), F.coalesce(text("BRAND_NAME"), text("MANUFACTURER_NAME")).alias("brand_name"), text("BRAND_CODE").alias("brand_code"))
    either = F.explode(F.array(F.struct(brand_key(F.col("MANUFACTURER_NAME")).alias("key"), F.lit(0).alias("kind")), F.struct(brand_key(F.col("BRAND_NAME")).alias("key"), F.lit(1).alias("kind"))))
    rows = brands.select(pair.alias("pair"), "ordinal", either.alias("k")).select("pair", "ordinal", "k.*").where("key <> ''")
    return rows.groupBy("key").agg(F.min_by("pair", F.struct("kind", "ordinal")).alias("pair")).select("key", "pair.*")


def resolve_brands(rows: DataFrame, brands: DataFrame, column: str) -> DataFrame:
    """Adds ``manufacturer_name, manufacturer_code, brand_name, brand_code, brand_confidence, brand_method, brand_review``.

    Each distinct name is resolved once. Placeholders are empty at confidence 1; a nearest entry under ACCEPT is a
    suggestion that asks for review; others stay unresolved.
    """
    index = brand_index(brands)
    index = sent_if_small(index)
    names = rows.select(F.col(column).alias("name")).where(~is_placeholder(F.col("name"))).distinct().withColumn("key", brand_key(F.col("name")))
    exact = names.join(index, "key", "left")
    open_keys = exact.where("brand_name is null and manufacturer_name is null").select("key")
    near = best_matches(open_keys, index.select("key"), SUGGEST).withColumn("score", ratio(F.col("key"), F.col("match"))).select("key", "match", "score")
    near = near.join(index.withColumnRenamed("key", "match"), "match").select("key", "score", *[F.col(c).alias(f"near_{c}") for c in _PARTS])
    found = exact.join(near, "key", "left")
    is_exact = F.coalesce("manufacturer_name", "brand_name").isNotNull()
    resolved = found.select(
        "name",
        *[F.coalesce(c, f"near_{c}").alias(c) for c in _PARTS],
        F.when(is_exact, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("brand_confidence"),
        F.when(is_exact, "exact").when(F.col("score").isNotNull(), "fuzzy").otherwise("unresolved").alias("brand_method"),
        (~is_exact & F.coalesce(F.col("score") < ACCEPT, F.lit(True))).alias("brand_review"),
    )
    out = rows.join(resolved, rows[column] == resolved["name"], "left").drop("name")
    return out.withColumns(
        {"brand_confidence": F.coalesce("brand_confidence", F.lit(1.0)), "brand_method": F.coalesce("brand_method", F.lit("placeholder")), "brand_review": F.coalesce("brand_review", F.lit(False))}
    )


def method_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("brand_method").agg(F.count("*").alias("n"))
