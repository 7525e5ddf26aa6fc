"""Catalogue dedup by normalised part number and brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import brand_key, is_placeholder, mpn_key, percent


def completeness(columns: list[str]) -> Column:
    """How many of the columns hold something other than an empty marker."""
    return sum((F.when(is_placeholder(F.col(c).cast("string")), 0).otherwise(1) for c in columns), F.lit(0))


def keyed(rows: DataFrame, mpn: str = "Mfg_Part_Num", brand: str = "Part_Manuf", index: str = "row_index") -> DataFrame:
    """Adds ``mpn_key, brand_key, completeness``; '' is no part number and no brand."""
    values = [c for c in rows.columns if c != index and not c.startswith("_")]
    return rows.withColumns(
        {"mpn_key": mpn_key(F.col(mpn)), "brand_key": F.when(is_placeholder(F.col(brand)), "").otherwise(brand_key(F.col(brand))), "completeness": completeness(values)}
    )


def mark_duplicates(rows: DataFrame, mpn: str = "Mfg_Part_Num", brand: str = "Part_Manuf", index: str = "row_index") -> DataFrame:
    """Adds ``survivor_index`` (of the row's group) and ``survives``; rows without a part number all survive.

    The survivor is the most complete row, the earliest of equals; ``index`` may be a number or the ``ordinal`` of a reader. It is found by a max per group, pre-aggregated before
    the shuffle, so a group with very many rows is no one's burden; a salted window is not needed.
    """
    k = keyed(rows, mpn, brand, index)
    best = F.min_by(F.col(index), F.struct((-F.col("completeness")).alias("gaps"), F.col(index).alias("place")))
    groups = k.where("mpn_key <> ''").groupBy("mpn_key", "brand_key").agg(best.alias("survivor_index"), F.count("*").alias("group_rows"))
    joined = k.join(groups, ["mpn_key", "brand_key"], "left")
    return joined.withColumn("survives", F.coalesce(F.col("survivor_index") == F.col(index), F.lit(True)))


def survivors(rows: DataFrame, **options) -> DataFrame:
    return mark_duplicates(rows, **options).where("survives")


def dedup_report(rows: DataFrame, **options) -> DataFrame:
    """One row: totals, duplicate rate, groups of two and more, rows without a part number."""
    m = mark_duplicates(rows, **options)
    counts = m.agg(
        F.count("*").alias("total_rows"),
        F.count_if("survives").alias("unique_products"),
        F.count_if(~F.col("survives")).alias("duplicate_rows_removed"),
        F.count_if(F.col("survives") & (F.col("group_rows") > 1)).alias("groups"),
        F.count_if(F.col("mpn_key") == "").alias("rows_without_part_number"),
    )
    return counts.withColumn("duplicate_rate_pct", F.coalesce(percent(F.col("duplicate_rows_removed"), F.col("total_rows")), F.lit(0.0)))


def collisions(rows: DataFrame, mpn: str = "Mfg_Part_Num", brand: str = "Part_Manuf", index: str = "row_index") -> DataFrame:
    """``mpn_key, brands, n_brands, n_rows``: part numbers under more than one brand, for review."""
    k = keyed(rows, mpn, brand, index).where("mpn_key <> ''")
    per_brand = k.groupBy("mpn_key", "brand_key").agg(F.count("*").alias("n"))
    named = F.when(F.col("brand_key") != "", F.col("brand_key"))
    found = per_brand.groupBy("mpn_key").agg(F.array_join(F.array_sort(F.collect_list(named)), ", ").alias("brands"), F.count(named).alias("n_brands"), F.sum("n").alias("n_rows"))
    return found.where("n_brands > 1")


def collision_rows(rows: DataFrame, mpn: str = "Mfg_Part_Num", brand: str = "Part_Manuf", index: str = "row_index") -> DataFrame:
    """The rows behind ``collisions``: ``mpn_key``, their index, their brand."""
    k = keyed(rows, mpn, brand, index)
    return k.join(collisions(rows, mpn, brand, index).select("mpn_key"), "mpn_key", "left_semi").select("mpn_key", index, "brand_key")
