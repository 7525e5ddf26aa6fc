"""The gate: which fields may reach published content, and why the others may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extra_key, no_blank, percent

LEAST_CONFIDENCE = 0.65
#: Core fields in order, their public label, and whether titles carry them.
ATTRIBUTES = [("voltage_rating", "Voltage", True), ("current_rating", "Current", True), ("ip_rating", "Enclosure Rating", True), ("connector_type", "Connector Type", True), ("material", "Material", True), ("mounting_type", "Mounting", True), ("certifications", "Certifications", False), ("operating_temperature_min", "Min Operating Temperature", False), ("operating_temperature_max", "Max Operating Temperature", False)]
NOT_CONTENT = (
    "brand manufacturer manufacturer_name mfr mpn manufacturer_part_number mfg_part_num part_number model model_no model_number sku stock_no stock_number item_number upc ean gtin barcode "
    "http https url source_url product_url estimated_arrival estimated_arrival_on arrival_date availability available ship_to_store shipping"
).split()


def gate(fields: DataFrame, include_enriched: bool = False) -> DataFrame:
    """Adds ``admitted, reason`` (null where admitted)."""
    status, conf = F.coalesce("status", F.lit("missing")), F.coalesce("confidence", F.lit(0.0))
    reason = (
        F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "no value extracted")
        .when(status == "flagged_ungrounded", "evidence not found in the source")
        .when(status == "flagged_validation_error", F.concat(F.lit("failed a rule: "), F.coalesce("message", F.lit("rule error"))))
        .when(status == "missing", "field is missing")
        .when((status == "ai_enriched") & F.lit(not include_enriched), "inferred, not sourced")
        .when(status == "ai_enriched", None)
        .when(~status.isin("verified", "flagged_low_confidence"), F.concat(F.lit("status not admissible: "), status))
        .when(conf < LEAST_CONFIDENCE, "confidence below the threshold for publication")
    )
    return fields.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def non_product(key: str, label: str, value: str):
    """Extras that are no product content: identifiers, links, shipping."""
    return extra_key(F.col(key)).isin(NOT_CONTENT) | extra_key(F.col(label)).isin(NOT_CONTENT) | F.trim(F.coalesce(value, F.lit(""))).rlike("(?i)^https?://")


TOTALS = ("n_admitted", "n_withheld", "n_inferred")


def total_counts() -> list[Column]:
    """Admitted and withheld (fields without a value count in neither), and inferred ones admitted, over gated fields."""
    some = F.trim(F.coalesce("value", F.lit(""))) != ""
    counted = (some & F.col("admitted"), some & ~F.col("admitted"), F.col("admitted") & (F.col("status") == "ai_enriched"))
    return [F.count_if(c).alias(name) for c, name in zip(counted, TOTALS, strict=True)]


def with_share(counts: DataFrame) -> DataFrame:
    return counts.withColumn("pass_pct", F.coalesce(percent(F.col("n_admitted"), F.col("n_admitted") + F.col("n_withheld")), F.lit(0.0)))


def totals(gated: DataFrame, *keys: str) -> DataFrame:
    """``total_counts`` (per ``keys`` if given) and the pass percentage."""
    return with_share(gated.groupBy(*keys).agg(*total_counts()))


def records(gated: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """Admitted fields as product records: ``product_id, brand, manufacturer, series, mpn, item_type, attributes``.

    Core attributes come in fixed order under public labels, then extras in order of appearance; an extra whose value
    equals an earlier one's, or the product's identity, drops out. ``identity`` (product_id, brand, manufacturer, series,
    mpn) overrides; otherwise the part number is read from the name.
    """
    table = F.map_from_arrays(F.array(*[F.lit(k) for k, _, _ in ATTRIBUTES]), F.array(*[F.struct(F.lit(n).alias("place"), F.lit(label).alias("label"), F.lit(key).alias("is_key")) for n, (_, label, key) in enumerate(ATTRIBUTES)]))
    a = gated.withColumn("known", F.try_element_at(table, F.col("field_key")))
    usable = F.col("admitted") & (F.col("known").isNotNull() | (~F.col("is_core") & ~non_product("field_key", "label", "value")))
    entry = F.when(usable, F.struct(F.coalesce("known.place", F.lit(100) + F.col("pos")).alias("place"), F.coalesce("known.label", "label").alias("label"), "value", "unit", F.coalesce("known.is_key", F.lit(False)).alias("is_key")))
    of = lambda key: F.max(F.when((F.col("field_key") == key) & F.col("admitted"), F.col("value")))
    out = a.groupBy("product_id").agg(of("product_name").alias("product_name"), of("category").alias("item_type"), F.array_sort(F.collect_list(entry)).alias("entries"))
    values = F.transform("entries", lambda e: F.lower(F.trim(e["value"])))
    own = F.array(F.lower(F.coalesce("product_name", F.lit(""))), F.lower(F.coalesce("item_type", F.lit(""))))
    kept = F.filter("entries", lambda e, i: (e["place"] < 100) | ((F.array_position(values, F.lower(F.trim(e["value"]))) == i + 1) & ~F.array_contains(own, F.lower(F.trim(e["value"])))))
    out = out.withColumn("attributes", F.transform(kept, lambda e: F.struct(e["label"].alias("label"), e["value"].alias("value"), e["unit"].alias("unit"), e["is_key"].alias("is_key"))))
    named = no_blank(F.regexp_extract(F.upper(F.coalesce("product_name", F.lit(""))), r"^\s*([A-Z0-9]{2,}(?:[-/][A-Z0-9]+)+)", 1))
    if identity is not None:
        out = out.join(identity, "product_id", "left").withColumn("mpn", F.coalesce("mpn", named))
    else:
        out = out.withColumns({**{c: F.lit(None).cast("string") for c in ("brand", "manufacturer", "series")}, "mpn": named})
    return out.select("product_id", "brand", "manufacturer", "series", "mpn", "item_type", "attributes", F.array().cast("array<string>").alias("features"))
