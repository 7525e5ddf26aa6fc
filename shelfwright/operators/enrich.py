"""Rule-based values for missing fields, stamped as inferred; review actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, to_double
from .extract import COMPOUNDS, COMPOUND_WORDS, group
from .staging import let

GENERIC_WORDS = "metal|brass|stainless|steel|alloy|chrome|nickel"


def signs() -> Column:
    """What a product's text, name and category (``of_product_name, of_category``) let infer, taken once a product."""
    low = F.lower(F.concat_ws(" ", "of_product_name", "of_category", "raw_text"))
    compound = F.when(any_of(COMPOUND_WORDS, F.lower("raw_text")), group(F.col("raw_text"), f"(?i)\\b({COMPOUNDS})\\b", 1))
    kinds = lambda b: {"sensor": any_of("proximity|inductive|sensor|m8|m12|m18", b), "threaded": any_of("m5|m8|m12|m18|m23|tubular", b), "dc": F.contains(b, F.lit("dc")) & F.contains(b, F.lit("10-30")), "generic": any_of(GENERIC_WORDS, b), "compound": compound}
    return let(low, lambda b: F.struct(*[c.alias(k) for k, c in kinds(b).items()]))


def enrich(fields: DataFrame) -> DataFrame:
    """Validated fields -> the same with inferred values where a core field is missing.

    ``ai_enriched`` for inferred ones, ``needs_review`` for a material of which only generic words are known. ``signs``
    that ``validated`` left beside the fields are used up; without them a window on product_id finds them.
    """
    f = fields
    if "signs" not in fields.columns:
        w = Window.partitionBy("product_id")
        of = lambda key: F.max(F.when(F.col("field_key") == key, F.col("value"))).over(w)
        f = f.withColumns({"of_product_name": of("product_name"), "of_category": of("category")}).withColumn("signs", signs())
    key, compound = F.col("field_key"), F.col("signs.compound")
    is_open = (F.col("status") == "missing") & F.col("is_core")
    value = (
        F.when((key == "category") & F.col("signs.sensor"), "Inductive Proximity Sensor").when((key == "mounting_type") & F.col("signs.sensor") & F.col("signs.threaded"), "Threaded")
        .when((key == "material") & compound.isNotNull(), compound).when((key == "voltage_rating") & F.col("signs.dc"), "30")
    )
    sure = F.when(key == "category", 0.75).when(key == "mounting_type", 0.82).when(key == "material", 0.88).otherwise(0.70)
    withheld = is_open & (key == "material") & compound.isNull() & F.col("signs.generic")
    filled = is_open & value.isNotNull()
    return f.withColumns(
        {
            "value": F.when(filled, value).otherwise(F.col("value")), "value_num": F.when(filled, to_double(value)).otherwise(F.col("value_num")),
            "unit": F.when(filled & (key == "voltage_rating"), "V").otherwise(F.col("unit")), "confidence": F.when(filled, sure).otherwise(F.col("confidence")),
            "reasoning": F.when(filled, "inferred from the product's domain").when(withheld, "generic material words only").otherwise(F.col("reasoning")),
            "status": F.when(filled, "ai_enriched").when(withheld, "needs_review").otherwise(F.col("status")),
        }
    ).drop("signs", "of_product_name", "of_category")


def latest_actions(reviews: DataFrame) -> DataFrame:
    """The last action per product and field, by time, then value: a maximum, pre-aggregated, so a hot product is no one's burden."""
    rest = ["action", "new_value", "new_unit"]
    return reviews.groupBy("product_id", "field_key").agg(F.max(F.struct("ts", *rest)).alias("r")).select("product_id", "field_key", "r.*")


def apply_reviews(fields: DataFrame, reviews: DataFrame) -> DataFrame:
    """Approve verifies at full confidence, reject empties the field, override sets value and unit; other actions change nothing."""
    r = latest_actions(reviews).select("product_id", "field_key", F.lower("action").alias("action"), "new_value", "new_unit")
    f = fields.join(r, ["product_id", "field_key"], "left")
    a = F.coalesce("action", F.lit(""))
    return f.withColumns(
        {
            "value": F.when(a == "reject", None).when(a == "override", F.col("new_value")).otherwise(F.col("value")), "unit": F.when(a == "reject", None).when(a == "override", F.coalesce("new_unit", "unit")).otherwise(F.col("unit")),
            "status": F.when(a.isin("approve", "override"), "verified").when(a == "reject", "missing").otherwise(F.col("status")), "confidence": F.when(a.isin("approve", "override"), 1.0).when(a == "reject", 0.0).otherwise(F.col("confidence")),
            "is_reviewed": a.isin("approve", "reject", "override"),
        }
    ).withColumn("value_num", to_double(F.col("value"))).drop("action", "new_value", "new_unit")


def review_queue(fields: DataFrame, status: str | None = None) -> DataFrame:
    """Fields that wait for a person (K14: needs_review is among them), of one status if given."""
    waiting = F.contains("status", F.lit("flagged")) | F.col("status").isin("missing", "ai_enriched", "needs_review")
    return fields.where(waiting if status is None else waiting & (F.col("status") == status))


def search(products: DataFrame, text: str) -> DataFrame:
    """``id, name, category, ip_rating, origin``: the text in any, case aside; in the id as written."""
    low = F.lit(text.lower())
    anywhere = F.contains("id", F.lit(text))
    for c in ("name", "category", "ip_rating", "origin"):
        anywhere = anywhere | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), low)
    return products.where(anywhere)
