"""The operators composed: catalogue rows to scored content, texts to records, the commerce report."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import meaningful
from ..operators import attributes, classify, dedup, delivery, describe, discover, enrich, evaluate, identity, trust, validate, vocabulary
from ..operators.staging import settled
from ..sources import store as stored


def process_texts(texts: DataFrame, inferred: bool = True) -> DataFrame:
    """Product texts -> validated (and, if asked, enriched) fields."""
    fields = validate.validated(texts, {"signs": enrich.signs()} if inferred else None)
    return enrich.enrich(fields) if inferred else fields


def process_batch(batch: DataFrame, pages: DataFrame, chosen_policy: str = "manufacturer_only", inferred: bool = True) -> tuple[DataFrame, DataFrame, Observation]:
    """Addresses -> fields of their pages, dead letters ``url, stage, reason``, and counts of both: one failure stops nothing.

    A product's id is its address. The counts (``asked, processed, sparse`` and one a stage) are observed while the outcomes
    of whichever of the two tables is written first pass by, so they cost no pass of their own.
    """
    counts = Observation("batch")
    of = lambda stage: F.count_if(F.col("stage") == stage).alias(stage)
    outcomes = discover.batch_outcomes(batch, pages, chosen_policy).observe(
        counts, F.count(F.lit(1)).alias("asked"), F.count_if(F.col("stage").isNull()).alias("processed"), F.count_if(F.col("stage").isNull() & (F.col("reason") == "sparse page")).alias("sparse"), *[of(s) for s in ("sourcing", "fetch", "content")]
    )
    texts = outcomes.where("stage is null").select(F.col("url").alias("product_id"), F.col("text").alias("raw_text"), F.col("title").alias("name_hint"), F.lit(None).cast("string").alias("category_hint"))
    return process_texts(texts, inferred), outcomes.where("stage is not null").select("url", "stage", "reason"), counts


def save_batch(batch: DataFrame, pages: DataFrame, store: str, letters: str, version: int, buckets: int = stored.BUCKETS, chosen_policy: str = "manufacturer_only") -> dict[str, int]:
    """Summaries of a batch into the store, its failures into ``<letters>/version=<n>``, and the counts. Run again, it gives the same."""
    fields, dead, counts = process_batch(batch, pages, chosen_policy)
    dead.write.mode("overwrite").parquet(f"{letters}/version={version}")
    stored.upsert_store(validate.summarize(fields), store, version, "product_id", buckets=buckets)
    return counts.get


def records_of(fields: DataFrame, include_enriched: bool = False, known: DataFrame | None = None) -> DataFrame:
    return trust.records(trust.gate(fields, include_enriched), known)


def catalog_content(rows: DataFrame, labels: DataFrame, brands: DataFrame, lov: tuple[DataFrame, DataFrame] | None = None, suggest: bool = True) -> dict[str, DataFrame]:
    """Catalogue rows -> the survivors' content: ``survivors, classified, attributes, validated, resolved, descriptions``.

    Order: dedup first, then each distinct description is classified once and each distinct brand string resolved once.
    Survivors, and their classification, are worked out and stored once, as several parts read them.
    """
    kept = settled(dedup.survivors(rows))
    classified = settled(classify.classify(kept, labels, source="lov" if lov else "fallback"))
    attrs = attributes.attribute_rows(classified)
    validated = None
    if lov is not None:
        long = attrs.join(classified.select("row_index", "classpath"), "row_index").select(F.col("row_index").alias("row_id"), "classpath", "label", "value")
        validated = vocabulary.validate(long, *lov, suggest=suggest)
        attrs = attrs.join(validated.select(F.col("row_id").alias("row_index"), "label", "canonical"), ["row_index", "label"], "left").withColumn("value", F.coalesce("canonical", "value")).drop("canonical")
    brand_columns = [c for c in ("Unilog_Brand", "E1_Brand", "DIB_Brand", "Part_Manuf") if c in rows.columns]
    named = classified.withColumn("brand_input", F.coalesce(*[meaningful(F.col(c)) for c in brand_columns]))
    resolved = identity.resolve_brands(named, brands, "brand_input")
    entry = F.struct("pos", "label", "value", "unit", F.lit(True).alias("is_key"))
    packed = attrs.groupBy("row_index").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("pos")).alias("attributes"))
    none = F.array().cast("array<struct<label:string,value:string,unit:string,is_key:boolean>>")
    sure = ~F.col("brand_review")
    records = resolved.join(packed, "row_index", "left").select(
        F.col("row_index").alias("product_id"), F.coalesce(F.when(sure, F.col("brand_name")), F.col("brand_input")).alias("brand"), F.when(sure, F.col("manufacturer_name")).alias("manufacturer"), F.lit(None).cast("string").alias("series"),
        F.col("Mfg_Part_Num").alias("mpn"), "item_type", F.coalesce("attributes", none).alias("attributes"), F.array().cast("array<string>").alias("features"),
    )
    return {"survivors": kept, "classified": classified, "attributes": attrs, "validated": validated, "resolved": resolved, "descriptions": describe.descriptions(records)}


def scored_content(content: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """Accuracy of the generated invoice and title texts and item types against the truth."""
    wide = content["descriptions"].groupBy("product_id").agg(*[F.max(F.when(F.col("format") == k, F.col("text"))).alias(c) for k, c in (("invoice", "INVOICE_DESC"), ("mobile", "MOBILE_DESC"), ("title", "SHORT_DESC"))])
    made = content["classified"].select(F.col("row_index").alias("product_id"), "Mfg_Part_Num", F.col("item_type").alias("Item_Type")).join(wide, "product_id").drop("product_id")
    return evaluate.accuracy(evaluate.compared(made, truth))


def newest(products: DataFrame, n: int, order: str = "created_at", key: str = "product_id") -> DataFrame:
    """The ``n`` newest products (one at least), ties by key: a report over the latest part of a store."""
    return products.orderBy(F.desc(order), key).limit(max(1, n))


def _named(fields: DataFrame) -> DataFrame:
    """``product_id, name, category, part_text``: what a product is classified by."""
    of = lambda key: F.coalesce(F.max(F.when(F.col("field_key") == key, F.col("value"))), F.lit(""))
    wide = fields.groupBy("product_id").agg(of("product_name").alias("name"), of("category").alias("category"))
    return wide.withColumn("part_text", F.trim(F.concat_ws(" ", "name", "category")))


def product_view(fields: DataFrame, product_id: str, labels: DataFrame, include_enriched: bool = False) -> DataFrame:
    """One product: a row per description format, with its trust totals and its classification beside it."""
    mine = fields.where(F.col("product_id") == product_id)
    gated = trust.gate(mine, include_enriched)
    kind = classify.classify(_named(mine), labels, text="part_text").select("product_id", F.coalesce("item_type", F.when(F.col("category") != "", F.col("category"))).alias("item_type"), "classpath", F.round("confidence", 3).alias("confidence"), "method", "needs_review")
    records = trust.records(gated).drop("item_type").join(kind.select("product_id", "item_type"), "product_id")
    return describe.descriptions(records).join(trust.totals(gated, "product_id"), "product_id").join(kind, "product_id")


def delivery_rows(fields: DataFrame, given: DataFrame, lov: tuple[DataFrame, DataFrame] | None = None, features: DataFrame | None = None, include_enriched: bool = False) -> DataFrame:
    """The whole delivery table: ``given`` (see ``delivery.identified``) with identity, classification and descriptions.

    Products are classified among the vocabulary's leaves, or the built-in types, and their own categories. A classpath
    gives Classpath, Dept, Class and Fine; without one the type stands in Classpath and Class, with a warning.
    Descriptions name the resolved maker, brand and part number. ``warnings`` holds those of all parts.
    """
    fields = settled(fields)
    spark = fields.sparkSession
    who = settled(delivery.identified(fields, given))
    shown = fields.where(delivery.exportable())
    own_types = shown.where("field_key = 'category'").select(F.col("value").alias("label")).distinct()
    labels = classify.candidates(spark, lov[0] if lov else None, own_types)
    kinds = classify.classify(_named(shown), labels, text="part_text", source="lov" if lov else "fallback")
    kinds = settled(kinds.select("product_id", "classpath", F.coalesce("item_type", F.when(F.col("category") != "", F.col("category"))).alias("kind")))
    out = who.join(kinds, "product_id", "left").withColumn("levels", F.filter(F.transform(F.split("classpath", ">"), lambda x: F.trim(x)), lambda x: x != ""))
    flat = F.col("classpath").isNull() & F.col("kind").isNotNull()
    level = lambda n: F.coalesce(F.try_element_at("levels", F.lit(n)), F.lit(""))
    said = F.concat("identity_warnings", F.array_compact(F.array(F.when(flat, "no taxonomy: the item type stands for the classpath"))))
    out = out.withColumns({"Classpath": F.coalesce("classpath", "kind", F.lit("")), "Dept": level(1), "Class": F.when(flat, F.col("kind")).otherwise(level(2)), "Fine": level(3), "said": said}).drop("levels", "identity_warnings")
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    known = who.select("product_id", blank("BRAND_NAME").alias("brand"), blank("MANUFACTURER_NAME").alias("manufacturer"), F.lit(None).cast("string").alias("series"), blank("Mfg_Part_Num").alias("mpn"))
    records = records_of(fields, include_enriched, known).drop("item_type").join(kinds.select("product_id", F.col("kind").alias("item_type")), "product_id", "left")
    made = delivery.delivery(fields, out.drop("kind", "said"), describe.descriptions(records), features)
    return made.join(out.select("product_id", "said"), "product_id").withColumn("warnings", F.concat("said", "warnings")).drop("said")


def commerce_report(texts: DataFrame, labels: DataFrame, lov: tuple[DataFrame, DataFrame] | None = None, limit: int | None = None, include_enriched: bool = False, approved: DataFrame | None = None) -> DataFrame:
    """One row over a catalogue of texts (of its ``limit`` newest by ``created_at``, if asked): trust totals, description
    compliance, field summary, classification, vocabulary totals, duplicates, and the sourcing policy that holds.

    Fields are worked out once: trust totals are observed as they pass by into storage, which each other section reads as
    one aggregate. The row is ready when this returns, and the stored fields are gone; nothing but totals reaches the driver.
    """
    spark = texts.sparkSession
    observed = Observation("trust")
    gated = trust.gate(process_texts(texts if limit is None else newest(texts, limit)), include_enriched)
    gated = gated.observe(observed, *trust.total_counts()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        gated.write.format("noop").mode("overwrite").save()
        sections = _sections(gated, labels, lov)
        rows = [spark.createDataFrame([tuple(observed.get[c] for c in trust.TOTALS)], ", ".join(f"{c} long" for c in trust.TOTALS)).transform(trust.with_share), *sections]
        kinds = [f for df in rows for f in df.schema.fields]
        values = [v for df in rows for v in df.first()]
    finally:
        gated.unpersist()
    return spark.createDataFrame([tuple(values)], StructType([StructField(f.name, f.dataType) for f in kinds])).withColumns({"policy": F.lit("manufacturer_only"), "approved_list": F.lit(approved is not None)})


def _sections(gated: DataFrame, labels: DataFrame, lov: tuple[DataFrame, DataFrame] | None) -> list[DataFrame]:
    """One row each: description compliance, field summary, classification, duplicates, and vocabulary totals if there is one."""
    fields = gated.drop("admitted", "reason")
    kinds = classify.classify(_named(fields), labels, text="part_text", source="lov" if lov else "fallback")
    types = kinds.select("product_id", "name", F.coalesce("item_type", F.when(F.col("category") != "", F.col("category"))).alias("kind"))
    records = trust.records(gated).join(types, "product_id", "left").withColumn("item_type", F.col("kind")).drop("kind")
    prefixed = lambda df, prefix: df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])
    rows = records.select(F.xxhash64("product_id").alias("row_index"), F.coalesce("mpn", "product_id").alias("Mfg_Part_Num"), F.coalesce("brand", F.lit("")).alias("Part_Manuf"), F.col("name").alias("Part_Desc"))
    out = [describe.compliance(describe.descriptions(records.drop("name"))).drop("failing"), validate.catalog_stats(validate.summarize(fields)), prefixed(classify.classification_stats(kinds), "types"), prefixed(dedup.dedup_report(rows), "dedup")]
    if lov is not None:
        public = F.create_map(*[F.lit(x) for k, label, _ in trust.ATTRIBUTES for x in (k, label)])
        asked = fields.where("value is not null").withColumn("label", F.try_element_at(public, F.col("field_key"))).where("label is not null")
        asked = asked.join(kinds.where("classpath is not null").select("product_id", "classpath"), "product_id").select(F.col("product_id").alias("row_id"), "classpath", "label", "value")
        out.append(prefixed(vocabulary.compliance(vocabulary.validate(asked, *lov, suggest=False)), "lov"))
    return out
