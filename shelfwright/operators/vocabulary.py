"""Validation against controlled vocabularies: classpath -> attribute -> permitted values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent, value_key
from .similarity import best_matches

SUGGEST_CUTOFF = 0.7


def lov_tables(lov: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loaded rows (``ordinal, classpath, label, normalized_label, values_raw, filterable, sequence, guidelines``) ->
    attributes ``(classpath, cp_ordinal, label, label_key, normalized_label, filterable, sequence, guidelines, is_open)``
    and values ``(classpath, label_key, value, value_key)``.

    Values split at ``|``, ``;``, line ends, and commas outside brackets; markers for 'none' drop out. Rows of one
    classpath and label are one attribute with the union of their values; its other columns are the first row's.
    """
    rows = lov.where("trim(label) <> ''").withColumns({"label": F.trim("label"), "label_key": value_key(F.col("label"))})
    pieces = F.split("values_raw", r"[|;\n]+|,(?![^(]*\))")
    values = rows.select("classpath", "label_key", "ordinal", F.explode(pieces).alias("value")).withColumn("value", F.trim("value"))
    values = values.where("value <> ''").where(~F.lower("value").isin("n/a", "na", "none", "null", "-"))
    values = values.withColumn("value_key", value_key(F.col("value"))).groupBy("classpath", "label_key", "value_key").agg(F.max_by("value", "ordinal").alias("value"))
    first = lambda c: F.min_by(c, "ordinal").alias(c)
    attributes = rows.groupBy("classpath", "label_key").agg(F.min("ordinal").alias("first_row"), *[first(c) for c in ("label", "normalized_label", "sequence", "guidelines", "filterable")])
    attributes = attributes.withColumns({"sequence": F.col("sequence").try_cast("int"), "filterable": F.coalesce(F.upper(F.trim("filterable")).startswith("Y"), F.lit(False))})
    order = rows.groupBy("classpath").agg(F.min("ordinal").alias("cp_ordinal"))
    listed = values.select("classpath", "label_key").distinct().withColumn("listed", F.lit(True))
    attributes = attributes.join(order, "classpath").join(listed, ["classpath", "label_key"], "left").withColumn("is_open", F.col("listed").isNull()).drop("listed", "first_row")
    return attributes, values


def resolve_classpaths(paths: DataFrame, attributes: DataFrame) -> DataFrame:
    """``classpath`` -> ``classpath, lov_classpath``: itself if known, else the first loaded path of which one is a prefix of the other.

    Prefixes meet by equality: each path that is not known is spelt out in its prefixes, and so is each loaded path.
    """
    known = attributes.select(F.col("classpath").alias("lov_classpath"), "cp_ordinal").distinct().withColumn("k", value_key(F.col("lov_classpath")))
    asked = paths.select("classpath").distinct().withColumn("target", value_key(F.col("classpath")))
    exact = asked.join(known, asked["classpath"] == known["lov_classpath"], "left").select("classpath", "target", "lov_classpath")
    open_paths = exact.where("lov_classpath is null and target <> ''").select("classpath", "target")
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n)))
    some = known.where("k <> ''")
    longer = open_paths.select("classpath", prefixes("target").alias("k")).join(some, "k").select("classpath", "lov_classpath", "cp_ordinal")
    shorter = some.select("lov_classpath", "cp_ordinal", prefixes("k").alias("target")).join(open_paths, "target").select("classpath", "lov_classpath", "cp_ordinal")
    near = longer.unionByName(shorter).groupBy("classpath").agg(F.min_by("lov_classpath", "cp_ordinal").alias("near"))
    return exact.join(near, "classpath", "left").select("classpath", F.coalesce("lov_classpath", "near").alias("lov_classpath"))


def validate(rows: DataFrame, attributes: DataFrame, values: DataFrame, suggest: bool = True) -> DataFrame:
    """``row_id, classpath, label, value`` -> the same with ``outcome, canonical, suggestion``.

    Outcomes: blank (not counted), no_classpath, not_applicable, open (not counted), in_vocabulary, not_permitted.
    ``canonical`` is the approved spelling of a value in the vocabulary.
    """
    paths = resolve_classpaths(rows, attributes)
    keyed = rows.withColumns({"label_key": value_key(F.col("label")), "value_key": value_key(F.col("value"))}).join(paths, "classpath", "left")
    a = attributes.select(F.col("classpath").alias("lov_classpath"), "label_key", "is_open")
    v = values.select(F.col("classpath").alias("lov_classpath"), "label_key", "value_key", F.col("value").alias("canonical"))
    joined = keyed.join(a, ["lov_classpath", "label_key"], "left").join(v, ["lov_classpath", "label_key", "value_key"], "left")
    outcome = (
        F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "blank").when(F.col("lov_classpath").isNull(), "no_classpath").when(F.col("is_open").isNull(), "not_applicable").when(F.col("is_open"), "open")
    ).otherwise(F.when(F.col("canonical").isNotNull(), "in_vocabulary").otherwise("not_permitted"))
    out = joined.withColumn("outcome", outcome)
    if not suggest:
        return out.withColumn("suggestion", F.lit(None).cast("string")).select(*rows.columns, "outcome", "canonical", "suggestion")
    wrong_value = out.where("outcome = 'not_permitted'").select("lov_classpath", "label_key", F.col("value_key").alias("key"))
    near_value = best_matches(wrong_value, values.select(F.col("classpath").alias("lov_classpath"), "label_key", F.col("value_key").alias("key")), SUGGEST_CUTOFF, ["lov_classpath", "label_key"])
    near_value = near_value.select("lov_classpath", "label_key", F.col("key").alias("value_key"), F.col("match").alias("m")).join(v.withColumnRenamed("value_key", "m").withColumnRenamed("canonical", "near_value"), ["lov_classpath", "label_key", "m"]).drop("m")
    wrong_label = out.where("outcome = 'not_applicable'").select("lov_classpath", F.col("label_key").alias("key"))
    labels = attributes.select(F.col("classpath").alias("lov_classpath"), F.col("label_key").alias("key"), "label")
    near_label = best_matches(wrong_label, labels, SUGGEST_CUTOFF, ["lov_classpath"]).select("lov_classpath", F.col("key").alias("label_key"), F.col("match").alias("key")).join(labels, ["lov_classpath", "key"]).select("lov_classpath", "label_key", F.col("label").alias("near_label"))
    lost = out.where("outcome = 'no_classpath'").select(value_key(F.col("classpath")).alias("key")).distinct()
    known = attributes.groupBy("classpath").agg(F.min("cp_ordinal").alias("o")).select(value_key(F.col("classpath")).alias("key"), F.col("classpath").alias("near_path"), "o").groupBy("key").agg(F.min_by("near_path", "o").alias("near_path"))
    near_path = best_matches(lost, known, SUGGEST_CUTOFF).select(F.col("key").alias("path_key"), F.col("match").alias("key")).join(known, "key").select("path_key", "near_path")
    out = out.join(near_value, ["lov_classpath", "label_key", "value_key"], "left").join(near_label, ["lov_classpath", "label_key"], "left")
    out = out.withColumn("path_key", value_key(F.col("classpath"))).join(near_path, "path_key", "left")
    suggestion = F.when(F.col("outcome") == "not_permitted", F.col("near_value")).when(F.col("outcome") == "not_applicable", F.col("near_label")).when(F.col("outcome") == "no_classpath", F.col("near_path"))
    return out.withColumn("suggestion", suggestion).select(*rows.columns, "outcome", "canonical", "suggestion")


def compliance(validated: DataFrame, *keys: str) -> DataFrame:
    """Totals (per ``keys`` if given): checked, in_vocabulary, corrected, violations, open_skipped, and the percentage, null where nothing was checked."""
    is_in = F.col("outcome") == "in_vocabulary"
    checked = F.col("outcome").isin("in_vocabulary", "not_applicable", "not_permitted")
    out = validated.groupBy(*keys).agg(
        F.count_if(checked).alias("checked"), F.count_if(is_in).alias("in_vocabulary"), F.count_if(is_in & (F.col("canonical") != F.col("value"))).alias("corrected"),
        F.count_if(F.col("outcome").isin("not_applicable", "not_permitted", "no_classpath")).alias("violations"), F.count_if(F.col("outcome") == "open").alias("open_skipped"),
        F.count_distinct(F.when(F.col("outcome") == "no_classpath", F.col("row_id"))).alias("rows_without_classpath"),
    )
    return out.withColumn("lov_compliance_pct", percent(F.col("in_vocabulary"), F.col("checked")))


def adopted(validated: DataFrame) -> DataFrame:
    """The rows with approved spellings taken over."""
    return validated.withColumn("value", F.coalesce("canonical", "value"))
