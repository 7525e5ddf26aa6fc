"""Readers and writers: every one a Spark read or write with the columns that the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extra_key
from ..operators.sourcing import approved_domains

BRAND_NAMES = {
    "MANUFACTURER_NAME": ["manufacturer_name", "manufacturer", "mfr_name"], "MANUFACTURER_CODE": ["manufacturer_code", "mfr_code"], "BRAND_NAME": ["brand_name", "brand"], "BRAND_CODE": ["brand_code"],
}
LOV_NAMES = {
    "classpath": ["classpath", "class_path", "category_path"], "label": ["label", "attribute_label", "attribute", "attribute_name"], "normalized_label": ["normalized_label", "normalised_label"],
    "values_raw": ["normalized_values", "normalised_values", "values_raw", "permitted_values", "values", "lov"], "filterable": ["filterable", "is_filterable"], "sequence": ["sequence", "display_sequence"], "guidelines": ["guidelines", "notes"],
}


def read_table(spark: SparkSession, path: str | list[str], fmt: str = "parquet", placed: bool = False) -> DataFrame:
    """Parquet, or CSV/TSV with a header and every column as text; one file, a folder, or many of them.

    ``placed`` adds where each row comes from: ``source_name`` (the file's name without its ending) and ``ordinal``, which
    orders rows by file path, then by place in the file. It does not depend on how Spark splits or packs the files: a
    Parquet row has its index, a text row the start of its block and then its place in the order of reading within it.
    """
    if fmt == "parquet":
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    else:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    if not placed:
        return df
    block, row = (F.lit(0).cast("long"), F.col("_metadata.row_index")) if fmt == "parquet" else (F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    ordinal = F.struct(F.lit(0).alias("table"), F.col("_metadata.file_path").alias("path"), block.alias("block"), row.cast("long").alias("row"))
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return df.select("*", F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "").alias("source_name"), ordinal.alias("ordinal"))


def load_items(spark: SparkSession, path: str | list[str], fmt: str = "csv", placed: bool = False) -> DataFrame:
    """Catalogue rows: blanks as null, rows without any value dropped, unnamed columns as ``col_<n>``; ``ordinal`` if ``placed``."""
    df = read_table(spark, path, fmt, placed)
    place = ["ordinal"] if placed else []
    given = [c for c in df.columns if not placed or c not in ("source_name", "ordinal")]
    names = [c if c and not c.startswith("_c") else f"col_{n}" for n, c in enumerate(given)]
    df = df.select(*given, *place).toDF(*names, *place)
    blank = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`")).alias(c) for c in names]
    return df.select(*blank, *place).na.drop("all", subset=names)


def load_pair(spark: SparkSession, given: str, truth: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Input rows and the rows that they should become; of truth rows with one key the first in the file counts, by ``ordinal``."""
    return load_items(spark, given, fmt), load_items(spark, truth, fmt, placed=True)


def renamed(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns by any of their known names (case, blanks and hyphens aside); absent ones as null text."""
    there = {c.lower().strip().replace(" ", "_").replace("-", "_"): c for c in df.columns}
    pick = lambda known: next((F.col(f"`{there[k]}`").cast("string") for k in known if k in there), F.lit(None).cast("string"))
    return df.select(*[pick(known).alias(c) for c, known in names.items()], *[F.col(c) for c in ("ordinal", "source_name") if c in df.columns and c not in names])


def _ordered(df: DataFrame, table: int = 0) -> DataFrame:
    """``ordinal`` as the structure that ``read_table`` gives, led by the number of the table; a table without one has no
    order of its own, and its rows are ordered by their values."""
    kind = dict(df.dtypes).get("ordinal", "")
    if kind.startswith("struct"):
        ordinal = F.col("ordinal").withField("table", F.lit(table))
    else:
        row = F.col("ordinal").cast("long") if kind else F.lit(0).cast("long")
        path = F.lit("") if kind else F.to_json(F.struct(*df.columns)) if df.columns else F.lit("")
        ordinal = F.struct(F.lit(table).alias("table"), path.alias("path"), F.lit(0).cast("long").alias("block"), row.alias("row"))
    return df.withColumn("ordinal", ordinal)


def load_brands(df: DataFrame) -> DataFrame:
    out = renamed(_ordered(df), BRAND_NAMES)
    return out.where("trim(coalesce(MANUFACTURER_NAME, '')) <> '' or trim(coalesce(BRAND_NAME, '')) <> ''")


def load_lov(*tables: DataFrame) -> DataFrame:
    """Vocabulary rows of one or more tables, in order. Rows without a classpath belong to that of their ``source_name``,
    the file that ``read_table(placed=True)`` has read them from."""
    out = None
    for n, df in enumerate(tables):
        part = renamed(_ordered(df, n), LOV_NAMES)
        if "source_name" in df.columns:
            part = part.withColumn("classpath", F.coalesce(F.when(F.trim("classpath") != "", F.col("classpath")), F.col("source_name"))).drop("source_name")
        out = part if out is None else out.unionByName(part)
    return out


def load_vocabulary(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """Vocabulary rows of many files at once, as ``load_lov`` gives them: a file without classpaths is one of its own."""
    return load_lov(read_table(spark, path, fmt, placed=True))


def load_units(seed: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``variant, approved``: the file's forms over the seed's, each approved form also standing for itself."""
    from ..functions.units import unit_key

    rows = seed.select(unit_key(F.col("variant")).alias("variant"), "approved", F.lit(1).alias("rank"))
    if extra is not None:
        both = F.explode(F.array(F.col("variant"), F.col("approved")))
        rows = rows.unionByName(extra.select(both.alias("v"), "approved").select(unit_key(F.col("v")).alias("variant"), "approved", F.lit(0).alias("rank")))
    return rows.groupBy("variant").agg(F.min_by("approved", F.struct("rank", "approved")).alias("approved"))


def load_approved_domains(spark: SparkSession, path: str) -> DataFrame:
    return approved_domains(spark.read.text(path))


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("id string, name string, category_hint string, raw_input string, description string").json(path)


def product_texts(samples: DataFrame) -> DataFrame:
    return samples.select(F.col("id").alias("product_id"), F.col("raw_input").alias("raw_text"), F.col("name").alias("name_hint"), "category_hint")


def seed(existing: DataFrame, samples: DataFrame, key: str = "id") -> DataFrame:
    """The store with samples that it lacks: running it again changes nothing."""
    return existing.unionByName(samples.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(existing: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """New rows in place of old ones of the same key; of several new ones the last by ``order`` (else the greatest row)."""
    columns = [c for c in new.columns if c != key]
    rank = F.struct(*([F.col(order)] if order else []), *[F.col(c).cast("string") for c in columns])
    last = new.groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("r")).select(key, "r.*")
    return existing.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def point(store: DataFrame, value: str, key: str = "id") -> DataFrame:
    return store.where(F.col(key) == value)


def listing(store: DataFrame, schema: str) -> DataFrame:
    """Stored JSON records (``id, created_at, data_json``), newest first; unreadable ones are left out."""
    parsed = store.withColumn("record", F.from_json("data_json", schema, {"mode": "PERMISSIVE"}))
    return parsed.where(F.col("record").isNotNull() & F.get_json_object("data_json", "$").isNotNull()).orderBy(F.desc("created_at"), "id")


def as_json(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("data_json"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def reset(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").parquet(path)


def field_key(label: Column) -> Column:
    return extra_key(label)
