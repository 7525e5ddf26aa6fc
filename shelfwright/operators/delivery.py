"""The fixed delivery table: 252 columns, attributes packed in slots, features, logistics, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_number, extra_key, literal_map
from ..functions.units import normalized_unit
from .trust import non_product
from .validate import summary_counts, with_status

SLOTS, FEATURES = 50, 20
# The delivery header, in order.
_HEAD = [
    "MFR URL", "Ref URL 1", "Ref URL 2", "Ref URL 3", "Ref URL 4", "Ref URL 5", "PART_NUMBER", "Dept", "Class", "Fine", "SKU - MY_PART_NUMBER", "Mfg_Part_Num", "Part_Desc", "E1_Brand",
    "Unilog_Brand", "DIB_Brand", "Part_Manuf", "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME", "MANUFACTURER_PART_NUMBER", "ALTERNATE_PART_NUMBER", "Classpath", "MOBILE_DESC",
    "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION",
]
_MIDDLE = [
    "With", "Standard/Approvals", "Prop 65", "Application", "Includes", "Product Name",
]
_TAIL = [
    "UPC", "EAN", "GTIN", "UNSPSC", "Warranty", "List Price", "Selling Qty", "Selling UOM", "Standard Packaging Information", "LENGTH", "LENGTH_UOM", "HEIGHT", "HEIGHT_UOM", "WIDTH",
    "WIDTH_UOM", "WEIGHT", "WEIGHT_UOM", "VOLUME", "VOLUME_UOM", "Product Image", "Alternate Image 1", "Alternate Image 2", "Alternate Image 3", "Alternate Image 4", "SDS", "SDS_1",
    "Warranty Information", "Catalog", "Specification Sheet", "Instruction/Installation Manual", "Service Manual", "Owners/User Manual", "Line Drawing", "MTR", "RoHS",
    "Full Engineering Drawing", "Energy Star Guide", "Technical Bulletin", "Submittal", "Compatibility Chart", "Size Chart", "Product Label/Insert", "Video Link", "Video Link 1",
    "Country Of Origin", "Discontinued", "Actual Image (Yes/No)",
]
HEADERS = [*_HEAD, *(f"ITEM_FEATURES_{n}" for n in range(1, FEATURES + 1)), *_MIDDLE, *(f"ATTRIBUTE_{part} {n}" for n in range(1, SLOTS + 1) for part in ("LABEL", "VALUE", "UOM")), *_TAIL]
#: Extras that have a column of their own (white space, hyphens and underscores aside).
LOGISTICS = {
    "weight": "WEIGHT", "mass": "WEIGHT", "netweight": "WEIGHT", "itemweight": "WEIGHT", "upc": "UPC", "itemupc": "UPC", "ean": "EAN", "ean13": "EAN", "gtin": "GTIN", "gtin12": "GTIN", "gtin13": "GTIN", "gtin14": "GTIN",
    "unspsc": "UNSPSC", "countryoforigin": "Country Of Origin", "country": "Country Of Origin", "length": "LENGTH", "width": "WIDTH", "height": "HEIGHT", "volume": "VOLUME",
}
WITH_UNIT = ["WEIGHT", "LENGTH", "WIDTH", "HEIGHT", "VOLUME"]
#: Extras that name the product, by what they name.
IDENTITY_KEYS = {
    "manufacturer": ["manufacturer", "manufacturername", "mfr", "mfrname"], "brand": ["brand", "brandname"],
    "mpn": ["mpn", "mfgpartnum", "manufacturerpartnumber", "manufacturerpartno", "partnumber", "modelnumber", "modelno"],
}
IDENTITY = [key for keys in IDENTITY_KEYS.values() for key in keys]
CORE_ORDER = ["voltage_rating", "current_rating", "ip_rating", "connector_type", "operating_temperature_min", "operating_temperature_max", "material", "mounting_type"]
# Spellings of brands and manufacturers.
BRANDS = {"dewalt": "DEWALT", "dewlt": "DEWALT", "blackdecker": "BLACK+DECKER", "blackanddecker": "BLACK+DECKER"}
MAKERS = {
    "stanleyblackdecker": "Stanley Black & Decker", "stanleyblackanddecker": "Stanley Black & Decker", "blackdeckerdewalt": "Stanley Black & Decker", "blackanddeckerdewalt": "Stanley Black & Decker",
    "blackdeckerdewlt": "Stanley Black & Decker", "blackanddeckerdewlt": "Stanley Black & Decker",
}


def compact_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s_-]+", "")


def canonical(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(literal_map(names), F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")), F.trim(c))


def safe_mpn(c: Column) -> Column:
    """Whether a text can be a part number: one line of 80 characters at most that names no trade item code."""
    return F.coalesce((F.trim(c) != "") & (F.length(F.trim(c)) <= 80) & ~F.trim(c).rlike(r"[\n\r]") & ~c.rlike(r"(?i)\b(?:UPC|EAN|GTIN)\b"), F.lit(False))


def exportable() -> Column:
    return ~F.col("status").isin("missing", "not_applicable") & (F.trim(F.coalesce("value", F.lit(""))) != "")


def identified(fields: DataFrame, given: DataFrame) -> DataFrame:
    """``given`` (``product_id``, and any of ``mpn, manufacturer, brand, manufacturer_url, source_url``) with what the
    delivery row says of the product's identity: ``Mfg_Part_Num, MANUFACTURER_PART_NUMBER, MANUFACTURER_NAME, BRAND_NAME,
    MFR URL, identity_warnings``.

    The part number is the given one if it is safe, else the first safe extra of that meaning, else what the name begins
    with. Manufacturer and brand are the first extra of that meaning, else as given, in their canonical spelling. The URL
    is the given one, else the source if its site is a manufacturer's.
    """
    from .sourcing import policy

    there = given.columns
    of = lambda c: F.trim(F.col(c)) if c in there else F.lit(None).cast("string")
    key, label = compact_key(F.col("field_key")), compact_key(F.col("label"))
    extras = fields.where(exportable() & (~F.col("is_core") | (F.col("field_key") == "product_name")))
    extras = extras.withColumns({k: ~F.col("is_core") & (key.isin(names) | label.isin(names)) for k, names in IDENTITY_KEYS.items()})
    first = lambda k, more=F.lit(True): F.min_by(clean_number(F.col("value")), F.when(F.col(k) & more, F.col("pos"))).alias(f"own_{k}")
    name = F.max(F.when(F.col("field_key") == "product_name", F.col("value"))).alias("own_name")
    own = extras.groupBy("product_id").agg(first("manufacturer"), first("brand"), first("mpn", safe_mpn(F.col("value"))), name)
    out = given.join(own, "product_id", "left")
    named = F.regexp_extract(F.upper(F.coalesce("own_name", F.lit(""))), r"^\s*([A-Z0-9]{2,}(?:[-/][A-Z0-9]+)+)", 1)
    safe = lambda c: F.when(safe_mpn(c), c)
    out = out.withColumns({"raw_maker": F.coalesce("own_manufacturer", of("manufacturer"), F.lit("")), "raw_brand": F.coalesce("own_brand", of("brand"), F.lit("")), "the_mpn": F.coalesce(safe(of("mpn")), "own_mpn", safe(named), F.lit(""))})
    out = out.withColumns({"MANUFACTURER_NAME": canonical(F.col("raw_maker"), MAKERS), "BRAND_NAME": canonical(F.col("raw_brand"), BRANDS), "Mfg_Part_Num": F.col("the_mpn"), "MANUFACTURER_PART_NUMBER": F.col("the_mpn")})
    no_site = F.lit(None).cast("string")
    if "source_url" in there:
        sites = policy(given.where("source_url is not null").select("source_url").distinct(), url="source_url").select("source_url", F.col("category").alias("site"))
        out, no_site = out.join(sites, "source_url", "left"), F.col("site")
    used = F.coalesce(no_site == "manufacturer", F.lit(False))
    told = of("manufacturer_url")
    url = F.when(F.coalesce(told, F.lit("")) != "", told).when(used, of("source_url")).otherwise("")
    warnings = F.array_compact(
        F.array(
            F.when((F.coalesce(of("mpn"), F.lit("")) != "") & ~safe_mpn(of("mpn")), F.concat(F.lit("part number rejected: "), of("mpn"))),
            F.when(F.col("MANUFACTURER_NAME") != F.col("raw_maker"), F.concat(F.lit("manufacturer spelt "), F.col("raw_maker"))),
            F.when(F.col("BRAND_NAME") != F.col("raw_brand"), F.concat(F.lit("brand spelt "), F.col("raw_brand"))),
            F.when((F.coalesce(told, F.lit("")) == "") & of("source_url").isNotNull() & ~used, F.concat(F.lit("source is no manufacturer's: "), F.coalesce(no_site, F.lit("unknown")))),
        )
    )
    return out.select(*[c for c in there if c not in ("MANUFACTURER_NAME", "BRAND_NAME", "Mfg_Part_Num", "MANUFACTURER_PART_NUMBER", "MFR URL")], "Mfg_Part_Num", "MANUFACTURER_PART_NUMBER", "MANUFACTURER_NAME", "BRAND_NAME", url.alias("MFR URL"), warnings.alias("identity_warnings"))


def routed(fields: DataFrame) -> DataFrame:
    """Exportable fields with where they go: ``target`` (a logistics column, 'slot', or null) and ``slot`` (1, 2, ...).

    Core fields come first in fixed order, then extras as they came. The first usable extra of a logistics column takes
    it, a second one falls through to a slot. Identity, non-product and merged values go nowhere.
    """
    f = fields.where(exportable())
    key, label = compact_key(F.col("field_key")), compact_key(F.col("label"))
    place = F.array_position(F.array(*map(F.lit, CORE_ORDER)), F.col("field_key")).cast("int")
    merged = F.col("value").rlike(r"(?i)\b(?:package|item|product|overall)\s+(?:height|width|length|weight|depth|diameter)\b\s*[:=]?\s*[-+]?[0-9]")
    skip = (F.col("is_core") & (place == 0)) | (~F.col("is_core") & (key.isin(IDENTITY) | label.isin(IDENTITY) | non_product("field_key", "label", F.col("value")) | merged))
    aliases = literal_map(LOGISTICS)
    alias = F.when(~F.col("is_core"), F.coalesce(F.try_element_at(aliases, key), F.try_element_at(aliases, label)))
    f = f.withColumns({"skip": skip, "alias": alias, "order": F.when(F.col("is_core"), place).otherwise(F.col("pos") + 100)})
    first = F.row_number().over(Window.partitionBy("product_id", "alias", "skip").orderBy("order")) == 1
    f = f.withColumn("target", F.when(F.col("skip"), None).when(F.col("alias").isNotNull() & first, F.col("alias")).otherwise("slot"))
    slot = F.sum((F.col("target") == "slot").cast("int")).over(Window.partitionBy("product_id").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    return f.withColumn("slot", F.when(F.col("target") == "slot", slot)).drop("skip", "alias")


def own_unit(f_unit: str = "unit") -> Column:
    """The unit, unless it repeats the label, is 'grit', or stands in the value already."""
    u = F.trim(F.col(f_unit))
    inside = F.regexp_like(F.col("value"), F.concat(F.lit(r"(?i)(?:^|[\s\d/])\Q"), u, F.lit(r"\E(?:\s|/|$)")))
    return F.when((u != "") & (extra_key(u) != extra_key(F.col("label"))) & (F.lower(u) != "grit") & ~inside, normalized_unit(u))


def runtime_conflicts(features: DataFrame) -> DataFrame:
    """``product_id, pos, text`` -> rows to reject: claims of different runtimes for one battery capacity."""
    claim = r"(?i)(\d+(?:\.\d+)?)\s*(?:hours?|hrs?|h)\b.*?(\d+(?:\.\d+)?)\s*Ah\b"
    claims = features.where(F.col("text").rlike(claim)).select("product_id", "pos", F.regexp_extract("text", claim, 1).cast("double").alias("hours"), F.regexp_extract("text", claim, 2).cast("double").alias("capacity"))
    split = claims.groupBy("product_id", "capacity").agg(F.min("hours").alias("lo"), F.max("hours").alias("hi")).where("lo < hi")
    return claims.join(split, ["product_id", "capacity"], "left_semi").select("product_id", "pos").distinct()


def usable_features(features: DataFrame, texts: DataFrame) -> DataFrame:
    """``product_id, features`` ARRAY of at most 20: verbatim in the product's text, free of runtime conflicts, in order."""
    f = features.where("trim(text) <> ''").join(texts.select("product_id", "raw_text"), "product_id").where("contains(raw_text, trim(text))").join(runtime_conflicts(features), ["product_id", "pos"], "left_anti")
    return f.groupBy("product_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("text")))), lambda x: x["text"]), 1, FEATURES).alias("item_features"))


def delivery(fields: DataFrame, identity: DataFrame, texts: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """One row per product of ``identity`` (``product_id`` and any of the header's columns): product_id, the 252 columns
    in order (blanks as ''), ``slots_used, warnings``. ``texts`` is the long output of ``descriptions``."""
    r = routed(fields)
    entry = F.struct("slot", F.col("label"), clean_number(F.col("value")).alias("value"), F.coalesce(own_unit(), F.lit("")).alias("uom"))
    of = lambda key: F.max(F.when(F.col("field_key") == key, F.col("value")))
    fixed = {c: F.max(F.when(F.col("target") == c, clean_number(F.col("value")))).alias(c) for c in sorted(set(LOGISTICS.values()))}
    units = {f"{c}_UOM": F.max(F.when(F.col("target") == c, own_unit())).alias(f"{c}_UOM") for c in WITH_UNIT}
    packed = r.groupBy("product_id").agg(F.array_sort(F.collect_list(F.when(F.col("target") == "slot", entry))).alias("slots"), of("product_name").alias("Product Name"), of("certifications").alias("Standard/Approvals"), of("category").alias("Classpath"), *fixed.values(), *units.values())
    out = identity.join(packed, "product_id", "left")
    made = ["Product Name", "Standard/Approvals", "Classpath", *fixed, *units]
    out = identity.alias("i").join(packed.select("product_id", "slots", *[F.col(f"`{c}`").alias(f"__{n}") for n, c in enumerate(made)]), "product_id", "left")
    known = {c: F.col(f"__{n}") for n, c in enumerate(made)}
    if texts is not None:
        columns = {"invoice": "INVOICE_DESC", "mobile": "MOBILE_DESC", "title": "SHORT_DESC", "long": "LONG_DESC1", "web": "MARKETING_DESCRIPTION"}
        wide = texts.groupBy("product_id").agg(*[F.max(F.when(F.col("format") == k, F.col("text"))).alias(f"__{k}") for k in columns])
        out = out.join(wide, "product_id", "left")
        known |= {c: F.col(f"__{k}") for k, c in columns.items()}
    if features is not None:
        out = out.join(features, "product_id", "left")
        known |= {f"ITEM_FEATURES_{n}": F.try_element_at("item_features", F.lit(n)) for n in range(1, FEATURES + 1)}
    for n in range(1, SLOTS + 1):
        item = F.try_element_at("slots", F.lit(n))
        known |= {f"ATTRIBUTE_LABEL {n}": item["label"], f"ATTRIBUTE_VALUE {n}": item["value"], f"ATTRIBUTE_UOM {n}": item["uom"]}
    given = set(identity.columns)
    value = lambda h: F.coalesce(*([F.col(f"`{h}`").cast("string")] if h in given else []), *([known[h]] if h in known else []), F.lit("")).alias(h)
    n = F.coalesce(F.size("slots"), F.lit(0))
    n = F.when(F.col("slots").isNull(), 0).otherwise(F.size("slots"))
    warning = F.when(n > SLOTS, F.concat((n - SLOTS).cast("string"), F.lit(" attributes beyond the last slot were dropped")))
    return out.select("product_id", *[value(h) for h in HEADERS], F.least(n, F.lit(SLOTS)).alias("slots_used"), F.array_compact(F.array(warning)).alias("warnings"))


def catalog_csv(fields: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """The flat catalogue, 12 text columns; dynamic specifications joined, confidence as whole percent (K13: blanks stay blank).

    Without ``products`` (``product_id, overall_status, overall_confidence, created_at``) they are summed up in the same
    aggregate, so that fields are worked out once, and have no ``created_at``.
    """
    keys = ["product_name", "category", "voltage_rating", "current_rating", "ip_rating", "connector_type", "material"]
    some = F.col("value").isNotNull()
    shown = F.concat_ws(" ", F.concat(F.col("label"), F.lit(":")), "value", "unit")
    columns = [
        *[F.max(F.when(some & (F.col("field_key") == k), F.concat_ws(" ", "value", "unit"))).alias(k) for k in keys],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(some & ~F.col("is_core"), F.struct("pos", shown.alias("s"))))), lambda x: x["s"]), " | ").alias("other_specs"),
    ]
    if products is None:
        out = with_status(fields.groupBy("product_id").agg(*summary_counts(), *columns).where("total_fields > 0")).withColumn("created_at", F.lit(None).cast("timestamp"))
    else:
        out = products.join(fields.where(some).groupBy("product_id").agg(*columns), "product_id", "left")
    out = out.withColumns({"confidence": F.concat(F.floor(F.col("overall_confidence") * 100).cast("string"), F.lit("%")), "created_at": F.col("created_at").cast("string")})
    return out.select("product_id", *[F.coalesce(c, F.lit("")).alias(c) for c in [*keys, "other_specs", "overall_status", "confidence", "created_at"]])
