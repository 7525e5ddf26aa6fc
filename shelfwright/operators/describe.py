"""Five length-limited descriptions of a product record, as column expressions over its attribute array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_number, no_blank, percent, squeeze, to_double, word_cut
from ..functions.units import approved_unit, convert_decimals_in_text, decimal_to_fraction, fix_spacing_in_text

INVOICE, MOBILE, TITLE, LONG, WEB = 40, (60, 80), 200, 1000, (120, 1500)
# What an invoice line may shorten.
INVOICE_SHORT = [
    ("STAINLESS STEEL 316L", "SST316L"), ("STAINLESS STEEL", "SST"), ("STAINLESS-STEEL", "SST"), ("REFRIGERATOR", "REFRIG"), ("TEMPERATURE", "TEMP"), ("RIGHT ANGLE", "RA"), ("GALVANIZED", "GALV"), ("HEAVY DUTY", "HD"),
    ("STAINLESS", "SST"), ("ALUMINIUM", "ALUM"), ("CONNECTOR", "CONN"), ("ALUMINUM", "ALUM"), ("PRESSURE", "PRESS"), ("COUPLING", "CPLG"), ("THREADED", "THD"), ("MOUNTING", "MTG"), ("ASSEMBLY", "ASSY"), ("CYLINDER", "CYL"),
    ("DIAMETER", "DIA"), ("STANDARD", "STD"), ("ADAPTER", "ADPT"), ("NOMINAL", "NOM"), ("MAXIMUM", "MAX"), ("MINIMUM", "MIN"), ("THREAD", "THD"), ("BRONZE", "BRZ"), ("COPPER", "CU"), ("MOUNT", "MT"), ("BRASS", "BRS"), ("WITH", "W/"),
]


def joined(parts: list[Column], sep: str = " ") -> Column:
    return squeeze(F.concat_ws(sep, *[no_blank(F.trim(p)) for p in parts]))


def oxford(items: Column) -> Column:
    n = F.size(items)
    most = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(items, F.lit(-1))
    return F.when(n == 0, "").when(n == 1, last).when(n == 2, F.concat(most, F.lit(" and "), last)).otherwise(F.concat(most, F.lit(", and "), last))


def repaired(text: Column) -> Column:
    """Units spaced and inches as fractions, everywhere but in the part number (column ``mpn``)."""
    apart = F.when(F.coalesce(F.trim("mpn"), F.lit("")) == "", "(?!)").otherwise(F.concat(F.lit(r"\Q"), F.col("mpn"), F.lit(r"\E")))
    pieces = F.split(text, apart)
    return squeeze(F.call_function("array_join", F.transform(pieces, lambda t: convert_decimals_in_text(fix_spacing_in_text(t))), F.coalesce("mpn", F.lit(""))))


def _short(text: Column) -> Column:
    for long_form, form in INVOICE_SHORT:
        text = F.replace(text, F.lit(long_form), F.lit(form))
    return squeeze(text)


def _prefixes(parts: str, sep: str, least: int) -> Column:
    return F.transform(F.sequence(F.lit(least), F.greatest(F.size(parts), F.lit(least))), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def _longest(options: str, most: int) -> Column:
    """The last of the growing texts that fits."""
    return F.try_element_at(F.filter(options, lambda x: F.length(x) <= most), F.lit(-1))


def descriptions(records: DataFrame, key: str = "product_id") -> DataFrame:
    """Records (``key, brand, manufacturer, series, mpn, item_type, attributes ARRAY<STRUCT<label, value, unit, is_key>>,
    features``) -> long ``key, format, text, length, limit, compliant``. The manufacturer stands in for an absent brand.

    Steps are columns that later ones name, so that no step's expression is spelt out in another's.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    r = records.withColumns(
        {
            "maker": F.coalesce(no_blank(F.trim("brand")), F.col("manufacturer")),
            "features": F.filter(F.transform(F.coalesce("features", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda f: f != ""),
            "a": F.transform("attributes", lambda a: F.struct(text(a["label"]).alias("label"), text(a["value"]).alias("value"), text(a["unit"]).alias("unit"), a["is_key"].alias("is_key"), approved_unit(a["unit"]).alias("approved"))),
        }
    )
    inches = lambda a: F.when(a["approved"] == "in", F.concat(decimal_to_fraction(a["value"]), F.lit(" in")))
    shown = lambda a: F.coalesce(inches(a), F.trim(F.concat_ws(" ", clean_number(a["value"]), F.coalesce(a["approved"], a["unit"]))))
    r = r.withColumn("a", F.transform("a", lambda a: F.struct(a["label"].alias("label"), a["is_key"].alias("is_key"), ((a["unit"] != "") | to_double(a["value"]).isNotNull()).alias("measure"), shown(a).alias("shown"))))
    r = r.withColumn("a", F.filter("a", lambda a: a["shown"] != ""))
    unlabelled = lambda a: F.lower(a["label"]).isin("", "none")
    phrase = lambda a: F.when(unlabelled(a), a["shown"]).when(a["measure"], F.concat(a["shown"], F.lit(" "), F.lower(a["label"]))).when(F.contains(F.lower(a["shown"]), F.lower(a["label"])), a["shown"]).otherwise(F.concat(F.lower(a["label"]), F.lit(" of "), a["shown"]))
    spoken = lambda a: F.when(a["measure"] & ~unlabelled(a), F.concat(a["shown"], F.lit(" "), a["label"])).otherwise(a["shown"])
    r = r.withColumns({"keys": F.filter("a", lambda a: a["is_key"]), "others": F.filter("a", lambda a: ~a["is_key"])})
    only = lambda c: F.transform(c, lambda a: a["shown"])
    sentence = lambda lead, xs: F.when(F.size(xs) > 0, F.concat(F.lit(lead), F.lit(" "), oxford(xs), F.lit(".")))
    subject, item = joined([F.col("maker"), F.col("series"), F.col("mpn")]), F.trim(F.coalesce("item_type", F.lit("")))
    r = r.withColumns({"key_shown": only("keys"), "pool": F.concat(only("keys"), only("others")), "key_phrases": F.transform("keys", phrase), "other_phrases": F.transform("others", phrase), "subject": subject, "item": item})
    base = joined([F.col("maker"), F.col("item_type"), F.col("series"), F.col("mpn")], ", ")
    add = lambda acc, x: F.concat_ws(", ", no_blank(acc), x)
    first = F.when((F.col("subject") != "") & (F.col("item") != ""), F.concat(F.col("subject"), F.lit(" is a "), F.col("item"), F.lit("."))).when(F.col("subject") != "", F.concat(F.col("subject"), F.lit("."))).when(F.col("item") != "", F.concat(F.upper(F.substring("item", 1, 1)), F.substring("item", 2, 10000), F.lit(".")))
    r = r.withColumns(
        {
            "bits": F.concat(F.array(joined([F.col("item_type"), F.col("mpn")])), F.when(F.size("key_shown") > 0, F.col("key_shown")).otherwise(only("a"))),
            "mobile": F.aggregate("pool", base, lambda acc, x: F.when((F.length(acc) < MOBILE[0]) & (F.length(add(acc, x)) <= MOBILE[1]), add(acc, x)).otherwise(acc)),
            "title_tail": F.array_join(F.concat("features", "key_shown"), ", "),
            "long_run": F.array_join(F.concat(F.array_compact(F.array(F.when(F.size("features") > 0, F.concat(F.lit("With "), F.array_join("features", ", "))), no_blank(F.trim("series")))), F.transform("a", spoken)), ", "),
            "sentences": F.array_compact(F.array(first, sentence("It is rated for", F.col("key_phrases")), sentence("Additional specifications include", F.col("other_phrases")), sentence("Features include", F.col("features")))),
        }
    )
    head = joined([F.col("maker"), F.col("series"), F.col("mpn"), F.col("item_type")])
    r = r.withColumns(
        {
            "invoice_lines": F.transform(_prefixes("bits", " ", 1), lambda x: F.upper(squeeze(x))),
            "mobile_parts": F.filter(F.transform(F.split("mobile", ","), lambda x: F.trim(x)), lambda p: p != ""),
            "title": repaired(F.concat_ws("", head, F.when(F.col("title_tail") != "", F.concat(F.when(F.size("features") > 0, " With ").otherwise(", "), F.col("title_tail"))))),
            "long": repaired(joined([joined([F.col("maker"), F.col("item_type")]), F.col("long_run")], ", ")),
            "sentences": F.transform("sentences", repaired),
        }
    )
    r = r.withColumns({"invoice_full": F.try_element_at("invoice_lines", F.lit(-1)), "invoice_short": F.transform("invoice_lines", _short), "mobile_fits": _prefixes("mobile_parts", ", ", 1), "web_fits": _prefixes("sentences", " ", 0)})
    r = r.withColumns({"invoice_fit": _longest("invoice_short", INVOICE), "mobile_fit": _longest("mobile_fits", MOBILE[1]), "web_fit": F.filter("web_fits", lambda x: F.length(x) <= WEB[1])})
    trimmed = lambda c: F.regexp_replace(c, ",+$", "")
    finals = {
        "invoice": F.when(F.length("invoice_full") <= INVOICE, F.col("invoice_full")).otherwise(F.coalesce("invoice_fit", word_cut(F.get("invoice_short", F.lit(0)), INVOICE))),
        "mobile": F.when(F.length("mobile") <= MOBILE[1], F.col("mobile")).otherwise(F.coalesce("mobile_fit", word_cut(F.get("mobile_parts", F.lit(0)), MOBILE[1]))),
        "title": word_cut(trimmed(F.col("title")), TITLE),
        "long": word_cut(trimmed(F.col("long")), LONG),
        "web": F.when(F.size("web_fit") > 1, F.try_element_at("web_fit", F.lit(-1))).otherwise(F.concat(word_cut(F.coalesce(F.get("sentences", F.lit(0)), F.lit("")), WEB[1] - 1), F.when(F.length(F.get("sentences", F.lit(0))) > WEB[1] - 1, ".").otherwise(""))),
    }
    limits = {"invoice": (0, INVOICE), "mobile": MOBILE, "title": (0, TITLE), "long": (0, LONG), "web": WEB}
    texts = r.select(key, *[F.coalesce(c, F.lit("")).alias(name) for name, c in finals.items()])
    entry = [F.struct(F.lit(name).alias("format"), F.col(name).alias("text"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for name, (lo, hi) in limits.items()]
    out = texts.select(key, F.explode(F.array(*entry)).alias("d")).select(key, "d.*").withColumn("length", F.length("text"))
    limit = F.when(F.col("lo") > 0, F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))).otherwise(F.concat(F.lit("<= "), F.col("hi").cast("string")))
    fits = F.col("length").between(F.col("lo"), F.col("hi")) & ((F.col("format") != "invoice") | (F.col("text") == F.upper("text")))
    return out.select(key, "format", "text", "length", limit.alias("limit"), fits.alias("compliant"))


def compliance(texts: DataFrame, *keys: str) -> DataFrame:
    out = texts.groupBy(*keys).agg(F.count("*").alias("built"), F.count_if("compliant").alias("compliant"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("compliant"), F.col("format")))), ", ").alias("failing"))
    return out.withColumn("compliance_pct", F.coalesce(percent(F.col("compliant"), F.col("built")), F.lit(0.0)))
