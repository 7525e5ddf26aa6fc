"""Deterministic rules over the fields table; cross-field facts of a product by one window on its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, to_double
from . import extract
from .staging import gathered, let, staged

THRESHOLD = 0.65
IP_CODES = ["IP20", "IP40", "IP54", "IP55", "IP65", "IP66", "IP67", "IP68", "IP69K"]
NON_ELECTRICAL = "sanding belt|sanding disc|sandpaper|abrasive paper|abrasive sheet|flap disc|grinding wheel|cut-off wheel|cut off wheel|cutoff wheel|cut-off disc|cut off disc|cutoff disc|psa disc|abrasive disc"
NOT_ITS_FIELDS = ["voltage_rating", "current_rating", "ip_rating", "connector_type", "operating_temperature_min", "operating_temperature_max", "material", "certifications", "mounting_type"]
#: family of field names -> base unit, and (unit, factor, offset) into it; the complete table that K2 asks for.
FACTORS = [
    ("voltage", "V", [("V", 1, 0), ("MV", 0.001, 0), ("KV", 1000, 0), ("KILOVOLT", 1000, 0)]),
    ("current", "A", [("A", 1, 0), ("MA", 0.001, 0), ("KA", 1000, 0), ("KILOAMP", 1000, 0)]),
    ("temp", "°C", [("C", 1, 0), ("°C", 1, 0), ("F", 5 / 9, -32 * 5 / 9), ("°F", 5 / 9, -32 * 5 / 9), ("K", 1, -273.15)]),
    ("weight|mass", "kg", [("KG", 1, 0), ("LB", 0.453592, 0), ("LBS", 0.453592, 0), ("G", 0.001, 0), ("OZ", 0.0283495, 0)]),
    ("pressure", "bar", [("BAR", 1, 0), ("PSI", 0.0689476, 0), ("MPA", 10, 0), ("KPA", 0.01, 0)]),
    ("length|distance|size", "mm", [("MM", 1, 0), ("CM", 10, 0), ("M", 1000, 0), ("IN", 25.4, 0), ("INCH", 25.4, 0), ('"', 25.4, 0), ("FT", 304.8, 0)]),
]


def _based(value: Column, unit: Column, mine: Column, name: str, units: list[tuple], given: Column | None = None, kept: Column | None = None) -> tuple[Column, Column]:
    """Value and unit, in the base unit of a family where the field is one of it and its unit is known; else ``given, kept``."""
    n, symbol = to_double(value), F.upper(unit)
    hit = symbol.isin(*[s for s, _, _ in units]) & mine & n.isNotNull()
    number = F.coalesce(*[F.when(symbol == s, n * factor + offset) for s, factor, offset in units])
    made = F.when(hit, F.regexp_replace(F.bround(number, 3).cast("string"), r"\.0$", "")).otherwise(value if given is None else given)
    return made, F.when(hit, F.lit(name)).otherwise(unit if kept is None else kept)


def _in_base(key: Column, value: Column, unit: Column) -> tuple[Column, Column]:
    """Numbers with a known unit of their family in base units, rounded to 3 places; all else as it is."""
    made, base = value, unit
    for family, name, units in reversed(FACTORS):
        made, base = _based(value, unit, key.rlike(family), name, units, made, base)
    some = unit.isNotNull() & value.isNotNull()
    return F.when(some, made).otherwise(value), F.when(some, base).otherwise(unit)


def to_base_units(fields: DataFrame) -> DataFrame:
    value, unit = _in_base(F.col("field_key"), F.col("value"), F.col("unit"))
    return fields.withColumns({"value": value, "unit": unit})


def validate(fields: DataFrame) -> DataFrame:
    """Fields (see ``extract``) -> the same with ``value_num, status, message``. One shuffle, on product_id."""
    f = to_base_units(fields)
    f = f.withColumn("value", _plain_ip(F.col("field_key"), F.col("value"))).withColumn("value_num", to_double(F.col("value")))
    w = Window.partitionBy("product_id")
    of = lambda key, column="value_num": F.max(F.when(F.col("field_key") == key, F.col(column))).over(w)
    facts = {"category": of("category", "value"), "product_name": of("product_name", "value"), "connector": of("connector_type", "value"), "t_min": of("operating_temperature_min"), "t_max": of("operating_temperature_max")}
    f = f.withColumns({f"of_{k}": c for k, c in facts.items()}).withColumns(_signs())
    return staged(f, _judged(F.col)).drop(*(f"of_{k}" for k in facts), *_signs())


def validated(texts: DataFrame, beside: dict[str, Column] | None = None) -> DataFrame:
    """``validate(extract(texts))``: cross-field facts are taken while a text's fields are still one row, so that the texts
    are shuffled and not their fields, and fields are judged before they become rows, so that no filter of a reader works
    the rules out again. ``beside``: columns to stay beside each field, worked out once from the text and its product's
    facts (``of_category, of_product_name``)."""
    t = extract.packed(gathered(texts, "product_id"))
    w = Window.partitionBy("product_id")
    temperature = next(x for x in FACTORS if x[0] == "temp")
    text = lambda f: f["value"]
    degrees = lambda f: to_double(_based(f["value"], f["unit"], F.lit(True), *temperature[1:])[0])
    kinds = {"category": ("category", text), "product_name": ("product_name", text), "connector": ("connector_type", text), "t_min": ("operating_temperature_min", degrees), "t_max": ("operating_temperature_max", degrees)}
    of = lambda key, read: F.array_max(F.transform(F.filter("fields", lambda f: f["field_key"] == key), read))
    t = t.withColumns({f"of_{k}": of(*x) for k, x in kinds.items()}).withColumns({f"of_{k}": F.max(f"of_{k}").over(w) for k in kinds})
    beside = beside or {}
    t = staged(t, {**_signs(), **beside})
    names = [*extract.FIELDS, "is_grounded", "evidence_ok"]

    def based(f: Column) -> Column:
        value, unit = _in_base(f["field_key"], f["value"], f["unit"])
        return F.struct(*[{"value": _plain_ip(f["field_key"], value), "unit": unit}.get(c, f[c]).alias(c) for c in names])

    def judged(f: Column, pos: Column) -> Column:
        known = lambda c: f[c] if c in (*names, "value_num") else F.col(c)
        return F.struct(pos.alias("pos"), *[f[c].alias(c) for c in (*names, "value_num")], *[c.alias(k) for k, c in _judged(known).items()])

    counted = F.transform(F.transform("fields", based), lambda f: F.struct(*[f[c].alias(c) for c in names], to_double(f["value"]).alias("value_num")))
    kept = ["product_id", "raw_text", "usable", *beside]
    return t.select(*kept, F.inline(F.transform(counted, judged))).select("product_id", "raw_text", "usable", "pos", *names, *kept[3:], "value_num", "status", "message")


def _plain_ip(key: Column, value: Column) -> Column:
    """An IP code in its usual spelling, where it is a known one."""
    plain = F.regexp_replace(F.upper(F.trim(value)), r"[\s_-]", "")
    return F.when((key == "ip_rating") & plain.isin(IP_CODES), plain).otherwise(value)


def _signs() -> dict[str, Column]:
    """What a product's text and facts say of it: no electrical product, and used under water."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    kind = F.concat_ws(" ", F.lower("of_category"), F.lower("of_product_name"), low("raw_text"))
    return {"consumable": let(kind, lambda k: any_of(NON_ELECTRICAL, k)), "submersible": let(low("raw_text"), lambda k: any_of("submersible|underwater|deep well", k))}


def _judged(of) -> dict[str, Column]:
    """``status, message`` of a field by the rules; ``of`` names a field's columns and the facts and signs of its product."""
    submersible, connector = of("submersible"), F.upper(of("of_connector"))
    key, value, n = of("field_key"), of("value"), of("value_num")
    numbers = F.transform(F.regexp_extract_all(value, F.lit(r"(?<![\d.])(-?\d+(?:\.\d+)?)"), 1), lambda x: F.abs(x.cast("double")))
    readable = value.rlike(r"(?i)^\s*-?\d+(?:\.\d+)?\s*V?\s*(?:[/–—-]\s*-?\d+(?:\.\d+)?\s*V?(?:\s+MAX)?)?\s*$")
    some = value.isNotNull()
    error = (
        F.when(~F.coalesce(of("usable"), F.lit(True)), "The input has no usable text.")
        .when(some & (key == "voltage_rating") & ~readable, "Voltage is not a number.")
        .when(some & (key == "voltage_rating") & (F.exists(numbers, lambda x: x > 1000) | (n < 0)), "Voltage outside 0 to 1000 V.")
        .when(some & (key == "current_rating") & n.isNull(), "Current is not a number.")
        .when(some & (key == "current_rating") & connector.rlike("M8|M12") & (n > 20), "More than 20 A on a compact connector.")
        .when(some & (key == "current_rating") & ((n < 0) | (n > 200)), "Current outside 0 to 200 A.")
        .when(some & (key == "ip_rating") & submersible & value.isin("IP20", "IP40", "IP54"), "Submersible use, but an indoor IP code.")
        .when(some & (key == "ip_rating") & ~value.isin(IP_CODES), "Not a standard IP code.")
        .when(some & (key == "operating_temperature_min") & ((n < -60) | (n > 100)), "Lowest temperature outside -60 to 100 °C.")
        .when(some & (key == "operating_temperature_max") & ((n < -20) | (n > 250)), "Highest temperature outside -20 to 250 °C.")
        .when(some & key.startswith("operating_temperature") & (of("of_t_min") > of("of_t_max")), "Lowest temperature over the highest.")
    )
    not_its = of("consumable") & key.isin(NOT_ITS_FIELDS) & (~some | (key == "material"))
    ungrounded = some & (key != "product_name") & ~(F.coalesce(of("is_grounded"), F.lit(True)) & F.coalesce(of("evidence_ok"), F.lit(True)))

    def status(error: Column) -> Column:
        return (
            F.when(~F.coalesce(of("usable"), F.lit(True)), "flagged_validation_error").when(not_its, "not_applicable").when(error.isNotNull(), "flagged_validation_error").when(~some | (F.trim(value) == ""), "missing")
            .when(ungrounded, "flagged_ungrounded").when(of("confidence") < THRESHOLD, "flagged_low_confidence").otherwise("verified")
        )

    return {"status": status(error), "message": F.when(not_its, "Does not apply to this category.").otherwise(error)}


def summary_counts() -> list[Column]:
    """Counts over a product's applicable fields and the mean confidence of those with a value (2 places)."""
    status, applies = F.col("status"), F.col("status") != "not_applicable"
    return [
        F.count_if(applies).alias("total_fields"), F.count_if(status == "verified").alias("verified"),
        F.count_if(status.isin("flagged_low_confidence", "flagged_validation_error", "flagged_ungrounded", "needs_review")).alias("flagged"),
        F.count_if(status == "missing").alias("missing"), F.count_if(status == "ai_enriched").alias("enriched"),
        F.bround(F.coalesce(F.avg(F.when(applies & F.col("value").isNotNull(), F.col("confidence"))), F.lit(0.0)), 2).alias("overall_confidence"),
    ]


def with_status(counts: DataFrame) -> DataFrame:
    return counts.withColumn("overall_status", F.when(F.col("flagged") + F.col("missing") + F.col("enriched") > 0, "needs_review").otherwise("verified"))


def summarize(fields: DataFrame) -> DataFrame:
    """Per product: counts over applicable fields, mean confidence of valued ones (2 places), overall status."""
    return with_status(fields.where("status <> 'not_applicable'").groupBy("product_id").agg(*summary_counts()))


def catalog_stats(summaries: DataFrame) -> DataFrame:
    """One row: products, verified, needs_review, share of fields verified (100.0 without fields), flagged fields, hours saved at 0.25 a product."""
    s = summaries.agg(
        F.count("*").alias("products"), F.count_if(F.col("overall_status") == "verified").alias("verified_products"), F.count_if(F.col("overall_status") == "needs_review").alias("review_products"),
        F.coalesce(F.sum("total_fields"), F.lit(0)).alias("fields"), F.coalesce(F.sum("verified"), F.lit(0)).alias("verified_fields"), F.coalesce(F.sum("flagged"), F.lit(0)).alias("flagged_fields"),
    )
    return s.withColumns({"verification_rate_pct": F.coalesce(F.bround(100.0 * F.try_divide("verified_fields", "fields"), 1), F.lit(100.0)), "hours_saved": F.col("products") * 0.25})
