"""Units and trade fractions as column expressions."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import unit_rows
from .text import clean_number, literal_map, to_double

# Units that may stand right behind a number.
_GLUED = (
    "inches|inch|milliamps|milliamp|amperes|ampere|amps|amp|volts|volt|kilograms|kilogram|pounds|pound|ounces|ounce|grams|gram|kilowatt|watts|watt|hertz|khz|mhz|hz|"
    "psig|psi|bar|kpa|mpa|gpm|lpm|cfm|rpm|dba|db|btu|gal|lbs|lb|oz|kg|mm|cm|ft|in|vac|vdc|kw|ma|hp|kv|mv|[wvalm]"
)


def unit_key(unit: Column) -> Column:
    """Lower case without dots, blanks, underscores and hyphens; degree spellings as 'deg'."""
    s = F.regexp_replace(F.lower(F.trim(unit)), r"[.\s_-]+", "")
    return F.replace(F.replace(s, F.lit("degrees"), F.lit("deg")), F.lit("°"), F.lit("deg"))


def approved_unit(unit: Column) -> Column:
    """The approved form from the seed table, else null."""
    return F.try_element_at(literal_map(dict(unit_rows())), unit_key(unit))


def normalized_unit(unit: Column) -> Column:
    """The approved form, else the unit as it came; null for blank."""
    return F.when(F.trim(unit) != "", F.coalesce(approved_unit(unit), F.trim(unit)))


def format_measurement(value: Column, unit: Column) -> Column:
    return F.concat_ws(" ", clean_number(value), normalized_unit(unit))


def _fractions() -> dict[str, str]:
    return {str(n): f"{n // gcd(n, 64)}/{64 // gcd(n, 64)}" for n in range(1, 64)}


def decimal_to_fraction(value: Column) -> Column:
    """'50.25' as '50-1/4', whole numbers plain; null where the value is no number or no clean 64th (K16: not finite is null)."""
    n = to_double(value)
    size = F.abs(n)
    whole = F.floor(size)
    scaled = (size - whole) * 64
    nearest = F.bround(scaled)
    sign = F.when(n < 0, "-").otherwise("")
    part = F.try_element_at(literal_map(_fractions()), nearest.cast("int").cast("string"))
    fraction = F.when(whole == 0, F.concat(sign, part)).otherwise(F.concat(sign, whole.cast("string"), F.lit("-"), part))
    usable = n.isNotNull() & ~F.isnan(n) & (size < 9e15)
    return F.when(usable & ((size - whole) < 1e-9), F.concat(sign, whole.cast("string"))).when(usable & (F.abs(scaled - nearest) <= 1e-6) & (nearest > 0) & (nearest < 64), fraction)


def fraction_to_decimal(text: Column) -> Column:
    """'50-1/4', '2 1/2', '1/2', '3' and their negatives as numbers, else null; a zero denominator is null."""
    s = F.trim(text)
    negative = s.startswith("-")
    body = F.trim(F.regexp_replace(s, "^-+", ""))
    mixed, plain = r"^(\d+)\s*[-\s]\s*(\d+)\s*/\s*(\d+)$", r"^(\d+)\s*/\s*(\d+)$"
    part = lambda p, k: F.regexp_extract(body, p, k).try_cast("double")
    size = F.when(body.rlike(mixed), part(mixed, 1) + F.try_divide(part(mixed, 2), part(mixed, 3))).when(body.rlike(plain), F.try_divide(part(plain, 1), part(plain, 2))).otherwise(to_double(body))
    return F.when(negative, -size).otherwise(size)


def decimal_fraction_table(spark: SparkSession) -> DataFrame:
    """``fraction, value``: the 63 sixty-fourths below one, reduced."""
    n = F.col("id")
    return spark.range(1, 64).select(decimal_to_fraction((n / 64).cast("string")).alias("fraction"), (n / 64).alias("value"))


def _rewrite(text: Column, pattern: str, change) -> Column:
    """Every match of ``pattern`` changed, the stretches between kept: the way to replace by a function natively."""
    runs = F.regexp_extract_all(text, F.lit(f"((?:{pattern})|(?s:.)(?:(?!{pattern})(?s:.))*)"), 1)
    return F.array_join(F.transform(runs, lambda t: F.when(t.rlike(f"^(?:{pattern})$"), change(t)).otherwise(t)), "")


def convert_decimals_in_text(text: Column) -> Column:
    """'50.25 in W' as '50-1/4 in W': decimals before an inch unit only, clean 64ths only."""
    number, unit = r"(?<![\d/-])(?<!\d\.)\d+\.\d+", r'\s*(?:inches|inch|in|")(?![A-Za-z])'
    return _rewrite(text, f"(?i:{number}{unit})", lambda t: F.coalesce(F.concat(decimal_to_fraction(F.regexp_extract(t, r"^(\d+\.\d+)", 1)), F.lit(" in")), t))


def fix_spacing_in_text(text: Column) -> Column:
    """'24in' as '24 in', with the unit's approved form; a bare G is left alone."""
    number = r"(?<![A-Za-z\d./-])(?:\d+-\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)"
    unit = lambda t: F.regexp_extract(t, r"([A-Za-z]+)$", 1)
    return _rewrite(text, f"(?i:{number}(?:{_GLUED})(?![A-Za-z]))", lambda t: F.concat(F.regexp_extract(t, r"^([\d./-]+)", 1), F.lit(" "), F.coalesce(approved_unit(unit(t)), unit(t))))
