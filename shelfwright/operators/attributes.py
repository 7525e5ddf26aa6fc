"""Attributes of terse descriptions, read with ordered patterns from the expanded text; no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import expand_abbreviations, no_blank, squeeze
from ..tables import CONNECTIONS, FINISHES, MATERIALS
from .staging import spread, staged

# How sizes, ratings and counts are written.
_FRACTION, _NUMBER = r"\d+\s*-\s*\d+/\d+|\d+/\d+", r"\d+\.\d+|\d+"
_ANY = f"{_FRACTION}|{_NUMBER}"
_MARK = r"\"|''|in\b|inch(?:es)?\b|mm\b|cm\b"
_FREE = "(?<![A-Za-z0-9])"
#: Not behind SCH / CLASS, not before #, LB, PSI, HNDL and the like; a plain number needs a unit mark.
_SIZE = rf"(?i){_FREE}(?<!(?:sch|sched|schedule|class|cl)\s{{0,3}}\.?\s{{0,3}})(?>((?:{_FRACTION})\s*(?:{_MARK})?|(?:{_NUMBER})\s*(?:{_MARK})))(?![-\s]*(?:#|lbs?\b|psi\b|hndl|handle|cycles?\b|gpm\b|dba\b|rpm\b|watts?\b|volts?\b|amps?\b))"
_PAIR = rf"(?i){_FREE}({_ANY})\s*(?:\"|''|in\b)?\s*[x×]\s*({_ANY})\s*(?:\"|''|in\b)?"
_PRESSURE = rf"(?i){_FREE}(?:cl(?:ass)?\s*)?(\d{{2,5}})\s*(?:#|lb\b|lbs\b|psi\b|class\b)|{_FREE}cl(?:ass)?\s*(\d{{2,5}})(?![A-Za-z0-9])"
_SCHEDULE = rf"(?i){_FREE}sch(?:ed(?:ule)?)?\s*\.?\s*(\d{{1,3}}s?)"
_HANDLES = rf"(?i){_FREE}(\d)\s*[- ]?\s*handle"
_VOLTS = rf"(?i){_FREE}(\d{{1,4}}(?:\.\d+)?)\s*(?:v|volts?|vac|vdc)(?![A-Za-z])"
_AMPS = rf"(?i){_FREE}(\d{{1,4}}(?:\.\d+)?)\s*(?:a|amps?)(?![A-Za-z])"


def _first(low: Column, listed: dict[str, str]) -> Column:
    """The place, from 0, of the first listed phrase that stands in the text between non-letters."""
    at = F.lit(None).cast("int")
    for n, phrase in reversed(list(enumerate(listed))):
        at = F.when(F.contains(low, F.lit(phrase)) & low.rlike(f"(?<![a-z]){phrase}(?![a-z])"), n).otherwise(at)
    return at


def with_attributes(rows: DataFrame, text: str = "Part_Desc") -> DataFrame:
    """Adds ``attributes``, ARRAY<STRUCT<label, value, unit, evidence>> in a fixed order, one entry a label; empty for null
    and blank texts. Each pattern is held against a text once."""
    known = rows.columns
    listed = {"Material": MATERIALS, "Finish": FINISHES, "Connection Type": CONNECTIONS}
    t = staged(spread(rows), {"at_text": squeeze(expand_abbreviations(F.col(text)))})
    whole = {"at_pair": _PAIR, "at_size": _SIZE, "at_pressure": _PRESSURE, "at_schedule": _SCHEDULE, "at_handles": _HANDLES, "at_volts": _VOLTS, "at_amps": _AMPS}
    low = F.lower("at_text")
    t = staged(t, {**{name: F.regexp_extract("at_text", pattern, 1 if name == "at_size" else 0) for name, pattern in whole.items()}, **{f"at_{n}": _first(low, x) for n, x in enumerate(listed.values())}})
    part = lambda name, k: no_blank(F.regexp_extract(name, whole[name], k))
    t = staged(
        t,
        {
            "at_pair1": part("at_pair", 1), "at_pair2": part("at_pair", 2), "at_token": no_blank(F.replace(F.regexp_extract("at_size", rf"^({_ANY})", 1), F.lit(" "), F.lit(""))),
            "at_class": F.coalesce(part("at_pressure", 1), part("at_pressure", 2)), "at_sch": F.upper(part("at_schedule", 1)), "at_hand": part("at_handles", 1), "at_v": part("at_volts", 1), "at_a": part("at_amps", 1),
        },
    )
    paired = F.col("at_pair") != ""
    size = F.col("at_size")
    unit = F.when(size.rlike(r"(?i)mm$"), "mm").when(size.rlike(r"(?i)cm$"), "cm").otherwise("in")

    def entry(label: str, value: Column, unit: Column | None, evidence: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(label).alias("label"), value.alias("value"), (F.lit(None).cast("string") if unit is None else unit).alias("unit"), F.trim(evidence).alias("evidence")))

    entries = [
        entry("Size", F.when(paired, F.col("at_pair1")).otherwise(F.col("at_token")), F.when(paired, "in").otherwise(unit), F.when(paired, F.col("at_pair")).otherwise(size)),
        entry("Second Size", F.when(paired, F.col("at_pair2")), F.lit("in"), F.col("at_pair")),
    ]
    for n, (label, shown) in enumerate(listed.items()):
        entries.append(entry(label, F.get(F.array(*map(F.lit, shown.values())), F.col(f"at_{n}")), None, F.get(F.array(*map(F.lit, shown)), F.col(f"at_{n}"))))
    entries += [
        entry("Pressure Class", F.col("at_class"), None, F.col("at_pressure")),
        entry("Schedule", F.col("at_sch"), None, F.col("at_schedule")),
        entry("Handle Count", F.col("at_hand"), None, F.col("at_handles")),
        entry("Voltage", F.col("at_v"), F.lit("volts"), F.col("at_volts")),
        entry("Current", F.col("at_a"), F.lit("amps"), F.col("at_amps")),
    ]
    return t.select(*known, F.array_compact(F.array(*entries)).alias("attributes"))


def attribute_rows(rows: DataFrame, key: str = "row_index", text: str = "Part_Desc") -> DataFrame:
    """Long form: ``key, pos, label, value, unit, evidence``."""
    return with_attributes(rows, text).select(key, F.posexplode("attributes").alias("pos", "a")).select(key, "pos", "a.*")


def attribute_map(attributes: Column) -> Column:
    """``{label: value}``."""
    return F.map_from_entries(F.transform(attributes, lambda a: F.struct(a["label"], a["value"])))
