"""Attributes from product texts: patterns with local evidence, natively; one long ``fields`` table."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, extra_key, literal_map, no_blank, squeeze
from .staging import let, spread, staged

# Words that make a number a rating, and the patterns of each field. Where a pattern may begin at many places,
# it looks first whether the next character can begin it.
CURRENT_WORDS = "current amperage amp rated rating consumption consume draw load nominal max maximum min minimum output input supply operating continuous inrush switching".split()
VOLTAGE_WORDS = "voltage volt supply rated rating operating power nominal input output range dc ac".split()
MATERIAL_WORDS = ["housing", "body", "housing material", "body material", "construction", "barrel", "casing", "case", "enclosure", "shell", "jacket", "sheath", "cover", "made of", "made from", "consists", "finish", "plated"]
COMPOUNDS = "Nickel-plated brass|Chrome-plated brass|Stainless steel 316L|Die-cast zinc alloy|Polyamide PA66|Aluminium alloy|Aluminum alloy|Aluminum anodized|Anodized aluminium|Anodized aluminum|Zinc alloy"
GENERIC = "Stainless steel|thermoplastic|brass|steel|aluminium|aluminum|polyamide|nylon|PVC|PTFE"

GENERIC_WORD = rf"(?i)\b({GENERIC})\b"
MATERIAL_LABEL = rf"(?i)\b(?:housing\s+material|body\s+material|material)\s*[:=-]\s*(?:{GENERIC})(?=\s*(?:[.;,\n]|$))"
VOLTAGE = r"(?i)(?=[rsov:\s0-9])(?:rated\s+voltage|supply\s+voltage|operating\s+voltage|voltage|rating)?[:\s]*([0-9]+(?:\.[0-9]+)?)\s*(?:(?:to|-|–|—|\.\.\.|…)\s*([0-9]+(?:\.[0-9]+)?))?\s*(VAC|VDC|Volts|Volt|mV|kV|V)(?![A-Za-z])"
CURRENT = r"(?i)(?=[cmr:\s0-9])(?:current|current\s+rating|max\s+current|current\s+consume|rating)?[:\s]*([0-9]+(?:\.[0-9]+)?)\s*(mA|Amps|Amp|A)(?![A-Za-z])"
IP_CODE = r"(?i)\b(IP[-_\s]?[0-9]{2,3}K?)\b"
CONNECTOR = r"(?i)\b(M12|M8|RJ45|Push-Pull|DIN Rail|Terminal Block|Push Plug|Socket|A-Coded|PNP|NPN|Tubular)\b"
TEMPERATURE = r"(?i)(?:operating\s+temp(?:erature)?|temperature|temp(?:erature)?\s+range|operating\s+range)[:\s]*([-+]?[0-9]+)\s*°?\s*[CF]?\s*(?:to|–|—|-|\.\.\.)\s*([-+]?[0-9]+)\s*°?\s*([CF]?)"
CERTIFICATE = r"(?i)\b(CE|UL|RoHS|ATEX|CSA|IECEx)\b"
MOUNTING = r"(?i)\b(DIN rail|Panel mount|Threaded|Tubular|Cable mount|Flush mount|Straight|Right angle)\b"
DYNAMIC = [
    ("Flow Rate", r"(?i)(?:flow(?:\s*rate)?)\D{0,12}?([0-9]+(?:\.[0-9]+)?)\s*(L/min|LPM|GPM|mL/min)"),
    ("Pressure", r"(?i)(?:pressure|rated\s*pressure|max(?:imum)?\s*pressure)\D{0,12}?([0-9]+(?:\.[0-9]+)?)\s*(psi|bar|MPa|kPa)"),
    ("Motor Speed", r"(?i)([0-9]{3,5})\s*(rpm)"),
    ("Mass", r"(?i)(?:mass|weight)\D{0,12}?([0-9]+(?:\.[0-9]+)?)\s*(kg|g|lbs?|oz)"),
    ("Port Size", r"(?i)(?:port|thread(?:ed)?\s*port)\D{0,12}?([0-9]+(?:\.[0-9]+)?(?:\s*/\s*[0-9]+)?)\s*(inch|in|\"|mm)"),
    ("Thread Size", r"(?i)\b(M[0-9]{1,2}(?:\s*x\s*[0-9.]+)?)\b()"),
    ("Sensing Distance", r"(?i)(?:sensing\s*(?:distance|range))\D{0,12}?([0-9]+(?:\.[0-9]+)?)\s*(mm|cm)"),
    ("Switching Frequency", r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(Hz|kHz)\b"),
    ("Cable Length", r"(?i)(?:cable(?:\s*length)?)\D{0,12}?([0-9]+(?:\.[0-9]+)?)\s*(m|cm|ft)\b"),
]
# Phrases that name a category outright, in order, then keywords that suggest one.
NAMED_CATEGORIES = [
    (r"(?i)\b(?:detail\s+file\s+)?sanding\s+belts?\b", "Sanding Belt"),
    (r"(?i)\bsanding\s+discs?\b", "Sanding Disc"),
    (r"(?i)\bflap\s+discs?\b", "Flap Disc"),
    (r"(?i)\bgrinding\s+wheels?\b", "Grinding Wheel"),
    (r"(?i)\bcut[-\s]?off\s+wheels?\b", "Cut-Off Wheel"),
    (r"(?i)\babrasive\s+sheets?\b", "Abrasive Sheet"),
    (r"(?i)\bproximity\s+sensors?\b", "Industrial Sensor"),
    (r"(?i)\bphotoelectric\s+sensors?\b", "Industrial Sensor"),
    (r"(?i)\bcircular\s+connectors?\b", "Industrial Connector"),
]
PRODUCT_TYPE = r"(?im)^\s*Product\s+Type\s*:\s*[^\n]*sanding[^\n]*$"
CATEGORIES = [
    (r"(?i)(sensor|transducer|transmitter|proximity)", "Industrial Sensor", 0.90),
    (r"(?i)(connector|plug|socket|terminal block|terminal)", "Industrial Connector", 0.92),
    (r"(?i)\b(pump)\b", "Industrial Pump", 0.88),
    (r"(?i)\b(valve)\b", "Industrial Valve", 0.88),
    (r"(?i)\b(motor|actuator)\b", "Industrial Motor / Actuator", 0.88),
    (r"(?i)\b(relay|contactor)\b", "Industrial Relay", 0.88),
    (r"(?i)\b(switch)\b", "Industrial Switch", 0.88),
    (r"(?i)\b(encoder)\b", "Industrial Encoder", 0.88),
    (r"(?i)\b(controller|plc|drive)\b", "Industrial Controller / Drive", 0.88),
    (r"(?i)\b(cable|cordset)\b", "Industrial Cable", 0.88),
]
# Words one of which each pattern needs, in the order of the patterns ('' for none).
DYNAMIC_WORDS = ["flow", "pressure", "rpm", "mass|weight", "port", "", "sensing", "hz", "cable"]
NAMED_WORDS = ["sanding", "sanding", "flap", "grinding", "wheel", "abrasive", "proximity", "photoelectric", "circular"]
COMPOUND_WORDS, GENERIC_WORDS = "brass|steel|alloy|polyamide|alumin", "thermoplastic|brass|steel|alumin|polyamide|nylon|pvc|ptfe"
TYPE_WORDS = "Sensor|Pump|Connector|Transducer|Transmitter|Valve|Relay|Switch|Motor|Actuator|Cable|Plug|Encoder|Controller|Drive"
# Part numbers, product-type phrases, headings that are no names, titles of no product, and site names behind titles.
PART = r"\b([A-Z]{2,5}[-–][A-Z0-9]+(?:[-–][A-Z0-9]+)*)\b"
TYPE_PHRASE = rf"(?<![A-Za-z0-9])([A-Za-z][A-Za-z \t]{{0,45}}?(?=[{''.join(sorted({w[0] for w in TYPE_WORDS.split('|')}))}])(?:{TYPE_WORDS}))"
HEADING = r"(?i)^\s*(?:={2,}|-{2,})?\s*(?:extracted\s+specification\s+tables?|page\s+content|specifications?|description|features?)\s*(?:={2,}|-{2,})?\s*$"
NO_TITLE = r"(?i)^(?:untitled|document|datasheet|catalog|spec sheet)"
NO_LINE = r"(?i)^(?:---|fetch|sparse|http|url:)"
SITES = [
    r"wikipedia(?:,\s*the free encyclopedia)?", r"amazon(?:\.[a-z.]+)?", "ebay", "alibaba", "indiamart", "digikey", "mouser", "rs components", "farnell", "newark", "automationdirect", "grainger", r"home\s*depot",
    "walmart", "youtube", "linkedin", "free encyclopedia", "official site", "official website", r"home\s*page", "products?", "datasheet", "catalog(?:ue)?", "buy online", "for sale", "shop",
]
TITLE_SIGNS = [(r"(?i)\b(?:sku|mpn|model|part)\b", 1), (r"(?i)\b(?:belt|sensor|connector|pump|valve|motor|relay|switch|cable|actuator|controller|drive|tool)\b", 2), (r"\b[A-Z0-9]{6,}\b", 2)]
# Specification rows that say nothing of the product, other names of a row, and units that a row's text may state.
SKIPPED_ROWS = [
    "description", "features", "specifications", "unit price", "price", "quantity", "add to wishlist", "secure checkout", "secure payment", "http", "https", "url", "source url", "product url",
    "estimated arrival", "estimated arrival on", "arrival date", "availability", "available", "ship to store", "shipping",
]
SKIPPED_KEYS = ["http", "https", "url", "source_url", "product_url", "estimated_arrival", "estimated_arrival_on", "arrival_date", "availability", "available", "ship_to_store", "shipping"]
UNEVEN = "  |\t|\n|\x0b|\f|\r"  # white space that is no single space, one of these where there is any
SKIPPED_VALUES = ["/ per", "-", "--", "N/A", "n/a"]
ROW_NAMES = {
    "sku": "Manufacturer Part Number", "mpn": "Manufacturer Part Number", "manufacturer part number": "Manufacturer Part Number", "upc": "UPC", "item upc": "UPC", "brand": "Brand", "vendor": "Brand",
    "pack quantity": "Pack Quantity", "item quantity": "Item Quantity", "item weight": "Item Weight", "country of origin": "Country of Origin", "grit": "Grit", "grit blend": "Grit Blend",
    "grit description": "Grit Description", "backing": "Backing", "assorted pack": "Assorted Pack", "product type": "Product Type", "cutting materials": "Cutting Materials",
}
STATED_UNITS = [(r"(?i)(?:\b(?:inches|inch|in)\b|[\"″])", "in"), (r"(?i)\bmm\b", "mm"), (r"(?i)\bcm\b", "cm"), (r"(?i)\b(?:feet|foot|ft)\b", "ft"), (r"(?i)\bkg\b", "kg"), (r"(?i)\b(?:lb|lbs)\b", "lb")]
# Grit and coatings, which are no body material unless a part of the body is said to be made of them.
ABRASIVES = ["aluminum oxide", "aluminium oxide", "zirconium blend", "zirconia", "silicon carbide", "ceramic abrasive", "abrasive grain", "abrasive grit", "grit blend", "grit description", "sanding belt", "sanding disc"]
BODY_PARTS = ["housing", "body", "barrel", "casing", "case", "enclosure", "shell", "backing"]
LABELS = {
    "product_name": "Product Name", "category": "Category", "voltage_rating": "Voltage Rating", "current_rating": "Current Rating", "ip_rating": "IP Rating", "connector_type": "Connector Type",
    "operating_temperature_min": "Operating Temp Min", "operating_temperature_max": "Operating Temp Max", "material": "Material", "certifications": "Certifications", "mounting_type": "Mounting Type",
}
CORE = list(LABELS)
FIELDS = ["field_key", "is_core", "label", "value", "unit", "snippet", "confidence", "reasoning"]
FIELD = "struct<field_key:string,is_core:boolean,label:string,value:string,unit:string,snippet:string,confidence:double,reasoning:string>"


def group(text: Column, pattern: str, k: int) -> Column:
    return no_blank(F.regexp_extract(text, pattern, k))


def told(words: str, found: Column, low: Column | str = "low_text") -> Column:
    """``found``, not worked out (null) where the lower-case text holds none of the words, separated by |, that its pattern needs."""
    return F.when(any_of(words, low), found)


def first_found(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """``at, hit`` of the first pattern that matches, from (words, pattern); later patterns are not held against the text."""
    hit = lambda k, words, pattern: told(words, let(F.regexp_extract(text, pattern, 0), lambda h: F.when(h != "", F.struct(F.lit(k).alias("at"), h.alias("hit")))))
    return F.coalesce(*[hit(k, *p) for k, p in enumerate(patterns)])


def number(c: Column) -> Column:
    """A number as the shortest text of its value: '24.0' and '24' are '24'."""
    return F.regexp_replace(c.cast("double").cast("string"), r"\.0$", "")


def window(text: Column, at: Column, found: Column, before: int, after: int) -> Column:
    """The match that begins at ``at`` (from 1; 0: none) with characters around it."""
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(found) + after))


def context_word(near: Column, words: list[str]) -> Column:
    """The first listed word that stands in the window."""
    return let(F.lower(near), lambda low: F.coalesce(*[F.when(F.contains(low, F.lit(w)), w) for w in words]))


def year_like(n: Column) -> Column:
    return (n == F.floor(n)) & n.between(1900, 2099)


def _field(key: str, value: Column, unit: Column | None, snippet: Column, confidence: Column, reason: Column) -> Column:
    some = value.isNotNull()
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.lit(key).alias("field_key"), F.lit(True).alias("is_core"), F.lit(LABELS[key]).alias("label"), value.cast("string").alias("value"), F.when(some, nothing if unit is None else unit).alias("unit"),
        F.when(some, snippet).alias("snippet"), F.when(some, confidence).otherwise(F.lit(0.0)).cast("double").alias("confidence"), reason.cast("string").alias("reasoning"),
    ).cast(FIELD)


def _rating(name: str, key: str, words: list[str], strong: str, unit_group: int, low: float, high: float, sure: tuple[float, float, float], unit: Column, hedges: str, is_range: bool) -> Column:
    """From the columns ``<name>0``.. (groups of the first match) and ``<name>_near`` (its surroundings)."""
    found = F.col(f"{name}0")
    first = F.col(f"{name}1").try_cast("double")
    second = F.col(f"{name}2").try_cast("double") if is_range else F.lit(None).cast("double")
    word = F.col(f"{name}_word")
    is_strong = F.coalesce(F.lower(F.col(f"{name}{unit_group}")).isin(*strong.lower().split("|")), F.lit(False))
    plausible = first.between(low, high) & F.coalesce(second.between(low, high), F.lit(True))
    year = year_like(first) & F.coalesce(year_like(second), F.lit(True)) & ~is_strong & (word.isNull() if is_range else F.lit(True))
    refusal = F.when(found.isNull(), "not found").when(~plausible, "outside the plausible range").when(year, "reads as a calendar year").when(word.isNull() & ~is_strong, "no context near the number")
    shown = F.when(second.isNotNull(), F.concat(number(first), F.lit("–"), number(second))).otherwise(number(first))
    confidence = F.when(any_of(hedges, "low_text"), sure[2]).when(word.isNotNull(), sure[0]).otherwise(sure[1])
    reason = F.coalesce(F.concat(F.lit("rejected: "), refusal), F.concat(F.lit("pattern with context '"), word, F.lit("'")), F.lit("pattern with an unambiguous unit"))
    return _field(key, F.when(refusal.isNull(), shown), unit, found, confidence, reason)


def _simple(key: str, found: str, confidence: float, change=lambda c: c) -> Column:
    c = F.col(found)
    return _field(key, change(c), None, c, F.lit(confidence), F.when(c.isNull(), "not found").otherwise("pattern"))


def _material() -> Column:
    one, other, word, labelled = (F.col(c) for c in ("m_one", "m_other", "m_word", "m_labelled"))
    reason = F.when(one.isNotNull(), "compound named").when(other.isNull(), "not found").when(labelled, "explicit label").when(word.isNotNull(), F.concat(F.lit("context '"), word, F.lit("'"))).otherwise("rejected: generic word without construction context")
    return _field("material", F.coalesce(one, F.when(labelled | word.isNotNull(), other)), None, F.coalesce(one, F.trim("m_near")), F.when(one.isNotNull(), 0.90).otherwise(0.84), reason)


def structural(name: Column) -> Column:
    """A section heading that stands where a name should."""
    return F.coalesce(name.rlike(HEADING), F.lit(False))


def without_site(title: Column) -> Column:
    """A title without the names of sites behind it, three at most; the title itself if nothing else is left."""

    def cut(kept: Column) -> Column:
        for _ in range(3):
            kept = F.btrim(F.regexp_replace(kept, rf"(?i)\s*[-–—|:]\s*(?:{'|'.join(SITES)})\s*$", ""), F.lit(" -–—|:"))
        return kept

    return let(F.trim(title), lambda whole: F.coalesce(let(cut(whole), no_blank), whole))


def title_line(lines: Column) -> Column:
    """Of the lines with letters and digits the one with most signs of a product title, then the shortest, then the first."""

    def judged(line: Column, pos: Column) -> Column:
        score = sum((F.when(line.rlike(pattern), points).otherwise(0) for pattern, points in TITLE_SIGNS), F.lit(0))
        fits = F.length(line).between(8, 220) & line.rlike("[A-Za-z]") & line.rlike("[0-9]") & ~structural(line) & ~line.rlike("^(?:===|---)")
        return F.when(fits, F.struct((-score).alias("away"), F.length(line).alias("size"), pos.alias("pos"), line.alias("line")))

    return F.array_min(F.transform(lines, judged))["line"]


def _name() -> tuple[Column, Column]:
    """The name as a struct, to be worked out once, and the field that reads it from ``name``."""
    hint, title, part, kind, first = (F.col(c) for c in ("hint", "hint_title", "n_part", "n_kind", "n_first"))
    hinted = F.when(~title.rlike(NO_TITLE), title)
    phrase = F.trim(kind)
    both = F.substring(F.when(F.contains(F.lower(part), F.lower(phrase)), part).otherwise(F.concat_ws(" ", part, phrase)), 1, 80)
    read = F.struct(
        F.coalesce(F.when(part.isNotNull() & kind.isNotNull(), both), F.substring(phrase, 1, 80), part, F.substring(first, 1, 70)).alias("value"), F.coalesce(part, kind, F.substring(first, 1, 70)).alias("snippet"),
        F.when(part.isNotNull() & kind.isNotNull(), 0.92).when(kind.isNotNull(), 0.86).when(part.isNotNull(), 0.85).otherwise(0.45).alias("confidence"), F.lit("part number, product-type phrase or first line").alias("reason"),
    )
    given = F.struct(hinted.alias("value"), hint.alias("snippet"), F.lit(0.95).alias("confidence"), F.lit("hint").alias("reason"))
    line = title_line(F.col("lines"))
    recovered = F.struct(F.substring(line, 1, 160).alias("value"), line.alias("snippet"), F.lit(0.90).alias("confidence"), F.lit("title line, for a heading in the name's place").alias("reason"))
    guessed = F.when(hinted.isNotNull(), given).otherwise(read)

    def sound(n: Column) -> Column:
        heading = F.trim(F.coalesce(n["value"], F.lit(""))).rlike("^$") | structural(n["value"])
        return F.when(~heading, n).otherwise(let(recovered, lambda r: F.when(r["value"].isNotNull(), r).otherwise(read)))

    n = F.col("name")
    return let(guessed, sound), _field("product_name", n["value"], None, n["snippet"], n["confidence"], n["reason"])


def _category() -> Column:
    at, hit, named_at, named, hinted = (F.col(c) for c in ("cat.at", "cat.hit", "named.at", "named.hit", "category_hinted"))
    label = F.get(F.array(*[F.lit(x) for _, x, _ in CATEGORIES]), at)
    sure = F.get(F.array(*[F.lit(x) for _, _, x in CATEGORIES]), at)
    outright = F.get(F.array(*[F.lit(x) for _, x in NAMED_CATEGORIES]), named_at)
    typed = F.when(F.col("product_type").isNotNull(), F.when(F.contains("low_text", F.lit("belt")), "Sanding Belt").when(F.contains("low_text", F.lit("disc")), "Sanding Disc"))
    value = F.coalesce(outright, typed, label, hinted, F.lit("Industrial Component"))
    snippet = F.when(named_at.isNotNull(), named).when(typed.isNotNull(), F.col("product_type")).when(at.isNotNull(), hit).otherwise(F.coalesce(hinted, F.substring(F.coalesce("n_line", "text"), 1, 30)))
    confidence = F.when(named_at.isNotNull(), 0.92).when(typed.isNotNull(), 0.90).when(at.isNotNull(), sure).when(hinted.isNotNull(), 0.95).otherwise(0.60)
    reason = F.when(named_at.isNotNull(), "product-type phrase").when(typed.isNotNull(), "product type row").when(at.isNotNull(), "keyword").when(hinted.isNotNull(), "hint").otherwise("default")
    return _field("category", value, None, snippet, confidence, reason)


def _extra(label: Column, value: Column, unit: Column, snippet: Column, confidence: float, reason: str) -> Column:
    return F.struct(
        extra_key(label).alias("field_key"), F.lit(False).alias("is_core"), label.alias("label"), value.alias("value"), unit.alias("unit"), snippet.alias("snippet"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reasoning")
    ).cast(FIELD)


def _dynamic() -> list[Column]:
    """From the columns ``d<k>`` (whole match), ``d<k>_1`` and ``d<k>_2`` (its groups)."""
    return [F.when(F.col(f"d{k}_1").isNotNull(), _extra(F.lit(label), F.col(f"d{k}_1"), F.col(f"d{k}_2"), F.col(f"d{k}"), 0.82, "pattern")) for k, (label, _) in enumerate(DYNAMIC)]


def stated_unit(key: Column, unit: Column, snippet: Column) -> Column:
    """The unit, but null if it repeats the key or is 'grit', and the one unit that the snippet states where that is another."""
    stated = F.array_compact(F.array(*[F.when(snippet.rlike(pattern), name) for pattern, name in STATED_UNITS]))
    kept = F.when((extra_key(unit) != key) & ~extra_key(unit).isin("grit", ""), F.trim(unit))
    return F.when(kept.isNotNull(), let(stated, lambda x: F.when((F.size(x) == 1) & (F.lower(F.get(x, F.lit(0))) != F.lower(kept)), F.get(x, F.lit(0))).otherwise(kept)))


def spec_rows(text: Column) -> Column:
    """ARRAY<FIELD> of 'Label: Value' lines, of the specification section where there is one; a unit in the label's last brackets is the unit."""
    after = F.get(F.split(text, r"(?i)=== extracted specification tables ===", 2), F.lit(1))
    section = F.coalesce(F.get(F.split(after, r"(?i)=== page content ==="), F.lit(0)), text)
    lines = F.filter(F.transform(F.split(section, "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")))
    even = F.transform(lines, lambda x: F.struct(x.alias("line"), F.when(any_of(UNEVEN, x), squeeze(x)).otherwise(x).alias("even")))
    parts = F.transform(even, lambda r: F.struct(F.trim(F.substring_index(r["even"], ":", 1)).alias("label"), F.trim(F.substr(r["even"], F.instr(r["even"], ":") + 1)).alias("value"), r["line"].alias("line")))
    fit = lambda r: (r["label"] != "") & (r["value"] != "") & (F.length(r["label"]) <= 60) & (F.length(r["value"]) <= 240)
    kept = F.filter(parts, lambda r: fit(r) & ~F.lower(r["label"]).isin(SKIPPED_ROWS) & ~r["value"].isin(SKIPPED_VALUES))
    bracket = r"\s*\(([^()]{1,12})\)\s*$"
    has = lambda r: F.contains(r["label"], F.lit("("))
    read = F.transform(kept, lambda r: F.struct(F.when(has(r), F.trim(F.regexp_replace(r["label"], bracket, ""))).otherwise(r["label"]).alias("label"), F.when(has(r), group(r["label"], bracket, 1)).alias("unit"), r["value"].alias("value"), r["line"].alias("line")))
    named = F.transform(read, lambda r: F.struct(F.coalesce(F.try_element_at(literal_map(ROW_NAMES), F.lower(r["label"])), r["label"]).alias("label"), r["unit"].alias("unit"), r["value"].alias("value"), r["line"].alias("line")))
    made = F.transform(named, lambda r: _extra(r["label"], r["value"], stated_unit(extra_key(r["label"]), r["unit"], r["line"]), r["line"], 0.94, "specification row"))
    return F.filter(made, lambda f: ~f["field_key"].isin(SKIPPED_KEYS))


def extract(texts: DataFrame) -> DataFrame:
    """``product_id, raw_text, name_hint, category_hint`` -> the long fields table, before validation; no row is shuffled but
    where a small table is dealt over all cores. What stands in the text is judged field by field and only if it is read."""
    rest = ["product_id", "raw_text", "usable"]
    rows = _found(spread(texts)).select(*rest, "norm_text", F.posexplode("found").alias("pos", "f")).select(*rest, "norm_text", "pos", "f.*")
    return rows.select(*rest, "pos", *FIELDS, *[c.alias(k) for k, c in _grounds(F.col).items()])


def packed(texts: DataFrame) -> DataFrame:
    """``product_id, raw_text, usable, fields``: a row per text with its fields, grounds included, in an array."""
    grounded_field = lambda f: F.struct(*[f[c].alias(c) for c in FIELDS], *[c.alias(k) for k, c in _grounds(lambda c: f[c] if c in FIELDS else F.col(c)).items()])
    return staged(_found(texts), {"fields": F.transform("found", grounded_field)}).select("product_id", "raw_text", "usable", "fields")


def _grounds(of) -> dict[str, Column]:
    """``is_grounded, evidence_ok`` of a field; ``of`` names a field's columns and those of its text."""
    value, snippet = of("value"), of("snippet")
    stands = F.when(verbatim(snippet, of("raw_text")), True).otherwise(_stands(snippet, of("norm_text")))
    return {"is_grounded": F.when(value.isNotNull(), stands), "evidence_ok": numeric_evidence(value, snippet) & material_evidence(of("field_key"), value, snippet)}


def _found(texts: DataFrame) -> DataFrame:
    """``product_id, raw_text, usable, found, norm_text``: a row per text with its fields in an array, and the text as snippets
    are held against it (null where all of them stand in it letter by letter).

    Texts under 10 characters, and null ones, give their 11 core fields as ``flagged_validation_error``. Of dynamic
    fields with one key the pattern's comes before the specification row's. There is no shuffle. Each pattern is held
    against a text once, and only if a word that it needs is there; its groups are read from what it found.
    """
    text = F.col("text")
    t = texts.withColumn("text", F.coalesce("raw_text", F.lit(""))).withColumn("low_text", F.lower("text"))
    found = lambda pattern: F.regexp_extract(text, pattern, 0)
    t = staged(
        t,
        {
            "v_at": F.regexp_instr(text, F.lit(VOLTAGE)), "c_at": F.regexp_instr(text, F.lit(CURRENT)), "m_at": told(GENERIC_WORDS, F.regexp_instr(text, F.lit(GENERIC_WORD))), "t0": told("temp|operating", found(TEMPERATURE)), "ip": told("ip", found(IP_CODE)), "plug": found(CONNECTOR),
            "mount": found(MOUNTING), "m_one": told(COMPOUND_WORDS, found(rf"(?i)\b({COMPOUNDS})\b")), "n_part": told("-|–", found(PART)), "n_kind": told(TYPE_WORDS, found(TYPE_PHRASE), "text"), "certificates": F.regexp_extract_all(text, F.lit(CERTIFICATE), 1),
            "product_type": told("product", found(PRODUCT_TYPE)), "named": first_found(text, [(w, p) for w, (p, _) in zip(NAMED_WORDS, NAMED_CATEGORIES, strict=True)]), "cat": first_found(text, [(re.sub(r"\(\?i\)|\\b|[()]", "", p), p) for p, _, _ in CATEGORIES]), "lines": F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "specs": spec_rows(text), "hint": no_blank(F.trim("name_hint")), "category_hinted": no_blank(F.trim("category_hint")),
            **{f"d{k}": told(w, found(p)) for k, (w, (_, p)) in enumerate(zip(DYNAMIC_WORDS, DYNAMIC, strict=True))},
        },
        compiled=True,
    )
    blanks = ["t0", "ip", "plug", "mount", "m_one", "n_part", "n_kind", "product_type", *(f"d{k}" for k in range(len(DYNAMIC)))]
    t = t.withColumns({c: no_blank(F.col(c)) for c in blanks})
    at = lambda name, pattern: F.when(F.col(f"{name}_at") > 0, F.regexp_extract(F.substr(text, F.col(f"{name}_at")), pattern, 0))
    t = staged(
        t,
        {
            "v0": at("v", VOLTAGE), "c0": at("c", CURRENT), "m_other": at("m", GENERIC_WORD), "hint_title": F.when(~structural(F.col("hint")), without_site(F.col("hint"))),
            "n_line": F.get(F.filter("lines", lambda x: ~x.rlike("^(?:---|Fetch Error|Sparse Content)")), F.lit(0)), "n_first": F.coalesce(without_site(F.get(F.filter("lines", lambda x: ~x.rlike(NO_LINE)), F.lit(0))), F.substring(text, 1, 60)),
            **{f"t{k}": F.regexp_extract("t0", TEMPERATURE, k) for k in (1, 2, 3)}, **{f"d{n}_{k}": F.regexp_extract(f"d{n}", p, k) for n, (_, p) in enumerate(DYNAMIC) for k in (1, 2)},
        },
        compiled=True,
    )
    t = t.withColumns({c: no_blank(F.col(c)) for c in ["t1", "t2", "t3", *(f"d{n}_{k}" for n in range(len(DYNAMIC)) for k in (1, 2))]})
    t = staged(
        t,
        {
            **{f"v{k}": F.regexp_extract("v0", VOLTAGE, k) for k in (1, 2, 3)}, **{f"c{k}": F.regexp_extract("c0", CURRENT, k) for k in (1, 2)},
            "v_near": window(text, F.col("v_at"), F.col("v0"), 45, 20), "c_near": window(text, F.col("c_at"), F.col("c0"), 45, 20), "m_near": window(text, F.col("m_at"), F.col("m_other"), 60, 40), "m_close": window(text, F.col("m_at"), F.col("m_other"), 40, 24),
            "dynamic": F.concat(F.array_compact(F.array(*_dynamic())), F.col("specs")), "usable": F.length(F.trim(text)) >= 10,
        },
    )
    name, name_field = _name()
    t = staged(
        t.drop("specs", *(f"d{k}{x}" for k in range(len(DYNAMIC)) for x in ("", "_1", "_2"))),
        {
            "v_word": context_word(F.col("v_near"), VOLTAGE_WORDS), "c_word": context_word(F.col("c_near"), CURRENT_WORDS), "m_word": context_word(F.col("m_near"), MATERIAL_WORDS),
            "m_labelled": F.coalesce(F.col("m_close").rlike(MATERIAL_LABEL), F.lit(False)), "keys": F.transform("dynamic", lambda d: d["field_key"]), "name": name,
        },
        compiled=True,
    )
    temp_unit = F.coalesce("t3", F.lit("°C"))
    core = [
        name_field,
        _category(),
        _rating("v", "voltage_rating", VOLTAGE_WORDS, "VAC|VDC|Volts|mV|kV", 3, 0.1, 40000.0, (0.90, 0.78, 0.50), F.lit("V"), "supposedly|around|maybe", True),
        _rating("c", "current_rating", CURRENT_WORDS, "mA|Amps|Amp", 2, 0.0001, 5000.0, (0.88, 0.76, 0.55), F.when(F.lower("c2") == "ma", "mA").otherwise("A"), "maybe|around", False),
        _simple("ip_rating", "ip", 0.94, F.upper),
        _simple("connector_type", "plug", 0.89),
        _field("operating_temperature_min", number(F.col("t1")), temp_unit, F.col("t0"), F.lit(0.85), F.lit("labelled range")),
        _field("operating_temperature_max", number(F.col("t2")), temp_unit, F.col("t0"), F.lit(0.85), F.lit("labelled range")),
        _material(),
        _field("certifications", no_blank(F.array_join(F.array_sort(F.array_distinct(F.transform("certificates", F.upper))), ", ")), None, F.array_join("certificates", ", "), F.lit(0.92), F.lit("pattern")),
        _simple("mounting_type", "mount", 0.86),
    ]
    first_of_key = F.filter("dynamic", lambda d, i: (F.array_position(F.col("keys"), d["field_key"]) == i + 1) & (d["field_key"] != ""))
    nothing = F.array(*[_field(k, F.lit(None).cast("string"), None, F.lit(None).cast("string"), F.lit(0.0), F.lit("no usable text")) for k in CORE])
    rest = ["product_id", "raw_text", "usable"]
    out = staged(t.select(*rest, F.when(F.col("usable"), F.array(*core)).alias("core"), first_of_key.alias("more")), {"found": F.coalesce(F.concat("core", "more"), nothing)})
    other = F.exists("found", lambda f: f["value"].isNotNull() & ~F.coalesce(verbatim(f["snippet"], F.col("raw_text")), F.lit(False)))
    return staged(out, {"norm_text": F.when(other, _normal(F.col("raw_text")))})


def verbatim(snippet: Column, text: Column) -> Column:
    """The snippet stands in the text letter by letter, so it does so too when both are in lower case and single spaces
    (but for the Greek capital whose lower case depends on what follows it)."""
    return F.contains(text, snippet) & snippet.rlike(r"\S") & ~F.contains(snippet, F.lit("Σ"))


def _normal(text: Column) -> Column:
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def _stands(snippet: Column, normal_text: Column) -> Column:
    def judge(z: Column) -> Column:
        parts = F.regexp_extract_all(z["s"], F.lit(r"([a-z0-9°µ.\-/]+)"), 1)
        share = let(parts, lambda p: (F.size(p) > 0) & (F.size(F.filter(p, lambda x: F.contains(z["t"], x))) >= 0.8 * F.size(p)))
        return (z["s"] != "") & (F.contains(z["t"], z["s"]) | share)

    return F.coalesce(let(F.struct(F.lower(squeeze(snippet)).alias("s"), normal_text.alias("t")), judge), F.lit(False))


def grounded(snippet: Column, text: Column) -> Column:
    """The snippet, white space and case aside, stands in the text, or four fifths of its tokens do."""
    return _stands(snippet, _normal(text))


def _numbers(c: Column) -> Column:
    ranges = F.regexp_replace(F.regexp_replace(c, r"(?i)(?<=\d)\s+to\s+(?=\d)", " "), r"(?<=\d)\s*(?:[-–—]|\.\.\.|…)\s*(?=\d)", " ")
    plain = F.when(c.rlike(r"(?i)\d\s*(?:[-–—]|\.\.\.|…|\sto\s)"), ranges).otherwise(c)
    return F.transform(F.regexp_extract_all(plain, F.lit(r"([-+]?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def numeric_evidence(value: Column, snippet: Column) -> Column:
    """Every number of the value stands in the snippet."""
    told = F.struct(_numbers(value).alias("claimed"), _numbers(F.coalesce(snippet, F.lit(""))).alias("stated"))
    return F.coalesce(value.isNull() | (value == snippet) | ~value.rlike("[0-9]") | let(told, lambda t: (F.size(t["claimed"]) == 0) | (F.size(F.array_except(t["claimed"], t["stated"])) == 0)), F.lit(True))


def material_evidence(key: Column, value: Column, snippet: Column) -> Column:
    """A compound material is claimed only if the snippet names the same compound, and grit only if a part of the body is made of it."""
    shown = F.coalesce(snippet, F.lit(""))
    named = let(group(F.lower(value), f"(?i)({COMPOUNDS})", 1), lambda n: n.isNull() | F.contains(F.lower(squeeze(shown)), n))
    return (key != "material") | value.isNull() | (named & body_material(value, shown))


def body_material(value: Column, snippet: Column) -> Column:
    """False for words of grit and coating (they are no body material), unless the snippet says that a part of the body is the value."""
    grit = let(F.lower(F.concat_ws(" ", value, snippet)), lambda text: F.exists(F.array(*map(F.lit, ABRASIVES)), lambda a: F.contains(text, a)))
    body = F.concat(F.lit(rf"(?i)\b(?:{'|'.join(BODY_PARTS)})\s*(?:material)?\s*[:=-]?\s*\Q"), F.trim(value), F.lit(r"\E(?=\s*(?:[.;,\n]|$))"))
    return ~grit | F.regexp_like(snippet, body)
