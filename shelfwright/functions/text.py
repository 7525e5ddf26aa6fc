"""Text keys, tokens and number formats as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import ABBREVIATIONS, AMBIGUOUS, COMPANY_ENDINGS, CORPORATE_SUFFIXES, PLACEHOLDERS, STOPWORDS


def literal_map(pairs: dict[str, str]) -> Column:
    """A constant map; Spark folds it once per query, so a lookup is one probe."""
    return F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*map(F.lit, pairs.values())))


def no_blank(c: Column) -> Column:
    """Null for the empty string. (Spark's nullif adds a projection for each use, which makes wide plans slow to optimize.)"""
    return F.when(c != "", c)


def any_of(words: str, text: Column | str) -> Column:
    """Whether one of the words, separated by |, stands in the text."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words.split("|")])


#: What every text that Spark reads as a number looks like, and some that it does not.
NUMBER_LIKE = r"^[^!-~]*[+-]?(?:(?i:nan|inf|infinity)|[0-9.][0-9a-fA-FxXpP.+-]*)[^!-~]*$"


def to_double(c: Column) -> Column:
    """``try_cast`` to double, tried only where the text may be a number, as each failure costs an exception."""
    return F.when(c.rlike(NUMBER_LIKE), c.try_cast("double"))


def squeeze(c: Column) -> Column:
    """White space as single spaces, none at the ends. Single spaces are not matched, as most white space is that already."""
    return F.trim(F.regexp_replace(c, r" \s+|[^\S ]\s*", " "))


def is_placeholder(c: Column) -> Column:
    """Null, blank, or one of the markers that stand for an empty cell."""
    s = F.lower(F.trim(c))
    return F.coalesce((s == "") | s.isin(PLACEHOLDERS), F.lit(True))


def meaningful(c: Column) -> Column:
    """White space collapsed and outer blanks and hyphens dropped; null if nothing or only a marker is left."""
    s = F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" -"))
    return F.when((s != "") & ~F.lower(s).isin("unbranded", "no brand", "no unilog brand", "no dib brand", "n/a", "na", "none", "null", "unknown"), s)


def brand_key(name: Column) -> Column:
    """Lower case, symbols as spaces, trailing corporate words dropped as often as they occur; null gives ''."""
    words = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]+", " "), " +", " ")
    any_suffix = "|".join(CORPORATE_SUFFIXES)
    return F.trim(F.regexp_replace(F.trim(words), f"(^| )({any_suffix})( ({any_suffix}))*$", ""))


def mpn_key(mpn: Column) -> Column:
    """Letters and digits, upper case, leading zeros of each run of digits dropped (the intent of K1: 'A100' keeps its zeros)."""
    kept = F.upper(F.regexp_replace(F.coalesce(mpn, F.lit("")), "[^A-Za-z0-9]+", ""))
    return F.regexp_replace(kept, "(?<![0-9])0+(?=[0-9])", "")


def value_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def extra_key(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def identity_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def soft_key(c: Column) -> Column:
    """For scoring: no-break spaces, white space and case ignored."""
    return F.lower(squeeze(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(" "))))


def hard_key(c: Column) -> Column:
    """For scoring: symbols and punctuation ignored too."""
    return squeeze(F.regexp_replace(soft_key(c), r"[^a-z0-9\s]+", ""))


def expand_abbreviations(text: Column) -> Column:
    """Whole alphabetic tokens replaced from the shorthand table; all else kept."""
    known = literal_map(ABBREVIATIONS)
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1)
    return F.array_join(F.transform(runs, lambda t: F.coalesce(F.try_element_at(known, F.lower(t)), t)), "")


def tokens(text: Column) -> Column:
    """Alphabetic tokens, lower case, longer than one letter, no stopwords; repeats stay."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]+)"), 1), F.lower)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def ambiguous_extra(found: Column) -> Column:
    """Meanings of ambiguous abbreviations among the tokens that another token corroborates."""
    readings = [F.when(F.array_contains(found, short) & F.arrays_overlap(found, F.array(*map(F.lit, words))), F.lit(meaning)) for short, (meaning, words) in AMBIGUOUS.items()]
    return F.array_compact(F.array(*readings))


def company_tokens(c: Column) -> Column:
    """Words that name a company: no endings such as Inc, three letters at least unless there is a digit; none of a placeholder."""
    words = F.regexp_extract_all(F.lower(F.coalesce(meaningful(c), F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.filter(words, lambda t: ~t.isin(COMPANY_ENDINGS) & ((F.length(t) >= 3) | t.rlike("[0-9]")))


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """Null when the whole is 0; half-even."""
    return F.bround(F.lit(100.0) * F.try_divide(part, whole), places)


def clean_number(c: Column) -> Column:
    """'24.0' as '24', other numbers without trailing zeros, text as it is."""
    n = to_double(c)
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(n.isNotNull() & ~F.isnan(n) & F.trim(c).rlike(r"^[+-]?[0-9]+\.?[0-9]*$"), F.regexp_replace(plain, r"^\+", "")).otherwise(F.trim(c))


def safe_confidence(c: Column, default: float = 0.60) -> Column:
    n = c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def word_cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space within them if there is one."""
    head = F.substring(text, 1, most)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) > most, F.rtrim(F.regexp_replace(cut, "[ ,]+$", ""))).otherwise(text)
