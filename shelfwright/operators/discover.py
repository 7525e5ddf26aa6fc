"""The best source for a sparse catalogue row among candidate pages, with the stage at which others fail."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import company_tokens, meaningful
from .pages import READY, SPARSE
from .sourcing import policy
from .staging import sent_if_small, slices, spread

MOST_CANDIDATES, PREFIX = 10, 3
#: White space and punctuation that may part the characters of a part number, inside a character class.
SEPARATORS = r"\s\p{Z}\x{85}\x{1c}-\x{1f}._/\-–—"
#: What parts the chains of a page, as Python writes it: its white space is that of SEPARATORS.
NO_SEPARATOR = r"[^A-Za-z0-9\s._/\-–—]+"
#: Bytes of part numbers that may be sent to every task.
NUMBER_BYTES = 64_000_000
# Words of a technical page and of a shop page.
TECHNICAL = ["specifications", "technical data", "technical specifications", "manufacturer part number", "model", "sku", "upc", "gtin", "weight", "dimensions", "dimension", "length", "width", "height", "diameter", "size", "material", "backing", "grit", "pack quantity", "country of origin", "voltage", "current", "pressure", "flow", "temperature", "capacity", "thread", "connection", "rating", "certification", "certifications"]
SHOP = ["add to cart", "your cart", "continue shopping", "free shipping", "secure checkout", "wishlist", "sale price", "regular price", "unit price", "sign in", "create account"]
SPEC_ROW = r"(?m)^\s*[A-Za-z][A-Za-z0-9 /_()#%&.+-]{1,58}\s*:\s*\S.{0,220}$"


def richness(text: Column) -> Column:
    """Density of product detail: capped length, specification rows, technical words, headings; less for shop words."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    rows = F.regexp_count(t, F.lit(SPEC_ROW))
    heading = F.contains(low, F.lit("specifications")) | F.contains(low, F.lit("technical data"))
    points = F.least(F.length(t), F.lit(3000)) / 150.0 + F.least(rows, F.lit(15)) * 5.0 + F.least(hits(TECHNICAL), F.lit(15)) * 2.0
    points = points + F.when(F.contains(low, F.lit("=== extracted specification tables ===")), 12.0).otherwise(0.0) + F.when(heading, 6.0).otherwise(0.0)
    return F.bround(points - F.least(hits(SHOP), F.lit(10)) * 1.5, 3)


def search_query(requests: DataFrame) -> DataFrame:
    """Adds ``query``: quoted part number, manufacturer, brand, and up to ten words of the description (100 characters)."""
    words = F.array_join(F.slice(F.split(meaningful(F.col("part_desc")), " "), 1, 10), " ")
    part = meaningful(F.col("mfg_part_num"))
    return requests.withColumn("query", F.concat_ws(" ", F.when(part.isNotNull(), F.concat(F.lit('"'), part, F.lit('"'))), meaningful(F.col("manufacturer")), meaningful(F.col("brand")), F.substring(words, 1, 100)))


def compact_number(mpn: Column) -> Column:
    """Letters and digits of a part number, upper case; '' if there are none. No zeros are dropped here."""
    return F.upper(F.regexp_replace(F.coalesce(mpn, F.lit("")), "[^A-Za-z0-9]+", ""))


def mpn_pattern(mpn: Column) -> Column:
    """A pattern for the part number with any punctuation between its characters and no letter or digit next to it."""
    letters = F.filter(F.split(compact_number(mpn), ""), lambda c: c != "")
    return F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), F.array_join(letters, f"[{SEPARATORS}]*"), F.lit("(?![A-Za-z0-9])"))


def mpn_on_page(mpn: Column, text: Column) -> Column:
    """Whether the number stands on the page: one pattern a row, for few pairs. ``numbers_on_pages`` is for many."""
    return F.coalesce(mpn.rlike("[A-Za-z0-9]") & F.regexp_like(text, mpn_pattern(mpn)), F.lit(False))


def page_grams(pages: DataFrame, longest: int, begins: Collection[str], key: str = "url", text: str = "text") -> DataFrame:
    """``key, gram``: every run of whole words of a page that only separators part, joined without them, in upper case, up
    to ``longest`` characters, that begins with one of ``begins`` (of PREFIX characters; shorter ones are whole runs), once
    a page. A number can only stand on a page as one of these: it starts and ends with a word.

    Runs grow from each word until they are too long, so a page takes time in line with its length.
    """
    schema = T.StructType([pages.schema[key], T.StructField("gram", T.StringType())])
    begins = frozenset(begins)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, word = re.compile(NO_SEPARATOR), re.compile("[A-Za-z0-9]+")
        for batch in slices(batches, text, 500_000):
            at, grams = [], []
            for row, page in enumerate(batch.column(text).to_pylist()):
                found = set()
                for chain in parts.split(page or ""):
                    words = [w.upper() for w in word.findall(chain)]
                    for first in range(len(words)):
                        run = ""
                        for k in range(first, len(words)):
                            run += words[k]
                            if len(run) > longest:
                                break
                            if run[:PREFIX] in begins:
                                found.add(run)
                            elif len(run) >= PREFIX:
                                break
                at += [row] * len(found)
                grams += found
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(grams, pa.string())], names=[key, "gram"])

    return spread(pages.select(key, text)).mapInArrow(grow, schema)


def numbers_on_pages(numbers: DataFrame, pages: DataFrame, number: str = "mfg_part_num", key: str = "url", text: str = "text") -> DataFrame:
    """``key, number_key``: which part numbers stand on which pages, many against many without naming candidates.

    Runs of words of the pages meet the numbers by equality: where the numbers are few bytes, each task has them and only
    what was found is shuffled. Runs with the first PREFIX characters of no number fall out before that by a table of such
    beginnings, of which there are 36 to the power of PREFIX at most.
    """
    asked = numbers.select(compact_number(F.col(number)).alias("number_key")).where("number_key <> ''").distinct()
    begins = {row["begin"]: row["longest"] for row in asked.groupBy(F.substring("number_key", 1, PREFIX).alias("begin")).agg(F.max(F.length("number_key")).alias("longest")).collect()}
    if not begins:
        return pages.select(key, F.lit("").alias("number_key")).where("false")
    grams = page_grams(pages, max(begins.values()), begins, key, text)
    return grams.join(sent_if_small(asked, NUMBER_BYTES), F.col("gram") == F.col("number_key")).select(key, "number_key").distinct()


def corroborated(manufacturer: Column, brand: Column, text: Column, title: Column, host: Column) -> Column:
    """A word of the manufacturer's or brand's name stands in text, title or host; true if there is no usable name."""
    wanted = F.array_distinct(F.concat(company_tokens(manufacturer), company_tokens(brand)))
    evidence = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.concat_ws(" ", title, host, text)), "[^a-z0-9]+", " "), F.lit(" "))
    compact, compact_host = F.replace(evidence, F.lit(" "), F.lit("")), F.regexp_replace(F.coalesce(host, F.lit("")), "[^a-z0-9]", "")
    return (F.size(wanted) == 0) | F.exists(wanted, lambda w: F.contains(evidence, F.concat(F.lit(" "), w, F.lit(" "))) | F.contains(compact_host, w) | ((F.length(w) >= 4) & F.contains(compact, w)))


def candidate_urls(found: DataFrame) -> DataFrame:
    """``request_id, position, url`` -> first MOST_CANDIDATES distinct URLs of each request, by first position."""
    first = found.where("trim(url) <> ''").groupBy("request_id", "url").agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("position", "url"))
    return first.withColumn("place", rank).where(F.col("place") <= MOST_CANDIDATES).drop("place")


def judge_candidates(requests: DataFrame, candidates: DataFrame, pages: DataFrame, chosen_policy: str = "manufacturer_only") -> DataFrame:
    """Every candidate with its outcome: ``request_id, url, category, stage`` (null where it passes) ``, score, rank``.

    Stages in order: sourcing, fetch (no such page), identity (part number, then maker), content (sparse). ``pages`` is
    ``url, title, text``. Part numbers meet pages by equality of word runs. Pages are scored once each and joined last, so
    that a text is shuffled once, not once a candidate. The first of a request by score, then site
    kind, then position, then address has rank 1 among those that pass.
    """
    urls = policy(candidate_urls(candidates).select("url").distinct(), chosen_policy)
    c = candidate_urls(candidates).join(urls, "url").join(requests, "request_id").withColumn("number_key", compact_number(F.col("mfg_part_num")))
    held = numbers_on_pages(requests, pages.join(candidates.select("url").distinct(), "url", "left_semi")).withColumn("held", F.lit(True))
    c = c.join(held, ["url", "number_key"], "left").join(pages.withColumn("points", richness(F.col("text"))), "url", "left")
    kind = F.when(F.col("category") == "manufacturer", 0).when(F.col("category") == "unknown", 1).when(F.col("category") == "distributor", 2).otherwise(3)
    text = F.coalesce("text", F.lit(""))
    stage = (
        F.when(~F.col("allowed"), "sourcing").when(F.col("text").isNull(), "fetch").when(F.col("held").isNull(), "identity: part number")
        .when(~corroborated(F.col("manufacturer"), F.col("brand"), text, F.col("title"), F.col("host")), "identity: maker").when(F.length(text) < READY, "content")
    )
    judged = c.withColumns({"stage": stage, "score": F.coalesce("points", richness(F.lit(""))), "kind": kind})
    order = Window.partitionBy("request_id", F.col("stage").isNull()).orderBy(F.desc("score"), "kind", "position", "url")
    return judged.withColumn("rank", F.when(F.col("stage").isNull(), F.row_number().over(order))).select("request_id", "url", "category", "position", "stage", "score", "rank")


def best_sources(judged: DataFrame) -> DataFrame:
    return judged.where("rank = 1").select("request_id", "url", "category", "score")


def batch_outcomes(batch: DataFrame, pages: DataFrame, chosen_policy: str = "manufacturer_only") -> DataFrame:
    """A batch of addresses, each with what becomes of it: ``url, title, text, stage, reason``, one row per distinct address.

    ``stage`` is null where a page can be processed, else where it failed, with the reason: sourcing (policy), fetch (no
    such page), content (no text at all). A sparse page is processed; its reason says so. Addresses meet pages by a left
    join, so that none is lost; blank ones fail as sourcing.
    """
    urls = policy(batch.select("url").distinct(), chosen_policy)
    found = pages.groupBy("url").agg(F.max_by(F.struct("title", "text"), F.length(F.coalesce("text", F.lit("")))).alias("page"))
    joined = urls.join(found, "url", "left")
    text = F.trim(F.coalesce("page.text", F.lit("")))
    stage = F.when(~F.col("allowed"), "sourcing").when(F.col("page").isNull(), "fetch").when(text == "", "content")
    why = F.when(~F.col("allowed"), F.col("reason")).when(F.col("page").isNull(), "no such page").when(text == "", "empty page").when(F.length(text) < SPARSE, "sparse page")
    return joined.select("url", "page.title", "page.text", stage.alias("stage"), why.alias("reason"))
