"""Line dedup by site-relative frequency: lines on more than a share of a host's pages are its boilerplate and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

RATIO = 0.1
#: What stands on one page only is no repetition, however few pages the host has.
LEAST_PAGES = 2
#: Bytes of boilerplate keys that may be sent to every task; more are joined by shuffle.
BROADCAST_BYTES = 8_000_000


def line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host, text`` -> ``host, bad``: keys of the lines on more than ``ratio`` of the host's pages, ``least_pages`` at least.

    Counts are pre-aggregated per task. A host's list holds at most (mean lines a page / ratio) keys.
    """
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), line_key))).alias("line"))
    seen = lines.where(F.col("line") != line_key(F.lit(""))).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    return seen.join(totals, "host").where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("bad"))


def dedup_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """All columns and rows of ``docs``; ``text`` loses the lines that exceed the boilerplate ratio on their host.

    A page counts once for a line, however often the line stands there; a repeated row is a page of its own. Lines are
    compared without blanks at their ends; blank lines are never boilerplate. Kept lines keep order and blanks. Rows
    without a host share one host. Null texts stay null and hold no lines, but count as pages; a text whose lines all go
    becomes empty and its row stays. An ``n_chars`` column gets the new length of a text that lost lines.
    """
    site, bad, left = fresh(docs, "line_host", "line_bad", "line_left")
    keyed = docs.withColumn(site, F.coalesce(F.col(host).cast("string"), F.lit("")))
    lists = materialize(boilerplate(keyed.select(F.col(site).alias("host"), "text"), ratio, least_pages), "boilerplate").select(F.col("host").alias(site), F.col("bad").alias(bad))
    size = lists.agg(F.coalesce(F.sum(8 * F.size(bad) + F.length(site) + 64), F.lit(0))).first()[0]
    joined = keyed.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, site, "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(bad, line_key(x)))
    out = joined.withColumn(left, F.when(F.col(bad).isNotNull() & F.col("text").isNotNull(), kept))
    lost = F.size(left) < F.size(lines)
    text = F.when(lost, F.array_join(left, "\n")).otherwise(F.col("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", text).select(*docs.columns)


def line_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_lines, n_kept, text``: what dedup_lines leaves of each document (lines of a null text: 0)."""
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(c, "\n"))).cast("long")
    after = dedup_lines(docs.select("doc_id", "source", "text", F.col("text").alias("__before")), **options)
    n_kept = F.when((F.col("text") == "") & (F.col("__before") != ""), F.lit(0)).otherwise(count("text")).cast("long")
    return after.select("doc_id", count("__before").alias("n_lines"), n_kept.alias("n_kept"), "text")


#: DuckDB SQL for line_report with the production parameters.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text FROM documents),
l AS (SELECT r, doc_id, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
bad AS (SELECT k.host, key FROM k JOIN (SELECT host, count(*) AS pages FROM d GROUP BY host) h ON h.host = k.host WHERE key <> ''
        GROUP BY k.host, key, pages HAVING count(DISTINCT r) >= {LEAST_PAGES} AND count(DISTINCT r) > {RATIO} * pages),
m AS (SELECT k.*, b.key IS NULL AS keep FROM k LEFT JOIN bad b ON b.host = k.host AND b.key = k.key),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (keep) AS n_kept, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '') AS text FROM m GROUP BY r)
SELECT d.doc_id, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_kept, 0)::BIGINT AS n_kept, CASE WHEN d.text IS NULL THEN NULL ELSE g.text END AS text
FROM d LEFT JOIN g USING (r)
"""
