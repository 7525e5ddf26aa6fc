"""Registered queries over the driver's tables, and the SQL that DuckDB can hold against them.

Catalogue rows, product texts, vocabularies and truth rows are derived from the given tables by SQL that both engines
read alike, so the work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import units as fu
from ..operators import attributes, classify, dedup, delivery, describe, discover, enrich, evaluate, extract, identity, pages, sourcing, trust, validate, vocabulary
from ..operators.staging import settled
from ..tables import ABBREVIATIONS, AMBIGUOUS, CORPORATE_SUFFIXES, DOMAINS, ITEM_TYPES, PLACEHOLDERS, STOPWORDS, unit_rows
from . import flows

CATALOG = """SELECT CAST(p_partkey AS BIGINT) AS row_index,
 CASE p_partkey % 3 WHEN 0 THEN concat('DW-AD-', CAST(p_partkey % 500 AS STRING)) WHEN 1 THEN concat('dw ad ', CAST(p_partkey % 500 AS STRING)) ELSE concat('DWAD', CAST(p_partkey % 500 AS STRING)) END AS Mfg_Part_Num,
 CASE p_partkey % 8 WHEN 0 THEN '3/8 CPLG BRS 150#' WHEN 1 THEN concat(CAST(p_size AS STRING), ' IN BALL VLV SS THD') WHEN 2 THEN 'LAV FCT 2-HNDL CHR' WHEN 3 THEN '1-1/2" MALLEABLE IRON ELBOW'
  WHEN 4 THEN concat('2" SCH 40 PVC PIPE NIP ', p_type) WHEN 5 THEN concat('DW AD ', CAST(p_size AS STRING), ' M8 PROX SNSR 24V') WHEN 6 THEN 'DW UNDERCOUNTER RACK DETERGENT PORTABLE' ELSE p_name END AS Part_Desc,
 CASE WHEN p_partkey % 11 = 0 THEN '-- Unbranded --' WHEN p_partkey % 2 = 0 THEN concat(p_brand, ' Inc.') ELSE concat(upper(p_brand), ' MFG CO') END AS Part_Manuf,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS E1_Brand FROM part"""
BRANDS = """SELECT p_brand AS MANUFACTURER_NAME, concat('M', substr(p_brand, 7)) AS MANUFACTURER_CODE, concat(p_brand, ' Line') AS BRAND_NAME, concat('B', substr(p_brand, 7)) AS BRAND_CODE, min(p_partkey) AS ordinal FROM part GROUP BY p_brand"""
TEXTS = """SELECT concat('P', CAST(p_partkey AS STRING)) AS product_id,
 concat('AX-', CAST(p_partkey AS STRING), ' ', p_name, ' inductive sensor', chr(10), 'Rated voltage: ', CAST(p_size * 10 AS STRING), ' VDC', chr(10), 'Rated current: ', CAST(p_size * 9 AS STRING), ' A', chr(10),
  CASE WHEN p_partkey % 3 = 0 THEN 'Protection IP67' WHEN p_partkey % 3 = 1 THEN 'Protection IP-677' ELSE 'Housing: nickel-plated brass, IP20, submersible' END, chr(10),
  'Operating temperature: -', CAST(p_size AS STRING), ' to ', CAST(p_partkey % 300 AS STRING), ' C', chr(10), 'Connector M12, CE, RoHS') AS raw_text,
 CAST(NULL AS STRING) AS name_hint, CASE WHEN p_partkey % 4 = 0 THEN 'Sensors' ELSE NULL END AS category_hint FROM part"""
LISTINGS = """SELECT concat('L', CAST(p_partkey AS STRING)) AS product_id, concat('=== EXTRACTED SPECIFICATION TABLES ===', chr(10), 'SKU: DCB', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 0 THEN ' UPC 12' ELSE '' END, chr(10),
 'Vendor: ', CASE p_partkey % 3 WHEN 0 THEN 'DeWalt' WHEN 1 THEN 'black & decker' ELSE p_brand END, chr(10), 'Manufacturer: ', CASE WHEN p_partkey % 2 = 0 THEN 'Stanley Black and Decker' ELSE concat('Maker ', p_brand) END, chr(10),
 'Price: 9.99', chr(10), 'Grit (grit): ', CAST(p_size AS STRING), chr(10), 'Item Weight (lb): ', CAST(p_size AS STRING), ' oz total 2 lb', chr(10), '=== PAGE CONTENT ===', chr(10),
 CASE p_partkey % 4 WHEN 0 THEN 'Sanding belt DCB518ASTS06G of aluminum' WHEN 1 THEN 'Grinding wheel, aluminum oxide' WHEN 2 THEN 'Proximity Sensor for rails, body: nylon' ELSE 'A page' END, chr(10), 'Note: not a row of the table') AS raw_text,
 CASE p_partkey % 7 WHEN 0 THEN concat('Belt ', CAST(p_partkey AS STRING), ' - Amazon.com | Official Site') WHEN 1 THEN 'Specifications' ELSE NULL END AS name_hint, CAST(NULL AS STRING) AS category_hint FROM part"""
UNIT_ROWS = """SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size * 0.25 AS STRING) AS value,
 CASE p_partkey % 9 WHEN 0 THEN 'Inches' WHEN 1 THEN 'in.' WHEN 2 THEN 'lbs' WHEN 3 THEN 'V_AC' WHEN 4 THEN 'furlong' WHEN 5 THEN 'degrees C' WHEN 6 THEN concat('x', CAST(p_size % 4 AS STRING)) WHEN 7 THEN '' ELSE 'G P M' END AS unit FROM part"""
LOV = """SELECT * FROM (VALUES (1, 'Fittings > Coupling', 'Material', 'Brass|Bronze|Stainless Steel'), (2, 'Fittings > Coupling', 'Connection Type', 'Threaded;Sweat'), (3, 'Fittings > Coupling', 'Size', CAST(NULL AS STRING)),
 (4, 'Valves > Ball Valve', 'Material', 'Stainless Steel,Brass'), (5, 'Valves > Ball Valve', 'Size', CAST(NULL AS STRING))) AS t(ordinal, classpath, label, values_raw)"""
ASKED = """SELECT CAST(p_partkey AS BIGINT) AS row_id, CASE p_partkey % 4 WHEN 0 THEN 'Fittings > Coupling' WHEN 1 THEN 'Valves > Ball Valve' WHEN 2 THEN 'fittings > coupling > reducing' ELSE 'Valves > Bal Valve' END AS classpath,
 CASE p_partkey % 5 WHEN 0 THEN 'material' WHEN 1 THEN 'Connection  Type' WHEN 2 THEN 'Size' WHEN 3 THEN 'Materials' ELSE 'Material' END AS label,
 CASE p_partkey % 7 WHEN 0 THEN 'BRASS' WHEN 1 THEN 'Threaded' WHEN 2 THEN 'stainless-steel' WHEN 3 THEN 'Bronz' WHEN 4 THEN '' WHEN 5 THEN 'sweat' ELSE 'Bronze' END AS value FROM part"""
REVIEWS = """SELECT concat('P', CAST(user_id AS STRING)) AS product_id, CASE event_id % 3 WHEN 0 THEN 'voltage_rating' WHEN 1 THEN 'ip_rating' ELSE 'material' END AS field_key,
 CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'override' END AS action, CAST(event_id AS STRING) AS new_value, CAST(NULL AS STRING) AS new_unit, ts FROM events"""
URLS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat('https://www.moen.com/p/', CAST(page_id AS STRING)) WHEN 2 THEN concat('smile.amazon.co.uk/dp/', CAST(page_id AS STRING)) WHEN 3 THEN concat('http://10.0.', CAST(page_id % 256 AS STRING), '.1:8080/x') WHEN 4 THEN 'ftp://files.turck.de/a' ELSE 'https://www.grainger.com:22/x' END AS url FROM pages"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The shared SQL with its table read from ``sf_dir``."""
    for name in ("part", "events", "pages"):
        if sql.rstrip().endswith(f"FROM {name}") or f"FROM {name} GROUP" in sql:
            return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf_dir, name))
    return spark.sql(sql)


def _texts(spark, d):
    return derived(spark, d, TEXTS)


def _fields(spark, d):
    return validate.validated(_texts(spark, d))


def dedup_survivors(spark, d):
    return dedup.survivors(derived(spark, d, CATALOG)).select("row_index", "Mfg_Part_Num", "Part_Manuf", "mpn_key", "brand_key")


def dedup_report(spark, d):
    return dedup.dedup_report(derived(spark, d, CATALOG))


def mpn_collisions(spark, d):
    return dedup.collisions(derived(spark, d, CATALOG)).select("mpn_key", "brands", "n_brands", F.col("n_rows").cast("long").alias("n_rows"))


def unit_normalise(spark, d):
    u = derived(spark, d, UNIT_ROWS)
    return u.select("id", "unit", fu.normalized_unit(F.col("unit")).alias("approved"), fu.decimal_to_fraction(F.col("value")).alias("fraction"))


def unmapped_units(spark, d):
    u = derived(spark, d, UNIT_ROWS).where("trim(unit) <> ''").where(fu.approved_unit(F.col("unit")).isNull())
    return u.groupBy(F.trim("unit").alias("unit")).agg(F.count("*").alias("n"))


def decimal_fraction(spark, d):
    u = derived(spark, d, UNIT_ROWS).select("id", "value", fu.decimal_to_fraction(F.col("value")).alias("fraction"))
    return u.select("id", "value", "fraction", fu.fraction_to_decimal(F.col("fraction")).alias("back"))


def expand_abbrev(spark, d):
    return derived(spark, d, CATALOG).select("row_index", ft.expand_abbreviations(F.col("Part_Desc")).alias("expanded"))


def _classified(spark, d):
    return classify.classify(derived(spark, d, CATALOG), classify.candidates(spark))


def classify_types(spark, d):
    return _classified(spark, d).select("row_index", "item_type", "confidence", "method", "runner_up", "needs_review")


def classify_stats(spark, d):
    return classify.classification_stats(_classified(spark, d))


def terse_attributes(spark, d):
    return attributes.attribute_rows(derived(spark, d, CATALOG))


def _validated(spark, d, suggest=True):
    from ..sources.tables import load_lov

    lov = vocabulary.lov_tables(load_lov(derived(spark, d, LOV)))
    return vocabulary.validate(derived(spark, d, ASKED), *lov, suggest=suggest)


def lov_validate(spark, d):
    return _validated(spark, d, False).select("row_id", "outcome", "canonical")


def lov_suggest(spark, d):
    return _validated(spark, d).where("suggestion is not null").select("row_id", "label", "value", "outcome", "suggestion")


def lov_compliance(spark, d):
    return vocabulary.compliance(_validated(spark, d, False))


def brand_exact(spark, d):
    rows = derived(spark, d, CATALOG).select("row_index", "Part_Manuf")
    return identity.resolve_brands(rows, derived(spark, d, BRANDS), "Part_Manuf").select("row_index", "manufacturer_name", "brand_name", "brand_confidence", "brand_method", "brand_review")


def brand_fuzzy(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Suplier#"), F.substring("c_name", 10, 9)).alias("name"))
    brands = table(spark, d, "supplier").select(F.col("s_name").alias("MANUFACTURER_NAME"), F.lit(None).cast("string").alias("MANUFACTURER_CODE"), F.lit(None).cast("string").alias("BRAND_NAME"), F.lit(None).cast("string").alias("BRAND_CODE"), F.col("s_suppkey").alias("ordinal"))
    return identity.resolve_brands(rows, brands, "name").select("c_custkey", "manufacturer_name", F.round("brand_confidence", 6).alias("brand_confidence"), "brand_method", "brand_review")


def _content(spark, d):
    return flows.catalog_content(derived(spark, d, CATALOG), classify.candidates(spark), derived(spark, d, BRANDS))


def catalog_descriptions(spark, d):
    return _content(spark, d)["descriptions"]


def compliance_summary(spark, d):
    return describe.compliance(_content(spark, d)["descriptions"], "format")


def _compared(spark, d):
    """Generated rows whose brand or description went wrong here and there, held against the catalogue's own."""
    rows = derived(spark, d, CATALOG)
    made = rows.select("Mfg_Part_Num", F.when(F.col("row_index") % 4 != 3, F.col("Part_Desc")).alias("Part_Desc"), F.when(F.col("row_index") % 7 == 0, F.lit("Other")).otherwise(F.col("E1_Brand")).alias("E1_Brand"), "Part_Manuf")
    truth = rows.select("Mfg_Part_Num", F.when(F.col("row_index") % 3 == 0, F.lower("Part_Desc")).otherwise(F.col("Part_Desc")).alias("Part_Desc"), F.coalesce("E1_Brand", F.lit("")).alias("E1_Brand"), F.col("Part_Manuf"), F.col("row_index").alias("ordinal"))
    return evaluate.compared(made, truth, fields=["E1_Brand", "Part_Desc", "Part_Manuf"])


def field_accuracy(spark, d):
    return evaluate.accuracy(_compared(spark, d))


def weakest_fields(spark, d):
    return evaluate.weakest(evaluate.accuracy(_compared(spark, d)), 2).select("field", "exact", "total", "exact_pct")


def extract_fields(spark, d):
    return extract.extract(_texts(spark, d)).select("product_id", "field_key", "value", "unit", "confidence", "is_grounded")


def validate_fields(spark, d):
    return _fields(spark, d).select("product_id", "field_key", "value", "unit", "status")


def rating_checks(spark, d):
    keys = ["voltage_rating", "current_rating", "ip_rating", "operating_temperature_min", "operating_temperature_max"]
    return _fields(spark, d).where(F.col("field_key").isin(keys)).select("product_id", "field_key", "value", "status")


def record_summary(spark, d):
    return validate.summarize(_fields(spark, d))


def catalog_stats(spark, d):
    return validate.catalog_stats(validate.summarize(_fields(spark, d)))


def grounding(spark, d):
    """A snippet of each document is held against its own text, and one of the document before it, if there is one."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.substring("text", 11, 60).alias("foreign"))
    both = docs.withColumn("own", F.substring("text", 11, 60)).join(other, "doc_id", "left").withColumn("foreign", F.coalesce("foreign", F.lit("")))
    return both.select("doc_id", extract.grounded(F.col("own"), F.col("text")).alias("own_grounded"), F.coalesce(extract.grounded(F.col("foreign"), F.col("text")), F.lit(False)).alias("foreign_grounded"))


def trust_gate(spark, d):
    return trust.gate(flows.process_texts(_texts(spark, d))).select("product_id", "field_key", "admitted", "reason")


def trust_totals(spark, d):
    return trust.totals(trust.gate(flows.process_texts(_texts(spark, d))))


def source_policy(spark, d):
    return sourcing.policy(derived(spark, d, URLS)).select("page_id", "registrable", "category", "allowed", "needs_review")


def url_safety(spark, d):
    return sourcing.url_safety(derived(spark, d, URLS)).select("page_id", "host", "safe", "refusal")


def page_clean(spark, d):
    return pages.clean_pages(table(spark, d, "pages")).select("page_id", "title", "text", "n_specs", "is_sparse", "ready")


def short_runs(spark, d):
    """Clauses of each document as chunks."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.,\n]")).alias("pos", "text"))
    kept = pages.collapse_runs(docs.withColumn("text", F.trim("text")).where("text <> ''"), ["doc_id"])
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.count_if(F.col("text") == pages.OMITTED).alias("n_marked"), F.sum(F.length("text")).alias("n_chars"))


def _doc_pages(spark, d):
    """Documents as pages of 300 characters."""
    docs = table(spark, d, "documents").where("text <> ''")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 300).cast("int")), lambda k: F.substr(F.col("text"), k * 300 + 1, F.lit(300)))
    return docs.select("doc_id", F.posexplode(cut).alias("page_no", "text"))


def joined_pages(spark, d):
    return pages.joined_pages(_doc_pages(spark, d)).select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


def snippet_pages(spark, d):
    """The page on which a text's beginning, middle and last words stand, and a snippet that is on none."""
    paged = _doc_pages(spark, d)
    docs = table(spark, d, "documents").where("text <> ''")
    snippets = F.array(*[F.struct(F.lit(k).alias("field_key"), s.alias("snippet")) for k, s in (("head", F.substring("text", 1, 12)), ("middle", F.expr("substring(text, length(text) div 2 + 1, 9)")), ("last", F.expr("right(text, 15)")), ("none", F.lit("\x01")))])
    fields = docs.select("doc_id", F.inline(snippets))
    return pages.evidence_pages(pages.snippet_offsets(fields, pages.joined_pages(paged)), paged).select("doc_id", "field_key", F.coalesce("page_no", F.lit(-1)).alias("page_no"))


def content_richness(spark, d):
    return table(spark, d, "documents").select("doc_id", discover.richness(F.col("text")).alias("score"))


def discover_best_source(spark, d):
    """Each page's first longer word is asked for as a part number; the page itself and two neighbours are candidates. Pages are parsed once."""
    parsed = settled(pages.clean_pages(table(spark, d, "pages")).select("page_id", "url", "title", "text"))
    body = F.element_at(F.split("text", pages.CONTENT), -1)
    requests = parsed.select(F.col("page_id").alias("request_id"), F.regexp_extract(body, r"([A-Za-z]{6,})", 1).alias("mfg_part_num"), F.lit(None).cast("string").alias("part_desc"), F.lit(None).cast("string").alias("manufacturer"), F.lit(None).cast("string").alias("brand"))
    own = parsed.select("page_id", "url")
    near = own.select(F.explode(F.array(*[F.struct((F.col("page_id") + k).alias("request_id"), F.lit(abs(k)).alias("position")) for k in (-1, 0, 1)])).alias("r"), "url").select("r.*", "url")
    judged = discover.judge_candidates(requests, near, parsed.groupBy("url").agg(F.max("title").alias("title"), F.max("text").alias("text")), "allow_all")
    return discover.best_sources(judged)


def page_numbers(spark, d):
    """Which of the benchmark's and documents' opening words, taken as part numbers, stand on which documents."""
    number = lambda name: table(spark, d, name).select(F.regexp_extract("text", r"^\s*([A-Za-z]+\s+[A-Za-z]+)", 1).alias("mfg_part_num"))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return discover.numbers_on_pages(number("benchmark").unionByName(number("documents")), docs, key="doc_id").distinct()


def _batch(spark, d):
    """Documents as pages under addresses of every kind; some addresses have no page."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    site = F.when(F.col("doc_id") % 5 == 0, "https://www.moen.com/p/").when(F.col("doc_id") % 5 == 1, "https://shop.example/p/").when(F.col("doc_id") % 5 == 2, "https://www.amazon.com/dp/").when(F.col("doc_id") % 5 == 3, "http://192.168.0.1/").otherwise("https://gone.example/")
    rows = docs.withColumn("url", F.concat(site, F.col("doc_id").cast("string")))
    return rows.select("url"), rows.where("doc_id % 5 <> 4").select("url", F.lit(None).cast("string").alias("title"), "text")


def batch_outcomes(spark, d):
    return discover.batch_outcomes(*_batch(spark, d)).select("url", F.coalesce(F.length("text"), F.lit(-1)).alias("n_chars"), "stage", "reason")


def batch_totals(spark, d):
    out = discover.batch_outcomes(*_batch(spark, d))
    return out.groupBy(F.coalesce("stage", F.lit("processed")).alias("stage"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def delivery_slots(spark, d):
    made = delivery.routed(_fields(spark, d))
    return made.where("slot is not null").select("product_id", "slot", "field_key", "value")


GIVEN = """SELECT concat('P', CAST(p_partkey AS STRING)) AS product_id, CASE p_partkey % 4 WHEN 0 THEN concat('MX-', CAST(p_partkey AS STRING)) WHEN 1 THEN 'X1 UPC 5' ELSE NULL END AS mpn,
 CASE p_partkey % 3 WHEN 0 THEN 'https://www.moen.com/p' WHEN 1 THEN 'https://www.grainger.com/p' ELSE NULL END AS source_url, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE NULL END AS brand FROM part"""


def header_name(header: str) -> str:
    """A column name without the characters that SQL names would have to quote."""
    return header.replace(" ", "_").replace("/", "_").replace("(", "").replace(")", "")


def delivery_table(spark, d):
    """All columns of the delivery table, with identity, classification and descriptions."""
    out = flows.delivery_rows(_fields(spark, d), derived(spark, d, GIVEN))
    return out.select("product_id", *[F.col(f"`{h}`").alias(header_name(h)) for h in delivery.HEADERS], "slots_used", F.array_join("warnings", "; ").alias("warnings"))


def catalog_export(spark, d):
    return delivery.catalog_csv(_fields(spark, d))


def review_latest(spark, d):
    return enrich.latest_actions(derived(spark, d, REVIEWS)).select("product_id", "field_key", "action", "new_value")


def review_queue(spark, d):
    fields = enrich.apply_reviews(_fields(spark, d), derived(spark, d, REVIEWS))
    return enrich.review_queue(fields).select("product_id", "field_key", "status")


def catalog_search(spark, d):
    wide = _fields(spark, d).groupBy(F.col("product_id").alias("id")).agg(*[F.max(F.when(F.col("field_key") == k, F.col("value"))).alias(n) for k, n in (("product_name", "name"), ("category", "category"), ("ip_rating", "ip_rating"))])
    return enrich.search(wide.withColumn("origin", F.lit("text")), "ip67").select("id", "ip_rating")


def _lov(spark, d):
    from ..sources.tables import load_lov

    return vocabulary.lov_tables(load_lov(derived(spark, d, LOV)))


def commerce_report(spark, d):
    return flows.commerce_report(_texts(spark, d), classify.candidates(spark), _lov(spark, d))


def product_views(spark, d):
    """The formats of one product, the one with the greatest key."""
    texts = _texts(spark, d)
    last = texts.agg(F.max("product_id").alias("last"))
    fields = validate.validated(texts.join(F.broadcast(last), F.col("product_id") == F.col("last"), "left_semi"))
    return flows.product_view(fields, last.first()[0], classify.candidates(spark)).select("product_id", "format", "text", "compliant", "n_admitted", "n_withheld", "item_type", "method")


def newest_products(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_orderdate").alias("created_at"))
    return flows.newest(orders, 100).select("product_id", F.col("created_at").cast("string").alias("created_at"))


def _listings(spark, d):
    return validate.validated(derived(spark, d, LISTINGS))


def listing_fields(spark, d):
    """Names, categories, materials and specification rows of shop pages."""
    return _listings(spark, d).select("product_id", "field_key", "value", "unit", "confidence", "status")


def identity_columns(spark, d):
    given = derived(spark, d, "SELECT concat('L', CAST(p_partkey AS STRING)) AS product_id, CASE p_partkey % 4 WHEN 0 THEN concat('MX-', CAST(p_partkey AS STRING)) WHEN 1 THEN 'X1 UPC 5' ELSE NULL END AS mpn, CASE p_partkey % 3 WHEN 0 THEN 'https://www.moen.com/p' WHEN 1 THEN 'https://www.grainger.com/p' ELSE NULL END AS source_url FROM part")
    out = delivery.identified(_listings(spark, d), given)
    return out.select("product_id", F.col("Mfg_Part_Num").alias("mpn"), F.col("MANUFACTURER_NAME").alias("manufacturer"), F.col("BRAND_NAME").alias("brand"), F.col("MFR URL").alias("url"), F.size("identity_warnings").alias("n_warnings"))


def catalog_validated(spark, d):
    """The catalogue flow with its vocabulary stage: outcomes of the attributes of classified rows."""
    lov = _lov(spark, d)
    out = flows.catalog_content(derived(spark, d, CATALOG), classify.candidates(spark, lov[0]), derived(spark, d, BRANDS), lov, suggest=False)
    return out["validated"].select("row_id", "label", "value", "outcome", "canonical")


RECORDS = """SELECT CAST(o_orderkey AS STRING) AS id, o_orderdate AS created_at, CASE o_orderkey % 7 WHEN 3 THEN concat(chr(123), '"status": "', o_orderstatus) WHEN 5 THEN CAST(NULL AS STRING)
 ELSE concat(chr(123), '"status": "', o_orderstatus, '", "clerk": "', o_orderpriority, '"', chr(125)) END AS data_json FROM orders"""
MORE_UNITS = "SELECT CASE p_partkey % 4 WHEN 0 THEN 'Inches' WHEN 1 THEN concat('Box of ', CAST(p_size AS STRING)) WHEN 2 THEN ' LBS. ' ELSE concat('Pk', CAST(p_size % 3 AS STRING)) END AS variant, CASE p_partkey % 4 WHEN 0 THEN 'INCH' WHEN 1 THEN 'bx' WHEN 2 THEN CASE WHEN p_size < 10 THEN 'LB' ELSE 'pound' END ELSE 'pk' END AS approved FROM part"
GLUED = """SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 5 WHEN 0 THEN concat('Pipe of ', CAST(p_size * 0.25 AS STRING), ' in by ', CAST(p_size AS STRING), 'mm') WHEN 1 THEN concat(CAST(p_size AS STRING), 'IN cover, ', CAST(p_size AS STRING), 'V')
 WHEN 2 THEN concat('weighs ', CAST(p_size AS STRING), 'lbs') WHEN 3 THEN concat('model ', CAST(p_size AS STRING), 'G of ', CAST(p_size AS STRING), '-1/4IN') ELSE concat('no number here ', p_name) END AS text FROM part"""
CLAIMS = """SELECT concat('P', CAST(p_partkey AS STRING)) AS product_id, CAST(p_size AS STRING) AS hours, CAST(p_size + p_partkey % 2 AS STRING) AS others, p_name FROM part"""


SPARSE_TEXTS = """SELECT concat('E', CAST(p_partkey AS STRING)) AS product_id, CASE p_partkey % 5 WHEN 0 THEN concat('Inductive unit with plug M12, number ', CAST(p_partkey AS STRING)) WHEN 1 THEN concat('Supply of 10-30 dc for unit ', CAST(p_partkey AS STRING))
 WHEN 2 THEN concat('A part of nickel-plated brass, unit ', CAST(p_partkey AS STRING)) WHEN 3 THEN concat('A part of some metal alloy, unit ', CAST(p_partkey AS STRING)) ELSE concat('Nothing is known of unit ', CAST(p_partkey AS STRING)) END AS raw_text,
 CAST(NULL AS STRING) AS name_hint, CAST(NULL AS STRING) AS category_hint FROM part"""


def enriched_fields(spark, d):
    """What can be inferred from texts that say little."""
    fields = flows.process_texts(derived(spark, d, SPARSE_TEXTS))
    return fields.where(F.col("field_key").isin("mounting_type", "material", "voltage_rating")).select("product_id", "field_key", F.coalesce("value", F.lit("")).alias("value"), "confidence", "status")


def product_listing(spark, d):
    """Stored records that can be read, of a store in which some cannot."""
    from ..sources.tables import listing

    rows = spark.sql(RECORDS.replace("FROM orders", "FROM {t}"), t=table(spark, d, "orders"))
    return listing(rows, "status string, clerk string").select("id", F.col("created_at").cast("string").alias("created_at"), "record.status", "record.clerk")


def approved_list(spark, d):
    """Sites of an allow-list made of the pages' addresses, some with remarks."""
    lines = table(spark, d, "pages").select(F.concat("url", F.when(F.col("page_id") % 3 == 0, " # checked").otherwise("")).alias("value"))
    return sourcing.approved_domains(lines)


def unit_table(spark, d):
    """The seed of unit variants with a file's own over them."""
    from ..sources.tables import load_units

    return load_units(spark.createDataFrame(unit_rows(), "variant string, approved string"), derived(spark, d, MORE_UNITS))


def repaired_text(spark, d):
    rows = derived(spark, d, GLUED)
    return rows.select("id", fu.convert_decimals_in_text(F.col("text")).alias("as_fractions"), fu.fix_spacing_in_text(F.col("text")).alias("spaced"))


def search_queries(spark, d):
    rows = derived(spark, d, CATALOG).select("row_index", F.col("Mfg_Part_Num").alias("mfg_part_num"), F.col("Part_Manuf").alias("manufacturer"), F.col("E1_Brand").alias("brand"), F.col("Part_Desc").alias("part_desc"))
    return discover.search_query(rows).select("row_index", "query")


def usable_features(spark, d):
    """Features that stand in the text and agree on runtimes."""
    rows = derived(spark, d, CLAIMS)
    first, second = (F.concat(F.lit("Runs "), h, F.lit(" hours at 2 Ah"), F.lit(end)) for h, end in ((F.col("hours"), ""), (F.col("others"), " pack")))
    listed = F.array(first, second, F.lit(" Brushless "), F.lit("Not in the text"), F.lit(" "), F.col("p_name"))
    texts = rows.select("product_id", F.concat_ws(". ", first, second, F.lit("Brushless motor"), "p_name").alias("raw_text"))
    out = delivery.usable_features(rows.select("product_id", F.posexplode(listed).alias("pos", "text")), texts)
    return out.select("product_id", F.array_join("item_features", " | ").alias("features"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dedup_survivors, dedup_report, mpn_collisions, unit_normalise, unmapped_units, decimal_fraction, expand_abbrev, classify_types, classify_stats, terse_attributes, lov_validate, lov_suggest, lov_compliance,
        brand_exact, brand_fuzzy, catalog_descriptions, compliance_summary, field_accuracy, weakest_fields, extract_fields, validate_fields, rating_checks, record_summary, catalog_stats, grounding, trust_gate, trust_totals,
        source_policy, url_safety, page_clean, short_runs, joined_pages, snippet_pages, content_richness, discover_best_source, page_numbers, batch_outcomes, batch_totals, enriched_fields, product_listing, approved_list, unit_table, repaired_text, search_queries, usable_features, delivery_slots, delivery_table, catalog_export, review_latest, review_queue, catalog_search, commerce_report, product_views, newest_products, listing_fields, identity_columns, catalog_validated,
    )
}
