from pyspark.sql import functions as F

from shelfwright.functions.text import NUMBER_LIKE, to_double
from shelfwright.operators import delivery, discover, enrich, extract, pages, sourcing, trust, validate

TEXT = "product_id string, raw_text string, name_hint string, category_hint string"
BLOCK = "CN-M12-5P Circular Connector\nRated voltage: 250 V\nRated current: 4 A\nMaterial: Stainless steel\nProtection: IP67\nOperating temperature: -25 to 80 C"


def fields(spark, *texts):
    df = spark.createDataFrame([(f"p{k}", t, None, None) for k, t in enumerate(texts)], TEXT)
    return validate.validate(extract.extract(df))


def of(rows, product, key):
    return next(r for r in rows if r.product_id == product and r.field_key == key)


def test_extraction(spark):
    rows = fields(spark, BLOCK, "Founded in 2008 A leading company of the region", "Consumption 200 mA typical.", "Supply 10...30 VDC sensor", "The town was founded on 12 March 2008.", None).collect()
    assert of(rows, "p0", "voltage_rating").value == "250" and of(rows, "p0", "current_rating").value == "4"
    assert of(rows, "p0", "material").value.lower() == "stainless steel" and of(rows, "p0", "ip_rating").status == "verified"
    assert of(rows, "p1", "current_rating").value is None and of(rows, "p4", "voltage_rating").value is None
    assert of(rows, "p2", "current_rating").value == "0.2" and of(rows, "p3", "voltage_rating").value == "10–30"
    assert {r.status for r in rows if r.product_id == "p5"} == {"flagged_validation_error"}


def test_rules(spark):
    rows = fields(spark, "Sensor protection IP-677 operating temperature: 90 to 10 C", "Submersible sensor IP20", "M12 connector rated current 150 A", "Sanding belt 80 grit aluminum oxide").collect()
    assert of(rows, "p0", "ip_rating").status == "flagged_validation_error" and of(rows, "p0", "operating_temperature_min").status == "flagged_validation_error"
    assert of(rows, "p1", "ip_rating").status == "flagged_validation_error" and of(rows, "p2", "current_rating").status == "flagged_validation_error"
    assert sum(r.status == "not_applicable" for r in rows if r.product_id == "p3") == 9
    s = validate.summarize(fields(spark, BLOCK)).first()
    assert s.total_fields == s.verified + s.flagged + s.missing + s.enriched


def test_gate_and_review(spark):
    f = enrich.enrich(fields(spark, BLOCK))
    gated = trust.gate(f)
    t = trust.totals(gated).first()
    assert t.n_admitted + t.n_withheld == f.where("trim(coalesce(value, '')) <> ''").count()
    assert trust.totals(trust.gate(f, include_enriched=True)).first().n_inferred >= t.n_inferred
    ts = F.to_timestamp(F.lit("2024-01-01"))
    reviews = spark.createDataFrame([("p0", "voltage_rating", "override", "24", "V"), ("p0", "ip_rating", "reject", None, None)], "product_id string, field_key string, action string, new_value string, new_unit string").withColumn("ts", ts)
    after = enrich.apply_reviews(f, reviews).collect()
    assert of(after, "p0", "voltage_rating").value == "24" and of(after, "p0", "ip_rating").status == "missing"
    assert enrich.review_queue(f).count() > 0


def test_sources(spark):
    urls = ["https://www.amazon.co.uk/x", "https://www.grainger.com/a", "https://en.wikipedia.org/w", "https://moen.com/p", "https://pdb2.turck.de/x", "https://shop.unknown.example/", "http://127.0.0.1/", "http://[::1]/", "http://2130706433/", "ftp://moen.com/x", "https://u:p@moen.com/", "https://moen.com:22/", "javascript:alert(1)", "", None]
    rows = {r.url: r for r in sourcing.policy(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert [rows[u].category for u in urls[:6]] == ["marketplace", "distributor", "encyclopedia", "manufacturer", "manufacturer", "unknown"]
    assert [rows[u].allowed for u in urls] == [False, False, False, True, True, True] + [False] * 9
    approved = sourcing.approved_domains(spark.createDataFrame([("grainger.com # ok",), ("# none",)], "value string"))
    again = {r.url: r.allowed for r in sourcing.policy(spark.createDataFrame([(u,) for u in urls[:4]], "url string"), approved=approved).collect()}
    assert again == {urls[0]: False, urls[1]: True, urls[2]: False, urls[3]: False}


def test_pages(spark):
    html = "<html><head><title>Belt</title></head><body><nav>Home</nav><main><table><tr><th>Weight</th><td>0.13 lb</td></tr></table><dl><dt>Grit</dt><dd>80</dd></dl><p>" + "A sanding belt for metal. " * 12 + "</p></main></body></html>"
    rows = {r.page_id: r for r in pages.clean_pages(spark.createDataFrame([(1, "u", html), (2, "v", None), (3, "w", "<p>short")], "page_id long, url string, html string")).collect()}
    assert rows[1].title == "Belt" and "Weight: 0.13 lb" in rows[1].text and "Grit: 80" in rows[1].text and "Home" not in rows[1].text and rows[1].ready
    assert rows[2].text == "" and rows[2].is_sparse and rows[3].is_sparse
    runs = spark.createDataFrame([(1, k, "ab") for k in range(20)] + [(1, 20, "x" * 30)], "doc long, pos int, text string")
    assert [r.text for r in pages.collapse_runs(runs, ["doc"]).orderBy("pos").collect()] == ["ab"] * 3 + [pages.OMITTED, "x" * 30]
    docs = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, " ")], "doc_id string, page_no int, text string")
    assert pages.joined_pages(docs).first().text == "--- [Page 1] ---\na\n\n--- [Page 2] ---\nb"


def test_discovery(spark):
    cases = [("DCB518ASTS06G", "buy DCB518-ASTS06G now", True), ("ABC123", "XYZABC123999", False), ("ABC123", "ABC1234", False), (None, "x", False)]
    df = spark.createDataFrame([(k, m, t) for k, (m, t, _) in enumerate(cases)], "k int, m string, t string")
    assert [r.y for r in df.select("k", discover.mpn_on_page(F.col("m"), F.col("t")).alias("y")).orderBy("k").collect()] == [c[2] for c in cases]
    texts = spark.createDataFrame([(1, "Add to cart. Free shipping. " * 80), (2, "Specifications\nVoltage: 24 V\nWeight: 2 lb\nMaterial: Brass\n")], "k int, t string")
    shop, spec = (r.y for r in texts.select("k", discover.richness(F.col("t")).alias("y")).orderBy("k").collect())
    assert spec > shop


def test_delivery(spark):
    f = fields(spark, BLOCK + "\nWeight 2 kg. Flow rate 5 L/min")
    slots = [(r.slot, r.field_key) for r in delivery.routed(f).where("slot is not null").orderBy("slot").collect()]
    assert [s for s, _ in slots] == list(range(1, len(slots) + 1)) and slots[0][1] == "voltage_rating"
    out = delivery.delivery(f, f.select("product_id").distinct())
    assert out.columns[1:253] == delivery.HEADERS and len(delivery.HEADERS) == 252
    row = out.first()
    assert row["WEIGHT"] == "2" and row["WEIGHT_UOM"] == "kg" and row["ATTRIBUTE_LABEL 1"] == "Voltage Rating" and row["UPC"] == ""
    claims = spark.createDataFrame([("p", 0, "Runs 23 hours at 2 Ah"), ("p", 1, "Runs 24 hours at 2 Ah"), ("p", 2, "Brushless")], "product_id string, pos int, text string")
    texts = spark.createDataFrame([("p", "Runs 23 hours at 2 Ah Runs 24 hours at 2 Ah Brushless")], "product_id string, raw_text string")
    assert delivery.usable_features(claims, texts).first().item_features == ["Brushless"]


def test_each_pattern_is_worked_out_once(spark):
    df = spark.createDataFrame([("p", BLOCK, None, None)], TEXT)
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    plan = extract.extract(df)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("(?:rated\\s+voltage") == 5 and plan.count("flow(?:\\s*rate)") == 3 and plan.count("sanding\\s+belts?") == 1  # the match, then its groups
    assert plan.count("regexp_extract(") < 120


def test_names(spark):
    texts = [
        ("=== EXTRACTED SPECIFICATION TABLES ===\nSKU: DCB518ASTS06G\nGrit: 80\n=== PAGE CONTENT ===\nDCB518ASTS06G detail file sanding belt", "Specifications"),
        ("A valve made for water", "Acme Valve 12 - Wikipedia | Shop"),
        ("CN-M12-5P Circular Connector", "document.pdf"),
        ("https://x\nAn editorial page | Amazon.com\nmore", None),
        ("PRX-M18-30 and no more", None),
    ]
    df = spark.createDataFrame([(f"p{k}", t, h, None) for k, (t, h) in enumerate(texts)], TEXT)
    names = {r.product_id: (r.value, r.confidence) for r in extract.extract(df).where("field_key = 'product_name'").collect()}
    assert names == {"p0": ("DCB518ASTS06G detail file sanding belt", 0.9), "p1": ("Acme Valve 12", 0.95), "p2": ("CN-M12-5P Circular Connector", 0.92), "p3": ("An editorial page", 0.45), "p4": ("PRX-M18-30", 0.85)}


def test_specification_rows(spark):
    text = "=== EXTRACTED SPECIFICATION TABLES ===\nVendor: Dewalt\nGrit (grit): 80\nItem Weight (oz): 2 lb\nPrice: 9\nQuantity: -\nBacking: Cloth\nBacking: Paper\nURL: x\nUPC: 123\n=== PAGE CONTENT ===\nNot: a row"
    got = {r.label: (r.value, r.unit, r.confidence) for r in extract.extract(spark.createDataFrame([("p", text, None, None)], TEXT)).where("not is_core").collect()}
    assert got == {"Brand": ("Dewalt", None, 0.94), "Grit": ("80", None, 0.94), "Item Weight": ("2 lb", "lb", 0.94), "Backing": ("Cloth", None, 0.94), "UPC": ("123", None, 0.94), "Mass": ("2", "lb", 0.82)}


def test_grit_is_no_body_material(spark):
    cases = [("Aluminum oxide", "Material: Aluminum oxide", False), ("aluminum", "blend of aluminum oxide grit", False), ("aluminum", "Housing: aluminum, with aluminum oxide", True), ("brass", "Body brass", True), (None, None, True)]
    df = spark.createDataFrame([(k, v, s) for k, (v, s, _) in enumerate(cases)], "k int, v string, s string")
    assert [r.y for r in df.select("k", extract.material_evidence(F.lit("material"), F.col("v"), F.col("s")).alias("y")).orderBy("k").collect()] == [c[2] for c in cases]


def test_identity_of_a_delivery_row(spark):
    f = fields(spark, "=== EXTRACTED SPECIFICATION TABLES ===\nSKU: UPC 123\nModel Number: DW-12\nVendor: dewlt\nManufacturer: Stanley Black and Decker\n=== PAGE CONTENT ===\nA tool", "PRX-M18-30 Sensor")
    given = spark.createDataFrame([("p0", None, "https://moen.com/p", None), ("p1", "12 GTIN", "https://www.grainger.com/p", None), ("p2", "A1", None, "https://own.example/x")], "product_id string, mpn string, source_url string, manufacturer_url string")
    rows = {r.product_id: r for r in delivery.identified(f, given).collect()}
    assert [(rows[p].Mfg_Part_Num, rows[p].MANUFACTURER_NAME, rows[p].BRAND_NAME, rows[p]["MFR URL"]) for p in ("p0", "p1", "p2")] == [
        ("DW-12", "Stanley Black & Decker", "DEWALT", "https://moen.com/p"), ("PRX-M18-30", "", "", ""), ("A1", "", "", "https://own.example/x"),
    ]
    assert [len(rows[p].identity_warnings) for p in ("p0", "p1", "p2")] == [2, 2, 0]
    out = delivery.delivery(f, delivery.identified(f, given)).where("product_id = 'p0'").first()
    assert out["Mfg_Part_Num"] == "DW-12" and out["BRAND_NAME"] == "DEWALT"


def test_delivery_rows_with_a_taxonomy(spark):
    from shelfwright.operators import vocabulary
    from shelfwright.plans import flows
    from shelfwright.sources.tables import load_lov

    f = fields(spark, "=== EXTRACTED SPECIFICATION TABLES ===\nModel Number: DW-12\nVendor: dewlt\n=== PAGE CONTENT ===\nSanding belt for metal, 80 grit aluminum oxide", BLOCK)
    given = spark.createDataFrame([("p0", None, "https://www.grainger.com/p"), ("p1", "MX-7", None)], "product_id string, mpn string, source_url string")
    flat = {r.product_id: r for r in flows.delivery_rows(f, given).collect()}
    assert flat["p0"].Class == flat["p0"].Classpath != "" and flat["p0"].Dept == "" and flat["p0"]["BRAND_NAME"] == "DEWALT" and "DEWALT" in flat["p0"]["SHORT_DESC"]
    assert [len(flat[p].warnings) for p in ("p0", "p1")] == [3, 1] and flat["p1"]["Mfg_Part_Num"] == "MX-7" and flat["p1"]["SHORT_DESC"].startswith("MX-7")
    lov = vocabulary.lov_tables(load_lov(spark.createDataFrame([(1, "Tools > Abrasives > Sanding Belt", "Grit", "80")], "ordinal int, classpath string, label string, values string")))
    row = next(r for r in flows.delivery_rows(f, given, lov).collect() if r.product_id == "p0")
    assert (row.Dept, row.Class, row.Fine, row.Classpath) == ("Tools", "Abrasives", "Sanding Belt", "Tools > Abrasives > Sanding Belt") and len(row.warnings) == 2


def test_fields_are_not_shuffled_for_validation(spark):
    from shelfwright.plans import flows

    texts = [BLOCK, "Sensor protection IP-677 operating temperature: 90 to 10 C", "Submersible sensor IP20", "M12 connector rated current 150 A\nOperating Temperature Max (F): 5", "Sanding belt 80 grit aluminum oxide", None, "inductive sensor M12, 10-30 dc"]
    df = spark.createDataFrame([(f"p{k % 6}", t, None, None) for k, t in enumerate(texts)], TEXT)  # p0 has two texts
    wanted = validate.validate(extract.extract(df))
    for got, same in ((validate.validated(df), wanted), (flows.process_texts(df), enrich.enrich(wanted))):
        assert got.columns == same.columns and got.exceptAll(same).isEmpty() and same.exceptAll(got).isEmpty()
        plan = got._jdf.queryExecution().sparkPlan().toString()
        planned = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and planned.count("Exchange") == 1 and planned.rindex("Generate") < planned.index("Exchange")


def test_patterns_wait_for_their_words(spark):
    words = [(w, p) for w, (_, p) in zip(extract.DYNAMIC_WORDS, extract.DYNAMIC, strict=True)]
    texts = ["FLOW rate 5 L/min", "Rated Pressure 3 bar", "1500 RPM", "Weight: 2 kg", "Port 1/4 inch", "M8", "Sensing range 8 mm", "50 kHz", "Cable 2 m"]
    df = spark.createDataFrame([(t, t.lower()) for t in texts], "text string, low_text string")
    row = df.select(*[extract.told(w, F.regexp_extract("text", p, 0) != "").alias(f"d{k}") for k, (w, p) in enumerate(words)]).collect()
    assert all(row[k][f"d{k}"] for k in range(len(words))) and row[0]["d1"] is None


def test_rules_are_worked_out_once_for_every_reader(spark):
    df = spark.createDataFrame([("p", BLOCK, None, None)], TEXT)
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    plans = [read(validate.validated(df))._jdf.queryExecution().optimizedPlan().toString() for read in (validate.summarize, delivery.routed)]
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert [p.count("M8|M12") for p in plans] == [2, 2]  # status and message
    assert not [line for p in plans for line in p.split("\n") if "Filter" in line and "M8|M12" in line]


def test_what_may_be_a_number(spark):
    texts = ["1", " -2.5e3 ", "+.5", "1d", "2F", "NaN", "-Infinity", "inf", "0x1p3", "\t7\n", "", " ", "IP67", "250 VDC", "4 A", "-5 to 100 C", "10–30", "1,5", "infinite", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("t", to_double(F.col("t")).alias("got"), F.col("t").try_cast("double").alias("wanted"), F.col("t").rlike(NUMBER_LIKE).alias("tried")).collect()
    assert all(str(r.got) == str(r.wanted) for r in rows)
    assert not [r.t for r in rows if r.tried and r.t in ("IP67", "250 VDC", "4 A", "-5 to 100 C")]


def test_grounds_are_worked_out_only_where_read(spark):
    df = spark.createDataFrame([("p", BLOCK, None, None)], TEXT)
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    plans = [extract.extract(df).select("product_id", "value", *c)._jdf.queryExecution().optimizedPlan().toString() for c in ([], ["is_grounded"], ["evidence_ok"])]
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert ["[-+]?\\d+" in p for p in plans] == [False, False, True]  # numbers of value and snippet
    assert ["[a-z0-9°µ.\\-/]+" in p for p in plans] == [False, True, False]  # words of the snippet


def test_verbatim_snippets_are_grounded(spark):
    cases = [("a  B\tc", "x a  B\tc y"), (" \t ", "a \t b"), ("", "a"), ("ΟΣ", "ΟΣΑ"), ("Ab", "xAbx"), ("a b", "a\n b"), ("İ q", "z İ q"), ("a", ""), (None, "a")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, s string, t string")
    rows = df.select(F.coalesce(extract.verbatim(F.col("s"), F.col("t")), F.lit(False)).alias("fast"), extract.grounded(F.col("s"), F.col("t")).alias("whole")).collect()
    assert [r.fast for r in rows] == [True, False, False, False, True, False, True, False, False] and all(r.whole for r in rows if r.fast)


def test_uneven_specification_rows(spark):
    text = "=== EXTRACTED SPECIFICATION TABLES ===\nItem  Weight\t(oz) :  2\t lb\x0bnet\nBacking:\tCloth\nGrit :80\n=== PAGE CONTENT ===\nSensor"
    got = {r.label: (r.value, r.snippet) for r in extract.extract(spark.createDataFrame([("p", text, None, None)], TEXT)).where("reasoning = 'specification row'").collect()}
    assert got == {"Item Weight": ("2 lb net", "Item  Weight\t(oz) :  2\t lb\x0bnet"), "Backing": ("Cloth", "Backing:\tCloth"), "Grit": ("80", "Grit :80")}
