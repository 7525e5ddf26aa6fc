import pytest
from pyspark.sql import functions as F

from shelfwright.operators import attributes, classify, dedup, describe, evaluate, identity, vocabulary
from shelfwright.sources.tables import load_lov

ROWS = "row_index long, Mfg_Part_Num string, Part_Desc string, Part_Manuf string"


def test_dedup(spark):
    rows = spark.createDataFrame(
        [(0, "DW-AD-511-M8", None, "Turck Inc."), (1, "dw ad 511 m8", "sensor", "TURCK INC"), (2, "DWAD511M8", "sensor", "-- Unbranded --"), (3, "XYZ-100", None, "Banner"), (4, "XYZ-100", None, "Omron"), (5, None, "x", "Moen"), (6, "", "x", "Moen")],
        ROWS,
    )
    kept = {r.row_index for r in dedup.survivors(rows).collect()}
    assert kept == {1, 2, 3, 4, 5, 6}
    r = dedup.dedup_report(rows).first()
    assert (r.total_rows, r.unique_products, r.duplicate_rows_removed, r["groups"], r.rows_without_part_number) == (7, 6, 1, 1, 2)
    found = dedup.collisions(rows).collect()
    assert [(c.mpn_key, c.brands) for c in found] == [("XYZ100", "banner, omron")]
    assert {x.row_index for x in dedup.survivors(dedup.survivors(rows).select(*rows.columns)).collect()} == kept
    assert dedup.dedup_report(rows.limit(0)).first().duplicate_rate_pct == 0.0


@pytest.fixture(scope="module")
def classified(spark):
    texts = ["3/8 CPLG BRS 150#", "Single Handle Pull-Down Kitchen Faucet Chrome", "DW AD 511 M8 PROX SNSR", "DW UNDERCOUNTER RACK DETERGENT PORTABLE", "zzqq xxyy 99", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row_index long, Part_Desc string")
    return {r.row_index: r for r in classify.classify(rows, classify.candidates(spark)).collect()}


def test_classify(classified):
    assert classified[0].item_type == "Coupling" and not classified[0].needs_review
    assert "Faucet" in classified[1].item_type and classified[1].method == "fallback_phrase"
    assert classified[2].item_type != "Dishwasher" and "dishwasher" not in classified[2].expanded_text.lower()
    assert classified[3].item_type == "Dishwasher" and classified[3].needs_review
    for k in (4, 5):
        assert classified[k].item_type is None and classified[k].needs_review and classified[k].method == "unresolved"


CASES = [
    ("3/8 CPLG BRS 150#", {"Size": "3/8", "Material": "Brass", "Pressure Class": "150"}),
    ("3/8 x 1/4 REDUCING CPLG SS", {"Size": "3/8", "Second Size": "1/4", "Material": "Stainless Steel"}),
    ('1-1/2" MALLEABLE IRON ELBOW', {"Size": "1-1/2", "Material": "Malleable Iron"}),
    ('2" SCH 40 PVC PIPE', {"Size": "2", "Schedule": "40"}),
    ("LAV FCT 2-HNDL CHR", {"Size": None, "Handle Count": "2"}),
    ("CL150 FLANGE 4 IN", {"Size": "4", "Pressure Class": "150"}),
    ("1/2 LB WEIGHT", {"Size": None}),
    (None, {"Size": None}),
]


def test_attributes(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "row_index long, Part_Desc string")
    found = {k: {} for k in range(len(CASES))}
    for r in attributes.attribute_rows(rows).collect():
        found[r.row_index][r.label] = r.value
    for k, (_, wanted) in enumerate(CASES):
        assert {label: found[k].get(label) for label in wanted} == wanted, CASES[k]


def test_vocabulary(spark):
    cp = "Fittings > Pipe Fittings > Coupling"
    lov = spark.createDataFrame([(0, cp, "Material", "Brass|Bronze|Stainless Steel"), (1, cp, "Connection Type", "Threaded, Sweat; Grooved"), (2, cp, "Size", None)], "ordinal long, classpath string, label string, values_raw string")
    a, v = vocabulary.lov_tables(load_lov(lov))
    rows = spark.createDataFrame([(1, cp, "Material", "brass"), (1, cp, "Connection Type", "Thread"), (1, cp, "Size", "0.375"), (1, cp, "Colour", "Gold")], "row_id long, classpath string, label string, value string")
    out = vocabulary.validate(rows, a, v)
    got = {r.label: r for r in out.collect()}
    assert got["Material"].canonical == "Brass" and got["Connection Type"].suggestion == "Threaded" and got["Size"].outcome == "open" and got["Colour"].outcome == "not_applicable"
    t = vocabulary.compliance(out).first()
    assert (t.checked, t.in_vocabulary, t.corrected, t.violations, t.open_skipped) == (3, 1, 1, 2, 1)
    assert vocabulary.compliance(out.where("false")).first().lov_compliance_pct is None


def test_brands(spark):
    brands = spark.createDataFrame([("Turck Inc.", "T1", None, None, 0), ("Banner Engineering", "B1", "Banner", "B2", 1)], "MANUFACTURER_NAME string, MANUFACTURER_CODE string, BRAND_NAME string, BRAND_CODE string, ordinal long")
    rows = spark.createDataFrame([(0, "TURCK"), (1, "Banner Enginering"), (2, "zzz"), (3, "n/a"), (4, None), (5, "turk")], "row_index long, name string")
    got = {r.row_index: r for r in identity.resolve_brands(rows, brands, "name").collect()}
    assert got[0].brand_method == "exact" and got[0].brand_name == "Turck Inc."
    assert got[1].brand_method == "fuzzy" and not got[1].brand_review
    assert got[2].brand_method == "unresolved" and got[3].brand_method == got[4].brand_method == "placeholder"
    assert got[5].brand_method == "fuzzy"


def test_descriptions(spark):
    schema = "product_id long, brand string, manufacturer string, series string, mpn string, item_type string, attributes array<struct<label:string,value:string,unit:string,is_key:boolean>>, features array<string>"
    attrs = [("Width", "0.375", "in", True), ("Finish", "Chrome", None, True), ("Handle Count", "1", None, False), ("Flow", "1.5", "gpm", True), ("Voltage", "24", "VDC", False)]
    rows = [(1, "Moen", None, "Arbor", "7594ESRS", "Kitchen Faucet", attrs, ["Pull-down spray", "Power Clean"]), (2, None, "Anvil", None, "120V", None, [], []), (3, None, None, None, None, None, None, None)]
    out = {(r.product_id, r.format): r for r in describe.descriptions(spark.createDataFrame(rows, schema)).collect()}
    assert len(out) == 15
    assert all(out[1, f].compliant for f in ("invoice", "title", "long", "web", "mobile"))
    assert "3/8 in" in out[1, "title"].text and "7594ESRS" in out[1, "title"].text and out[1, "web"].text.endswith(".")
    assert out[2, "title"].text == "Anvil 120V"
    assert all(out[3, f].text == "" for f in ("invoice", "mobile", "title", "long", "web"))


def test_accuracy(spark):
    made = spark.createDataFrame([("A-1", "Red valve", "x"), ("A-2", "red  VALVE", None), ("Z", "?", "?")], "Mfg_Part_Num string, d string, e string")
    truth = spark.createDataFrame([("a1", "Red valve", "x"), ("a2", "Red valve", "y")], "Mfg_Part_Num string, d string, e string")
    got = {r.field: r for r in evaluate.accuracy(evaluate.compared(made, truth)).collect()}
    assert (got["d"].exact, got["d"].normalised, got["d"].total) == (1, 2, 2) and (got["e"].exact, got["e"].attempted) == (1, 1)
    assert got[None].total == 4 and [r.field for r in evaluate.weakest(evaluate.accuracy(evaluate.compared(made, truth)), 1).collect()] == ["d"]
    assert [r.Mfg_Part_Num for r in evaluate.unmatched(made, truth).collect()] == ["Z"]
    assert evaluate.examples(evaluate.compared(made, truth)).count() == 2
    assert F is not None


def test_nearest_first_matches_all_pairs(spark, monkeypatch):
    import random
    from difflib import SequenceMatcher

    from shelfwright.operators import similarity

    monkeypatch.setattr(similarity, "FEW", 20)
    rng = random.Random(3)
    right = [f"supplier 0000{n:05d}" for n in range(400)] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 30))).strip() or "a" for _ in range(60)]
    left = [f"suplier 0000{rng.randint(0, 3999):05d}" for _ in range(60)] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 30))).strip() or "b" for _ in range(60)] + right[:3]
    seen = []
    score = similarity._best
    monkeypatch.setattr(similarity, "_best", lambda pairs, *a: seen.append(pairs.filter("lk like 'suplier%'").distinct().count()) or score(pairs, *a))
    df = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    found = {r.key: (r.match, r.ratio) for r in similarity.best_matches(df(left), df(right), 0.72).collect()}
    wanted = {}
    for a in set(left):
        best = max((SequenceMatcher(None, b, a).ratio(), b) for b in set(right))
        if best[0] >= 0.72:
            wanted[a] = (best[1], best[0])
    assert found == wanted
    assert sum(seen) < len(set(left[:60])) * 400 / 2  # not all of the pairs over the cutoff are formed


def test_letters_shared():
    from collections import Counter

    import pyarrow as pa

    from shelfwright.operators.similarity import letters_shared

    left, right = ["suplier 000012345", "", "привет мир", "x\U0001f600y", "aab"], ["supplier 000054321", "q", "мир", "\U0001f600", "ba"]
    wanted = [sum((Counter(a) & Counter(b)).values()) for a, b in zip(left, right, strict=True)]
    assert letters_shared(pa.array(left), pa.array(right)).tolist() == wanted
    assert letters_shared(pa.array(left)[2:], pa.array(right)[2:]).tolist() == wanted[2:]
    assert letters_shared(pa.array([], pa.string()), pa.array([], pa.string())).tolist() == []
    assert letters_shared(pa.array(["a"]), pa.array([chr(97 + 128)])).tolist() == [1]  # more, never less


def test_exploded_keys_are_never_broadcast(spark, monkeypatch):
    from shelfwright.operators import similarity, staging

    monkeypatch.setattr(similarity, "FEW", 20)
    monkeypatch.setattr(staging, "bytes_of", lambda df: staging.BROADCAST_BYTES + 1)
    plans = []
    score = similarity._best
    monkeypatch.setattr(similarity, "_best", lambda pairs, *a: plans.append(pairs._jdf.queryExecution().executedPlan().toString()) or score(pairs, *a))
    df = lambda keys: spark.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias("key"))  # noqa: E731  expected to be small
    right = [f"supplier 0000{n:05d}" for n in range(40)] + ["a key of more than twenty-four letters", "ab"]
    found = similarity.best_matches(df(["suplier 000000007", "a key of more then twenty-four letters", "zz"]), df(right), 0.72).collect()
    assert {r.key: r.match for r in found} == {"suplier 000000007": right[7], "a key of more then twenty-four letters": right[40]}
    joined = [line for plan in plans for line in plan.split("\n") if "Join" in line and any(f"{c}#" in line for c in ("rest", "gram", "size"))]
    assert len(plans) == 3 and len(joined) >= 4  # by what is left, twice; by bigram; by length
    assert not [line for line in joined if "BroadcastHashJoin" in line and "LeftOuter" not in line]  # counts of bigrams may be sent


def test_export_and_identity_work_out_fields_once(spark):
    from shelfwright.plans import queries

    for query in (queries.catalog_export, queries.identity_columns):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate posexplode(") == 1, query.__name__


def test_survivors_are_worked_out_once(spark):
    from shelfwright.plans import queries

    plan = queries.compliance_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "PROX SNSR" not in plan  # the catalogue's own expressions
