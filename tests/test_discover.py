"""Part numbers on pages, many against many, and batches whose failures are kept."""

import random
import re

from pyspark.sql import functions as F

from shelfwright.operators import discover
from shelfwright.plans import flows
from shelfwright.sources import store

SEP = r"[\s._/\-–—]*"


def stands(number, text):
    letters = re.sub("[^A-Z0-9]", "", (number or "").upper())
    return bool(letters) and bool(text) and re.search(rf"(?<![A-Za-z0-9]){SEP.join(letters)}(?![A-Za-z0-9])", text, re.I | re.A if text.isascii() else re.I) is not None


def test_numbers_on_pages_match_brute_force(spark):
    rng = random.Random(7)
    parts = ["AB", "12", "x9", "C", "7", "dcb", "518"]
    seps = [" ", "-", ".", "/", "_", "–", "—", "\n", " ", " ", ", ", "(", "é", "  ", "", "#"]
    word = lambda n: "".join(rng.choice(parts) + (rng.choice(seps) if rng.random() < 0.6 else "") for _ in range(n))
    texts = {k: word(rng.randint(0, 40)) for k in range(120)} | {900: None, 901: "", 902: "DCB518-ASTS06G", 903: "XYZABC123999", 904: "the ABC-123."}
    numbers = [word(rng.randint(1, 3)) for _ in range(80)] + ["DCB518ASTS06G", "ABC123", None, "", "--", "dcb-518 asts 06g", "A" * 30]
    docs = spark.createDataFrame(list(texts.items()), "url long, text string")
    asked = spark.createDataFrame([(n,) for n in numbers], "mfg_part_num string")
    found = {(r.url, r.number_key) for r in discover.numbers_on_pages(asked, docs).collect()}
    key = lambda n: re.sub("[^A-Z0-9]", "", (n or "").upper())
    wanted = {(k, key(n)) for k, t in texts.items() for n in numbers if stands(n, t)}
    assert found == wanted and len(found) > 500 and (902, "DCB518ASTS06G") in found and (904, "ABC123") in found and (903, "ABC123") not in found
    by_row = asked.crossJoin(docs).where(discover.mpn_on_page(F.col("mfg_part_num"), F.col("text"))).select("url", discover.compact_number(F.col("mfg_part_num"))).distinct()
    assert {tuple(r) for r in by_row.collect()} == wanted
    assert discover.numbers_on_pages(asked.limit(0), docs).count() == 0 and discover.numbers_on_pages(asked, docs.limit(0)).count() == 0


def test_no_pair_meets_but_by_equality(spark):
    asked, docs = spark.createDataFrame([("A1 B2",)], "mfg_part_num string"), spark.createDataFrame([(1, "x A1-B2 y")], "url long, text string")
    plan = discover.numbers_on_pages(asked, docs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


LONG = "Specifications of a valve for water and steam.\n" * 8


def test_stages_in_order(spark):
    pages = [("https://moen.com/a", "Moen", f"AB-12 {LONG}"), ("https://moen.com/b", "Moen", "AB-12 short"), ("https://moen.com/c", "Moen", LONG), ("https://other.example/d", "x", f"AB 12 {LONG}"), ("https://moen.com/f", "AB-12", "short without it")]
    asked = [(1, p, k) for k, p in enumerate(["https://moen.com/a", "https://moen.com/b", "https://moen.com/c", "https://other.example/d", "https://moen.com/e", "https://www.amazon.com/x", "https://moen.com/f"])]
    requests = spark.createDataFrame([(1, "ab12", "Moen Inc", None)], "request_id int, mfg_part_num string, manufacturer string, brand string")
    out = discover.judge_candidates(requests, spark.createDataFrame(asked, "request_id int, url string, position int"), spark.createDataFrame(pages, "url string, title string, text string"))
    stages = {r.url.split("/")[-1]: (r.stage, r["rank"]) for r in out.collect()}
    assert stages == {"a": (None, 1), "b": ("content", None), "c": ("identity: part number", None), "d": ("identity: maker", None), "e": ("fetch", None), "x": ("sourcing", None), "f": ("identity: part number", None)}
    assert [r.url for r in discover.best_sources(out).collect()] == ["https://moen.com/a"]


def test_batch_keeps_failures(spark, tmp_path):
    text = "CN-M12-5P Circular Connector\nRated voltage: 250 V\nRated current: 4 A\nMaterial: Stainless steel\n" + "More about it. " * 20
    pages = [("https://moen.com/a", "A", text), ("https://moen.com/a", "A", "older and shorter"), ("https://moen.com/s", None, "CN-M12-5P Connector"), ("https://moen.com/z", None, " "), ("https://www.amazon.com/x", None, text)]
    asked = ["https://moen.com/a", "https://moen.com/a", "https://moen.com/s", "https://moen.com/z", "https://moen.com/gone", "https://www.amazon.com/x", "http://127.0.0.1/", "", None]
    batch, found = spark.createDataFrame([(u,) for u in asked], "url string"), spark.createDataFrame(pages, "url string, title string, text string")
    rows = {r.url: (r.stage, r.reason) for r in discover.batch_outcomes(batch, found).collect()}
    assert rows == {
        "https://moen.com/a": (None, None), "https://moen.com/s": (None, "sparse page"), "https://moen.com/z": ("content", "empty page"), "https://moen.com/gone": ("fetch", "no such page"),
        "https://www.amazon.com/x": ("sourcing", "marketplace not permitted"), "http://127.0.0.1/": ("sourcing", "not fetchable: blocked network 127.0.0.0/8"), "": ("sourcing", "not fetchable: empty"), None: ("sourcing", "not fetchable: empty"),
    }
    path, letters = str(tmp_path / "store"), str(tmp_path / "letters")
    for _ in range(2):  # again: the same
        counts = flows.save_batch(batch, found, path, letters, 0, buckets=4)
        assert counts == {"asked": 8, "processed": 2, "sparse": 1, "sourcing": 4, "fetch": 1, "content": 1}
        assert {r.product_id for r in store.read_store(spark, path).collect()} == {"https://moen.com/a", "https://moen.com/s"}
        assert spark.read.parquet(letters).count() == 6


def test_runs_of_a_table_of_one_split_are_grown_by_all_cores(spark, tmp_path):
    made = spark.createDataFrame([("a", "the ab-12 C d, x"), ("b", None), ("c", "AB 12 cd AB/12 " * 50), ("c", "ab12—cd"), ("d", "ab,12 cd é ab12é")], "url string, text string")
    made.coalesce(1).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    grams = discover.page_grams(pages, 6, {"AB", "AB1"})
    assert grams.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    rows = [tuple(r) for r in grams.collect()]
    assert sorted(set(rows)) == [("a", "AB"), ("a", "AB12"), ("a", "AB12C"), ("a", "AB12CD"), ("c", "AB"), ("c", "AB12"), ("c", "AB12AB"), ("c", "AB12CD"), ("d", "AB"), ("d", "AB12")]
    assert rows.count(("c", "AB12")) == 2  # once a page, however often it stands there
    numbers = spark.createDataFrame([("AB-12",), ("ab 12 cd",), ("",), (None,)], "mfg_part_num string")
    found = {tuple(r) for r in discover.numbers_on_pages(numbers, pages).collect()}
    assert found == {("a", "AB12"), ("a", "AB12CD"), ("c", "AB12"), ("c", "AB12CD"), ("d", "AB12")}


def test_each_page_is_parsed_once_and_ties_go_by_address(spark):
    from shelfwright.plans import queries

    plan = queries.discover_best_source(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1 and "html" not in plan  # the runs of words; pages lie ready
    text = "Part AB-12 of brass. " * 40
    pages = spark.createDataFrame([(u, "t", text) for u in ("https://b.example/x", "https://a.example/x", "https://c.example/x")], "url string, title string, text string")
    requests = spark.createDataFrame([(1, "AB12", None, None, None)], "request_id long, mfg_part_num string, part_desc string, manufacturer string, brand string")
    found = pages.select(F.lit(1).cast("long").alias("request_id"), F.lit(0).alias("position"), "url").union(spark.createDataFrame([(1, 1, "https://none.example/x")], "request_id long, position int, url string"))
    rows = {r.url: (r.stage, r.score, r["rank"]) for r in discover.judge_candidates(requests, found, pages, "allow_all").collect()}
    assert [rows[f"https://{k}.example/x"][2] for k in "abc"] == [1, 2, 3] and rows["https://none.example/x"] == ("fetch", 0.0, None)
