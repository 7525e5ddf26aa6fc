"""Readers, the store and the incremental flow."""

import os

import pytest
from pyspark.sql import functions as F

from shelfwright.operators import classify, dedup, identity, vocabulary
from shelfwright.sources import store, tables
from shelfwright.streaming import incremental


def write(path, *rows):
    path.write_text("\n".join(",".join(r) for r in rows) + "\n")


def test_files_lend_their_names(spark, tmp_path):
    write(tmp_path / "Ball Valves.csv", ("Attribute Label", "Permitted Values"), ("Material", "Brass|Bronze"), ("Size", ""))
    write(tmp_path / "Couplings.v2.csv", ("attribute_label", "permitted_values"), ("Material", "Steel"))
    attributes, values = vocabulary.lov_tables(tables.load_vocabulary(spark, str(tmp_path / "Ball Valves.csv")).unionByName(tables.load_vocabulary(spark, str(tmp_path / "Couplings.v2.csv"))))
    assert {(r.classpath, r.label) for r in attributes.collect()} == {("Ball Valves", "Material"), ("Ball Valves", "Size"), ("Couplings.v2", "Material")}
    assert {(r.classpath, r.value) for r in values.collect()} == {("Ball Valves", "Brass"), ("Ball Valves", "Bronze"), ("Couplings.v2", "Steel")}
    both = tables.load_vocabulary(spark, [str(tmp_path / "Ball Valves.csv"), str(tmp_path / "Ball Valves.csv")])
    assert both.select("classpath").distinct().count() == 1 and both.count() == 4
    write(tmp_path / "own.csv", ("classpath", "label", "values"), ("A > B", "Grit", "80"), ("", "Grit", "60"))
    assert [r.classpath for r in tables.load_vocabulary(spark, str(tmp_path / "own.csv")).orderBy("ordinal").collect()] == ["A > B", "own"]
    assert {r.label for r in classify.candidates(spark, attributes).collect()} == {"Ball Valves", "Couplings.v2"}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_the_first_row_stays_the_first(spark, tmp_path, fmt):
    """However rows are dealt over files and splits, rows keep the order of the file, and the first of equals survives."""
    rows = spark.createDataFrame([(f"M{k % 5}", "same", f"B{k % 5}", str(k)) for k in range(400)], "Mfg_Part_Num string, Part_Desc string, Part_Manuf string, mark string").coalesce(1)
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    getattr(rows.write.option("header", True), fmt)(one)
    (rows.write.option("header", True).option("maxRecordsPerFile", 37)).format(fmt).save(many)
    firsts = []
    for path, split in ((one, "128m"), (one, "2k"), (many, "128m"), (many, "1k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = tables.load_items(spark, path, fmt, placed=True).repartition(7)
        assert [r.mark for r in df.orderBy("ordinal").collect()] == [str(k) for k in range(400)]
        firsts.append({r.mark for r in dedup.survivors(df, index="ordinal").collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert firsts == [{"0", "1", "2", "3", "4"}] * 4


def test_the_first_brand_of_a_key(spark, tmp_path):
    brands = spark.createDataFrame([("Acme Inc", "1", "First", "a"), ("ACME", "2", "Second", "b")] + [(f"Other {k}", "3", None, None) for k in range(50)], "manufacturer string, mfr_code string, brand string, brand_code string").coalesce(1)
    brands.write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "brands"))
    placed = tables.read_table(spark, str(tmp_path / "brands"), placed=True).repartition(5)
    rows = spark.createDataFrame([(1, "acme")], "row_index long, name string")
    assert identity.resolve_brands(rows, tables.load_brands(placed), "name").first().brand_name == "First"


def test_pairs_and_unordered_tables(spark, tmp_path):
    write(tmp_path / "in.csv", ("Mfg_Part_Num", ""), ("A1", "x"), ("", " "))
    write(tmp_path / "out.csv", ("Mfg_Part_Num", "Brand"), ("A1", "one"), ("A1", "two"))
    given, truth = tables.load_pair(spark, str(tmp_path / "in.csv"), str(tmp_path / "out.csv"))
    assert given.columns == ["Mfg_Part_Num", "col_1"] and given.count() == 1
    assert [r.Brand for r in truth.orderBy("ordinal").collect()] == ["one", "two"]
    free = spark.createDataFrame([("b", "L", "1"), ("a", "L", "2")], "classpath string, label string, values string")
    same = [tables.load_lov(df).orderBy("ordinal").first().classpath for df in (free, free.orderBy("classpath"))]
    assert same[0] == same[1] and tables.load_lov(free, free).select("ordinal.table").distinct().count() == 2


ROW = "product_id string, n long, note string"


def folders(path):
    return {os.path.join(os.path.basename(d), b) for v in os.listdir(path + "/data") if v.startswith("version=") for d in [os.path.join(path, "data", v)] for b in os.listdir(d) if b.startswith("bucket=")}


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path) is None and store.lookup(spark, path, "p1", "product_id") is None
    df = lambda *rows: spark.createDataFrame(list(rows), ROW)
    store.upsert_store(df(*[(f"p{k}", k, "old") for k in range(60)]), path, 0, "product_id", buckets=8)
    before = folders(path)
    assert len(before) == 8
    store.upsert_store(df(("p1", 100, "new"), ("new", 7, None), ("p1", 99, "less")), path, 1, "product_id", order="n", buckets=8)
    written = folders(path) - before
    assert 1 <= len(written) <= 2 and all(w.startswith("version=1") for w in written)  # only touched buckets
    rows = {r.product_id: (r.n, r.note) for r in store.read_store(spark, path).collect()}
    assert len(rows) == 61 and rows["p1"] == (100, "new") and rows["new"] == (7, None) and rows["p2"] == (2, "old")
    assert store.read_store(spark, path, 0).count() == 60
    store.upsert_store(df(("p1", 100, "new"), ("new", 7, None), ("p1", 99, "less")), path, 1, "product_id", order="n", buckets=8)  # again
    assert {r.product_id: (r.n, r.note) for r in store.read_store(spark, path).collect()} == rows
    for v in (2, 3):
        store.upsert_store(df(*[(f"p{k}", k, f"v{v}") for k in range(60)]), path, v, "product_id", buckets=8)
    assert store.versions(spark, path) == [2, 3] and store.read_store(spark, path, 1) is None
    assert {f.split(os.sep)[0] for f in folders(path)} == {"version=2", "version=3"}
    assert store.read_store(spark, path).where("note = 'v3'").count() == 60
    store.upsert_store(df(), path, 4, "product_id", buckets=8)
    assert store.read_store(spark, path).count() == 61


def test_half_a_version_is_not_there(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a", 1, "x")], ROW)
    store.upsert_store(df, path, 0, "product_id", buckets=4)
    df.withColumns({"n": F.lit(9), "version": F.lit(1), "bucket": store.bucket_of(F.col("product_id"), 4)}).write.partitionBy("version", "bucket").mode("append").parquet(path + "/data")
    assert store.versions(spark, path) == [0] and store.read_store(spark, path).first().n == 1
    store.upsert_store(df.withColumn("n", F.lit(2).cast("long")), path, 1, "product_id", buckets=4)
    assert [r.n for r in store.read_store(spark, path).collect()] == [2]


def test_lookup_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "20000")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.page.size", "2000")
    rows = spark.range(40_000).select(F.concat(F.lit("p"), F.col("id")).alias("product_id"), "id", F.sha2(F.col("id").cast("string"), 256).alias("note"))
    store.upsert_store(rows, path, 0, "product_id", buckets=2)
    for key in ("parquet.block.size", "parquet.page.size"):
        spark.sparkContext._jsc.hadoopConfiguration().unset(key)
    found = store.lookup(spark, path, "p777", "product_id", buckets=2)
    assert [r.id for r in found.collect()] == [777]
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "EqualTo(product_id,p777)" in text and "PartitionFilters: [" in text and "version" in text.split("PartitionFilters: [")[1].split("]")[0]

    def scans(node):
        out = [node] if "Scan" in node.nodeName() else []
        for k in range(node.children().size()):
            out += scans(node.children().apply(k))
        return out + (scans(node.executedPlan()) if node.nodeName() == "AdaptiveSparkPlan" else [])

    read = [s.metrics().apply("numOutputRows").value() for s in scans(plan)]
    assert read and sum(read) < 4_000  # of 20,000 rows in the bucket
    assert store.lookup(spark, path, "absent", "product_id", buckets=2).count() == 0


def test_incremental(spark, tmp_path):
    landing, path, checkpoint = (str(tmp_path / n) for n in ("in", "store", "check"))
    text = "CN-M12-5P Circular Connector\nRated voltage: 250 V"
    df = lambda *rows: spark.createDataFrame(list(rows), incremental.SCHEMA)
    df(("a", text, None, None), ("b", text, None, None)).write.mode("append").parquet(landing)
    run = lambda check: incremental.start(incremental.incoming(spark, landing), path, check, buckets=4).awaitTermination(120)
    run(checkpoint)
    first = {r.product_id: r for r in incremental.current(spark, path).collect()}
    assert set(first) == {"a", "b"}
    df(("b", "short", None, None), ("c", text, None, None)).write.mode("append").parquet(landing)
    run(checkpoint)
    second = {r.product_id: r for r in incremental.current(spark, path).collect()}
    assert set(second) == {"a", "b", "c"} and second["a"] == first["a"] and second["b"].overall_status == "needs_review" and second["b"] != first["b"]
    assert incremental.current(spark, path, 0).count() == 2
