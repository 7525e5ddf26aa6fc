import pytest

import corpus_pipeline
from shelfwright.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SMALL), name)
        assert out.columns == columns and 0 < out.count() <= docs.count(), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_contents_of_the_chain(spark, tmp_path):
    """Each stage's decisions, followed to the packed ids: toxic, copied and benchmark documents go, boilerplate lines go, all others stay whole."""
    import os
    import random
    import zlib

    import numpy as np

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    item = " ".join(word() for _ in range(30))
    texts, toxic, gone = {}, {}, set()
    for k in range(330):
        parts = [line(12) for _ in range(4)]
        toxic[k] = int(k % 5 == 0)
        if toxic[k]:
            parts[k % 4] = parts[k % 4][:-1] + " vexid."
            gone.add(k)
        texts[k] = "\n".join([*parts[:2], "Read more on our site", *parts[2:]])
    for k, copy in ((1, 400), (1, 401), (2, 402)):  # exact copies, and one with a word changed
        texts[copy] = texts[k] if copy != 402 else texts[k].replace(texts[k].split()[-1], "changed.")
        gone.add(copy)
    for k in (403, 404):
        texts[k] = line(20) + " " + item + " " + line(20)
        gone.add(k)
    texts |= {405: "", 406: None, 407: line(1500)}
    rows = [(k, t, "en", "one.example", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, y) for k, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    there = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) == set(texts) - gone
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for doc, pieces in out.groupby("doc_id"):
        text = "\n".join(x for x in (texts[doc] or "").split("\n") if x != "Read more on our site")
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert pieces.length.sum() == len(ids), doc
        assert all(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in pieces.itertuples()), doc
    assert not [x for x in set(os.listdir(shared)) - there if x.split("-")[0] in ("toxicity", "line_dedup", "near_dedup", "decontamination")]
