import json
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shelfwright.llm import op13_concat

public = pytest.importorskip("public_tokenizers")
PATH = public.path(op13_concat.TOKENIZER)

TEXTS = [
    "", " ", None, "Don't CAN'T 'S 's''s !!'s", "x\0y \x1c\x1d z\x85w\xa0v", "İstanbul Σας ΟΔΟΣ", "é à́ ́x", "<|endoftext|> a <|startoftext|>b", "漢字 かな 123 ４５ Ⅷ ²³", "ŉ ſ ß ẞ ÿ Ÿ ǆ ǅ Ⱥ Ƨ",
    "😀👍🏽 a😀b", "a\tb\r\nc\x0cd　e", "À la carte’s “x” — y…", "가 가 ﬁ Å K Å", "don't.I'll've", "aa" * 500, "﻿x ​ y", "12 3.4e5 _a_b__", "\n\n", "'tis 'llama x  y\n z ",
]


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, op13_concat.END]


@pytest.mark.parametrize("proved", [True, False])
def test_ids_are_the_tokenizers(proved, monkeypatch):
    monkeypatch.setattr(op13_concat, "CACHE", 60)
    monkeypatch.setattr(op13_concat, "PORTION", 300)
    assert op13_concat.same_as_ranks(PATH)
    encoder = op13_concat.Encoder(PATH, proved)
    texts = [*TEXTS, "Ein schöner Tag, 3 'll. " * 90, "ünïcödé — " * 90, "x" * 900, "y" * 900 + " z" * 400]
    wanted = [ids_of(t)[:-1] for t in texts]
    assert [x.tolist() for x in encoder.encode(pa.array(texts, pa.string()))] == wanted
    assert [encoder.encode(pa.array([t], pa.string()))[0].tolist() for t in texts] == wanted


def test_proof_from_the_file(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    for change in (lambda m: m["model"]["merges"].reverse(), lambda m: m.update(normalizer={"type": "NFC"}), lambda m: m["pre_tokenizer"]["pretokenizers"][0].update(invert=False), lambda m: m["model"]["merges"].pop(), lambda m: m["model"].update(end_of_word_suffix=None)):
        other = json.loads(json.dumps(file))
        change(other)
        (tmp_path / "other.json").write_text(json.dumps(other))
        assert not op13_concat.same_as_ranks.__wrapped__(str(tmp_path / "other.json"))


@pytest.mark.parametrize(("capacity", "block"), [(64, 4096), (7, 2), (4096, 1)])
def test_round_trip(spark, capacity, block, monkeypatch):
    monkeypatch.setattr(op13_concat, "BLOCK", block)
    texts = {k: t for k, t in enumerate(TEXTS)} | {100 + k: f"Some words, number {k}. " * (k % 9) for k in range(60)} | {900: "long text, " * 900}
    rows = [(k, t, 1, 2) for k, t in texts.items()] + [(None, "no id here", 0, 0), (100, texts[100], 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, part int").repartition(7)
    out = op13_concat.concatenated(docs, capacity=capacity).toPandas()
    ids = {k: ids_of(t) for k, t in [*texts.items(), (None, "no id here")]}
    total = sum(len(ids_of(t)) for _, t, _, _ in rows)
    assert out.length.sum() == total
    for doc, pieces in out.groupby("doc_id", dropna=False):
        whole = ids[None if doc != doc else int(doc)]
        copies = 2 if doc == 100 else 1
        assert pieces.length.sum() == copies * len(whole) and set(pieces.doc_tokens) == {len(whole)}
        for p in pieces.itertuples():
            part = np.array(whole[p.start : p.start + p.length], "<u4")
            assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.boundary == (p.start + p.length < len(whole))
        if copies == 1:
            place = pieces.sort_values("start")
            assert list(place.start) == [0, *place.length.cumsum()[:-1]]
    padding = 0
    for _, pieces in out.groupby("sequence_id"):
        placed = pieces.sort_values("offset")
        assert list(placed.offset) == [0, *placed.length.cumsum()[:-1]] and placed.length.sum() <= capacity
        size = int(placed.length.sum())
        padding += 0 if size & (size - 1) == 0 else capacity - size
    assert padding == 0 and out.sequence_id.nunique() == total // capacity + bin(total % capacity).count("1")


def test_windows():
    assert op13_concat.windows(0, 8) == (0, []) and op13_concat.windows(16, 8) == (2, []) and op13_concat.windows(23, 8) == (2, [16, 20, 22])


def test_no_documents(spark):
    assert op13_concat.concatenated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
