import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from shelfwright.llm import op03_lines, op04_html, op06_license, op07_decontam, op09_packing, op10_balltree

DOCS = "doc_id long, text string"


def test_lines(spark):
    rows = [(k, "a" if k < 20 else None, f"Menu \nown line {k}\n\nrare" if k % 20 < 6 else f"own line {k}") for k in range(40)] + [(90, "a", None), (91, "a", ""), (92, "a", "Menu")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, source string, text string, n_chars long")
    out = {r.doc_id: r for r in op03_lines.dedup_lines(docs).collect()}
    assert out[0].text == "own line 0\n" and out[0].n_chars == len(out[0].text) and out[7].text == "own line 7" and out[7].n_chars == 7
    assert out[92].text == "" and out[90].text is None and len(out) == 43
    report = op03_lines.line_report(docs).toPandas()
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841  DuckDB reads it by name
    theirs = con.sql(op03_lines.SQL).df()
    key = lambda df: sorted((int(r.doc_id), int(r.n_lines), int(r.n_kept), "" if r.text is None or r.text != r.text else r.text) for r in df.itertuples())
    assert key(report) == key(theirs)
    assert op03_lines.dedup_lines(docs.limit(0)).count() == 0


PAGES = [
    ("<html><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy now, cheap</div><article><h1>Title &amp; more</h1><p><b>First, with  a\nlong   enough paragraph.<br><p>Second one.</article><footer>&copy; x</footer></body></html>", "Title & more\nFirst, with a long enough paragraph.\nSecond one."),
    ("<body><div id='wrap'><div class='post'><p>" + "A sentence, with commas, of some length. " * 4 + "</p><p>" + "Another, equally long paragraph here. " * 3 + "</p></div><div class='sidebar'><p>Links, links, links and more links here</p></div><ul class='menu'><li>x</ul></div>", None),
    ("<script>var t='</p>';</script><style>p{}</style>", ""),
    ("", ""),
    (None, ""),
    ("<p>" * 3000 + "deep", "deep"),
]


def test_html(spark):
    got = op04_html.main_texts(spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert all(r.n_chars == len(r.text) for r in got)
    for r, (_, wanted) in zip(got, PAGES, strict=True):
        assert wanted is None or r.text == wanted
    assert got[1].text.count("\n") == 1 and "Links" not in got[1].text


def test_html_keeps_the_whole_article():
    line = lambda k: f"Sentence {k} of it, with commas, and a little more text to be long enough. " * 2
    long, short = ("".join(f"<p>{line(k)}</p>" for k in ks) for ks in (range(40), range(40, 47)))
    page = f"<body><article><section>{long}</section><section><h2>Further</h2>{short}<p>Short.</p><ul><li>One</ul></section></article><footer>x</footer></body>"
    assert op04_html.main_text(page).split("\n") == [line(k).strip() for k in range(40)] + ["Further"] + [line(k).strip() for k in range(40, 47)] + ["Short.", "One"]


def test_html_keeps_siblings_of_a_long_section():
    line = "A sentence of it, with commas, and a little more text to be long enough. "
    page = f"<body><div><div>{f'<p>{line * 2}</p>' * 40}</div>Bare <b>text</b>.<h2>Further</h2><div><p>{line}</p></div><ul><li><a href='/'>Link one</a></ul></div>"
    assert op04_html.main_text(page).split("\n")[40:] == ["Bare text.", "Further", line.strip()]


def test_license(spark):
    texts = ["Released under the MIT License.\nUnder the mit-license", "Licensed under the Apache License, Version 2.0.", "CC BY-NC cc by nc", None, "", "under the MIT", "é mit", "This work is licensed under the GNU General Public License, version 3."]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[0])]
    out = op06_license.license_scan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for k, t in enumerate(texts):
        w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]
        starts = [i for p in op06_license.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = by[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        assert 0 <= r.score <= 1
    assert by[0].base_labels == by[0].labels == "mit" and by[7].labels == "gpl-3" and by[7].base_labels == "" and by[5].labels == ""


def license_brute(text):
    """Labels and score by the definition: per template, votes by diagonal, runs of near diagonals, covered words."""
    w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]
    labels, score = set(), 0.0
    for label, phrase, base, least in op06_license.template_list():
        t = phrase.split()
        gap = max(op06_license.DIAGONALS, len(t) // 2)
        votes = {}
        for pos in range(len(w) - 2):
            for at in range(len(t) - 2):
                if w[pos : pos + 3] == t[at : at + 3]:
                    votes.setdefault(pos - at, []).append(at)
        runs = []
        for d in sorted(votes):
            if runs and not base and d - runs[-1][-1] <= gap:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            share = len({at + j for d in run for at in votes[d] for j in range(3)}) / len(t)
            score = max(score, share)
            if share >= least:
                labels.add(label)
    return ",".join(sorted(labels)), score


def test_license_votes_by_diagonal(spark):
    rng = random.Random(12)
    notice = op06_license.NOTICES[0][1].split()
    texts = [" ".join(notice)]
    for at in ([3, 8, 13, 18, 24], [5, 10, 15, 20, 25]):  # five words put in
        words = list(notice)
        for k in reversed(at):
            words.insert(k, "indeed")
        texts.append(" ".join(words))
    texts.append(" ".join(notice[:14] + notice[2:5] + notice[14:] + notice[2:5]))  # stray repeats
    texts.append(" ".join(notice[:10]))
    pool = [x for _, t in op06_license.NOTICES for x in t.split()]
    texts += [" ".join(rng.choice(pool) if rng.random() < 0.3 else x for x in rng.choice(op06_license.NOTICES)[1].split() * 2) for _ in range(60)]
    rows = [(k, t, "x", "y", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS + ", labels string, key string, h int")
    out = {r.doc_id: r for r in op06_license.license_scan(docs).collect()}
    assert {k: (r.labels, round(r.score, 9)) for k, r in out.items()} == {k: (a, round(b, 9)) for k, t in enumerate(texts) for a, b in [license_brute(t)]}
    assert all(out[k].labels == "mit" and out[k].spans[0].label == "mit" for k in range(4)) and out[4].labels == ""
    assert op06_license.license_scan(docs.limit(0)).count() == 0


def test_license_with_words_put_in(spark):
    """Up to ten words at one place of a notice, whole notices of every kind, and names that differ in one word."""
    notices = [(label, text) for label, text in op06_license.NOTICES if len(text.split()) >= 20]
    texts = [(label, " ".join(text.split()[:at] + ["indeed"] * n + text.split()[at:])) for label, text in notices for n in (0, 1, 4, 8, 10) for at in (6, len(text.split()) // 2)]
    names = [("lgpl-2.1", "GNU Lesser General Public License v2.1"), ("mit", "// SPDX-License-Identifier: MIT"), ("bsd-3", "BSD 3-Clause License"), ("gpl-2", "SPDX-License-Identifier: GPL-2.0-only"), ("", "GNU General Public License"), ("", "SPDX-License-Identifier: Zlib"), ("", "BSD 4-Clause License")]
    rows = [(k, t) for k, (_, t) in enumerate(texts + names)]
    out = {r.doc_id: r.labels for r in op06_license.license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(label in out[k].split(",") for k, (label, _) in enumerate(texts))
    assert [out[len(texts) + k] for k in range(len(names))] == [label for label, _ in names]


def test_html_in_linear_time():
    import time

    line = "A sentence of it, with commas, and a little more text to be long enough."
    pages = ["<div class='a'><p>" + line + "</p>", '<a "', "<b>", "<p><b>", "<i>", "<li>x", "</i></b>", "<!--", "<script>"]
    for part in pages:
        times = []
        for n in (20_000, 80_000):
            page = (part * (n // len(part) + 1))[:n] + line
            began = time.perf_counter()
            op04_html.main_text(page)
            times.append(time.perf_counter() - began)
        assert times[1] < 12 * max(times[0], 0.02), part
    deep = "<div><p>" + line + "</p>"
    assert op04_html.main_text(deep * 12_000).count("\n") == 11_999  # about a million characters, nested


def test_html_furniture_by_whole_names():
    line = "A sentence of it, with commas, and a little more text to be long enough."
    body = "".join(f'<div class="{c}"><p>{c.replace(" ", "").upper()} {line}</p></div>' for c in ("share-of-market", "article-tags", "notice of intent", "nav-bar", "site-footer", "cookie-banner", "noticeable"))
    text = op04_html.main_text(f"<body><article>{body}</article></body>")
    assert [t.split(" ")[0] for t in text.split("\n")] == ["SHARE-OF-MARKET", "NOTICEABLE"]


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, "<p>x", "t"), (1, None, "<p>x", "t"), (None, "u", None, "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in op04_html.main_texts(pages).collect()) == [(0, ""), (1, "x"), (1, "x")]
    assert op04_html.main_texts(pages.limit(0)).count() == 0


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a\nMenu", "s", "x", "y", "z", "w"), (2, "b\nMenu", "s", "x", "y", "z", "w"), (3, None, None, None, None, None, None)], DOCS + ", source string, line_host string, line_bad string, line_left string, text_row string")
    kept = op03_lines.dedup_lines(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()} == {1: "a", 2: "b", 3: None}
    bench = spark.createDataFrame([(1, "a menu")], "item_id long, text string")
    clean = op07_decontam.decontaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3]
    assert op07_decontam.decontaminated(docs.limit(0), bench).count() == 0 and op09_packing.packed(docs.limit(0)).count() == 0
    assert op09_packing.packed(docs.withColumnsRenamed({"source": "salt", "line_host": "rank", "line_bad": "shares"})).count() == 3


def test_ranks_are_proved_from_the_file(tmp_path):
    import json

    public = pytest.importorskip("public_tokenizers")
    path = public.path(op09_packing.TOKENIZER)
    assert op09_packing.same_as_ranks(path)
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    for change in (lambda m: m["model"]["merges"].reverse(), lambda m: m.update(normalizer={"type": "NFC"}), lambda m: m["pre_tokenizer"].update(add_prefix_space=True), lambda m: m["model"]["merges"].pop()):
        other = json.loads(json.dumps(file))
        change(other)
        (tmp_path / "other.json").write_text(json.dumps(other))
        assert not op09_packing.same_as_ranks.__wrapped__(str(tmp_path / "other.json"))


def test_ranks_in_salted_shares(spark, monkeypatch):
    monkeypatch.setattr(op09_packing, "RANKED", 7)
    rows = [(k % 40, 0, 0, 5 + (k % 3 == 0), k) for k in range(100)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = op09_packing.ranked(pieces).toPandas()
    for n, group in out.groupby("length"):
        assert sorted(group["rank"]) == list(range(len(group))), n


def test_decontamination_finds_exact_and_near(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    items = [(k, " ".join(word() for _ in range(rng.choice([5, 9, 20, 40, 70])))) for k in range(30)] + [(90, None), (91, "")]
    rows, wanted = [], set()
    for k in range(60):
        body = [word() for _ in range(rng.randint(0, 200))]
        if k < 30:
            part = items[k][1].split()
            if len(part) >= 40:
                part[rng.randrange(2)] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = part
            wanted.add((k, k))
        rows.append((k, " ".join(body).title() if k % 2 else " ".join(body)))
    rows += [(900, None), (901, "")]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = op07_decontam.contaminations(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted and all(r.similarity >= 0.75 for r in got)
    assert {r.doc_id for r in op07_decontam.decontaminated(docs, bench).collect()} == {r[0] for r in rows if r[0] >= 30}
    assert op07_decontam.contaminations(docs, bench.limit(0)).count() == 0


def test_decontamination_matches_brute_force():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))).encode()
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate([1, 3, 5, 12, 20, 20, 40, 40, 100, 100])]
    texts = []
    for k in range(150):
        part = list(items[k % 10][1])
        n, cut = len(part), rng.randrange(max(1, len(part) // 5))
        at = rng.randrange(n - cut + 1)
        part[at : at + cut] = [[word() for _ in range(cut)], [], [word() for _ in range(rng.randint(0, 3))]][k % 3]  # words replaced, dropped, or few for many
        texts.append([word() for _ in range(rng.choice([0, 0, 30]))] + part + [word() for _ in range(rng.choice([0, 0, 30]))])
    texts += [texts[8] + texts[18], texts[6] + texts[6], []]
    wanted = {}
    for d, text in enumerate(texts):
        for k, item in items:
            for start in range(-len(item) + 1, len(text)):
                part = text[max(start, 0) : start + len(item)]
                alike = op07_decontam.similarity(op07_decontam.weighted(part), op07_decontam.weighted(item))
                if alike >= 0.75 and alike > wanted.get((d, k), (0,))[0]:
                    wanted[d, k] = (alike, max(start, 0), len(part))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": [b" ".join(t).decode() for t in texts]})
    found = [r for out in op07_decontam._matches(iter([batch]), items) for r in out.to_pylist()]
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"], r["n_words"]) for r in found}
    assert len(wanted) > 60 and {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in wanted.items()}


def test_packing_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdé, .\n") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([0, 3, 50, 400, 900]))) for _ in range(60)] + [None, "", "  two  spaces ", "x<|endoftext|>y", "a\nb", " lead", "trail \n"]
    rows = list(enumerate(texts)) + [(None, "abc"), (3, texts[3])]
    out = op09_packing.packed(spark.createDataFrame(rows, DOCS)).toPandas()
    tok = Tokenizer.from_file(public.path(op09_packing.TOKENIZER))
    for k, t in enumerate(texts):
        if k == 3:
            continue
        ids, p = tok.encode(t or "", add_special_tokens=False).ids + [2], out[out.doc_id == k].sort_values("piece")
        assert p.length.sum() == len(ids) and list(p.start) == list(np.cumsum(p.length) - p.length)
        assert [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(p.start, p.length, strict=True)] == list(p.ids_crc32)
        assert all(n == 1024 for n in list(p.length)[1:])
    assert len(out) > len(rows) - 1
    filled = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (filled.length.sum() <= 1024).all()
    for _, g in filled:
        assert list(g.offset) == list(np.cumsum(g.length) - g.length)


@pytest.mark.parametrize("seed", range(5))
def test_plan(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 1025), rng.randint(1, 300))}
    bins, seen = {}, {}
    for length, first, n, start, per, offset in op09_packing.plan(counts):
        assert first == seen.get(length, 0)
        seen[length] = first + n
        for k in range(n):
            bins.setdefault(start + k // per, []).append((offset + k % per * length, length))
    assert seen == counts
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and sum(3 * n > 1024 for _, n in parts) <= 2
    assert len(bins) <= 1.25 * (sum(k * v for k, v in counts.items()) / 1024) + 60 + sum(v for k, v in counts.items() if k > 512)


@pytest.mark.parametrize("options", [{}, {"cells": 3, "shard_rows": 40, "block_rows": 5}])
def test_top_k(spark, options):
    rng = np.random.default_rng(8)
    base = rng.normal(0, 0.3, (300, 6))
    base[50:120] = base[50]
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(base)] + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1020, [1.0, 2.0]), (1040, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in op10_balltree.top_k(df, k=7, leaf=8, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    usable = {k: np.floor(64 * np.array(v)) for k, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    wanted = {}
    for q in usable:
        if q % 20 == 0:
            near = sorted(((-int(usable[q] @ v), k) for k, v in usable.items() if k != q and len(v) == len(usable[q])))[:7]
            wanted[q] = [(k, -s) for s, k in near]
    assert got == {q: x for q, x in wanted.items() if x}
    assert op10_balltree.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"cells": 5, "shard_rows": 30, "block_rows": 7}])
def test_top_k_with_repeated_ids(spark, options):
    """Each row of a repeated id is a candidate and a query of its own, as in SQL."""
    rng = np.random.default_rng(12)
    rows = [(int(k % 90), [float(x) for x in rng.normal(0, 0.3, 5)]) for k in range(240)] + [(20, [0.5] * 5)] * 30 + [(7, [0.5] * 5)] * 3
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cell string, bar int")
    embeddings = df.select("vec_id", "embedding").toArrow()  # noqa: F841  DuckDB reads it by name
    theirs = duckdb.sql(op10_balltree.SQL).df()
    ours = op10_balltree.top_k(df, leaf=8, **options).toPandas()
    key = lambda df: sorted(map(tuple, df[["query_id", "rank", "vec_id", "score"]].values.tolist()))
    assert key(ours) == key(theirs) and len(ours) == 100


def test_decontamination_in_blocks_of_items(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    items = [(k, " ".join(word() for _ in range(12))) for k in range(20)]
    rows = [(k, " ".join([word(), word(), items[k % 20][1], word()])) for k in range(30)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in op07_decontam.contaminations(docs, bench).collect()}
    monkeypatch.setattr(op07_decontam, "ITEM_BYTES", 1_000)
    assert {tuple(r) for r in op07_decontam.contaminations(docs, bench).collect()} == whole and len(whole) == 30
