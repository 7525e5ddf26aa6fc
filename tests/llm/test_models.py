import math
import zlib
from collections import Counter

import numpy as np

from shelfwright.llm import op02_hmm, op05_cnn, op08_toxic

DOCS = "doc_id long, text string"


def held(doc_id, modulus, fold):
    return zlib.crc32(str(doc_id).encode()) % modulus == fold


def test_hmm_base_counts_and_gain(spark):
    rng = np.random.default_rng(1)
    tongues = [["the", "of", "and", "to"], ["der", "die", "und", "zu"]]
    rows = [(k, " ".join(rng.choice(tongues[k % 2], rng.integers(0, 40)))) for k in range(80)] + [(900, None), (901, ""), (902, "Unseen THE")]
    out = {r.doc_id: r for r in op02_hmm.hmm_scores(spark.createDataFrame(rows, DOCS), states=2, rounds=8).collect()}
    tokens = {k: (t or "").encode().lower().split() + [None] for k, t in rows}
    counts = Counter(w for k, ws in tokens.items() if not held(k, 5, 1) for w in ws)
    total, types = sum(counts.values()), len(counts)
    for k, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws)
        r = out[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k, 5, 1), len(ws), sum(counts[w] > 0 for w in ws), total)
        assert abs(r.base_score - base) < 1e-6
    test = [r for k, r in out.items() if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_forward_against_all_paths():
    rng = np.random.default_rng(2)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = op02_hmm.Model(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))).T.copy())
    symbols, lengths = rng.integers(0, 5, 9), np.array([4, 1, 4])
    got = op02_hmm.forward(model, symbols, lengths)
    at = 0
    for n, value in zip(lengths, got, strict=True):
        s, total = symbols[at : at + n], 0.0
        for path in np.ndindex(*(3,) * n):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, n):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert abs(value - math.log10(total)) < 1e-9
        at += n
    counts = op02_hmm.expected(model, symbols, lengths)
    assert abs(counts[:3].sum() - 3) < 1e-9 and abs(counts[3:12].sum() - 6) < 1e-9 and abs(counts[12:].sum() - 9) < 1e-9


def test_moves_are_counted_once_across_segments():
    lengths = np.array([1, 2, 5, 9, 16])
    places, sizes, first = op02_hmm.segments(lengths, 4)
    assert sizes.max() <= 4 and first.sum() == len(lengths) and (sizes - 1).sum() == (lengths - 1).sum()
    ends = np.cumsum(sizes)
    moves = [(int(a), int(b)) for e, n in zip(ends, sizes, strict=True) for a, b in zip(places[e - n : e], places[e - n + 1 : e], strict=False)]
    begins = np.cumsum(lengths) - lengths
    assert sorted(moves) == [(int(b) + t, int(b) + t + 1) for b, n in zip(begins, lengths, strict=True) for t in range(n - 1)]
    rng = np.random.default_rng(3)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = op02_hmm.Model(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))).T.copy())
    counts = op02_hmm.expected(model, rng.integers(0, 5, lengths.sum())[places], sizes, first)
    assert abs(counts[:3].sum() - len(lengths)) < 1e-9 and abs(counts[3:12].sum() - (lengths - 1).sum()) < 1e-9 and abs(counts[12:].sum() - lengths.sum()) < 1e-9


def test_repeated_rows_and_clashing_names(spark):
    rows = [(k, f"some words {k}. grubly ones", "s", 0.5, 1) for k in range(30)] + [(3, "some words 3. grubly ones", "s", 0.5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tox_score string, score double, held_out int")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)], "doc_id long, toxic int, quality int")
    assert op08_toxic.without_toxic(docs, labels, threshold=2.0).columns == docs.columns
    for out in (op08_toxic.toxicity_scores(docs, labels), op05_cnn.quality_scores(docs, labels), op02_hmm.hmm_scores(docs)):
        got = [r.score for r in out.where("doc_id = 3").collect()]
        assert len(got) == 2 and got[0] == got[1] and out.count() == 31
    for empty in (op08_toxic.toxicity_scores(docs.limit(0), labels), op05_cnn.quality_scores(docs.limit(0), labels)):
        assert empty.count() == 0


def sentences(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    junk = [lambda t: t.replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: "spam " * 60]
    rows, labels = [], []
    for k in range(240):
        t = sentences(rng, 80)
        bad = k % 4 == 0
        rows.append((k, junk[k % 3](t) if bad else t))
        labels.append((k, 0 if bad else 1))
    rows += [(1000, None), (1001, ""), (None, "abc")]
    out = op05_cnn.quality_scores(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    truth = dict(labels)
    test = [r for r in out if r.doc_id in truth and r.held_out]
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.9


def test_chunks_cover_the_whole_text():
    net = op05_cnn.Network.first(4, 0.5, 1)
    alone = [b"x" * n for n in (0, 1, 31, 32, 33, 64, 65, 1000)]
    assert np.allclose(net.scores(alone), [net.scores([t])[0] for t in alone], atol=1e-6)
    assert not np.allclose(net.scores([b"a" * 990 + b"!" * 64]), net.scores([b"a" * 1054]), atol=1e-6)


def test_long_texts_in_pieces_score_alike():
    net = op05_cnn.Network.first(6, 0.5, 2)
    rng = np.random.default_rng(5)
    for n in (65, 96, 97, 200, 1000, 1031):
        text = bytes(rng.choice(np.frombuffer(b"abc de", np.uint8), n)) + b"word word word " * 9
        assert np.allclose(net.scores([text]), net.scores([text], at_once=64), atol=1e-6)


def test_toxicity_on_held_out_rows_and_places(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(300):
        parts = [sentences(rng, 9) for _ in range(5)]
        if k % 3 == 0:
            parts[k % 5] += " " + ["grubly", "vexid"][k % 2]
        rows.append((k, ". ".join(parts) + "."))
        labels.append((k, int(k % 3 == 0)))
    rows += [(1000, None), (1001, ""), (None, "abc"), (1002, "  ")]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in op08_toxic.toxicity_scores(docs, marks).collect()}
    truth = dict(labels)
    test = [r for k, r in out.items() if k in truth and r.held_out]
    assert all(r.held_out == held(k, 3, 1) for k, r in out.items() if k is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.95
    assert all(r.offending == [r.doc_id % 5] for r in test if r.predicted)
    assert out[1000].score == out[1001].score == out[1002].score == 0
    assert op08_toxic.without_toxic(docs, marks).columns == docs.columns


def test_models_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    assert op05_cnn.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 2
    assert op08_toxic.toxicity_scores(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 2
    assert op02_hmm.hmm_scores(docs.limit(0)).count() == 0


def test_clean_text_of_any_length_is_clean():
    rng = np.random.default_rng(9)
    texts, labels = [], []
    for k in range(400):
        parts = [sentences(rng, 8) for _ in range(6)]
        if k % 3 == 0:
            parts[k % 6] += " vexid"
        texts.append(". ".join(parts) + ".")
        labels.append(float(k % 3 == 0))
    model = op08_toxic.train(texts, np.array(labels))
    clean = [t for t, y in zip(texts, labels, strict=True) if not y]
    for long in ("zq zr. " * 20_000, " ".join(clean), " ".join(clean) * 20):
        assert model.score(long) < op08_toxic.THRESHOLD and not model.sentence_scores(long).any()
    for text, y in zip(texts, labels, strict=True):
        alone, padded = model.score(text), model.score(text + " zq zr. " * 5_000 + clean[0])
        assert abs(alone - padded) < 1e-9 and (alone >= op08_toxic.THRESHOLD) == bool(y)
        assert alone < op08_toxic.THRESHOLD or model.sentence_scores(text).max() >= op08_toxic.LEAST


def test_score_is_the_noisy_or_of_its_sentences():
    weights = {b"bad": 4.0, b"^wors": 1.5, b"worse": 1.0, b"nice": -2.0}
    model, bias = op08_toxic.Mil(weights, -2.0), -2.0

    def by_hand(text):
        none = 1.0
        for sentence in text.lower().replace("!", ".").split("."):
            words = {w.strip(",") for w in sentence.split()}
            z = sum(weights.get(w.encode(), 0) + sum(weights.get(b"^" + w.encode()[:n], 0) for n in (4, 5, 6) if len(w) >= n) for w in words)
            p = 1 / (1 + np.exp(-(z + bias)))
            none *= 1 - p if z > 0 and p >= op08_toxic.LEAST else 1
        return 1 - none

    for text in ("", "fine", "bad. bad bad! nice bad", "worse, worse. worst", "Bad nice nice. x", "nice. nice"):
        assert abs(model.score(text) - by_hand(text)) < 1e-9, text
