"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A sentence's probability is a logistic unit over its words and their first 4, 5 and 6 bytes (families of words share a
beginning), and a document is toxic if any sentence is: P = 1 - (1 - leak) prod(1 - p). Only sentences with words that speak
for toxicity take part; what they do not explain is the leak, one for each document whatever its length. Training maximises
the likelihood of document labels (SAMPLE labelled rows at most, whole texts), so the sentence scores that it learns also
locate what offends. A document's score is the noisy-or of its sentences at LEAST or more, without the leak: text that
offends nowhere adds nothing to it, however long, and a document over the threshold has a sentence that offends.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_LIMIT, fold, fresh, portions
from .op05_cnn import labelled_sample

SAMPLE, STEPS, VOCABULARY, RATE, DECAY = 5000, 200, 50_000, 0.15, 3e-5
THRESHOLD = 0.7
#: Sentences below this score are clean.
LEAST = 0.25
PREFIXES = (4, 5, 6)
#: Where training starts: a sentence with one neutral word at 1 in 400, a leak of 1 in 100.
FIRST_BIAS, FIRST_LEAK = -6.0, -4.6
#: Bytes: A-Z to lower case; all ASCII but letters, digits and sentence ends to spaces; sentence ends to new lines.
_CLEAN = bytes(b"\n"[0] if chr(c) in ".!?\n" else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence that has any; sentences end at ``. ! ?`` and line ends."""
    clean = (text or "").encode("utf-8", "surrogatepass").lower().translate(_CLEAN)
    return [w for s in clean.split(b"\n") if (w := s.split())]


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings (with a mark that no word holds)."""
    return [word, *(b"^" + word[:n] for n in PREFIXES if len(word) >= n)]


class _Weights(dict):
    """Memo of the summed weights of a word's features; cleared when full."""

    def __init__(self, known: dict[bytes, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        value = self[word] = sum(self.known.get(f, 0.0) for f in features(word))
        return value


class Mil:
    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias, self.memo = weights, bias, _Weights(weights)

    def __reduce__(self):
        return Mil, (self.weights, self.bias)

    def sentence_scores(self, text: str | None) -> np.ndarray:
        get = self.memo.__getitem__
        z = np.array([sum(map(get, set(s))) for s in sentences(text)])
        p = 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))
        return np.where((z > 0) & (p >= LEAST), p, 0.0)

    def score(self, text: str | None) -> float:
        return noisy_or(self.sentence_scores(text))


def noisy_or(p: np.ndarray) -> float:
    return float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def train(texts: list[str | None], labels: np.ndarray, steps: int = STEPS) -> Mil:
    """Adam over the whole sample, on words whose documents are toxic more often than chance allows (a G test that holds
    over the whole vocabulary; the VOCABULARY strongest). Without that, few documents are learnt by heart."""
    known: dict[bytes, list[bytes]] = {}
    spread: dict[bytes, list[int]] = {}
    for text, y in zip(texts, labels, strict=True):
        words = {w for s in sentences(text) for w in s}
        for f in {f for w in words for f in (known.get(w) or known.setdefault(w, features(w)))}:
            spread.setdefault(f, [0, 0])[int(y)] += 1
    rate = (labels.sum() + 1) / (len(labels) + 2)
    least = 2 * np.log(max(len(spread), 1)) + 6

    def strength(w: bytes) -> float:
        clean, toxic = spread[w]
        n = clean + toxic
        if toxic <= n * rate:
            return 0.0
        return 2 * (toxic * np.log(toxic / n / rate) + (clean * np.log(clean / n / (1 - rate)) if clean else 0.0))

    strong = {w: x for w in spread if (x := strength(w)) >= least}
    words = sorted(strong, key=lambda w: (-strong[w], w))[:VOCABULARY]
    place = {w: k for k, w in enumerate(words)}
    if not place or labels.min() == labels.max():
        return Mil({}, FIRST_BIAS)
    found = {w: ids for w, fs in known.items() if (ids := [k for f in fs if (k := place.get(f)) is not None])}
    del known, spread
    doc, sizes, columns = array("i"), array("i"), array("i")
    for i, text in enumerate(texts):
        for sentence in sentences(text):
            if ids := sorted({k for w in set(sentence) for k in found.get(w, ())}):
                columns.extend(ids)
                sizes.append(len(ids))
                doc.append(i)
    doc, sizes, columns = (np.frombuffer(x, np.int32) for x in (doc, sizes, columns))
    at = len(doc)
    rows = np.repeat(np.arange(at, dtype=np.int32), sizes)
    w = np.zeros(len(place) + 2)  # then the bias, and the leak as log(exp(-log(1 - leak)) - 1)
    w[-2:] = FIRST_BIAS, FIRST_LEAK
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=w[columns], minlength=at) + w[-2]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts)) - np.log1p(np.exp(w[-1])))
        some = np.clip(1 - none, 1e-9, 1)
        each = np.where(labels == 1, -none / some, 1.0) / len(texts)
        d = each[doc] * p
        g = np.concatenate((np.bincount(columns, weights=d[rows], minlength=len(place)), [d.sum(), each.sum() / (1 + np.exp(-w[-1]))]))
        g[:-2] += DECAY * w[:-2]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return Mil({word: float(x) for word, x in zip(words, w, strict=False) if abs(x) > 1e-6}, float(w[-2]))


def _fit(batches: Iterator[pa.RecordBatch], steps: int) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["doc_id"], r["label"], r["text"] or "") for b in batches for r in b.to_pylist())
    model = train([t for _, _, t in rows], np.array([y for _, y, _ in rows], float), steps)
    items = [(None, model.bias), *sorted(model.weights.items())]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], pa.binary()), pa.array([x for _, x in items], pa.float64())], ["word", "weight"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Mil:
    """Learns from labelled rows whose crc32(doc_id as text) mod 3 is not 1; the model has VOCABULARY words at most."""
    rows = labelled_sample(docs, labels, "toxic", 3, 1, sample).repartition(1).mapInArrow(functools.partial(_fit, steps=steps), "word binary, weight double").collect()
    weights = {bytes(r.word): r.weight for r in rows if r.word is not None}
    return Mil(weights, next((r.weight for r in rows if r.word is None), FIRST_BIAS))


def _score(batches: Iterator[pa.RecordBatch], model: Mil, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        scores, places, worst = [], [], []
        for t in batch.column("text"):
            p = model.sentence_scores(t.as_py())
            scores.append(noisy_or(p))
            places.append(np.flatnonzero(p).astype(np.int32))
            worst.append(float(p.max()) if len(p) else None)
        added = [pa.array(scores, pa.float64()), pa.array(places, pa.list_(pa.int32())), pa.array(worst, pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])


def scored(docs: DataFrame, model: Mil) -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` and three more, with their names: the score, the sentences that offend (counted from 0),
    the highest sentence score."""
    from pyspark.sql import types as T

    names = fresh(docs, "tox_score", "tox_sentences", "tox_worst")
    kinds = [T.DoubleType(), T.ArrayType(T.IntegerType()), T.DoubleType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    return docs.mapInArrow(functools.partial(_score, model=model, names=names), schema), names


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``doc_id, text`` and ``doc_id, toxic`` -> ``doc_id, held_out, score, predicted, offending``, one row per document row.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out; ``offending`` lists the sentences that score LEAST or more,
    of which a document predicted as toxic has one at least. A text without words (null, empty) scores 0, and so does
    every text without labels of both kinds. Null ids are
    scored; repeated rows get the same score.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out, (score, places, _) = scored(docs, fit(docs, labels, **options))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= threshold).cast("int").alias("predicted"), F.col(places).alias("offending"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    out, (score, _, _) = scored(docs, fit(docs, labels, **options))
    return out.where(F.col(score) < threshold).select(*docs.columns)
