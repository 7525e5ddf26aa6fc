"""Quality classifier: a byte-level convolutional network in numpy, max-pooled over overlapping chunks of the whole text.

Input of a position: its byte and the WIDTH - 1 bytes after it, and one repeat channel that is on where the next eight
bytes equal those some 2 to LAGS bytes before (what a filter of bytes cannot compare; its weight in each filter is learned
like the others). FILTERS learned filters are rectified, averaged over chunks of CHUNK
positions that overlap by half and cover the text, max-pooled over the chunks, and combined by a logistic unit.
The gradient of a document goes through one chunk a filter, so training is cheap; it sees SAMPLE labelled rows at most,
chosen by a hash of their id.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, portions

WIDTH, FILTERS, CHUNK, LAGS = 3, 8, 64, 32
SAMPLE, EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 3000, 5, 300, 32, 0.02, 11
THRESHOLD = 0.3
#: Bytes that go through the network at once.
AT_ONCE = 1_000_000
HALF = CHUNK // 2


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with each text padded to whole half chunks (an empty one too) and two more, so that no filter sees two texts;
    the first half chunk of each text, its length."""
    lengths = np.array([len(t) for t in texts], np.int64)
    halves = np.maximum(-(-lengths // HALF), 1) + 2
    starts = np.concatenate(([0], np.cumsum(halves)))
    data = np.zeros(starts[-1] * HALF + WIDTH + 8, np.uint8)
    for t, at in zip(texts, starts, strict=False):
        data[at * HALF : at * HALF + len(t)] = np.frombuffer(t, np.uint8)
    return data, starts, lengths


def repeats(data: np.ndarray, n: int) -> np.ndarray:
    """1 where the eight bytes from a position equal those 2..LAGS bytes before; padding never counts."""
    code = np.zeros(n, np.uint64)
    for j in range(8):
        code |= data[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    on = np.zeros(n, bool)
    for lag in range(2, LAGS + 1):
        on[lag:] |= code[lag:] == code[:-lag]
    return (on & (data[:n] > 0)).astype(np.float32)


class Network:
    def __init__(self, tables: np.ndarray, repeat: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float):
        self.tables, self.repeat, self.bias, self.weights, self.offset = tables, repeat, bias, weights, offset

    @classmethod
    def first(cls, filters: int, rate: float, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        sign = np.where(np.arange(filters) % 2, -1, 1)
        return cls(rng.normal(0, 0.3, (WIDTH, 256, filters)).astype(np.float32), rng.normal(0, 0.5, filters).astype(np.float32), np.zeros(filters, np.float32), (sign * 0.5).astype(np.float32), float(np.log(rate / (1 - rate))))

    def pooled(self, texts: list[bytes]) -> tuple:
        """Max over chunks of each filter's mean, the chunk it came from, and what a gradient needs."""
        data, starts, lengths = laid_out(texts)
        n = starts[-1] * HALF
        on = repeats(data, n)
        out = on[:, None] * self.repeat
        out += self.bias
        for j in range(WIDTH):
            out += self.tables[j].take(data[j : j + n], axis=0)
        np.maximum(out, 0, out=out)
        sizes = np.full(starts[-1], HALF, np.int64)
        real = np.maximum(lengths, 1)
        last = starts[1:] - 3  # of a text's own half chunks
        sizes[last] = real - (np.diff(starts) - 3) * HALF
        tails = np.flatnonzero(sizes < HALF)
        for k in tails:
            out[k * HALF + sizes[k] : (k + 1) * HALF] = 0
        sums = out.reshape(-1, HALF, out.shape[1]).sum(1)
        inner = np.ones(starts[-1], bool)
        inner[last] = inner[last + 1] = inner[last + 2] = False  # a text's last half chunk stands alone only if it is the first
        both, count = sums.copy(), sizes.copy()
        at = np.flatnonzero(inner)
        both[at] += sums[at + 1]
        count[at] += sizes[at + 1]
        mean = both / count[:, None]
        mean[last[np.diff(starts) > 3]] = -1  # covered by the chunk before
        mean[last + 1] = mean[last + 2] = -1  # padding
        best = np.maximum.reduceat(mean, starts[:-1], axis=0)
        return best, mean, count, starts, data, on, out, inner

    def pooled_long(self, text: bytes, at_once: int) -> np.ndarray:
        """What ``pooled`` gives for one text, worked out ``at_once`` bytes at a time: each piece has the half chunk before
        it and a little after it in sight, so that no chunk's mean differs."""
        halves, per, best = max(-(-len(text) // HALF), 1), max(at_once // HALF, 1), None
        for first in range(0, max(halves - 1, 1), per):
            last = min(first + per, max(halves - 1, 1))  # chunks first to last - 1
            begin, low, end = first * HALF, max(first - 1, 0) * HALF, min(len(text), (last + 1) * HALF)
            seen = text[low : end + WIDTH + 8]
            data = np.zeros(end - low + WIDTH + 8, np.uint8)
            data[: len(seen)] = np.frombuffer(seen, np.uint8)
            n = end - low
            out = repeats(data, n)[:, None] * self.repeat + self.bias
            for j in range(WIDTH):
                out += self.tables[j].take(data[j : j + n], axis=0)
            out = np.maximum(out, 0)[begin - low :]
            starts = np.arange(0, max(len(out), 1), HALF)
            sums = np.add.reduceat(out, starts, axis=0) if len(out) else np.zeros((1, len(self.bias)), np.float32)
            sizes = np.diff(np.append(starts, max(len(out), 1)))
            mean = (sums[:-1] + sums[1:]) / (sizes[:-1] + sizes[1:])[:, None] if len(sums) > 1 else sums / sizes[:, None]
            best = mean.max(0) if best is None else np.maximum(best, mean.max(0))
        return best

    def scores(self, texts: list[bytes], at_once: int = AT_ONCE) -> np.ndarray:
        short = [t for t in texts if len(t) <= at_once]
        best = np.empty((len(texts), len(self.bias)), np.float32)
        if short:
            best[[len(t) <= at_once for t in texts]] = self.pooled(short)[0]
        for i, t in enumerate(texts):
            if len(t) > at_once:
                best[i] = self.pooled_long(t, at_once)
        z = best.astype(np.float64) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, texts: list[bytes], target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        best, mean, count, starts, data, on, out, inner = self.pooled(texts)
        p = 1 / (1 + np.exp(-np.clip(best @ self.weights + self.offset, -40, 40)))
        d = ((p - target) * weight / len(texts)).astype(np.float32)
        tables, repeat, bias = np.zeros_like(self.tables), np.zeros_like(self.repeat), np.zeros_like(self.bias)
        for i in range(len(texts)):
            chunk = starts[i] + mean[starts[i] : starts[i + 1]].argmax(0)
            for f, c in enumerate(chunk):
                end = (c + 1 + inner[c]) * HALF
                at = np.arange(c * HALF, end)
                at = at[out[at, f] > 0]
                g = d[i] * self.weights[f] / count[c]
                repeat[f] += g * on[at].sum()
                bias[f] += g * len(at)
                for j in range(WIDTH):
                    tables[j, :, f] += g * np.bincount(data[at + j], minlength=256)
        return [tables, repeat, bias, best.T @ d, np.array(d.sum())]

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.repeat, self.bias, self.weights, np.array(self.offset)]


def train(texts: list[bytes], labels: np.ndarray, filters: int = FILTERS, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the logistic loss; both labels weigh alike in a batch's gradient up to a factor of four."""
    if not len(texts) or labels.min() == labels.max():
        rate = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
        net = Network.first(filters, rate, seed)
        net.weights = np.zeros_like(net.weights)
        return net
    rate = labels.mean()
    net = Network.first(filters, rate, seed)
    rng = np.random.default_rng(seed)
    weight = np.where(labels == (rate < 0.5), min(4.0, max(rate, 1 - rate) / min(rate, 1 - rate)), 1.0)
    moments = [(np.zeros_like(x, dtype=np.float64), np.zeros_like(x, dtype=np.float64)) for x in net.parameters()]
    step = 0
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            step += 1
            new = []
            for x, g, (m, v) in zip(net.parameters(), net.gradients([texts[i] for i in part], labels[part], weight[part]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                new.append((x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
            net = Network(*new[:4], float(new[4]))
    return net


def _fit(batches: Iterator[pa.RecordBatch], epochs: int) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["doc_id"], r["label"], r["text"] or "") for b in batches for r in b.to_pylist())
    net = train([t.encode("utf-8", "surrogatepass") for _, _, t in rows], np.array([y for _, y, _ in rows], float), epochs=epochs)
    yield pa.RecordBatch.from_pylist([{"part": k, "numbers": x.ravel().tolist()} for k, x in enumerate(net.parameters())], schema=pa.schema([("part", pa.int32()), ("numbers", pa.list_(pa.float64()))]))


def _score(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]
        scores, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                size += len(texts[end])
                end += 1
            scores.append(net.scores(texts[at:end]))
            at = end
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(scores) if scores else np.empty(0))], ["doc_id", "held_out", "score"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``most`` labelled rows outside the held-out fold, by a hash of the id; several labels of one id: the largest."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id"), modulus) != held)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = materialize(ids, "sample")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """``doc_id, text`` and ``doc_id, quality`` -> ``doc_id, held_out, score, predicted``, one row per document row.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out; only the text's bytes are input. Null and empty texts are
    scored as one chunk of padding. Without labels of both kinds every score is the smoothed share of label 1. Null ids are
    scored; repeated rows each get the same score.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = labelled_sample(docs, labels, "quality", 5, 0, sample).repartition(1).mapInArrow(functools.partial(_fit, epochs=epochs), "part int, numbers array<double>").collect()
    parts = {r.part: np.array(r.numbers) for r in rows}
    net = Network.first(FILTERS, 0.5, SEED)
    if parts:
        net = Network(*(parts[k].astype(np.float32).reshape(x.shape) for k, x in enumerate(net.parameters()[:4])), float(parts[4][0]))
    scored = docs.withColumn("held_out", fold(F.col("doc_id"), 5) == 0).mapInArrow(functools.partial(_score, net=net), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
