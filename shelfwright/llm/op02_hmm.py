"""Hidden Markov language model: Baum-Welch counts summed across partitions, exact likelihood by scaled forward recursion.

The text is read once. Each task packs its documents into blocks of about BLOCK_TOKENS tokens (one row a block: token
ids within the block, the block's vocabulary and its training counts), written in the shared folder. What follows works
on blocks: global counts (pre-aggregated a block), expected counts of each Baum-Welch round (one sum a task, then one
sum a cell), and, for scores, a join of each block's vocabulary with the global counts.

The emission of a state is P(class | state) * P(word | class). The TOP most frequent training words and the end are
classes of their own; other words fall in SUFFIXES classes by their last bytes, in which a word's probability is
add-one-half smoothed over the class, with one place for unknown words. So the model is a distribution over texts in the
same sense as the unigram base. Scores run over whole texts. For training, long texts are cut every SEGMENT tokens, one
token of overlap, so that every move is counted once; a segment that is not a text's first begins with the model's
long-run distribution of states and counts neither as a start nor its overlap as an emission.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, words_of

BLOCK_TOKENS = 1_000_000
#: Tokens that Baum-Welch holds at once.
AT_ONCE = 200_000
STATES, ROUNDS, TOP, SUFFIXES, SEGMENT = 8, 5, 2000, 512, 128
SEED = 7
END = b" end "  # holds white space, so it is no word
_BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, hashes binary, counts binary, suffixes binary"


class _Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    docs: list[tuple] = []
    vocabulary = _Vocabulary({END: 0})
    held_ids: list[np.ndarray] = []
    size = 0

    def row() -> pa.RecordBatch:
        flat = np.concatenate(held_ids)
        train = np.concatenate([np.full(len(x), not d[1]) for d, x in zip(docs, held_ids, strict=True)])
        counts = np.bincount(flat[train], minlength=len(vocabulary)).astype(np.int32)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) >> 1 for w in vocabulary), np.int64, len(vocabulary))
        suffixes = np.fromiter((xxhash.xxh3_64_intdigest(w[-2:]) % SUFFIXES for w in vocabulary), np.uint16, len(vocabulary))
        order = np.argsort(-np.bincount(flat, minlength=len(vocabulary)), kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order), dtype=np.uint32)
        planes = place[flat].view(np.uint8).reshape(-1, 4).T.tobytes()  # frequent words have small ids, so most high bytes are 0
        return pa.RecordBatch.from_pylist(
            [
                {
                    "block": part << 32 | number, "doc_ids": [d[0] for d in docs], "held": [d[1] for d in docs], "lengths": [len(x) for x in held_ids], "ids": planes,
                    "hashes": hashes[order].tobytes(), "counts": counts[order].tobytes(), "suffixes": suffixes[order].tobytes(),
                }
            ],
            schema=_schema(),
        )

    for batch in batches:
        for doc_id, text, is_held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out")), strict=True):
            words = words_of(text)
            words.append(END)
            docs.append((doc_id, is_held))
            held_ids.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
            size += len(words)
            if size >= BLOCK_TOKENS:
                yield row()
                docs, held_ids, vocabulary, size, number = [], [], _Vocabulary({END: 0}), 0, number + 1
    if docs:
        yield row()


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in _BLOCK.split(","))])


def _array(row: dict, name: str, kind) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _ids(row: dict) -> np.ndarray:
    return np.ascontiguousarray(_array(row, "ids", np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n = _array(row, "counts", np.int32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_array(row, "hashes", np.int64)[n > 0]), pa.array(_array(row, "suffixes", np.uint16)[n > 0].astype(np.int32)), pa.array(n[n > 0])], ["hash", "suffix", "n"])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            hashes = _array(row, "hashes", np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), row["block"], np.int64)), pa.array(hashes)], ["block", "hash"])


def classes_of(hashes: np.ndarray, suffixes: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Class per word: its place among the (sorted) top hashes, else its suffix's."""
    at = np.minimum(np.searchsorted(top, hashes), max(len(top) - 1, 0))
    found = top[at] == hashes if len(top) else np.zeros(len(hashes), bool)
    return np.where(found, at, len(top) + suffixes.astype(np.int64))


class Model:
    """Start, transition and emission probabilities; ``emit`` is classes x states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def usual(self) -> np.ndarray:
        """The long-run distribution of states."""
        p = np.full(len(self.start), 1 / len(self.start))
        for _ in range(200):
            p = p @ self.move
        return p / p.sum()

    @classmethod
    def first(cls, weights: np.ndarray, states: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        emit = (weights + 1e-6 * weights.sum())[:, None] * np.exp(rng.normal(0, 1, (len(weights), states)))
        return cls(np.full(states, 1 / states), np.full((states, states), 0.2 / states) + 0.8 * np.eye(states), emit / emit.sum(0))

    @classmethod
    def from_counts(cls, cells: np.ndarray, states: int, prior: np.ndarray) -> Model:
        """Cells: starts, then moves, then emissions; a little of the overall distribution keeps all probabilities positive."""
        start, move, emit = cells[:states] + 0.1, cells[states : states + states**2].reshape(states, states) + 0.1, cells[states + states**2 :].reshape(-1, states) + prior[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def forward(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 likelihood of each of the sequences that stand one after another in ``symbols`` (each at least one long)."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    sizes = lengths[order]
    emit = model.emit
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    scale = np.empty(len(symbols))
    state = None
    for t, n in enumerate(alive):
        at = starts[:n] + t
        state = (model.start if state is None else state[:n] @ model.move) * emit[symbols[at]]
        total = state.sum(1)
        scale[at] = total
        state /= total[:, None]
    return np.add.reduceat(np.log10(scale), np.concatenate(([0], np.cumsum(lengths)[:-1])))


def segments(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts sequences that stand one after another: the place of each segment's tokens, the segments' lengths, and which
    are a sequence's first. Others begin with the last token of the one before."""
    n = np.maximum(-(-(lengths - 1) // (size - 1)), 1)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    whole = np.repeat(lengths, n)
    sizes = np.minimum(size, whole - number * (size - 1))
    begin = np.repeat(np.cumsum(lengths) - lengths, n) + number * (size - 1)
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), sizes, number == 0


def expected(model: Model, symbols: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Baum-Welch counts of the sequences in ``symbols``, flat: starts, moves, emissions. ``first``: see ``segments``."""
    first = np.ones(len(lengths), bool) if first is None else first
    states = len(model.start)
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    sizes = lengths[order]
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    seen = model.emit[symbols]
    ahead, scale = np.empty((len(symbols), states)), np.empty(len(symbols))
    begin = np.where(first[order][:, None], model.start, model.usual())
    state = None
    for t, n in enumerate(alive):
        at = starts[:n] + t
        state = (begin if state is None else state[:n] @ model.move) * seen[at]
        scale[at] = total = state.sum(1)
        state /= total[:, None]
        ahead[at] = state
    behind = np.ones((len(sizes), states))
    moves = np.zeros((states, states))
    for t in range(len(alive) - 2, -1, -1):
        n = alive[t + 1]  # the others end here, with a one behind them
        at = starts[:n] + t
        later = seen[at + 1] * behind[:n] / scale[at + 1][:, None]
        moves += ahead[at].T @ later
        behind[:n] = later @ model.move.T
        ahead[at] *= behind[:n]
    moves *= model.move
    begun = ahead[starts][first[order]].sum(0)
    ahead[starts[~first[order]]] = 0
    emitted = np.stack([np.bincount(symbols, weights=ahead[:, s], minlength=len(model.emit)) for s in range(states)], 1)
    return np.concatenate((begun, moves.ravel(), emitted.ravel()))


def _baum_welch(batches: Iterator[pa.RecordBatch], model: Model, top: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.to_pylist():
            lengths, held = np.array(row["lengths"]), np.array(row["held"])
            symbols = classes_of(_array(row, "hashes", np.int64), _array(row, "suffixes", np.uint16), top)[_ids(row)]
            symbols, lengths = symbols[np.repeat(~held, lengths)], lengths[~held]
            if not len(lengths):
                continue
            places, cut, begins = segments(lengths, SEGMENT)
            symbols = symbols[places]
            ends = np.cumsum(cut)
            first = 0
            while first < len(cut):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, "right")))
                counts = expected(model, symbols[ends[first] - cut[first] : ends[last - 1]], cut[first:last], begins[first:last])
                total = counts if total is None else total + counts
                first = last
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], ["cell", "n"])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(blocks: pa.Table, known: pa.Table, model: Model, top: np.ndarray, tokens: int, types: int, class_tokens: np.ndarray, class_types: np.ndarray) -> pa.Table:
    parts = []
    found, n = known.column("hash").to_numpy(), known.column("n").to_numpy()
    for row in blocks.to_pylist():
        hashes = _array(row, "hashes", np.int64)
        counts = np.zeros(len(hashes))
        order = np.argsort(hashes, kind="stable")
        counts[order[np.searchsorted(hashes, found, sorter=order)]] = n
        classes = classes_of(hashes, _array(row, "suffixes", np.uint16), top)
        ids, lengths = _ids(row), np.array(row["lengths"], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        base = np.log10((counts + 0.5) / (tokens + 0.5 * (types + 1)))
        suffix = np.maximum(classes - len(top), 0)
        within = np.where(classes < len(top), 0, np.log10((counts + 0.5) / (class_tokens[suffix] + 0.5 * (class_types[suffix] + 1))))
        score = forward(model, classes[ids], lengths) + np.add.reduceat(within[ids], starts)
        total = np.full(len(lengths), tokens, np.int64)
        arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), lengths, np.add.reduceat((counts > 0)[ids].astype(np.int64), starts), total, np.add.reduceat(base[ids], starts), score]
        parts.append(pa.table([pa.array(a) if isinstance(a, np.ndarray) else a for a in arrays], names=[x.split(" ")[0] for x in _SCORED.split(", ")]))
    return pa.concat_tables(parts)


def hmm_scores(docs: DataFrame, held_out: str | None = None, states: int = STATES, rounds: int = ROUNDS, top: int = TOP) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per input row.

    ``held_out`` names a boolean column of rows to keep out of training (default: crc32 of the id as text mod 5 is 1).
    Null and empty texts are the end token alone. Null ids are scored and trained on like others; repeated rows each
    count. Without training rows all words are unknown and the model is the untrained one. Words are told apart by a
    63-bit hash. The model (states x classes) and the ``top`` words are all that the driver sees.
    """
    import xxhash

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.col(held_out) if held_out else fold(F.col("doc_id"), 5) == 1).alias("held_out"))
    blocks = materialize(docs.mapInArrow(_blocks, _BLOCK), "blocks")
    counts = materialize(blocks.select("hashes", "counts", "suffixes").mapInArrow(_counted, "hash long, suffix int, n long").groupBy("hash", "suffix").agg(F.sum("n").alias("n")), "counts")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = xxhash.xxh3_64_intdigest(END) >> 1
    best = counts.orderBy((F.col("hash") != end), F.desc("n"), "hash").limit(top).collect()  # the end is one of them whatever its count
    best = sorted(best, key=lambda r: r.hash)
    top_hashes = np.array([r.hash for r in best], np.int64)
    weights = np.zeros(len(best) + SUFFIXES)
    weights[: len(best)] = [r.n for r in best]
    class_tokens, class_types = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_tokens[r.suffix], class_types[r.suffix] = r.n, r.v
    for r in best:
        class_tokens[r.suffix] -= r.n
        class_types[r.suffix] -= 1
    weights[len(best) :] = class_tokens + 1
    prior = 5 * weights / weights.sum()

    model = Model.first(weights, states, SEED)
    trained = blocks.select("lengths", "held", "ids", "hashes", "suffixes")
    for _ in range(rounds if tokens else 0):
        cells = np.zeros(states + states**2 + len(weights) * states)
        for r in trained.mapInArrow(functools.partial(_baum_welch, model=model, top=top_hashes), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            cells[r.cell] = r.n
        model = Model.from_counts(cells, states, prior)

    words = blocks.select("block", "hashes").mapInArrow(_vocabulary, "block long, hash long")
    known = words.join(counts.select("hash", "n"), "hash").select("block", "hash", "n")
    score = functools.partial(_scored, model=model, top=top_hashes, tokens=tokens, types=types, class_tokens=class_tokens, class_types=class_types)
    scored = blocks.drop("counts").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda x, y: score(x, y), _SCORED)
    return scored
