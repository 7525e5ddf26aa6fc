"""Best-fit packing: large pieces pair by greedy matching, small pieces best-fit the gaps, planned on the length histogram.

A plan needs only how many pieces of each length there are, so the driver sees at most CAPACITY numbers whatever the
input. It matches, fills and records runs of equal bins; a run gives ranks of a length to bins and offsets. Pieces then
take their rank within their length (counted per salted share of a length, so that a length that many pieces have is
not one task's work) and look their place up in the plan.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, portions

CAPACITY, END, TOKENIZER = 1024, 2, "byte_bpe_50k.json"
#: Pieces of one length that one task ranks; a length that more have is split by salts.
RANKED = 50_000
#: Bytes of (length, salt) offsets that may be sent to every task.
BROADCAST_BYTES = 16_000_000
CACHE = 400_000
#: Fixed value: how the customary byte-level pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = re.compile(r"\s\s")
_STATE: dict = {}


class Encoder:
    """Ids by the tokenizer, remembered per stretch between single spaces, where the customary cut always cuts.

    Texts with white space next to white space, where it may not, and with special tokens are encoded whole. Where
    ``same_as_ranks`` has proved that the file's vocabulary in rank order gives the same ids, new stretches are encoded
    many at once by it, split by line ends; else each is encoded by the tokenizer itself, and so is any text if the file
    does not even cut in the customary way.
    """

    def __init__(self, path: str, proved: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.fast = _by_ranks(_file(path)) if proved else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
        plain = [p for p in new if p[:1] == " " and "\n" not in p]
        if plain:
            ids = self.fast.encode_to_numpy("\n".join(plain)).astype("<u4")
            cuts = np.flatnonzero(ids == self.line)
            if len(cuts) == len(plain) - 1:
                raw, at = ids.tobytes(), [0, *((cuts + 1) * 4).tolist(), (len(ids) + 1) * 4]
                for k, p in enumerate(plain):
                    self.known[p] = raw[at[k] : at[k + 1] - 4]
        for p in new:
            if p not in self.known:
                self.known[p] = self._whole(p)

    @functools.cached_property
    def line(self) -> int:
        return int(self.fast.encode_to_numpy("\n")[0])

    def encode(self, text: str) -> bytes:
        if not self.fast or _SPACES.search(text) or text[:1].isspace() or text[-1:].isspace() or "\0" in text or any(t in text for t in self.special):
            return self._whole(text)
        parts = text.replace(" ", "\0 ").split("\0")
        known = self.known
        new = [p for p in set(parts) if p not in known]
        if new:
            self._learn(new if len(known) + len(new) <= CACHE else list(set(parts)))
        return b"".join(map(known.__getitem__, parts))


def _file(path: str) -> dict:
    import json

    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _bytes_of(tokens) -> dict[str, bytes]:
    """Tokens of a byte-level file as bytes; those with characters that stand for no byte are left out."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    return {t: bytes(map(byte_of.__getitem__, t)) for t in tokens if all(c in byte_of for c in t)}


def _by_ranks(file: dict):
    import tiktoken

    special = {t["content"] for t in file.get("added_tokens", [])}
    vocabulary = file["model"]["vocab"]
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={b: vocabulary[t] for t, b in _bytes_of(vocabulary.keys() - special).items()}, special_tokens={})


@functools.cache
def same_as_ranks(path: str) -> bool:
    """Whether a tokenizer file provably gives the ids that merging the lowest-ranked pair of its vocabulary gives.

    The file must be a plain byte-level BPE that cuts in the customary way, with all 256 bytes, and its merges must make
    tokens in the order of their ids. Merging by rank then differs only if two neighbours join to a token by another pair
    than the file's. Neighbours l, r that join to t came about within the bytes of t, by the same merges as when t stands
    alone; so it is enough that each token alone is put together last from the pair that the file has for it.
    """
    file = _file(path)
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    usual = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if not plain or not usual or file.get("normalizer") or file.get("truncation") or file.get("padding"):
        return False
    special = {t["content"] for t in file.get("added_tokens", [])}
    vocabulary = model["vocab"]
    as_bytes = _bytes_of(vocabulary.keys() - special)
    if len(as_bytes) != len(vocabulary.keys() - special):
        return False
    rank = {b: vocabulary[t] for t, b in as_bytes.items()}
    pairs = {}
    last = -1
    for merge in model["merges"]:
        left, right = (as_bytes.get(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
        if left is None or right is None or rank.get(left + right, -1) <= last:
            return False
        last = rank[left + right]
        pairs[left + right] = (left, right)
    if not all(bytes([b]) in rank for b in range(256)) or len(pairs) + 256 != len(rank):
        return False
    return all(_last_pair(token, rank) == pair for token, pair in pairs.items())


def _last_pair(token: bytes, rank: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging by rank joins last to the whole token; None if it never does."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        low, at = min((rank.get(parts[k] + parts[k + 1], len(rank) + 1_000_000), k) for k in range(len(parts) - 1))
        if low > len(rank) + 999_999:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, proved: bool) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = _STATE.get(path) or _STATE.setdefault(path, Encoder(path, proved))
    end = np.array([END], "<u4").tobytes()
    for batch in portions(batches):
        columns: list[list] = [[] for _ in range(5)]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = encoder.encode(text.as_py() or "") + end
            n = len(ids) // 4
            cut = n % capacity or capacity
            edges = [0, *range(cut, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                for column, value in zip(columns, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, ranks, first bin, per bin, offset)``: from ``first rank`` on, every ``per bin`` ranks of the
    length go to the next bin, one behind the other from ``offset``. Bins of ``capacity``; counts of 1..capacity.

    Lengths over a third of the capacity, largest first, each pair with the largest other one that fits; at most two of
    them share a bin. The others, largest first, each go to the bin with the least room that takes them.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[list[int]]] = {}  # room -> runs [first bin, bins, used]
    order: list[int] = []  # the rooms there are, sorted
    bins = 0

    def put(length: int, first: int, n: int, per: int, offset: int) -> None:
        out.append((length, rank[length], n * per, first, per, offset))
        rank[length] += n * per
        left[length] -= n * per

    def add(room: int, run: list[int]) -> None:
        if room:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append(run)

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        length = large[-1]
        if not left[length]:
            large.pop()
            continue
        mate = next((k for k in reversed(large) if k + length <= capacity and left[k] > (k == length)), None)
        n = left[length] if mate is None else left[length] // 2 if mate == length else min(left[length], left[mate])
        if mate is None:
            put(length, bins, n, 1, 0)
        elif mate == length:
            put(length, bins, n, 2, 0)
        else:
            put(length, bins, n, 1, 0)
            put(mate, bins, n, 1, length)
        used = length + (mate or 0)
        add(capacity - used, [bins, n, used])
        bins += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                per = capacity // length
                n = max(1, left[length] // per)
                add(capacity, [bins, n, 0])
                bins += n
                continue
            room = order[at]
            first, n, used = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            per = min(room // length, left[length])
            take = min(n, left[length] // per)
            put(length, first, take, per, used)
            add(room - per * length, [first, take, used + per * length])
            if take < n:
                add(room, [first + take, n - take, used])
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the pieces of a length. A length is split in as many salted shares of about RANKED
    pieces as it needs; their counts are gathered in a window, the pieces never."""
    known = pieces.columns
    shares = pieces.groupBy("length").agg(F.ceil(F.count("*") / RANKED).alias("shares"))  # a row a length, at most the capacity
    salted = pieces.join(F.broadcast(shares), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("shares")))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    before = materialize(before, "bases")
    small = 24 * before.count() <= BROADCAST_BYTES
    within = salted.withColumn("within", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    return within.join(F.broadcast(before) if small else before, ["length", "salt"]).select(*known, (F.col("base") + F.col("within")).alias("rank"))


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, text`` -> a row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and then END; longer ones than ``capacity`` are cut in pieces of ``capacity``, the first of
    which may be shorter. ``tokenizer`` is the path of a tokenizer file that every executor has (default: the installed
    public one). Null and empty texts are END alone. Null ids and repeated rows are packed like others. Special tokens'
    strings in a text get the tokenizer's own treatment. No documents give no rows.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = materialize(rows.mapInArrow(functools.partial(_pieces, path=tokenizer, capacity=capacity, proved=same_as_ranks(tokenizer)), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs: dict[int, list[tuple]] = {}
    for length, first, n, bin_, per, offset in plan(counts, capacity):
        runs.setdefault(length, []).append((first, n, bin_, per, offset))
    return ranked(pieces).mapInArrow(functools.partial(_place, runs=runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _place(batches: Iterator[pa.RecordBatch], runs: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
    tables = {length: np.array(sorted(x), np.int64) for length, x in runs.items()}
    for batch in batches:
        lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            mine = np.flatnonzero(lengths == length)
            table = tables[int(length)]
            run = table[np.searchsorted(table[:, 0], ranks[mine], "right") - 1]
            ahead = ranks[mine] - run[:, 0]
            sequence[mine] = run[:, 2] + ahead // run[:, 3]
            offset[mine] = run[:, 4] + ahead % run[:, 3] * length
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])
