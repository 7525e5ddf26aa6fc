"""Concatenate and cut: all documents one behind the other, cut at fixed windows, by prefix sums over partition totals.

The first pass writes each document's ids with the number of its partition and how many ids lie before it there. Totals of
partitions, a number each, give every partition's place among all ids: sums of blocks of partitions first, then sums within
a block. The second pass knows each document's place among all ids from these and cuts it at the windows it crosses; a piece
that another one of its document follows in the next window is a boundary record. Only totals are shuffled. What is left
after the last full window is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PORTION, materialize, portions
from .op09_packing import _bytes_of, _file, _last_pair
from .vectors import BROADCAST_BYTES

CAPACITY, END, TOKENIZER = 4096, 2, "word_bpe_49k.json"
#: Partitions whose totals are summed in one window.
BLOCK = 4_096
CACHE = 400_000
#: The suffix of a word's last token, the normalizers, and how the customary lower-case vocabulary cuts a text.
SUFFIX = "</w>"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII, and the letters of western Latin alphabets, which are composed already and have a one-letter lower case among
#: them. Words of texts made of these are cut by Arrow as the tokenizer cuts them: blanks are put around what is no letter.
_LETTER = "a-z\xdf-\xf6\xf8-įı-ſ"
_PLAIN = "^[\t\n\r !-~\xc0-\xd6\xd8-įı-ſ]*$"
_ODD = rf"('(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{_LETTER}]+)"
_STATE: dict = {}


class Encoder:
    """Ids by the tokenizer, remembered per word.

    Where ``same_as_ranks`` has proved that the file cuts and merges in the customary way, texts of plain characters are cut
    into words by Arrow's kernels, many texts at once, and new words encoded together; other texts are cut at blanks,
    which no token spans, and their stretches encoded by the tokenizer. Texts with a special token's string, and all texts
    of another file, are encoded by it whole.
    """

    def __init__(self, path: str, proved: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast, self.ends = _by_ranks(_file(path)) if proved else (None, None)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """New plain words: each ends with an id of a last token, which is where the ids are cut again."""
        ids = self.fast.encode_to_numpy("\0".join(words) + "\0").astype("<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            for w in words:
                self.known[w] = self._whole(w)
            return
        raw, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
        for k, w in enumerate(words):
            self.known[w] = raw[at[k] : at[k + 1]]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, one text behind the other, and where each text begins among them."""
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _ODD, r" \1 "))
        words = parts.flatten().dictionary_encode()
        listed = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
        distinct = pc.binary_join(listed, "\0")[0].as_py().split("\0")  # at once; a blank at either end gives the word ""
        known = self.known
        known[""] = b""
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > CACHE:
            known.clear()
            known[""] = b""
            new = [w for w in distinct if w]
        if new:
            self._learn(new)
        found = list(map(known.__getitem__, distinct))
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        code = words.indices.to_numpy()
        size = sizes[code]
        ends = np.cumsum(size)
        places = np.repeat(starts[code] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        edges = np.r_[0, ends][parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return ids[places], edges

    def _other(self, text: str) -> np.ndarray:
        if not self.fast or any(t in text for t in self.special):
            return np.frombuffer(self._whole(text), "<u4")
        parts = text.replace("\n", " ").split(" ")
        for part in parts:
            if part not in self.known:
                if len(self.known) >= CACHE:
                    self.known.clear()
                    return np.frombuffer(b"".join(map(self._whole, parts)), "<u4")
                self.known[part] = self._whole(part)
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")

    def encode(self, texts: pa.Array, cut: bool = True) -> list[np.ndarray]:
        """The ids of each text; nulls are empty. A text much longer than a portion is taken in stretches between blanks."""
        texts = pc.fill_null(texts, "")
        if not self.fast:
            return [self._other(t) for t in texts.to_pylist()]
        special = functools.reduce(pc.or_, [pc.match_substring(texts, t) for t in self.special], pa.array([False] * len(texts)))
        if cut and len(texts) == 1 and pc.binary_length(texts)[0].as_py() > 2 * PORTION and not special[0].as_py():
            return [np.concatenate([ids for part in _stretches(texts[0].as_py()) for ids in self.encode(pa.array([part]), cut=False)])]
        plain = pc.and_(pc.match_substring_regex(texts, _PLAIN), pc.invert(special))
        ids, edges = self._plain(texts.filter(plain))
        of, out = 0, []
        for is_plain, text in zip(plain.to_pylist(), texts, strict=True):
            if is_plain:
                out.append(ids[edges[of] : edges[of + 1]])
                of += 1
            else:
                out.append(self._other(text.as_py()))
        return out


def _stretches(text: str) -> Iterator[str]:
    """The text in parts of about a portion, cut at blanks; a stretch without blanks stays whole."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + PORTION)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def _ranks(file: dict) -> tuple[dict[bytes, int], dict[str, bytes]]:
    """Ranks of the vocabulary's tokens as bytes, a last token's suffix as the byte 0."""
    special = {t["content"] for t in file.get("added_tokens", [])}
    vocabulary = {t: n for t, n in file["model"]["vocab"].items() if t not in special}
    stem = _bytes_of({t.removesuffix(SUFFIX) for t in vocabulary})
    as_bytes = {t: stem[x] + b"\0" * t.endswith(SUFFIX) for t in vocabulary if (x := t.removesuffix(SUFFIX)) in stem}
    return {b: vocabulary[t] for t, b in as_bytes.items()}, as_bytes


def _by_ranks(file: dict):
    import tiktoken

    rank, _ = _ranks(file)
    ends = np.zeros(max(rank.values()) + 1, bool)
    ends[[n for b, n in rank.items() if len(b) > 1 and b.endswith(b"\0")]] = True
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=rank, special_tokens={}), ends


@functools.cache
def same_as_ranks(path: str) -> bool:
    """Whether a tokenizer file provably gives the ids that merging the lowest-ranked pair gives, word by word.

    The file must normalize and cut in the customary way, be a plain byte-level BPE whose last tokens carry the suffix, and
    make tokens in the order of their ids. With the suffix as a byte of its own, which no token has elsewhere, joining it to
    a word's last byte ranks below all merges and so comes first. From there on, as without a suffix, it is enough that
    each token alone is put together last from the pair that the file has for it.
    """
    file = _file(path)
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
    suffix = model.get("end_of_word_suffix") == SUFFIX and not any(file.get(k) for k in ("truncation", "padding"))
    steps = cut.get("pretokenizers") or [{}, {}]
    split = steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": PATTERN} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    byte = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and steps[1].get("use_regex") is False
    if not (plain and suffix and split and byte) or (file.get("normalizer") or {}).get("normalizers") != NORMALIZER:
        return False
    rank, as_bytes = _ranks(file)
    special = {t["content"] for t in file.get("added_tokens", [])}
    single = [bytes([b]) for b in range(256)]
    if len(as_bytes) != len(model["vocab"].keys() - special) or len(rank) != len(as_bytes) or not all(b in rank and b + b"\0" in rank for b in single):
        return False
    if any(b"\0" in b[:-1] for b in rank if len(b) > 1 and b != b"\0\0"):
        return False
    last = max(rank[b + b"\0"] for b in single)
    pairs = {}
    for merge in model["merges"]:
        left, right = (as_bytes.get(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
        if left is None or right is None or left.endswith(b"\0") or rank.get(left + right, -1) <= last:
            return False
        last = rank[left + right]
        pairs[left + right] = (left, right)
    return len(pairs) + 512 == len(rank) and all(_last_pair(token, rank) == pair for token, pair in pairs.items())


def _encoded(batches: Iterator[pa.RecordBatch], path: str, proved: bool) -> Iterator[pa.RecordBatch]:
    """``doc_id, ids`` (two bytes each where all fit, as ``wide`` tells) ``, n, part, before``."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = _STATE.get(path) or _STATE.setdefault(path, Encoder(path, proved))
    part, before = TaskContext.get().partitionId(), 0
    end = np.array([END], "<u4")
    for batch in portions(batches):
        found = [np.append(ids, end) for ids in encoder.encode(batch.column("text"))]
        n = np.array([len(x) for x in found], np.int64)
        wide = [bool(x.max() > 0xFFFF) for x in found]
        ids = pa.array([x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(found, wide, strict=True)], pa.binary())
        at = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(wide), pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(at)], ["doc_id", "ids", "wide", "n", "part", "before"])


def windows(total: int, capacity: int) -> tuple[int, list[int]]:
    """How many full windows there are, and where the sequences after them begin: the rest in powers of two, largest first."""
    full, rest = divmod(total, capacity)
    starts, at = [], full * capacity
    while rest:
        size = 1 << (rest.bit_length() - 1)
        starts.append(at)
        at, rest = at + size, rest - size
    return full, starts


def _cut(batches: Iterator[pa.RecordBatch], capacity: int, full: int, tail: list[int], total: int) -> Iterator[pa.RecordBatch]:
    edges = [*tail, total]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"]
    for batch in portions(batches, "ids"):
        columns: list[list] = [[] for _ in names]
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("wide").to_pylist(), batch.column("n").to_pylist(), batch.column("place").to_pylist(), strict=True)
        for doc_id, ids, wide, n, place in rows:
            raw = ids.as_py() if wide else np.frombuffer(ids.as_py(), "<u2").astype("<u4").tobytes()
            done = 0
            while done < n:
                at = place + done
                sequence = at // capacity
                if sequence < full:
                    begin, end = sequence * capacity, (sequence + 1) * capacity
                else:
                    k = int(np.searchsorted(tail, at, "right"))
                    sequence, begin, end = full + k - 1, edges[k - 1], edges[k]
                length = min(n - done, end - at)
                row = (doc_id, done, length, zlib.crc32(raw[4 * done : 4 * (done + length)]), n, sequence, at - begin, done + length < n)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                done += length
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def bases(pieces: DataFrame) -> tuple[DataFrame, int]:
    """``part, base`` (ids before the partition) and the number of all ids."""
    totals = pieces.groupBy("part").agg(F.sum("n").alias("total")).withColumn("block", F.floor(F.col("part") / BLOCK))
    totals = materialize(totals, "totals")
    blocks = sorted((r.block, r.total) for r in totals.groupBy("block").agg(F.sum("total").alias("total")).collect())  # one for BLOCK partitions
    ends = np.cumsum([0, *(n for _, n in blocks)]).tolist()
    first = pieces.sparkSession.createDataFrame([(b, at) for (b, _), at in zip(blocks, ends, strict=False)], "block long, first long")
    within = F.sum("total").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
    placed = totals.withColumn("within", within).join(F.broadcast(first), "block").select("part", (F.col("first") + F.col("within")).alias("base"))
    return placed, ends[-1]


def concatenated(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, text`` -> a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, boundary``.

    A document is its ids and then END; documents lie one behind the other in the order of the table's partitions, and each
    window of ``capacity`` ids is a sequence. ``boundary`` marks a piece that its document's next one follows at the start
    of the next sequence. ``tokenizer`` is the path of a tokenizer file that every executor has (default: the installed
    public one). Null and empty texts are END alone. Null ids and repeated rows are packed like others. Special tokens'
    strings in a text get the tokenizer's own treatment. No documents give no rows. Pieces, once written, no longer
    depend on how the table is read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    encoded = rows.mapInArrow(functools.partial(_encoded, path=tokenizer, proved=same_as_ranks(tokenizer)), "doc_id long, ids binary, wide boolean, n long, part long, before long")
    encoded = materialize(encoded, "encoded")
    base, total = bases(encoded)
    small = 16 * base.count() <= BROADCAST_BYTES
    placed = encoded.join(F.broadcast(base) if small else base, "part").select("doc_id", "ids", "wide", "n", (F.col("base") + F.col("before")).alias("place"))
    full, tail = windows(total, capacity)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"
    return placed.mapInArrow(functools.partial(_cut, capacity=capacity, full=full, tail=tail, total=total), schema)
