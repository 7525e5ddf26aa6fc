"""Benchmark decontamination: shingles that a near passage cannot lack, then exact weighted-shingle similarity at every place.

A text holds an item where its words, over the item's length, share 0.75 or more of the union of 5-word shingles, weighted
by their letters. Such a place lacks at most a quarter of the item's weight, so of any shingles that together weigh more
than a quarter it has at least one. Each item lists so many of its shingles, those that the fewest items have first (of
equals the heaviest). Every shingle of every text is looked up, and around each hit all starts that cover it are tried,
with sums kept up word by word. So nothing at the threshold is missed, wherever the edits or the cut ends lie.

SimHash fingerprints of windows, the method first meant for the candidates, cannot give that: see the README for how far
apart the fingerprints of true pairs lie.

Items are taken in blocks of ITEM_BYTES, each collected (a bounded table), held against all texts in one scan and its matches
written before the next: the driver holds one block at a time.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_HASH, discard, fresh, materialize, portions, words_of

WIDTH, PERCENT = 5, 75
ITEM_BYTES, AT_ONCE = 8_000_000, 20_000


def weighted(words: list[bytes]) -> dict[bytes, int]:
    """Distinct 5-word shingles (fewer words: the whole) and their letters."""
    n = min(WIDTH, len(words))
    return {s: len(s) for i in range(len(words) - n + 1) if n and (s := b" ".join(words[i : i + n]))}


def similarity(x: dict[bytes, int], y: dict[bytes, int]) -> float:
    both = sum(v for k, v in x.items() if k in y)
    union = sum(x.values()) + sum(y.values()) - both
    return both / union if union else 0.0


def _shingled(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and letters (as in ``weighted``) of the shingles of exactly ``width`` words, by their first word."""
    n = max(len(words) - width + 1, 0)
    ids = np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
    out = np.full(n, width, np.uint64)
    for j in range(width if n else 0):
        out = (out ^ ids[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out, ends[width : width + n] - ends[:n] + width - 1


def build(items: list[list[bytes]]) -> tuple[list[dict[int, int]], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Each item's shingles with their letters; by shingle width the listed ones, sorted, and the items that list them."""
    shingles = [dict(zip(*(x.tolist() for x in _shingled(w, min(WIDTH, len(w)))), strict=True)) if w else {} for w in items]
    held = Counter(h for s in shingles for h in s)
    rows: dict[int, list[tuple[int, int]]] = {}
    for k, own in enumerate(shingles):
        left = sum(own.values()) * (100 - PERCENT)
        for h in sorted(own, key=lambda h: (held[h], -own[h], h)):
            rows.setdefault(min(WIDTH, len(items[k])), []).append((h, k))
            left -= 100 * own[h]
            if left < 0:
                break
    return shingles, {n: (np.array([h for h, _ in v], np.uint64), np.array([k for _, k in v])) for n, v in ((n, sorted(v)) for n, v in rows.items())}


def best_place(hashes: list[int], letters: list[int], own: dict[int, int], length: int, width: int, starts: list[tuple[int, int]]) -> tuple[int, int] | None:
    """(start, end) in words of the first most similar place of a text among the ranges of starts, where it reaches PERCENT."""
    whole, top, found = sum(own.values()), (PERCENT, 100), None
    for low, high in starts:
        seen: dict[int, int] = {}
        both = total = a = b = 0  # shingles a to b - 1 are in the window
        for start in range(low, high + 1):
            to, end = max(start, 0), min(start + length - width + 1, len(hashes))
            while b < end or a < to:
                grow = b < end
                at = b if grow else a
                h, n = hashes[at], letters[at]
                if grow:
                    b += 1
                    seen[h] = seen.get(h, 0) + 1
                    change = n if seen[h] == 1 else 0
                elif at < b:
                    a += 1
                    seen[h] -= 1
                    change = 0 if seen[h] else -n
                total += change
                both += change if h in own else 0
            union = total + whole - both
            if both * top[1] > top[0] * union or found is None and both * top[1] == top[0] * union:
                top, found = (both, union), (to, end + width - 1)
    return found


def _matches(batches: Iterator[pa.RecordBatch], items: list[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
    shingles, index = build([w for _, w in items])
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])
    for batch in portions(batches):
        out: list[dict] = []
        texts = [words_of(t.as_py()) for t in batch.column("text")]
        ids = batch.column("doc_id").to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                size += len(texts[end])
                end += 1
            out += _search(texts[at:end], ids[at:end], items, shingles, index)
            at = end
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _search(texts: list[list[bytes]], ids: list, items: list, shingles: list, index: dict) -> list[dict]:
    lengths = np.array([len(t) for t in texts])
    first = np.concatenate(([0], np.cumsum(lengths)))
    words = [w for t in texts for w in t]
    out = []
    for width, (known, holders) in index.items():
        hashes, letters = _shingled(words, width)
        low, high = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
        ranges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for at in np.flatnonzero(high > low).tolist():
            doc = int(np.searchsorted(first, at, "right")) - 1
            at_word = at - int(first[doc])
            if at_word + width > lengths[doc]:
                continue  # it crosses into the next text
            for k in holders[low[at] : high[at]].tolist():
                spans, begin = ranges.setdefault((doc, k), []), at_word - len(items[k][1]) + width
                if spans and begin <= spans[-1][1] + 1:
                    spans[-1] = (spans[-1][0], at_word)
                else:
                    spans.append((begin, at_word))
        for (doc, k), spans in ranges.items():
            item_id, item = items[k]
            here = slice(int(first[doc]), int(first[doc + 1]) - width + 1)
            place = best_place(hashes[here].tolist(), letters[here].tolist(), shingles[k], len(item), width, spans)
            if place is not None:
                part = texts[doc][place[0] : place[1]]
                out.append({"doc_id": ids[doc], "item_id": item_id, "start": place[0], "n_words": len(part), "similarity": similarity(weighted(part), weighted(item))})
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text`` and ``item_id, text`` -> ``doc_id, item_id, start, n_words, similarity``: a row for each document row and item that it holds.

    Words are split at ASCII white space after A-Z became a-z. ``start`` is the first word of the most similar place (the
    first of equals), ``n_words`` its length. Null and empty texts hold nothing and are held by nothing; items of one text
    match alike; a repeated document row matches again. Null ids pass through. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("length(trim(text)) > 0")
    blocks = max(1, -(-items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0] // ITEM_BYTES))
    if blocks > 1:
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    out = None
    for b in range(blocks):
        part = items.where(F.col("block") == b) if blocks > 1 else items
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x))
        found = docs.mapInArrow(functools.partial(_matches, items=[(k, words_of(t)) for k, t in rows]), "doc_id long, item_id long, start long, n_words long, similarity double")
        found = materialize(found, "matches") if blocks > 1 else found  # before the next block is taken up
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        discard(items)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item. Rows without an id stay unless their text is found under no id."""
    (row,) = fresh(docs, "text_row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    held = materialize(contaminations(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(row)).distinct(), "held")
    return keyed.join(held, row, "left_anti").select(*docs.columns)
