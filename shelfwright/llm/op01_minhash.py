"""MinHash near-dedup: bottom-k sketches, inverted lists of retained values, union-sketch estimates, exact Jaccard.

One 64-bit hash function orders all shingles; a document's sketch is its K smallest. Documents with one shingle set form
a class, and only classes are compared.

* Lists. Two sets at the threshold share at least ``fewest_shared`` of their retained values (a bound on the union
  sketch, six standard deviations wide), so if each class orders its retained values from the rarest on and lists all but
  the last ``fewest_shared`` - 1, the two meet in a list. Most classes have no listed value that another one has.
* Short lists (RARE classes at most): every pair of classes in different components is a candidate. Those whose union
  sketch cannot belong to a pair at the threshold are dropped; the rest are confirmed on full sets, first one partner a
  class, then pairs whose ends are still in different components.
* Long lists (large families of near copies, hot passages) come first and never give all their pairs. Their classes meet
  in lists once more, by their whole sets: each lists the rarest quarter of its shingles. A shingle at place j of n (from
  the rarest on) shows that a pair whose first common shingle it is shares n - j at most, and so how large a partner may
  be; hardly any pair of a hot list is left by that. In each list all are first held against a pivot, the class whose
  shingles are the most frequent (then against more of them, as long as that links classes); what is left in different
  components, and still possible, is verified pair by pair.

So no list is cut, and no pair within one component is enumerated. Classes that consist of hot passages in ever new
selections are the one case in which a list may give many pairs, all of which then have to be told apart.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_HASH, discard, materialize, portions, words_of
from .components import components

WIDTH = 5
PERCENT = 75
K = 96
RARE = 40
#: Pairs (16 bytes each) that may be sent to every task.
BROADCAST_PAIRS = 500_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 63-bit hashes of ``width``-word shingles; fewer words are one shingle, none are no shingle."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64)
    ids = np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))
    n = min(width, len(ids))
    out = np.full(len(ids) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out ^ ids[j : len(ids) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out >>= np.uint64(1)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))].view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _sketched(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in portions(batches):
        sizes, keys, sketches = [], [], []
        for text in batch.column("text"):
            s = shingles(text.as_py(), width)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s) if len(s) else None)
            sketches.append(s[:k].copy())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(sketches)], ["doc_id", "n_shingles", "set_key", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        sets = [shingles(t.as_py(), width) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n_shingles", "members"])


def fewest_shared(n: int, k: int, percent: int) -> int:
    """The fewest retained values that a set of ``n`` shares with any set at the threshold.

    Their union has n / p members at most; of its k smallest (all, if fewer) a share p is common to both sets up to chance.
    """
    p, union = percent / 100, max(n, 1) * 100 / percent
    all_of_it = -(-percent * max(n, 1) // 100)
    if union <= k:
        return all_of_it
    return max(1, min(all_of_it, int(p * k - 6 * sqrt(p * (1 - p) * k * (1 - k / union)))))


def _fewest_shared(n: Column, k: int, percent: int) -> Column:
    """fewest_shared as a column."""
    p = percent / 100
    all_of_it = F.ceil(n * percent / 100)
    union = n * (100 / percent)
    chance = F.floor(p * k - 6 * F.sqrt(p * (1 - p) * k * F.greatest(1 - k / union, F.lit(0.0))))
    return F.when(union <= k, all_of_it).otherwise(F.greatest(F.lit(1), F.least(all_of_it, chance)))


def may_link(x: np.ndarray, nx: int, y: np.ndarray, ny: int, k: int, percent: int) -> bool:
    """Whether union sketch and set sizes leave a pair at the threshold possible."""
    if 100 * min(nx, ny) < percent * max(nx, ny):
        return False
    union = np.union1d(x, y)
    shared = np.intersect1d(x, y, assume_unique=True)
    if nx <= k and ny <= k:
        return 100 * len(shared) >= percent * len(union)
    union = union[:k]
    p = percent / 100
    return np.searchsorted(shared, union[-1], "right") >= p * len(union) - 6 * sqrt(p * (1 - p) * len(union))


def _estimated(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [
            may_link(np.frombuffer(x.as_buffer(), np.int64), n.as_py(), np.frombuffer(y.as_buffer(), np.int64), m.as_py(), k, percent)
            for x, n, y, m in zip(*(batch.column(c) for c in ("sketch_a", "n_a", "sketch_b", "n_b")), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in portions(batches, "members"):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("members")]
        copies = [xxhash.xxh3_64_intdigest(x) >> 1 for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(copies, pa.int64()), batch.column("n_shingles"), _lists(sets)], ["node", "copy", "n", "members"])


class _Linker:
    """Confirms links between classes; ``labels`` has the component of each linked class so far."""

    def __init__(self, sets: DataFrame, k: int, percent: int):
        self.sets, self.k, self.percent = sets, k, percent
        self.labels: DataFrame | None = None

    def _labelled(self, rows: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
        if self.labels is None:
            return rows.withColumn(component, F.col(node))
        return rows.join(self.labels.select(F.col("node").alias(node), F.col("component").alias(component)), node, "left").withColumn(component, F.coalesce(component, node))

    def _apart(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose ends are in different components."""
        return materialize(self._labelled(self._labelled(pairs, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b"), name)

    def _link(self, links: DataFrame) -> None:
        """Joins the components of linked classes."""
        edges = self._labelled(self._labelled(links.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb")
        edges = materialize(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
        if not edges.isEmpty():
            step = components(edges)
            if self.labels is None:
                self.labels = step
            else:
                old = self.labels
                moved = old.join(step.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
                self.labels = materialize(moved.unionByName(step.join(old.select("node"), "node", "left_anti").select("node", "component")), "labels")
                discard(old, step)
        discard(edges)

    def _with_sets(self, pairs: DataFrame, what: dict[str, str]) -> DataFrame:
        """``pairs`` with columns of both ends' sets: ``what`` maps a name (to which _a or _b is added) to an expression."""
        a, b = (self.sets.select(F.col("node").alias(c), *[F.expr(x).alias(f"{k}_{c}") for k, x in what.items()]) for c in "ab")
        few = pairs.count() <= BROADCAST_PAIRS
        return a.join(F.broadcast(pairs) if few else pairs, "a").join(b, "b")

    def _verify(self, pairs: DataFrame) -> bool:
        """Links the pairs that full sets confirm; whether there are any."""
        if pairs.isEmpty():
            return False
        full = self._with_sets(pairs, {"set": "members"}).select("a", "b", "set_a", "set_b")
        links = materialize(full.mapInArrow(functools.partial(_confirmed, percent=self.percent), "a long, b long"), "confirmed")
        some = not links.isEmpty()
        if some:
            self._link(links)
        discard(links)
        return some

    def _verify_apart(self, pairs: DataFrame) -> None:
        """As _verify, first one partner a class, then what is in different components by then."""
        first = materialize(pairs.groupBy("a").agg(F.min("b").alias("b")), "first")
        self._verify(first)
        rest = self._apart(pairs.join(first, ["a", "b"], "left_anti"), "rest")
        self._verify(rest)
        discard(first, rest)

    def short(self, entries: DataFrame) -> None:
        """Links among ``node, value`` entries of short lists: candidates by pairs, union sketches, full sets."""
        rows = materialize(self._labelled(entries.select("node", "value")), "short")
        ends = [rows.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"), "value") for c in "ab"]
        pairs = materialize(ends[0].join(ends[1], "value").where("a > b and ca <> cb").select("a", "b").distinct(), "pairs")
        if not pairs.isEmpty():
            sketches = self._with_sets(pairs, {"n": "n_shingles", "sketch": f"substring(members, 1, {8 * self.k})"}).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
            near = materialize(sketches.mapInArrow(functools.partial(_estimated, k=self.k, percent=self.percent), "a long, b long").distinct(), "near")
            self._verify_apart(near)
            discard(near)
        discard(rows, pairs)

    def long(self, nodes: DataFrame) -> None:
        """Links among the classes of long lists, ``node``, through lists of their rarest shingles."""
        entries = self._rarest(nodes)
        pivots = 1
        while True:
            open_ = self._open(entries)
            chosen = materialize(_foremost(open_, pivots), "chosen")
            possible = "node <> pivot and component <> its and n <= its_most and its_n <= most"
            pairs = materialize(open_.join(chosen, "value").where(possible).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
            more = self._verify(pairs)
            discard(chosen, pairs)
            if not more:
                break
            discard(open_)
            pivots *= 4
        ends = [open_.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"), F.col("n").alias(f"n{c}"), F.col("most").alias(f"m{c}"), "value") for c in "ab"]
        pairs = materialize(ends[0].join(ends[1], "value").where("a > b and ca <> cb and na <= mb and nb <= ma").select("a", "b").distinct(), "pairs")
        if not pairs.isEmpty():
            self._verify_apart(pairs)
        discard(entries, open_, pairs)

    def _rarest(self, nodes: DataFrame) -> DataFrame:
        """``node, n, central, value, most``: each class in the lists of its rarest shingles, with the largest size that a
        partner can have whose first common shingle this is."""
        whole = materialize(self.sets.join(nodes, "node", "left_semi").mapInArrow(_postings, "node long, copy long, n long, members array<long>"), "whole")
        posted = whole.select("node", "copy", "n", F.explode("members").alias("value"))
        held = posted.join(posted.groupBy("value").agg(F.count("*").alias("f")).where("f > 1"), "value")
        own = held.groupBy("node", "copy", "n").agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("v"), F.sum("f").alias("central"))
        own = own.withColumn("alone", F.col("n") - F.size("v"))
        listed = F.greatest(F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1 - F.col("alone"), F.lit(0)).cast("int")
        rows = own.select("node", "n", "central", "alone", F.posexplode(F.slice("v", 1, listed)).alias("at", "e"))
        most = F.floor((F.col("n") - F.col("alone") - F.col("at")) * (100 + self.percent) / self.percent).cast("long") - F.col("n")
        out = materialize(rows.select("node", "n", "central", F.col("e.value").alias("value"), most.alias("most")), "rarest")
        discard(whole)
        return out

    def _open(self, entries: DataFrame) -> DataFrame:
        """Entries, with components, of the lists that hold two components or more, but those to which all others are too large."""
        rows = self._labelled(entries)
        lists = rows.groupBy("value").agg(F.min("n").alias("least"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("value", "least")
        return materialize(rows.join(lists, "value").where("most >= least").drop("least"), "open")


def _foremost(entries: DataFrame, n: int) -> DataFrame:
    """``value, pivot, its, its_n, its_most``: the ``n`` most central entries of each value that are in different components,
    the smaller node of equals; first per salted share of a value, so no task sees a whole list."""
    t = F.struct((-F.col("central")).alias("away"), "node", F.col("component").alias("its"), F.col("n").alias("its_n"), F.col("most").alias("its_most"))
    part = entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64))).withColumn("t", t)
    if n > 1:
        part = part.groupBy("value", "salt", "component").agg(F.min("t").alias("t")).groupBy("value", "component").agg(F.min("t").alias("t")).withColumn("salt", F.pmod(F.xxhash64("component"), F.lit(64)))
    for keys in (["value", "salt"], ["value"]):
        if n == 1:
            part = part.groupBy(*keys).agg(F.min("t").alias("t"))
        else:
            part = part.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("t")), 1, n).alias("top")).select(*keys, F.explode("top").alias("t"))
    return part.select("value", F.col("t.node").alias("pivot"), "t.its", "t.its_n", "t.its_most")


def _listed(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """``node, value, size``: each class in the lists of its rarest retained values, as many as it needs to meet any partner; lists of one class are left out."""
    posted = classes.select("node", F.explode("sketch").alias("value"))
    shared = posted.join(posted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "value")
    own = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("values"))
    # A class lists all but the last fewest_shared - 1 of its values; those that nobody shares come first and need no list.
    slack = classes.groupBy("node").agg(F.max(1 - _fewest_shared(F.col("n_shingles"), k, percent)).cast("int").alias("slack"))
    values = own.join(slack, "node").select("node", F.explode(F.slice("values", 1, F.greatest(F.size("values") + F.col("slack"), F.lit(0)))).alias("v"))
    listed = materialize(values.select("node", F.col("v.value").alias("value")), "listed")
    out = materialize(listed.join(listed.groupBy("value").agg(F.count("*").alias("size")).where("size > 1"), "value"), "lists")
    discard(listed)
    return out


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, k: int = K, rare: int = RARE) -> DataFrame:
    """``doc_id, text`` (more columns are ignored) -> one row per input row: ``doc_id, n_shingles, component_id, kept, class_id``.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; ``component_id`` is the
    smallest doc_id reachable, ``class_id`` the smallest doc_id with the same shingle set, and ``kept`` marks the row
    whose doc_id is its component's. Null and empty texts have an empty set and are linked with nothing. Rows that
    repeat a doc_id count as one document (linked if any of them is) and are each returned. Rows without a doc_id are
    returned with null ids, kept, and take no part. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    full = materialize(docs.mapInArrow(functools.partial(_sketched, width=width, k=k), "doc_id long, n_shingles long, set_key binary, sketch array<long>"), "sketches")
    rows = materialize(full.drop("sketch"), "rows")
    known = full.where("doc_id is not null and set_key is not null")
    classes = materialize(known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")).drop("set_key"), "classes")
    discard(full)
    entries = _listed(classes, k, percent)
    discard(classes)

    ids = materialize(entries.select(F.col("node").alias("doc_id")).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_PAIRS else ids
    texts = docs.where("doc_id is not null").join(wanted, "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(functools.partial(_sets, width=width), "node long, n_shingles long, members binary"), "sets")
    linker = _Linker(sets, k, percent)
    long = materialize(entries.where(F.col("size") > rare).select("node").distinct(), "long")
    if not long.isEmpty():
        linker.long(long)
    linker.short(entries.where(F.col("size") <= rare))
    discard(ids, long, sets, entries)

    classes = rows.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("class_id"))
    out = rows.join(classes, "set_key", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    if linker.labels is not None:
        out = out.join(linker.labels.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id").select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id"
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that near_duplicates keeps; of rows repeating a kept doc_id all stay. Null ids stay."""
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
