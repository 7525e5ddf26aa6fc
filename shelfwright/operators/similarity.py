"""Blocked similarity join: every left key's best right key by matching-block ratio, without comparing all pairs.

Ratio is 2M / (la + lb), M the characters in matching blocks (longest block first, then left and right of it). Keys meet
only if lengths allow the cutoff and if they share a bigram rare enough that it must be shared: a ratio r leaves at most
(1 - r)(la + lb) unmatched characters, which can break so many bigrams; the rest must be shared. So a left key is looked
up by its rarest bigrams, one more than can be broken. Keys too short for that bound meet by length: one
row for each length that the ratio allows, joined on it.

Where right keys are many, the nearest are looked for first: matching blocks are a common subsequence, so pairs with few
unmatched characters become equal when as many are left out on either side. A left key whose best ratio beats all that
the pairs not met so far can have is done, and only the others go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .staging import sent_if_small, settled, slices

#: Right keys up to which the cutoff alone selects pairs; characters left out of a side, round by round; keys whose characters are left out, and how many of them one task takes.
FEW, LEFT_OUT, LONGEST, KEYS = 500, (2, 3), 24, 5000


def _ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from difflib import SequenceMatcher

    for left, right in pairs:
        yield pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def ratio(left: Column, right: Column) -> Column:
    return F.pandas_udf(_ratios, "double")(left, right)


def _bigrams(c: Column) -> Column:
    return F.when(F.length(c) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def letters_shared(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Characters that two texts share, row by row, each as often as both have it. Characters whose numbers are 128 apart count as one, which makes it more, never less."""

    def counts(texts: pa.Array) -> np.ndarray:
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), "")[0].as_py()
        letters = np.frombuffer(joined.encode("utf-32-le"), "<u4") % 128
        return np.bincount(np.repeat(np.arange(len(texts)) * 128, pc.utf8_length(texts)) + letters, minlength=128 * len(texts)).reshape(-1, 128)

    return np.minimum(counts(left), counts(right)).sum(1)


def _best(pairs: DataFrame, cutoff: float, scope: list[str]) -> DataFrame:
    """``scope..., lk, rk`` and ``most`` (no pair's ratio is over it) -> ``scope..., lk, rk, ratio``: the best of each left key.

    The pairs of a key pass by with the highest bound first, then the greatest string; a ratio is worked out only where it can be the best yet.
    """
    # Pairs are few bytes and much work: as many tasks as the session shuffles by, which adaptive execution leaves alone. Repeated pairs meet there too.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(tasks, *scope, "lk").distinct()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "lk", 40_000):
            lk, rk, most = (batch.column(c) for c in ("lk", "rk", "most"))
            bound = np.minimum(most, 2 * letters_shared(lk, rk) / pc.add(pc.utf8_length(lk), pc.utf8_length(rk)).to_numpy())
            yield batch.set_column(batch.schema.get_field_index("most"), "bound", pa.array(bound)).filter(pa.array(bound >= cutoff - 1e-9))

    pairs = pairs.mapInArrow(bounded, pairs.withColumnRenamed("most", "bound").schema)
    keys = [*scope, "lk"]
    schema = T.StructType([pairs.schema[c] for c in (*keys, "rk")] + [T.StructField("ratio", T.DoubleType())])

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        as_batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema=to_arrow_schema(schema))
        key, best, matcher, done = None, None, SequenceMatcher(None), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.select([*keys, "rk", "bound"]).columns), strict=True):
                mine, rk, bound = row[: len(keys)], row[-2], row[-1]
                if mine != key:
                    done += [] if best is None else [(*key, best[1], best[0])]
                    key, best = mine, None
                    matcher.set_seq2(mine[-1])
                if best is None or bound > best[0] + 1e-9 or (bound >= best[0] - 1e-9 and rk > best[1]):
                    matcher.set_seq1(rk)
                    found = (matcher.ratio(), rk)
                    if found[0] >= cutoff and (best is None or found > best):
                        best = found
            yield as_batch(done)
            done = []
        yield as_batch([] if best is None else [(*key, best[1], best[0])])

    return pairs.sortWithinPartitions(*keys, F.desc("bound"), F.desc("rk")).mapInArrow(climb, schema)


def _without(keys: DataFrame, key: str, cuts: dict[int, list[int]]) -> DataFrame:
    """Adds ``rest``: what is left of a key of a length in ``cuts`` without as many of its characters, each once."""
    schema = T.StructType([*keys.schema.fields, T.StructField("rest", T.StringType())])

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, key, 4000):
            at, rests = [], []
            for row, text in enumerate(batch.column(key).to_pylist()):
                found = {"".join(kept) for n in cuts.get(len(text), []) for kept in combinations(text, len(text) - n)}
                at += [row] * len(found)
                rests += found
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(rests, pa.string())], names=schema.names)

    return keys.mapInArrow(leave_out, schema)


def _nearest(l: DataFrame, r: DataFrame, cutoff: float, scope: list[str]) -> tuple[DataFrame | None, DataFrame, DataFrame]:  # noqa: E741
    """The best matches among pairs that leave few characters out, the left keys that other pairs could match as well or
    better, and the highest ratio of such a pair: ``la, lb, most``, for lengths up to LONGEST."""
    sizes = lambda df, c: [row[0] for row in df.select(F.length(c).alias("n")).where(F.col("n") <= LONGEST).distinct().collect()]
    lengths = [(la, lb) for la in sizes(l, "lk") for lb in sizes(r, "rk") if 2 * min(la, lb) >= (cutoff - 1e-9) * (la + lb)]
    spark, best = l.sparkSession, None
    dealt = lambda keys: keys.repartition(max(spark.sparkContext.defaultParallelism, -(-keys.count() // KEYS)))
    longer = r.select(F.length("rk").alias("n")).where(F.col("n") > LONGEST).agg(F.min("n")).first()[0]
    most = {(la, lb): 2 * min(la, lb) / (la + lb) for la, lb in lengths}
    bounds = lambda: F.broadcast(spark.createDataFrame([(*k, v) for k, v in most.items()], "la int, lb int, most double"))
    for n in LEFT_OUT:
        of = lambda la, lb: min(n, n - lb + la, int(la - cutoff * (la + lb) / 2 + 1e-9))  # noqa: E731, B023  more would not reach the cutoff
        left = {(la, lb): of(la, lb) for la, lb in lengths if of(la, lb) >= max(0, la - lb)}
        cut = lambda side: {size: sorted({i + (lb - la) * side for (la, lb), i in left.items() if (la, lb)[side] == size}) for size in {k[side] for k in left}}  # noqa: E731, B023
        # A key becomes hundreds of rows, which Spark's estimate leaves out: without the hint it sends them all to every task, through the driver.
        pairs = _without(dealt(l), "lk", cut(0)).join(_without(dealt(r), "rk", cut(1)).hint("merge"), [*scope, "rest"]).select(*scope, "lk", "rk")
        found = _best(_bounded(pairs, bounds()), cutoff, scope)
        best = settled(found if best is None else best.unionByName(found).groupBy(*scope, "lk").agg(F.max(F.struct("ratio", "rk")).alias("b")).select(*scope, "lk", "b.rk", "b.ratio"))
        most |= {(la, lb): 2 * (la - i - 1) / (la + lb) for (la, lb), i in left.items()}
        highest = {la: max([2 * la / (la + longer) if longer else 0.0, *(v for k, v in most.items() if k[0] == la)]) for la in range(1, LONGEST + 1)}
        reach = F.broadcast(spark.createDataFrame([(la, v) for la, v in highest.items() if v >= cutoff - 1e-9], "la int, reach double"))
        l = l.join(best.select(*scope, "lk", "ratio"), [*scope, "lk"], "left").join(reach, F.length("lk") == F.col("la"), "left")  # noqa: E741
        l = settled(l.where((F.length("lk") > LONGEST) | (F.coalesce("ratio", F.lit(0.0)) <= F.col("reach") + 1e-9)).select(*scope, "lk"))  # noqa: E741
    return best, l, bounds()


def _bounded(pairs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds ``most`` by the keys' lengths."""
    by_length = 2 * F.least("la", "lb") / (F.col("la") + F.col("lb"))
    return pairs.withColumns({"la": F.length("lk"), "lb": F.length("rk")}).join(bounds, ["la", "lb"], "left").withColumn("most", F.coalesce("most", by_length)).drop("la", "lb")


def best_matches(left: DataFrame, right: DataFrame, cutoff: float, scope: list[str] | None = None) -> DataFrame:
    """``left(scope..., key)``, ``right(scope..., key)`` -> ``scope..., key, match, ratio``: the best right key of each
    left key at or over ``cutoff`` within the scope; equal ratios go to the greater string. Empty keys match nothing."""
    scope = scope or []
    l = left.select(*scope, F.col("key").alias("lk")).where("lk <> ''").distinct()  # noqa: E741
    r = right.select(*scope, F.col("key").alias("rk")).where("rk <> ''").distinct()
    if r.limit(FEW + 1).count() <= FEW:
        return _named(_best(_selected(l, r, cutoff, scope).withColumn("most", F.lit(1.0)), cutoff, scope), scope)
    best, rest, bounds = _nearest(settled(l), r := settled(r), cutoff, scope)
    if not rest.isEmpty():
        others = _best(_bounded(_selected(rest, r, cutoff, scope), bounds), cutoff, scope)
        best = best.unionByName(others).groupBy(*scope, "lk").agg(F.max(F.struct("ratio", "rk")).alias("b")).select(*scope, "lk", "b.rk", "b.ratio")
    return _named(best, scope)


def _named(best: DataFrame, scope: list[str]) -> DataFrame:
    return best.select(*scope, F.col("lk").alias("key"), F.col("rk").alias("match"), "ratio")


def _selected(l: DataFrame, r: DataFrame, cutoff: float, scope: list[str]) -> DataFrame:  # noqa: E741
    """``scope..., lk, rk``: all pairs that the cutoff leaves, by rare bigrams or by length."""
    grams = r.select(*scope, "rk", F.explode(_bigrams(F.col("rk"))).alias("gram"))
    spread = grams.groupBy("gram").agg(F.count("*").alias("n"))
    # The shorter side's length bounds the pair: lb <= la (2 - r) / r. Broken bigrams: two per unmatched letter on the left at most.
    longest = F.floor(F.length("lk") * (2 - cutoff) / cutoff)
    broken = F.floor((1 - cutoff) * (F.length("lk") + longest)) * 2
    own = l.withColumn("broken", broken).withColumn("gram", F.explode(_bigrams(F.col("lk")))).join(spread, "gram", "left")
    rank = F.row_number().over(Window.partitionBy(*scope, "lk").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    looked = own.withColumn("place", rank).where(F.col("place") <= F.col("broken") + 1).where("n is not null")
    by_gram = looked.select(*scope, "lk", "gram").join(sent_if_small(grams), [*scope, "gram"]).select(*scope, "lk", "rk").distinct()
    few = l.where(F.size(_bigrams(F.col("lk"))) <= broken)
    lengths = (F.length("rk") >= F.length("lk") * cutoff / (2 - cutoff)) & (F.length("rk") <= F.length("lk") * (2 - cutoff) / cutoff)
    few = few.withColumn("size", F.explode(F.sequence(F.ceil(F.length("lk") * cutoff / (2 - cutoff)), F.floor(F.length("lk") * (2 - cutoff) / cutoff))))
    by_length = few.join(sent_if_small(r).withColumn("size", F.length("rk").cast("long")), [*scope, "size"]).select(*scope, "lk", "rk")
    return by_gram.unionByName(by_length).where(lengths)
