"""Field accuracy of generated rows against the truth, matched on the part-number key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hard_key, mpn_key, percent


def shared_fields(generated: DataFrame, truth: DataFrame, key: str) -> list[str]:
    return sorted(c for c in set(generated.columns) & set(truth.columns) if not c.startswith("_") and c != key)


def _long(df: DataFrame, fields: list[str], name: str, *keys: Column) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields]))
    return df.select(*keys, pairs.alias("p")).select("*", "p.*").drop("p")


def compared(generated: DataFrame, truth: DataFrame, key: str = "Mfg_Part_Num", fields: list[str] | None = None) -> DataFrame:
    """A row per matched generated row and field: ``mpn_key, part, field, got, expected, populated, attempted, exact, normalised``.

    Of truth rows that share a key the first in column order of their values counts (``ordinal`` column if there is one).
    """
    fields = shared_fields(generated, truth, key) if fields is None else fields
    order = F.col("ordinal") if "ordinal" in truth.columns else F.struct(*[F.col(f).cast("string") for f in fields])
    one = truth.withColumn("mpn_key", mpn_key(F.col(key))).where("mpn_key <> ''").groupBy("mpn_key").agg(F.min_by(F.struct(*fields), order).alias("t")).select("mpn_key", "t.*")
    g = _long(generated.withColumn("mpn_key", mpn_key(F.col(key))), fields, "got", F.col("mpn_key"), F.col(key).alias("part"))
    t = _long(one, fields, "expected", F.col("mpn_key"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    populated, attempted = text("expected") != "", text("got") != ""
    exact = populated & (text("got") == text("expected"))
    alike = (hard_key(F.col("got")) == hard_key(F.col("expected"))) & (hard_key(F.col("expected")) != "")
    return g.join(t, ["mpn_key", "field"]).withColumns({"populated": populated, "attempted": populated & attempted, "exact": exact, "normalised": exact | (populated & alike)})


def accuracy(rows: DataFrame) -> DataFrame:
    """Per field and overall (``field`` null) in one pass: counts and percentages (K8: coverage counts attempts where the truth has a value)."""
    out = rows.rollup("field").agg(
        F.count_if("populated").alias("total"), F.count_if("exact").alias("exact"), F.count_if("normalised").alias("normalised"), F.count_if("attempted").alias("attempted")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.withColumns(
        {
            "exact_pct": zero(percent(F.col("exact"), F.col("total"))), "normalised_pct": zero(percent(F.col("normalised"), F.col("total"))),
            "formatting_only_pct": zero(percent(F.col("normalised") - F.col("exact"), F.col("total"))), "coverage_pct": zero(percent(F.col("attempted"), F.col("total"))),
        }
    )


def weakest(scores: DataFrame, n: int = 5) -> DataFrame:
    return scores.where("field is not null").orderBy("exact_pct", "field").limit(n)


def examples(rows: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` mismatches a field, by key."""
    wrong = rows.where("populated and not exact").select("field", F.struct("mpn_key", "expected", "got").alias("x"))
    return wrong.groupBy("field").agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("examples"))


def unmatched(generated: DataFrame, truth: DataFrame, key: str = "Mfg_Part_Num") -> DataFrame:
    keys = truth.select(mpn_key(F.col(key)).alias("mpn_key")).where("mpn_key <> ''").distinct()
    return generated.withColumn("mpn_key", mpn_key(F.col(key))).join(keys, "mpn_key", "left_anti").drop("mpn_key")
