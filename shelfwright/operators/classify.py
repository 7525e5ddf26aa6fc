"""Item-type classification of terse descriptions: whole phrases, then weighted token overlap, then corroborated ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ambiguous_extra, expand_abbreviations, percent, tokens
from ..tables import ITEM_TYPES
from .staging import sent_if_small

MIN_SCORE, REVIEW_MARGIN, REVIEW_CONFIDENCE = 0.34, 0.12, 0.70


def candidates(spark: SparkSession, lov_attributes: DataFrame | None = None, extra_types: DataFrame | None = None) -> DataFrame:
    """``label, classpath, ordinal``: the leaves of the vocabulary's classpaths (the first path of a leaf), or the built-in types; then extra ones (``label``)."""
    if lov_attributes is not None:
        paths = lov_attributes.where("classpath is not null").groupBy("classpath").agg(F.min("cp_ordinal").alias("ordinal"))
        base = paths.select(F.trim(F.element_at(F.split("classpath", r"\s*>\s*"), -1)).alias("label"), "classpath", (F.row_number().over(Window.orderBy("ordinal", "classpath")) - 1).cast("long").alias("ordinal"))  # leaves of a vocabulary, a few thousand
    else:
        base = spark.createDataFrame([(label, None, k) for k, label in enumerate(ITEM_TYPES)], "label string, classpath string, ordinal long")
    if extra_types is not None:
        base = base.unionByName(extra_types.select("label", F.lit(None).cast("string").alias("classpath"), (F.lit(1_000_000_000) + F.xxhash64("label") % 1000).alias("ordinal")))
    return base.where("label <> ''").groupBy("label").agg(F.min_by("classpath", "ordinal").alias("classpath"), F.min("ordinal").alias("ordinal"))


def index(labels: DataFrame) -> DataFrame:
    """Inverted index ``token, label, classpath, ordinal, n_tokens, weight, total``: idf weights, repeats of a token in a label counted each time."""
    listed = labels.withColumn("tokens", tokens(F.col("label"))).where(F.size("tokens") > 0)
    n = listed.agg(F.count("*").alias("n"))
    each = listed.select("label", "classpath", "ordinal", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
    idf = each.groupBy("token").agg(F.countDistinct("label").alias("df")).crossJoin(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighted = each.join(idf, "token")
    totals = weighted.groupBy("label").agg(F.sum("idf").alias("total"))
    return weighted.groupBy("token", "label", "classpath", "ordinal", "n_tokens").agg(F.sum("idf").alias("weight")).join(totals, "label")


def _scored(texts: DataFrame, inverted: DataFrame) -> DataFrame:
    """``text, ranked``: the four best candidates ``(label, classpath, score)`` by score, then ordinal; scores agree to nine places before ties are broken."""
    hits = texts.select("text", F.explode("found").alias("token")).join(inverted, "token")
    score = (F.sum("weight") / F.first("total") + 0.001 * F.first("n_tokens")).alias("score")
    each = hits.groupBy("text", "label", "classpath", "ordinal").agg(score)
    order = Window.partitionBy("text").orderBy(F.desc(F.round("score", 9)), "ordinal")
    top = each.withColumn("place", F.row_number().over(order)).where("place <= 4")
    return top.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label", "classpath", "score"))), lambda x: x.dropFields("place")).alias("ranked"))


def _grams(words: str, n: int) -> Column:
    """All runs of ``n`` words; none in a shorter text."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def classify(rows: DataFrame, labels: DataFrame, text: str = "Part_Desc", source: str = "fallback") -> DataFrame:
    """Adds ``item_type, classpath, confidence, method, alternatives, runner_up, needs_review, expanded_text``.

    Each distinct text is classified once. Phrases (labels of two tokens and more, the longest first) win at 0.95; a
    candidate whose weighted overlap reaches MIN_SCORE comes next; then the same with corroborated readings of ambiguous
    abbreviations, which always ask for review. Nulls and blanks are unresolved.
    """
    texts = rows.select(F.col(text).alias("text")).where("trim(text) <> ''").distinct().withColumn("expanded_text", expand_abbreviations(F.col("text")))
    texts = texts.withColumn("found", F.array_distinct(tokens(F.col("expanded_text")))).withColumn("extra", ambiguous_extra(F.col("found")))
    inverted = sent_if_small(index(labels))

    words = F.split(F.trim(F.regexp_replace(F.lower("expanded_text"), r"\s+", " ")), " ")
    spans = labels.where(F.size(tokens(F.col("label"))) >= 2).withColumn("width", F.size(F.split(F.lower("label"), " ")))
    widths = [r.width for r in spans.select("width").distinct().collect()]
    ngrams = texts.withColumn("w", words).select("text", F.explode(F.array_distinct(F.flatten(F.array(*[_grams("w", n) for n in widths])))).alias("phrase")) if widths else texts.select("text", F.lit("").alias("phrase"))
    named = sent_if_small(spans.select(F.lower("label").alias("phrase"), "label", "classpath", "ordinal"))
    first = F.max_by(F.struct("label", "classpath"), F.struct(F.length("label"), -F.col("ordinal"))).alias("phrase_hit")
    by_phrase = ngrams.join(named, "phrase").groupBy("text").agg(first)

    strong = _scored(texts, inverted)
    weak = _scored(texts.where(F.size("extra") > 0).withColumn("found", F.array_union("found", "extra")), inverted).withColumnRenamed("ranked", "combined")
    joined = texts.join(by_phrase, "text", "left").join(strong, "text", "left").join(weak, "text", "left")

    ok = lambda c: F.coalesce(F.get(c, F.lit(0))["score"] >= MIN_SCORE, F.lit(False))
    kind = F.when(F.col("phrase_hit").isNotNull(), "phrase").when(ok(F.col("ranked")), "strong").when(ok(F.col("combined")), "context").otherwise("none")
    best = F.when(F.col("kind") == "strong", F.get("ranked", F.lit(0))).when(F.col("kind") == "context", F.get("combined", F.lit(0)))
    raw = F.bround(0.55 + 0.40 * F.least(best["score"], F.lit(1.0)), 3)
    confidence = F.when(F.col("kind") == "phrase", F.lit(0.95)).when(F.col("kind") == "strong", F.least(raw, F.lit(0.94))).when(F.col("kind") == "context", F.least(raw, F.lit(REVIEW_CONFIDENCE - 0.01))).otherwise(F.lit(0.0))
    rest = F.when(F.col("kind") == "strong", F.slice("ranked", 2, 3)).when(F.col("kind") == "context", F.slice("combined", 2, 3)).when(F.col("kind") == "none", F.slice("ranked", 1, 3))
    alternatives = F.coalesce(F.transform(rest, lambda x: F.struct(x["label"].alias("label"), F.bround(F.least(x["score"], F.lit(1.0)), 3).alias("score"))), F.array().cast("array<struct<label:string,score:double>>"))
    method = F.when(F.col("kind") == "none", "unresolved").otherwise(F.concat(F.lit(source), F.when(F.col("kind") == "phrase", "_phrase").when(F.col("kind") == "strong", "_token_overlap").otherwise("_token_overlap_ambiguous_context")))
    done = joined.withColumn("kind", kind).select(
        "text",
        "expanded_text",
        F.coalesce(F.col("phrase_hit.label"), best["label"]).alias("item_type"),
        F.when(F.col("kind") == "phrase", F.col("phrase_hit.classpath")).otherwise(best["classpath"]).alias("item_classpath"),
        confidence.alias("confidence"),
        method.alias("method"),
        alternatives.alias("alternatives"),
    )
    out = rows.join(done.withColumnRenamed("item_classpath", "classpath"), rows[text] == done["text"], "left").drop("text")
    out = out.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "method": F.coalesce("method", F.lit("unresolved")), "runner_up": F.get("alternatives", F.lit(0))["label"]})
    return out.withColumn("needs_review", needs_review())


def needs_review() -> Column:
    """Unresolved, under the confidence for unattended use, or too close to the runner-up (whose score is unscaled: K6)."""
    runner = F.get("alternatives", F.lit(0))["score"]
    return F.col("item_type").isNull() | (F.col("confidence") < REVIEW_CONFIDENCE) | F.coalesce(F.col("confidence") - runner < REVIEW_MARGIN, F.lit(False))


def classification_stats(classified: DataFrame) -> DataFrame:
    """One row of totals over classified rows."""
    some = F.col("item_type").isNotNull()
    out = classified.agg(
        F.count("*").alias("n_rows"), F.count_if(some).alias("classified"), F.count_if(~some).alias("unresolved"), F.count_if(some & F.col("needs_review")).alias("needs_review"),
        F.bround(F.coalesce(F.avg(F.when(some, F.col("confidence"))), F.lit(0.0)), 3).alias("mean_confidence"), F.count_if(some & F.col("classpath").isNotNull()).alias("with_classpath"),
    )
    return out.withColumn("resolution_rate_pct", F.coalesce(percent(F.col("classified"), F.col("n_rows")), F.lit(0.0)))


def method_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("method").agg(F.count("*").alias("n"))
