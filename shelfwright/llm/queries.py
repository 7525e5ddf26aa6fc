"""The registered queries of this subpackage and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op03_lines, op06_license, op10_balltree
from . import op11_laesa as laesa
from . import op12_nsbounds as nsbounds
from .common import read
from .op01_minhash import near_duplicates
from .op02_hmm import hmm_scores
from .op03_lines import line_report
from .op04_html import main_texts
from .op05_cnn import quality_scores
from .op06_license import license_scan
from .op07_decontam import contaminations
from .op08_toxic import toxicity_scores
from .op09_packing import packed
from .op10_balltree import top_k
from .op11_laesa import code_report
from .op12_nsbounds import cluster_report
from .op13_concat import concatenated


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(read(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).withColumn("spans", op06_license.span_digest(F.col("spans")))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op11_laesa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(read(spark, sf_dir, "embeddings"))


def op12_nsbounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(read(spark, sf_dir, "embeddings"))


def op13_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concatenated(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash, op2_hmm, op3_lines, op4_html, op5_quality, op6_license, op7_decontam, op8_toxicity, op9_packing, op10_topk, op11_laesa, op12_nsbounds, op13_concat)
}

ORACLE_SQL: dict[str, str] = {"op3_lines": op03_lines.SQL, "op6_license": op06_license.SQL, "op10_topk": op10_balltree.SQL, "op11_laesa": laesa.SQL, "op12_nsbounds": nsbounds.SQL}
