"""The queries of the text problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import leakage, mixing, subjects


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))
    return found.where(F.col("kind").isin("passage", "whole")).select("doc_id", "item_id").distinct()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels, areas, items = (_table(spark, sf_dir, n) for n in ("documents", "doc_labels", "subject_areas", "eval_items"))
    return subjects.subject_areas(documents, labels, areas, foreign=items).select("doc_id", "subject").distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p8_found, p9_mix, p9_shares, p10_found)}


ORACLE: dict[str, str] = {}
