"""Queries of the trained operators: quality classifier, language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import langid, quality_classifier
from .common import table


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select("doc_id", "p_text", "p_metadata", "quality_score", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


QUERIES = {"op2_quality_classifier": op2_quality_classifier, "op10_language_id": op10_language_id}
ORACLE: dict[str, str] = {}
