"""Query of the n-gram Jaccard join. Its shingle join over all documents is beyond the oracle's SQL; a brute-force test covers it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .ngram_join import ngram_join


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLE: dict[str, str] = {}
