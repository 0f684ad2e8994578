"""Query of the secret scan. SQL can't decode and parse what it reports; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .secret_scan import digest_columns, secret_spans


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(secret_spans(table(spark, sf_dir, "documents")))


QUERIES = {"op12_secret_scan": op12_secret_scan}
ORACLE: dict[str, str] = {}
