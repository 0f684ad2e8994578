"""Indexes as pure functions of the document table: tags, postings, path keys, file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as fx


def postings(docs: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, dl, term, tf): the terms of each document, how often it has them, and its length in terms."""
    words = docs.select(doc_id, fx.tokens(F.col(content)).alias("w")).select(doc_id, F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    return words.groupBy(doc_id, "dl", "term").agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, dl): document lengths in terms."""
    return docs.select(doc_id, F.size(fx.tokens(F.col(content))).cast("long").alias("dl"))


def tags(docs: DataFrame) -> DataFrame:
    """Inverted tag index (doc_id, tag_type, tag_value) of array columns ``domains`` and ``entities``."""
    one = lambda c, kind: F.transform(F.col(c), lambda v: F.struct(F.lit(kind).alias("tag_type"), v.alias("tag_value")))
    return docs.select("doc_id", F.inline(F.concat(one("domains", "domain"), one("entities", "entity"))))


def document_frequency(rows: DataFrame, term: str, doc_id: str = "doc_id") -> DataFrame:
    """(term, df) with distinct documents."""
    return rows.groupBy(term).agg(F.countDistinct(doc_id).alias("df"))


def path_keys(docs: DataFrame) -> DataFrame:
    """(path_token, kv_key, doc_id) of ``source_id`` and the array ``keys``."""
    return docs.select("doc_id", F.explode(fx.path_tokens(F.col("source_id"))).alias("path_token"), "keys").select("path_token", F.explode("keys").alias("kv_key"), "doc_id").distinct()


def compact_path_keys(rows: DataFrame, most: int = 200) -> DataFrame:
    """Rows of pairs that at most ``most`` documents have. Rows of the other pairs are lost to scores, small as their share of one is."""
    return rows.join(rows.groupBy("path_token", "kv_key").count().where(F.col("count") <= most).drop("count"), ["path_token", "kv_key"], "left_semi")


def filenames(docs: DataFrame) -> DataFrame:
    """(filename_stem, doc_id)."""
    return docs.select(fx.filename_stem(F.col("source_id")).alias("filename_stem"), "doc_id").where("filename_stem <> ''")
