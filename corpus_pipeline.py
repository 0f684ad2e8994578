"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import exact_dedup as exact
from marlstone.llm import ngram_join, packing, quality_classifier, quality_rules
from marlstone.llm.common import small, table, written

#: SQL can't express the trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def _whole(docs: DataFrame, *names: str) -> DataFrame:
    """The row as one column ``row``, beside the columns that a stage reads: no name of ``docs`` can clash."""
    return docs.select(F.struct("*").alias("row"), *names)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier, fitted on those of ``docs`` that have labels, doesn't reject.

    Null text, source, language and length count as empty. Repeated rows are judged alike, each on
    its own. Without labels of both classes all rows stay; an empty table stays empty.
    """
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(_whole(docs, "text", "source", "lang", "n_chars"), model).where("kept").select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines; ``n_chars`` follows the text.

    A null or empty text has no words and goes. Repeated rows are judged alike, each on its own.
    """
    found = quality_rules.quality_rules(_whole(docs, "text")).where("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (null as empty, A-Z as a-z): that of the largest id.

    Of repeated rows of that id any one stays; a null id stays only in a group without another.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    found = written(exact.exact_dedup(docs.select("doc_id", "text", mark.alias("mark"))), "found")
    gone = written(found.where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_gone")).distinct(), "gone")
    rows = _whole(docs, "doc_id", "text")
    rest = rows.join(small(gone), F.col("doc_id").eqNullSafe(F.col("_id")) & (mark == F.col("_gone")), "left_anti")
    again = written(found.where("kept AND group_size > 1").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"), "again")
    if again.limit(1).count():
        same = F.col("doc_id").eqNullSafe(F.col("_id"))
        twice = rest.join(small(again), same, "left_semi").withColumn("norm", exact.normalised()).dropDuplicates(["doc_id", "norm"]).drop("norm")
        rest = rest.join(small(again), same, "left_anti").union(twice)
    return rest.select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the largest id.

    Texts without a word and rows with a null id are alike to nothing and stay. An id that has
    several texts goes if each of them has another document to stand for it.
    """
    found = written(ngram_join.ngram_join(docs), "joined").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class_id")).alias("stays"))
    gone = written(found.where("NOT stays").select(F.col("doc_id").alias("_id")), "gone")
    return _whole(docs, "doc_id").join(small(gone), F.col("doc_id") == F.col("_id"), "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces packed into sequences; a null text is its end id alone, repeated rows are packed once each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", classify), ("quality rules", clean), ("exact dedup", unique), ("n-gram Jaccard join", distinct), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
