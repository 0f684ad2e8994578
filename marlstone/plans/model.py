"""The driver's tables seen as the engine's data model, in Spark and as SQL for the oracle."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators import index, maintained
from marlstone.operators.graph import shared_folder

#: The time at which time-dependent operators look at the data (seconds).
NOW = 1_710_000_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with shard, lifecycle (one in ten each warm and cold), path and times that follow from the id."""
    d = F.col("doc_id")
    suffix = F.element_at(F.array(F.lit(".md"), F.lit(".py"), F.lit(".txt")), (d % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"), F.col("source").alias("shard"), "lang", "n_chars",
        F.when(d % 10 == 9, 2).when(d % 10 == 8, 1).otherwise(0).alias("lifecycle"),
        F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/note_"), d.cast("string"), suffix).alias("source_id"),
        (F.lit(NOW) - d * 1800.0).alias("created_at"), F.when(d % 7 != 0, F.lit(NOW) - d * 3600.0).alias("verified_at"),
        (d % 23).cast("int").alias("access_count"),
    )


DOCS = f"""d AS (SELECT doc_id, text AS content, source AS shard, lang, n_chars,
  CASE doc_id % 10 WHEN 9 THEN 2 WHEN 8 THEN 1 ELSE 0 END AS lifecycle,
  '/data/' || source || '/' || lang || '/note_' || doc_id || ['.md', '.py', '.txt'][(doc_id % 3 + 1)::INT] AS source_id,
  {NOW}::DOUBLE - doc_id * 1800.0::DOUBLE AS created_at, CASE WHEN doc_id % 7 <> 0 THEN {NOW}::DOUBLE - doc_id * 3600.0::DOUBLE END AS verified_at,
  (doc_id % 23)::INT AS access_count FROM documents)"""


_BUILT: dict[tuple, tuple[tuple, DataFrame]] = {}


def built(spark: SparkSession, sf_dir: str, name: str, docs: DataFrame, make: Callable[[DataFrame], DataFrame], order: list[str] | None = None) -> DataFrame:
    """The index ``name`` = ``make(docs)`` over the documents of ``sf_dir``, in the shared folder, in step with their files.

    Each call looks at the files' paths, lengths and times of change. While they are as they were, and the
    index is still there, it is read; else ``maintained.sync`` makes anew what changed. The folder is the session's own.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    folder = f"{shared_folder(spark)}/index/{key[0]}/{hashlib.md5(sf_dir.encode()).hexdigest()}/{name}"
    seen = maintained.signature(spark, f"{sf_dir}/documents.parquet")
    if key not in _BUILT or _BUILT[key][0] != seen or not maintained.exists(spark, f"{folder}/current"):
        spark.catalog.refreshByPath(f"{sf_dir}/documents.parquet")
        _BUILT[key] = (seen, maintained.sync(docs, folder, make, order)[0])
    return _BUILT[key][1]


def forget() -> None:
    """Drops what is known of indexes; the next use looks at the documents again."""
    _BUILT.clear()


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dl, term, tf) of all documents, in order of terms."""
    return built(spark, sf_dir, "postings", documents(spark, sf_dir).select("doc_id", "content"), index.postings, ["term"])


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dl) of all documents."""
    return built(spark, sf_dir, "lengths", documents(spark, sf_dir).select("doc_id", "content"), index.doc_stats)


TOKENS = r"tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(content, '')), '[^\p{L}\p{N}]+')) AS term FROM d)"
POSTINGS = f"{DOCS}, {TOKENS}, post AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term <> '' GROUP BY doc_id, term)"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains (language, shard) and entities (distinct words of 10 to 13 letters) of each document."""
    words = F.filter(F.array_distinct(fx.tokens(F.col("content"))), lambda w: F.length(w).between(10, 13))
    make = lambda docs: index.tags(docs.select("doc_id", F.array("lang", "shard").alias("domains"), words.alias("entities")))
    return built(spark, sf_dir, "tags", documents(spark, sf_dir).select("doc_id", "content", "lang", "shard"), make)


TAGS = f"""{POSTINGS}, tags AS (SELECT doc_id, 'domain' AS tag_type, lang AS tag_value FROM d UNION ALL SELECT doc_id, 'domain', shard FROM d
  UNION ALL SELECT doc_id, 'entity', term FROM post WHERE length(term) BETWEEN 10 AND 13)"""


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, term): the distinct terms of three characters or more of each benchmark text."""
    q = table(spark, sf_dir, "benchmark")
    return q.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(fx.tokens(F.col("text")))).alias("term")).where(F.length("term") > 2)


QUERY = r"q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark) WHERE length(term) > 2)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-activation edges (a < b, weight): parts bought together, weight the number of orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = lines.select("l_orderkey", F.col("l_partkey").alias("b"))
    return lines.join(other, "l_orderkey").where("l_partkey < b").groupBy(F.col("l_partkey").alias("a"), "b").agg(F.count("*").cast("double").alias("weight"))


EDGES = """li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
edges AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*)::DOUBLE AS weight FROM li x JOIN li y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a query log: session (the user), time in seconds, type, document, value."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("session_id"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) / 1e6").alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("doc_id")
    )


LOG = "ev AS (SELECT event_id, user_id AS session_id, epoch_us(ts) / 1e6 AS ts, event_type, value, (props::JSON->>'k')::BIGINT AS doc_id FROM events)"
