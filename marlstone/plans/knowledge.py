"""Queries on claims in conflict and on edges between shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import graph
from marlstone.operators import maintenance as mt
from marlstone.operators import resolution as rs
from marlstone.plans import model as m
from marlstone.registry import query


def claims_and_edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Claims of the documents with an authority, a time and what they replace, and the edges between them.

    A claim that another of its key repeats later is replaced by the latest such one of largest id.
    """
    d = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, (*rs.AUTHORITY, "rumour"))), (d % 4 + 1).cast("int"))
    c = mt.claims(m.documents(spark, sf)).withColumn("observed_at", (d % 5).cast("double"))
    text = F.when(d % 3 == 0, F.col("claim_text")).otherwise(F.concat("claim_text", F.lit(" seen in "), d.cast("string")))
    edges = graph.checkpointed(mt.claim_edges(c.withColumn("claim_text", text), different=0.5).select("a", "b", "edge_type"))
    at = c.select("claim_id", "observed_at")
    both = edges.where("edge_type = 'supersedes'").join(at.toDF("a", "ta"), "a").join(at.toDF("b", "tb"), "b")
    later = both.select(F.when(F.col("ta") > F.col("tb"), F.col("a")).otherwise(F.col("b")).alias("claim_id"), F.when(F.col("ta") > F.col("tb"), F.col("b")).otherwise(F.col("a")).alias("old"))
    old = later.groupBy("claim_id").agg(F.max("old").alias("supersedes"))
    claims = c.select("claim_id", "doc_id", "entity_key", "observed_at", kind.alias("claim_type")).join(old, "claim_id", "left")
    return graph.checkpointed(claims), edges


@query("claim_resolution")
def claim_resolution(spark, sf) -> DataFrame:
    """Chains and components without end, which SQL reaches by recursion only; tested against plain loops over all claims."""
    return rs.latest_then_authority(*claims_and_edges(spark, sf))


@query("claim_flags")
def claim_flags(spark, sf) -> DataFrame:
    """As ``claim_resolution``."""
    return rs.keep_all_with_flags(*claims_and_edges(spark, sf))


_MARKED = f"""{m.POSTINGS}, en AS (SELECT doc_id, list(term ORDER BY term) AS entities FROM post WHERE length(term) BETWEEN 10 AND 13 GROUP BY 1),
r AS (SELECT d.doc_id, shard, [lang] AS domains, coalesce(entities, []) AS entities, n_chars % 50 AS key, lifecycle = 0 AS is_open FROM d LEFT JOIN en ON en.doc_id = d.doc_id)"""


@query(
    "seed_across_shards",
    f"""WITH {_MARKED}, tk AS (SELECT doc_id, 'e:' || unnest(entities) AS token FROM r UNION ALL SELECT doc_id, 'd:' || unnest(domains) FROM r),
    sz AS (SELECT token, count(*) AS size FROM tk GROUP BY 1 HAVING count(*) BETWEEN 2 AND {rs.BUCKET}),
    pr AS (SELECT x.doc_id AS a, y.doc_id AS b, min(lpad(size::VARCHAR, 4, '0') || x.token) AS first FROM tk x JOIN tk y ON x.token = y.token AND x.doc_id < y.doc_id JOIN sz ON sz.token = x.token GROUP BY 1, 2),
    v AS (SELECT a, b, first, (x.domains[1] = y.domains[1])::INT + list_has_any(x.entities, y.entities)::INT + (x.key = y.key)::INT + (x.is_open AND y.is_open)::INT AS votes FROM pr JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b WHERE x.shard <> y.shard)
    SELECT a, b, substr(first, 5) AS token, votes FROM v WHERE votes >= 2 ORDER BY first, a, b LIMIT {rs.EDGES // 2}""",
)
def seed_across_shards(spark, sf) -> DataFrame:
    """The first 200 pairs of the smallest buckets, as the operator seeds them."""
    docs = m.documents(spark, sf)
    entities = m.tags(spark, sf).where("tag_type = 'entity'").groupBy("doc_id").agg(F.collect_set("tag_value").alias("entities"))
    key = F.array((F.col("n_chars") % 50).cast("string"))
    rows = docs.join(entities, "doc_id", "left").select("doc_id", "shard", F.array("lang").alias("domains"), "entities", key.alias("keys"), (F.col("lifecycle") == 0).alias("is_open"))
    return rs.seed_across_shards(rows)
