"""Which of contradicting claims to act on: chains of versions folded to their heads, one winner a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import graph
from marlstone.operators.graph import checkpointed

#: Rank of a claim's authority, the best first; any other comes after them (fixed values).
AUTHORITY = ("primary", "derived", "inferred")
#: Kinds of edges whose ends can't both stand.
CONFLICTS = ("contradicts", "duplicates")


def heads(claims: DataFrame) -> DataFrame:
    """(claim_id, head): the claim that in the end replaced each of ``claims(claim_id, supersedes)``, itself where none did.

    Of several claims that replace one, the largest id is followed. Where replacements go round, the walk ends before it comes back.
    """
    replaced = claims.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("id")).agg(F.max("claim_id").alias("by"))
    versions = claims.select(F.col("claim_id").alias("id")).join(replaced, "id", "left").select("id", F.col("by").alias("supersedes"))
    return graph.chain(versions).select(F.col("id").alias("claim_id"), "head")


def conflict_clusters(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, cluster): ``claims(claim_id)`` that conflicting ``edges(a, b, edge_type)`` tie together, directly or through one other claim; alone, a claim is its own cluster.

    Only edges with an end among the claims count, as then does their other end; a cluster is named by its smallest claim.
    """
    ids = checkpointed(claims.select("claim_id").distinct())
    kept = edges.where(F.col("edge_type").isin(*CONFLICTS) & (F.col("a") != F.col("b"))).select("a", "b")
    near = kept.join(ids, kept.a == ids.claim_id, "left_semi").union(kept.join(ids, kept.b == ids.claim_id, "left_semi")).distinct()
    found = ids.join(graph.clusters(near), F.col("claim_id") == F.col("id"), "left").select("claim_id", F.coalesce("cluster", "claim_id").alias("label"))
    names = found.groupBy("label").agg(F.min("claim_id").alias("cluster"))
    return found.join(names, "label").select("claim_id", "cluster")


def latest_then_authority(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, cluster, accepted, reason) of every claim of ``claims(claim_id, claim_type, observed_at, supersedes)``.

    A claim that was replaced is rejected for its head. Among the heads of a cluster the best authority
    (by ``claim_type``) is accepted, then the latest, then the smallest id; a missing time is the oldest.
    """
    all_heads = checkpointed(heads(claims))
    standing = all_heads.where("claim_id = head").select("claim_id")
    tied = checkpointed(conflict_clusters(standing, edges))
    kind = F.lower("claim_type")
    rank = F.lit(99)
    for i, name in enumerate(AUTHORITY):
        rank = F.when(kind == name, i).otherwise(rank)
    # only the winner is brought to a cluster's claims, so a large cluster is an aggregate and a join
    rated = claims.join(tied, "claim_id").select("claim_id", "cluster", F.struct(rank.alias("rank"), (-F.coalesce(F.col("observed_at").cast("double"), F.lit(0.0))).alias("age"), "claim_id").alias("order"))
    winners = rated.groupBy("cluster").agg(F.min("order").alias("best")).select("cluster", F.col("best.claim_id").alias("winner"))
    of_heads = tied.join(winners, "cluster").select("claim_id", "cluster", (F.col("claim_id") == F.col("winner")).alias("accepted"), F.when(F.col("claim_id") != F.col("winner"), F.concat(F.lit("contradicts_winner "), "winner")).alias("reason"))
    replaced = all_heads.where("claim_id <> head").select("claim_id", F.lit(None).cast(claims.schema["claim_id"].dataType).alias("cluster"), F.lit(False).alias("accepted"), F.concat(F.lit("superseded_by "), "head").alias("reason"))
    return of_heads.union(replaced)


def keep_all_with_flags(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, cluster, superseded_by, contradicts) of every claim: its cluster among all claims, its head if another, and how many claims contradict it."""
    ends = edges.where("edge_type = 'contradicts' AND a <> b").select("a", "b")
    both = ends.union(ends.select("b", "a")).distinct().groupBy(F.col("a").alias("claim_id")).agg(F.count("*").alias("contradicts"))
    out = heads(claims).join(conflict_clusters(claims, edges), "claim_id").join(both, "claim_id", "left")
    return out.select("claim_id", "cluster", F.when(F.col("head") != F.col("claim_id"), F.col("head")).alias("superseded_by"), F.coalesce("contradicts", F.lit(0)).alias("contradicts"))


def claim_neighbours(seeds: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(claim_id, other): claims one edge of ``kinds`` away from each of ``seeds(claim_id)``, in either direction, each once."""
    kept = edges.where(F.col("edge_type").isin(*kinds)).select("a", "b")
    both = kept.union(kept.select("b", "a")).distinct().toDF("claim_id", "other")
    return both.join(seeds.select("claim_id").distinct(), "claim_id", "left_semi")


def claim_scan(claims: DataFrame, entity_key: str | None = None, claim_type: str | None = None, shard: str | None = None, least_confidence: float = 0.0, most: int | None = None) -> DataFrame:
    """Claims that pass each filter that is given, surest and latest first; ``most`` of them where it is given."""
    out = claims.where(F.col("confidence") >= least_confidence)
    for column, value in (("entity_key", entity_key), ("claim_type", claim_type), ("shard", shard)):
        out = out if value is None else out.where(F.col(column) == value)
    return out if most is None else out.orderBy(F.desc("confidence"), F.desc("observed_at"), "claim_id").limit(most)


#: Documents that a token's bucket holds at most, and edges that a pass seeds (both directions count).
BUCKET, EDGES = 40, 400


def seed_across_shards(docs: DataFrame, bucket: int = BUCKET, edges: int | None = EDGES, votes: int = 2) -> DataFrame:
    """Edges between shards: (a, b, token, votes) of ``docs(doc_id, shard, domains, entities, keys, is_open)``, a < b.

    Documents meet in the buckets of their domains and entities. A bucket of more than ``bucket`` documents says
    nothing and is left out: that is what the operator is for. A pair is formed in the smallest bucket
    that it shares (ties by token) and nowhere else, and stays if its documents lie in different shards and
    agree in two of four: a domain, an entity, a key, both open. Pairs of small buckets come first;
    ``edges`` / 2 of them are seeded, all of them where it is None.
    """
    of = lambda c, mark: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x))
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.concat(of("domains", "d:"), of("entities", "e:")))).alias("token"))
    sizes = tokens.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size").between(2, bucket))
    kept = checkpointed(tokens.join(sizes, "token"))
    own = kept.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("size", "token"))), lambda x: x["token"]).alias("tokens"))
    rows = checkpointed(docs.join(own, "doc_id"))
    here = kept.join(rows, "doc_id").select("token", "size", F.struct("doc_id", "shard", "domains", "entities", "keys", "is_open", "tokens").alias("x"))
    there = here.select("token", F.col("x").alias("y"))
    pairs = here.join(there, "token").where("x.doc_id < y.doc_id AND x.shard <> y.shard").where(F.element_at(F.array_intersect("x.tokens", "y.tokens"), 1) == F.col("token"))
    overlap = lambda c: F.coalesce(F.arrays_overlap(f"x.{c}", f"y.{c}"), F.lit(False)).cast("int")
    agreed = overlap("domains") + overlap("entities") + overlap("keys") + F.coalesce(F.col("x.is_open") & F.col("y.is_open"), F.lit(False)).cast("int")
    found = pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), "token", "size", agreed.alias("votes")).where(F.col("votes") >= votes)
    if edges is not None:
        found = found.orderBy("size", "token", "a", "b").limit(edges // 2)
    return found.select("a", "b", "token", "votes")


def topological(edges: DataFrame) -> DataFrame:
    """(id, level, place): ids of a DAG of edges (a before b) by level, then id: each after all that lead to it."""
    levels = graph.levels(edges)
    return levels.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy("id")))
