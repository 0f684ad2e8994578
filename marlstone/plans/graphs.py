"""Graph queries over co-purchase edges, entity words and derived version chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import graph
from marlstone.operators.running import running
from marlstone.plans import model as m
from marlstone.registry import query

BOTH = f"{m.EDGES}, bw AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges)"
SEEDS = "seeds AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 200 = 7)"


def _seeds(spark, sf) -> DataFrame:
    return m.table(spark, sf, "part").where("p_partkey % 200 = 7").select(F.col("p_partkey").alias("node"))


@query("edges_co_activation", f"WITH {m.EDGES} SELECT * FROM edges")
def edges_co_activation(spark, sf) -> DataFrame:
    return m.edges(spark, sf)


@query("edges_both_ways", f"WITH {BOTH} SELECT * FROM bw")
def edges_both_ways(spark, sf) -> DataFrame:
    return graph.both_ways(m.edges(spark, sf))


@query("degree_counts", f"WITH {m.EDGES} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node")
def degree_counts(spark, sf) -> DataFrame:
    return graph.degrees(m.edges(spark, sf))


@query(
    "neighbours_topk",
    f"WITH {m.EDGES}, {SEEDS}, e AS (SELECT * FROM edges UNION ALL SELECT b, a, weight FROM edges) SELECT * FROM (SELECT a, b, weight, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS position FROM e WHERE a IN (SELECT node FROM seeds)) WHERE position <= 5",
)
def neighbours_topk(spark, sf) -> DataFrame:
    return graph.neighbours(_seeds(spark, sf), m.edges(spark, sf), 5)


def _successor_sql() -> str:
    parts = [f"WITH {BOTH}, {SEEDS}, deg AS (SELECT a, count(*) AS deg FROM bw GROUP BY a), m0 AS (SELECT node, 1.0::DOUBLE / count(*) OVER () AS mass FROM seeds)"]
    for k in range(1, 5):
        parts.append(f"m{k} AS (SELECT bw.b AS node, sum(0.85::DOUBLE * mass / deg) AS mass FROM m{k - 1} JOIN bw ON node = bw.a JOIN deg ON deg.a = bw.a GROUP BY bw.b)")
    return ", ".join(parts) + " SELECT node, round_even(sum(mass), 6) AS mass, least(round_even(1.5 * sum(mass), 6), 3.0) AS boost FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4) WHERE node NOT IN (SELECT node FROM seeds) GROUP BY node"


@query("successor_representation", _successor_sql())
def successor_representation(spark, sf) -> DataFrame:
    """Discounted mass of four steps from the seeds, and the boost of a retrieval tier by it."""
    return graph.successor(_seeds(spark, sf), m.edges(spark, sf), steps=4)


@query("personalised_pagerank")
def personalised_pagerank(spark, sf) -> DataFrame:
    """Parts linked from a dearer to a cheaper one bought with it; iterative, so tested against brute force."""
    restart = _seeds(spark, sf).select("node", F.lit(10.0).alias("weight"))
    return graph.pagerank(m.edges(spark, sf), restart, rounds=50)


ENT = f"{m.POSTINGS}, ent AS (SELECT DISTINCT doc_id, term AS entity FROM post WHERE length(term) BETWEEN 10 AND 13), pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM ent x JOIN ent y USING (entity) WHERE x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 2)"


def _entities(spark, sf):
    return m.tags(spark, sf).where("tag_type = 'entity'").select("doc_id", F.col("tag_value").alias("entity")).distinct()


@query("shared_entity_pairs", f"WITH {ENT} SELECT * FROM pairs")
def shared_entity_pairs(spark, sf) -> DataFrame:
    return graph.shared_entities(_entities(spark, sf), 2)


@query(
    "entity_auto_links",
    f"WITH {ENT}, e AS (SELECT a, b, shared FROM pairs UNION ALL SELECT b, a, shared FROM pairs), n AS (SELECT doc_id, count(*) AS n FROM ent GROUP BY 1) SELECT a, b, shared, round_even(least(shared::DOUBLE / n, 1.0), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS r FROM e) JOIN n ON doc_id = a WHERE r <= 10",
)
def entity_auto_links(spark, sf) -> DataFrame:
    e = _entities(spark, sf)
    return graph.strongest_links(graph.shared_entities(e, 2, best=10), e.groupBy("doc_id").agg(F.count("*").alias("n")), 10)


@query(
    "edge_seeding_gate",
    f"""WITH {m.EDGES}, p AS (SELECT a, b, x.p_brand = y.p_brand AS same_domain, split_part(x.p_type, ' ', 1) = split_part(y.p_type, ' ', 1) AS same_entity, x.p_size = y.p_size AS same_key, x.p_partkey % 10 < 8 AND y.p_partkey % 10 < 8 AS both_open
    FROM edges JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b) SELECT * FROM (SELECT *, same_domain::INT + same_entity::INT + same_key::INT + both_open::INT AS votes FROM p) WHERE votes >= 2""",
)
def edge_seeding_gate(spark, sf) -> DataFrame:
    p = m.table(spark, sf, "part").select("p_partkey", "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), "p_size")
    x, y = p.toDF("a", "brand_a", "kind_a", "size_a"), p.toDF("b", "brand_b", "kind_b", "size_b")
    pairs = m.edges(spark, sf).select("a", "b").join(x, "a").join(y, "b")
    pairs = pairs.select("a", "b", (F.col("brand_a") == F.col("brand_b")).alias("same_domain"), (F.col("kind_a") == F.col("kind_b")).alias("same_entity"), (F.col("size_a") == F.col("size_b")).alias("same_key"), ((F.col("a") % 10 < 8) & (F.col("b") % 10 < 8)).alias("both_open"))
    return graph.seed_edges(pairs)


EV = f"""{m.EDGES}, st AS (SELECT a, b, least(weight / 3.0, 1.0)::DOUBLE AS weight, CASE WHEN (a + b) % 2 = 0 THEN 'seeded' ELSE 'observed' END AS source, (a % 5)::INT AS co_count, (b % 4)::DOUBLE AS miss_count FROM edges),
ret AS (SELECT p_partkey AS doc_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_partkey % 7 = 0)"""


@query(
    "edge_evidence",
    f"""WITH {EV}, j AS (SELECT st.*, x.rank AS ra, y.rank AS rb FROM st LEFT JOIN ret x ON x.doc_id = a LEFT JOIN ret y ON y.doc_id = b),
    k AS (SELECT a, b, weight, source, co_count + CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1 ELSE 0 END AS co_count,
      miss_count + CASE WHEN (ra IS NULL) <> (rb IS NULL) THEN 1.0 - CASE WHEN coalesce(ra, rb) <= 20 THEN 0.0 ELSE least(1.0, 20.0::DOUBLE / coalesce(ra, rb)) END ELSE 0.0 END AS miss FROM j),
    s AS (SELECT *, (co_count + 1) / (co_count + miss + 1) AS share FROM k)
    SELECT a, b, weight, CASE WHEN source = 'seeded' AND co_count >= 3 AND share >= 0.4 THEN 'promoted' ELSE source END AS source, co_count, round_even(miss, 6) AS miss_count FROM s WHERE weight * share >= 0.2""",
)
def edge_evidence(spark, sf) -> DataFrame:
    state = m.edges(spark, sf).select("a", "b", F.least(F.col("weight") / 3.0, F.lit(1.0)).alias("weight"), F.when((F.col("a") + F.col("b")) % 2 == 0, "seeded").otherwise("observed").alias("source"), (F.col("a") % 5).cast("int").alias("co_count"), (F.col("b") % 4).cast("double").alias("miss_count"))
    hits = m.table(spark, sf, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("doc_id"), "p_retailprice")
    got = running(hits, [F.desc("p_retailprice"), F.asc("doc_id")], {"rank": F.lit(1)}).select("doc_id", "rank")
    return graph.edge_evidence(state, got, 20, prune=0.2)


@query(
    "typed_expansion",
    "SELECT l_orderkey AS doc_id, l_linenumber AS position, l_partkey AS other, (l_suppkey % 5)::INT AS relation, (l_discount * 10)::DOUBLE AS confidence FROM lineitem WHERE l_linenumber <= 5 AND (l_suppkey % 5 <= 2 OR (l_suppkey % 5 <> 3 AND l_discount * 10 > 0.7))",
)
def typed_expansion(spark, sf) -> DataFrame:
    links = m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("other"), (F.col("l_suppkey") % 5).cast("int").alias("relation"), (F.col("l_discount") * 10).cast("double").alias("confidence"))
    return graph.typed_expansion(links)


@query(
    "supersedes_chain",
    """WITH RECURSIVE v AS (SELECT o_orderkey AS id, CASE WHEN rn % 6 <> 1 THEN prev END AS supersedes FROM (SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))),
    walk(id, cur, steps) AS (SELECT id, id, 0 FROM v UNION ALL SELECT w.id, v.supersedes, w.steps + 1 FROM walk w JOIN v ON v.id = w.cur WHERE v.supersedes IS NOT NULL AND v.supersedes <> w.id AND w.steps < 32)
    SELECT id, max_by(cur, steps) AS head, max(steps) AS steps FROM walk GROUP BY id""",
)
def supersedes_chain(spark, sf) -> DataFrame:
    """Orders of a customer as versions of a claim, five to a chain."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = m.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.row_number().over(w) % 6 != 1, F.lag("o_orderkey").over(w)).alias("supersedes"))
    return graph.chain(v)


@query("claim_clusters")
def claim_clusters(spark, sf) -> DataFrame:
    """Components of all edges; too many ways for a recursive query, so tested against brute force."""
    return graph.clusters(m.edges(spark, sf))


@query("topological_levels")
def topological_levels(spark, sf) -> DataFrame:
    return graph.levels(m.edges(spark, sf))


@query("evidence_rays")
def evidence_rays(spark, sf) -> DataFrame:
    """Seeded rays over each seed's neighbourhood of as many steps as a ray has bounces: a random walk, which SQL can't express."""
    e = graph.checkpointed(m.edges(spark, sf))
    seeds = _seeds(spark, sf).select(F.col("node").alias("query_id"), "node")
    front, near = seeds, None
    for _ in range(3):
        ways = graph.neighbours(front.select("node").distinct(), e, 10).select("a", "b", "weight")
        step = graph.checkpointed(front.join(ways, F.col("node") == F.col("a")).select("query_id", "a", "b", "weight"))
        near = step if near is None else near.union(step)
        front = step.select("query_id", F.col("b").alias("node")).distinct()
    return graph.evidence_rays(seeds, near.distinct())


@query("theta_rays")
def theta_rays(spark, sf) -> DataFrame:
    """Rays of each seed along its own vector and against it, by random numbers that SQL lacks; tested against exact transition powers.

    An edge's weight is its share of the heaviest one.
    """
    e = graph.checkpointed(m.edges(spark, sf))
    seeds = graph.checkpointed(_seeds(spark, sf).select(F.col("node").alias("query_id"), "node"))
    vectors = m.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"))
    top = e.agg(F.max("weight")).first()[0] or 1.0
    way = vectors.join(seeds, "node", "left_semi").select(F.col("node").alias("query_id"), "vector")
    return graph.theta_rays(seeds, e.withColumn("weight", F.col("weight") / top), vectors, way)
