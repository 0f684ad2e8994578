"""Queries of second-chance retrieval, calibration and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators import rescue as r
from marlstone.operators import tiers
from marlstone.plans import model as m
from marlstone.plans.evidence import SCORED, _scored
from marlstone.plans.retrieval import BM25, DENSE, TAGQ, _bm25, _vectors
from marlstone.registry import query

LEX = "lx AS (SELECT query_id, doc_id, ((query_id * 7 + doc_id * 3) % 19)::DOUBLE AS score FROM de WHERE (query_id + doc_id) % 41 = 0)"


def _lexical(spark, sf) -> DataFrame:
    vectors, queries = _vectors(spark, sf)
    i = F.col("query_id"), F.col("doc_id")
    return vectors.join(F.broadcast(queries), (i[0] + i[1]) % 41 == 0).select("query_id", "doc_id", ((i[0] * 7 + i[1] * 3) % 19).cast("double").alias("score"))


@query("semantic_boost", f"WITH {DENSE}, {LEX}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM lx) SELECT query_id, doc_id, round_even(de.score * 2.0 * greatest(0.5, 1 - top / 40), 6) AS score FROM t JOIN de USING (query_id, doc_id) WHERE top < 20 AND de.score > 0.05")
def semantic_boost(spark, sf) -> DataFrame:
    vectors, queries = _vectors(spark, sf)
    return r.semantic_boost(_lexical(spark, sf), vectors, queries, least=0.05)


@query(
    "semantic_fill",
    f"""WITH {DENSE}, {LEX}, h AS (SELECT query_id, count(*) AS have FROM lx GROUP BY 1), thin AS (SELECT qv.query_id, coalesce(have, 0) AS have FROM qv LEFT JOIN h USING (query_id) WHERE coalesce(have, 0) < 15),
    near AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM de WHERE score >= 0.1) WHERE k <= 60 AND score > 0.1),
    n AS (SELECT near.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM near WHERE NOT EXISTS (SELECT 1 FROM lx WHERE lx.query_id = near.query_id AND lx.doc_id = near.doc_id))
    SELECT query_id, doc_id, round_even(score * 3.0, 6) AS score FROM n JOIN thin USING (query_id) WHERE r <= 30 - have""",
)
def semantic_fill(spark, sf) -> DataFrame:
    vectors, queries = _vectors(spark, sf)
    return r.semantic_fill(_lexical(spark, sf), vectors, queries, 30, least=0.1)


@query(
    "lexical_rescue",
    f"""WITH {BM25}, tags AS (SELECT doc_id, lang AS tag_value FROM d UNION ALL SELECT doc_id, shard FROM d UNION ALL SELECT doc_id, term FROM post WHERE length(term) BETWEEN 10 AND 13),
    th AS (SELECT query_id, source_id, count(*) + max(CASE WHEN ends_with(source_id, '.md') THEN 1 ELSE 0 END) AS s FROM tags JOIN q ON tag_value = term JOIN d USING (doc_id) GROUP BY 1, 2),
    b AS (SELECT query_id, lower(source_id) AS key, source_id, s::DOUBLE AS s, 'tag' AS list, CASE WHEN query_id % 2 = 0 THEN 0 ELSE 1 END AS first FROM th UNION ALL SELECT query_id, lower(source_id), source_id, score, 'text', CASE WHEN query_id % 2 = 0 THEN 1 ELSE 0 END FROM bmr JOIN d USING (doc_id) WHERE rank BETWEEN 4 AND 12),
    k AS (SELECT query_id, lower(source_id) AS key FROM bmr JOIN d USING (doc_id) WHERE rank <= 3), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY first, s DESC) AS r FROM b) WHERE r = 1 AND (query_id, key) NOT IN (SELECT query_id, key FROM k))
    SELECT query_id, source_id, list, row_number() OVER (PARTITION BY query_id ORDER BY first, s DESC, source_id) AS position FROM o""",
)
def lexical_rescue(spark, sf) -> DataFrame:
    paths = m.documents(spark, sf).select("doc_id", "source_id")
    hits = m.tags(spark, sf).join(tiers.terms_side(m.query_terms(spark, sf)), F.col("tag_value") == F.col("term")).join(paths, "doc_id")
    th = hits.groupBy("query_id", "source_id").agg(F.count("*").alias("hits"), F.max(F.when(F.col("source_id").endswith(".md"), 1).otherwise(0)).alias("bonus"))
    bm = tiers.top(_bm25(spark, sf), 12).join(paths, "doc_id")
    return r.lexical_rescue(th, bm.where("rank >= 4").select("query_id", "source_id", "score"), bm.where("rank <= 3"), F.col("query_id") % 2 == 0)


@query(
    "chunk_fetch",
    f"WITH {BM25}, tags AS (SELECT doc_id, lang AS tag_value FROM d UNION ALL SELECT doc_id, shard FROM d UNION ALL SELECT doc_id, term FROM post WHERE length(term) BETWEEN 10 AND 13), h AS (SELECT query_id, doc_id, count(*) AS hits FROM tags JOIN q ON tag_value = term GROUP BY ALL), t AS (SELECT query_id, doc_id, score FROM bm), j AS (SELECT query_id, doc_id, round_even(coalesce(hits, 0) + coalesce(1 / (1 + abs(score)), 0), 6) AS score FROM h FULL JOIN t USING (query_id, doc_id)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM j) WHERE rank <= 5",
)
def chunk_fetch(spark, sf) -> DataFrame:
    terms = m.query_terms(spark, sf)
    tags = m.tags(spark, sf).join(tiers.terms_side(terms.select(F.col("term").alias("tag_value")).distinct()), "tag_value", "left_semi")
    hits = tiers.tag_exact(terms, tiers.by_document(tags, m.lengths(spark, sf).count(), terms), 1.0).withColumnRenamed("score", "hits")
    return r.chunk_fetch(hits, _bm25(spark, sf), 5)


@query("cold_fall_through", f"WITH {BM25}, x AS (SELECT query_id, doc_id, score, lifecycle FROM bmr JOIN d USING (doc_id) WHERE rank <= 10), e AS (SELECT query_id FROM x WHERE lifecycle < 2 GROUP BY 1 HAVING count(*) > 8) SELECT query_id, doc_id, score, 'hot' AS tier FROM x WHERE lifecycle < 2 UNION ALL SELECT query_id, doc_id, score, 'cold' FROM x WHERE lifecycle = 2 AND query_id NOT IN (SELECT query_id FROM e)")
def cold_fall_through(spark, sf) -> DataFrame:
    x = tiers.top(_bm25(spark, sf), 10).join(m.documents(spark, sf).select("doc_id", "lifecycle"), "doc_id")
    return r.cold_fall_through(x.where("lifecycle < 2"), x.where("lifecycle = 2"), 8)


@query(
    "relevance_window",
    rf"""WITH {m.DOCS}, {m.QUERY}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM d), p AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM w),
    h AS (SELECT query_id, doc_id, term, pos FROM p JOIN q USING (term) WHERE length(term) >= 8), s AS (SELECT query_id, doc_id, (pos // 20 - k) * 20 AS start, term FROM h, range(0, 2) r(k) WHERE (pos // 20 - k) * 20 >= 0 AND (pos // 20 - k) * 20 > pos - 40),
    g AS (SELECT query_id, doc_id, start, round_even(sum(1 + least(length(term), 16) / 8.0::DOUBLE), 6) AS weight FROM s GROUP BY ALL) SELECT query_id, doc_id, start::BIGINT AS start, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY weight DESC, start) AS r FROM g) WHERE r = 1""",
)
def relevance_window(spark, sf) -> DataFrame:
    return r.relevance_window(m.documents(spark, sf), m.query_terms(spark, sf).where(F.length("term") >= 8))


@query("source_change_compaction", f"WITH {m.DOCS} SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN least(0.8 - (doc_id % 7) / 10.0, 0.5) ELSE 0.8 - (doc_id % 7) / 10.0 END::DOUBLE AS decay, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE lifecycle END AS lifecycle, doc_id % 6 = 0 AS changed FROM d")
def source_change_compaction(spark, sf) -> DataFrame:
    d = m.documents(spark, sf).withColumn("decay", F.bround(0.8 - (F.col("doc_id") % 7) / 10.0, 6)).withColumn("last_accessed", F.lit(m.NOW))
    return r.source_change_compaction(d, d.select("source_id", (F.lit(m.NOW) + F.when(F.col("doc_id") % 6 == 0, 10.0).otherwise(-10.0)).alias("mtime")))


@query("compaction_sweep", f"WITH {m.TAGS}, t AS (SELECT doc_id, count(*) AS tags FROM tags GROUP BY 1), s AS (SELECT doc_id, lifecycle, CASE WHEN doc_id % 13 = 0 THEN 'skipped_no_vector' WHEN contains(source_id, '/fr/') THEN 'denied' WHEN 0.4 * tags / greatest(n_chars / 1000.0, 1.0) >= 1.0 THEN 'open' WHEN 0.4 * tags / greatest(n_chars / 1000.0, 1.0) >= 0.5 THEN 'warm' ELSE 'cold' END AS reason FROM d JOIN t USING (doc_id) WHERE lifecycle = 0) SELECT reason, count(*) AS n FROM s GROUP BY 1")
def compaction_sweep(spark, sf) -> DataFrame:
    """A dry run of the density gate over open documents: counts by reason."""
    n = m.tags(spark, sf).groupBy("doc_id").agg(F.count("*").alias("tags"))
    d = m.documents(spark, sf).where("lifecycle = 0").join(n, "doc_id")
    score = 0.4 * F.col("tags") / F.greatest(F.col("n_chars") / 1000.0, F.lit(1.0))
    reason = F.when(F.col("doc_id") % 13 == 0, "skipped_no_vector").when(F.col("source_id").contains("/fr/"), "denied").when(score >= 1.0, "open").when(score >= 0.5, "warm").otherwise("cold")
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("eval_risk_coverage", f"WITH {SCORED}, g AS (SELECT score, count(*) AS n, sum(1 - label) AS wrong FROM sc GROUP BY 1), c AS (SELECT sum(n) OVER (ORDER BY score DESC) AS cn, sum(wrong) OVER (ORDER BY score DESC) AS cw, sum(n) OVER () AS total FROM g) SELECT coverage, round_even(min_by(cw, cn) / min(cn)::DOUBLE, 6) AS risk, min(cn)::BIGINT AS n FROM c, (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (1.0)) v(coverage) WHERE cn >= coverage * total GROUP BY 1")
def eval_risk_coverage(spark, sf) -> DataFrame:
    return r.risk_coverage(_scored(spark, sf))


@query("calibration_fit")
def calibration_fit(spark, sf) -> DataFrame:
    """Coefficients of the confidence model over (score, log length); an iterative fit."""
    length = F.log1p(F.length("text").cast("double"))
    rows = m.table(spark, sf, "documents").join(m.table(spark, sf, "labels"), "doc_id").select(F.col("quality").alias("label"), (F.length(F.regexp_replace("text", "[^a-zA-Z ]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("share"), length.alias("length"))
    b = r.calibration(rows, ["share", "length"])
    return spark.createDataFrame([(n, round(v, 4)) for n, v in zip(("intercept", "share", "length"), b, strict=True)], "name string, value double")


@query("packet_items", f"WITH {BM25} SELECT query_id, doc_id, regexp_extract(source_id, '([^/]*)\\.[^.]*$', 1) AS title, substr(content, 1, 280) AS content, round_even(0.4 * (CASE WHEN contains(source_id, '/en/') THEN 1 ELSE 0 END) + 0.6 * (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END), 6)::DOUBLE AS coordinate FROM bmr JOIN d USING (doc_id) WHERE rank <= 3".replace("\\\\", "\\"))
def packet_items(spark, sf) -> DataFrame:
    """Title, excerpt and coordinate confidence of what a packet holds (the excerpt's length is its format)."""
    d = m.documents(spark, sf).select("doc_id", "source_id", "content")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return tiers.top(_bm25(spark, sf), 3).join(d, "doc_id").select("query_id", "doc_id", fx.filename_stem(F.col("source_id")).alias("title"), F.substring("content", 1, 280).alias("content"), fx.round6(0.4 * one(F.col("source_id").contains("/en/")) + 0.6 * one(F.col("doc_id") % 3 == 0)).alias("coordinate"))
