"""Retrieval queries: tiers over the documents for the benchmark texts, fusion, shards, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators import ann, fusion, graph, index, tiers
from marlstone.plans import model as m
from marlstone.registry import query

DEPTH = 16

BM25 = f"""{m.POSTINGS}, {m.QUERY},
dl AS (SELECT doc_id, count(*) FILTER (WHERE term <> '') AS dl FROM tok GROUP BY doc_id),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
hits AS (SELECT post.* FROM post JOIN (SELECT DISTINCT term FROM q) USING (term)),
idf AS (SELECT term, greatest(ln((st.n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM hits, st GROUP BY term, st.n),
bm AS (SELECT query_id, doc_id, round_even(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / st.a))), 6) AS score
  FROM hits JOIN idf USING (term) JOIN dl USING (doc_id) JOIN q USING (term), st GROUP BY query_id, doc_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""


def _bm25(spark, sf):
    return tiers.bm25_of(m.query_terms(spark, sf), m.postings(spark, sf), m.lengths(spark, sf))


@query("bm25_topk", f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bmr WHERE rank <= {DEPTH}")
def bm25_topk(spark, sf) -> DataFrame:
    return tiers.top(_bm25(spark, sf), DEPTH)


@query("bm25_hot_after_limit", f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bmr JOIN d USING (doc_id) WHERE rank <= {DEPTH} AND lifecycle < 2")
def bm25_hot_after_limit(spark, sf) -> DataFrame:
    """The lifecycle filter comes after the depth limit, so a query may get fewer than the depth."""
    hot = m.documents(spark, sf).where("lifecycle < 2").select("doc_id")
    return tiers.top(_bm25(spark, sf), DEPTH).join(hot, "doc_id", "left_semi").select("query_id", "doc_id", "score", "rank")


@query("document_frequency", f"WITH {m.POSTINGS}, {m.QUERY} SELECT term, count(DISTINCT doc_id) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term")
def document_frequency(spark, sf) -> DataFrame:
    terms = tiers.terms_side(m.query_terms(spark, sf).select("term").distinct())
    return index.document_frequency(m.postings(spark, sf).join(terms, "term", "left_semi"), "term")


@query("doc_stats", f"WITH {m.POSTINGS} SELECT doc_id, count(*) FILTER (WHERE term <> '') AS dl FROM tok GROUP BY doc_id")
def doc_stats(spark, sf) -> DataFrame:
    return index.doc_stats(m.documents(spark, sf))


TAGQ = f"{m.TAGS}, {m.QUERY}"


@query("tier_tag_exact", f"WITH {TAGQ} SELECT query_id, doc_id, count(*) * 3.0::DOUBLE AS score FROM tags JOIN q ON tag_value = term GROUP BY ALL")
def tier_tag_exact(spark, sf) -> DataFrame:
    return tiers.tag_exact(m.query_terms(spark, sf), m.tags(spark, sf))


@query(
    "tier_tag_idf",
    f"""WITH {TAGQ}, n AS (SELECT count(*) AS n FROM d), df AS (SELECT tag_value, count(DISTINCT doc_id) AS df FROM tags GROUP BY 1)
    SELECT query_id, doc_id, round_even(sum(ln(n::DOUBLE / df) / ln(n::DOUBLE)) * 3.0, 6) AS score FROM tags JOIN df USING (tag_value) JOIN q ON tag_value = term, n GROUP BY query_id, doc_id""",
)
def tier_tag_idf(spark, sf) -> DataFrame:
    return tiers.tag_idf(m.query_terms(spark, sf), m.tags(spark, sf), m.documents(spark, sf).count())


@query("tier_tag_prefix", f"WITH {TAGQ} SELECT query_id, doc_id, count(*) * 1.5::DOUBLE AS score FROM tags JOIN q ON starts_with(tag_value, term) GROUP BY ALL")
def tier_tag_prefix(spark, sf) -> DataFrame:
    return tiers.tag_prefix(m.query_terms(spark, sf), m.tags(spark, sf))


PARTS = """pt AS (SELECT p_partkey AS doc_id, '/parts/' || lower(replace(p_brand, '#', '')) || '/' || lower(split_part(p_name, ' ', 1)) || '.md' AS source_id,
  lower(p_type) AS p_type, lower(p_name) AS p_name FROM part),
pq AS (SELECT DISTINCT c_custkey % 40 AS query_id, unnest(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || replace(p_brand, '#', '')), '[^\\p{L}\\p{N}]+')) AS term
  FROM part JOIN customer ON p_partkey = c_custkey)"""


def _parts(spark, sf) -> DataFrame:
    """Parts as documents with a path and words; they stand in for a code base with many keys."""
    p = m.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("doc_id"),
        F.concat(F.lit("/parts/"), F.lower(F.translate("p_brand", "#", "")), F.lit("/"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(".md")).alias("source_id"),
        F.array_distinct(fx.tokens(F.col("p_type"))).alias("keys"), fx.tokens(F.col("p_name")).alias("words"),
    )


def _part_terms(spark, sf) -> DataFrame:
    p = m.table(spark, sf, "part").join(m.table(spark, sf, "customer"), F.col("p_partkey") == F.col("c_custkey"))
    words = fx.tokens(F.concat_ws(" ", "p_name", "p_type", F.translate("p_brand", "#", "")))
    return p.select((F.col("c_custkey") % 40).alias("query_id"), F.explode(words).alias("term")).distinct()


PK = f"""{PARTS}, pk AS (SELECT DISTINCT doc_id, path_token, kv_key FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(source_id, '[^\\p{{L}}\\p{{N}}]+'))) AS path_token, p_type FROM pt),
  unnest(regexp_split_to_array(p_type, '[^\\p{{L}}\\p{{N}}]+')) u(kv_key) WHERE length(path_token) >= 2 AND path_token NOT IN ('src', 'lib', 'data', 'docs', 'test', 'tests', 'home', 'users', 'tmp', 'index', 'main', 'init') AND kv_key <> '')"""


@query(
    "tier_path_key",
    f"""WITH {PK}, c AS (SELECT path_token, kv_key, count(*) AS card FROM pk GROUP BY ALL HAVING count(*) <= 200)
    SELECT a.query_id, doc_id, round_even(least(sum(10.0::DOUBLE / greatest(card, 2)), 12.0), 6) AS score FROM pk JOIN c USING (path_token, kv_key)
    JOIN pq a ON a.term = path_token JOIN pq b ON b.term = kv_key AND a.query_id = b.query_id GROUP BY 1, 2""",
)
def tier_path_key(spark, sf) -> DataFrame:
    return tiers.path_key(_part_terms(spark, sf), index.path_keys(_parts(spark, sf)))


@query(
    "path_key_compaction",
    f"WITH {PK} SELECT doc_id, path_token, kv_key FROM (SELECT *, count(*) OVER (PARTITION BY path_token, kv_key) AS c FROM pk) WHERE c <= 200",
)
def path_key_compaction(spark, sf) -> DataFrame:
    return index.compact_path_keys(index.path_keys(_parts(spark, sf)), 200).select("doc_id", "path_token", "kv_key")


@query(
    "tier_filename_anchor",
    f"""WITH {PARTS}, few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term) AS r FROM pq WHERE term <> '') WHERE r <= 64)
    SELECT query_id, doc_id, count(*) * 4.0::DOUBLE AS score FROM pt JOIN few ON regexp_extract(source_id, '([^/]*)\\.[^.]*$', 1) = term GROUP BY ALL""",
)
def tier_filename_anchor(spark, sf) -> DataFrame:
    return tiers.filename_anchor(_part_terms(spark, sf), index.filenames(_parts(spark, sf)))


SPARSE = f"""{m.POSTINGS}, {m.QUERY}, v AS (SELECT doc_id, term, ln(1 + tf) AS weight FROM post), qw AS (SELECT query_id, term, 1 + least(length(term), 16) / 8.0::DOUBLE AS q FROM q)"""


def _sparse(spark, sf):
    vectors = m.postings(spark, sf).select("doc_id", "term", F.log1p(F.col("tf").cast("double")).alias("weight"))
    return vectors, m.query_terms(spark, sf).withColumn("q", fx.term_weight(F.col("term")))


@query(
    "tier_sparse",
    f"""WITH {SPARSE}, s AS (SELECT query_id, doc_id, sum(weight * q) AS s FROM v JOIN qw USING (term) GROUP BY ALL HAVING sum(weight * q) > 0.01),
    r AS (SELECT query_id, doc_id, round_even(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round_even(s, 6) DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 50""",
)
def tier_sparse(spark, sf) -> DataFrame:
    vectors, terms = _sparse(spark, sf)
    return tiers.top(tiers.sparse(terms, vectors), 50)


@query(
    "tier_sparse_df_cap",
    f"""WITH {SPARSE}, n AS (SELECT count(*) AS n FROM d), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM v GROUP BY term),
    ok AS (SELECT qw.*, coalesce(df::DOUBLE / n, 0) <= 0.05 AS ok FROM qw LEFT JOIN df USING (term), n), kept AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM ok) WHERE ok OR NOT any_ok)
    SELECT query_id, doc_id, round_even(sum(weight * q), 6) AS score FROM v JOIN kept USING (term) GROUP BY query_id, doc_id HAVING sum(weight * q) > 0.01""",
)
def tier_sparse_df_cap(spark, sf) -> DataFrame:
    vectors, terms = _sparse(spark, sf)
    return tiers.sparse(terms, vectors, most_df=0.05, total=m.documents(spark, sf).count())


def _anchor(spark, sf):
    return tiers.lexical_anchor(m.query_terms(spark, sf), m.postings(spark, sf), m.documents(spark, sf).count())


ANCHOR = """an AS (SELECT query_id, doc_id, round_even(sum(boost), 6) AS score FROM (SELECT term, least(1.5 * ln(greatest(n, 100)::DOUBLE / count(*)), 3.0) AS boost
  FROM post, (SELECT count(*) AS n FROM d) WHERE term IN (SELECT term FROM q) GROUP BY term, n) JOIN post USING (term) JOIN q USING (term) WHERE boost > 1 GROUP BY query_id, doc_id)"""


@query("tier_lexical_anchor", f"WITH {m.POSTINGS}, {m.QUERY}, {ANCHOR} SELECT * FROM an")
def tier_lexical_anchor(spark, sf) -> DataFrame:
    return _anchor(spark, sf)


AUTH = f"""au AS (SELECT query_id, doc_id, CASE WHEN list_bool_or(list_transform(terms, lambda t: contains(lower(source_id), t))) THEN 2.0 ELSE 0.0 END
  + CASE WHEN list_has_any([lang, shard], terms) THEN 1.5 ELSE 0.0 END + CASE WHEN {m.NOW} - created_at < 172800 THEN 0.5 ELSE 0.0 END AS score
  FROM (SELECT query_id, doc_id FROM bmr WHERE rank <= {DEPTH}) c JOIN d USING (doc_id) JOIN (SELECT query_id, list(DISTINCT term) AS terms FROM q GROUP BY 1) USING (query_id))"""


def _authority(spark, sf, candidates):
    docs = m.documents(spark, sf).select("doc_id", "source_id", F.array("lang", "shard").alias("domains"), "created_at")
    return tiers.authority(candidates, m.query_terms(spark, sf), docs, m.NOW)


@query("tier_authority", f"WITH {BM25}, {AUTH} SELECT query_id, doc_id, score::DOUBLE AS score FROM au WHERE score > 0")
def tier_authority(spark, sf) -> DataFrame:
    return _authority(spark, sf, tiers.top(_bm25(spark, sf), DEPTH))


ACCESS = f"{m.LOG}, top_ev AS (SELECT max(ts) AS now FROM ev)"


@query(
    "tier_access_rate",
    f"""WITH {BM25}, {ACCESS}, n AS (SELECT doc_id, count(*) AS n FROM ev, top_ev WHERE ts > now - 86400 AND ts <= now GROUP BY 1)
    SELECT query_id, doc_id, round_even(least(n, 5) * 0.05::DOUBLE, 6) AS score FROM bmr JOIN n USING (doc_id) WHERE rank <= 200""",
)
def tier_access_rate(spark, sf) -> DataFrame:
    log = m.query_log(spark, sf)
    return tiers.access_rate(tiers.top(_bm25(spark, sf), 200), log, log.agg(F.max("ts")).first()[0], window=86400.0)


@query(
    "tier_entity_graph",
    f"WITH {BM25}, ent AS (SELECT doc_id, term FROM post WHERE length(term) BETWEEN 10 AND 13) SELECT query_id, doc_id, count(*) * 0.5::DOUBLE AS score FROM bmr JOIN ent USING (doc_id) JOIN q USING (query_id, term) WHERE rank <= 100 GROUP BY ALL",
)
def tier_entity_graph(spark, sf) -> DataFrame:
    entities = m.tags(spark, sf).where("tag_type = 'entity'").select("doc_id", F.col("tag_value").alias("entity"))
    return tiers.entity_graph(tiers.top(_bm25(spark, sf), 100), entities, m.query_terms(spark, sf))


CAND = "cand AS (SELECT DISTINCT o_custkey % 50 AS query_id, l_partkey AS doc_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _candidates(spark, sf):
    o = m.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("query_id"))
    return m.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("query_id", F.col("l_partkey").alias("doc_id")).distinct()


@query(
    "tier_edge_boost",
    f"""WITH {m.EDGES}, {CAND}, e AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)
    SELECT x.query_id, x.doc_id, least(count(*) * 1.0::DOUBLE, 3.0) AS score FROM cand x JOIN e ON e.a = x.doc_id JOIN cand y ON y.query_id = x.query_id AND y.doc_id = e.b GROUP BY 1, 2""",
)
def tier_edge_boost(spark, sf) -> DataFrame:
    return tiers.edge_boost(_candidates(spark, sf), m.edges(spark, sf))


@query(
    "tenant_visibility",
    """SELECT p_partkey AS doc_id, o.party_id FROM part LEFT JOIN (SELECT l_partkey, min(c_nationkey) AS party_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON p_partkey = l_partkey WHERE party_id = 3 OR party_id IS NULL""",
)
def tenant_visibility(spark, sf) -> DataFrame:
    orders = m.table(spark, sf, "orders").join(m.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    owned = m.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("doc_id")).agg(F.min("c_nationkey").alias("party_id"))
    return tiers.visible(m.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id")), owned, 3).select("doc_id", "party_id")


# --- vectors ----------------------------------------------------------------------------------

QV = "qv AS (SELECT vec_id AS query_id, embedding AS q, label AS qlabel FROM embeddings WHERE vec_id % 100 = 0)"
COS = "round_even(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 6)"
DENSE = f"{QV}, de AS (SELECT query_id, vec_id AS doc_id, {COS} AS score FROM embeddings, qv), der AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM de)"


def _vectors(spark, sf):
    v = m.table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("doc_id"), "embedding"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("dense_topk", f"WITH {DENSE} SELECT query_id, doc_id, score, rank FROM der WHERE rank <= 10")
def dense_topk(spark, sf) -> DataFrame:
    vectors, queries = _vectors(spark, sf)
    return tiers.dense(queries, vectors, 10)


@query("dense_floor", f"WITH {DENSE} SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM de WHERE score >= 0.15) WHERE rank <= 3")
def dense_floor(spark, sf) -> DataFrame:
    """The cold-tier search: best three above a floor."""
    vectors, queries = _vectors(spark, sf)
    return tiers.dense(queries, vectors, 3, least=0.15)


@query(
    "ann_gate",
    f"""WITH {DENSE}, lex AS (SELECT query_id, doc_id FROM de WHERE (query_id + doc_id) % 37 = 0), dn AS (SELECT query_id, doc_id, score FROM der WHERE rank <= 20),
    u AS (SELECT coalesce(l.query_id, n.query_id) AS query_id, coalesce(l.doc_id, n.doc_id) AS doc_id, round_even(coalesce(score, 0.3 - 0.01), 6) AS score, score IS NOT NULL AS is_dense FROM lex l FULL JOIN dn n ON l.query_id = n.query_id AND l.doc_id = n.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u),
    k AS (SELECT *, (score >= 0.3 OR rank <= 3) AND rank <= 12 AS kept FROM r),
    h AS (SELECT *, sum((kept AND is_dense)::INT) OVER (PARTITION BY query_id) AS have, row_number() OVER (PARTITION BY query_id, kept, is_dense ORDER BY rank) AS spare FROM k)
    SELECT query_id, doc_id, score, rank, NOT kept AS appended FROM h WHERE kept OR (is_dense AND spare <= 8 - have)""",
)
def ann_gate(spark, sf) -> DataFrame:
    vectors, queries = _vectors(spark, sf)
    asked = queries.select("query_id", F.pmod(-F.col("query_id"), F.lit(37)).alias("rest"))
    lexical = vectors.select("doc_id", F.pmod("doc_id", F.lit(37)).alias("rest")).join(tiers.terms_side(asked), "rest").select("query_id", "doc_id")
    return fusion.gate(fusion.union_pinned(lexical, tiers.dense(queries, vectors, 20), 0.3), 0.3, 3, 12, 8)

#: A query's vector is that of its own number; the lexical pool are its best twenty by BM25.
LED = f"""qv AS (SELECT item_id AS query_id, embedding AS q FROM benchmark JOIN embeddings ON vec_id = item_id), de AS (SELECT query_id, vec_id AS doc_id, {COS} AS score FROM embeddings, qv),
    dn AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM de) WHERE rank <= 20), lex AS (SELECT query_id, doc_id FROM bmr WHERE rank <= 20)"""
GATE = """u AS (SELECT coalesce(l.query_id, n.query_id) AS query_id, coalesce(l.doc_id, n.doc_id) AS doc_id, round_even(coalesce(score, 0.3 - 0.01), 6) AS score, score IS NOT NULL AS is_dense FROM lex l FULL JOIN dn n ON l.query_id = n.query_id AND l.doc_id = n.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u),
    k AS (SELECT *, (score >= 0.3 OR rank <= 3) AND rank <= 12 AS kept FROM r),
    h AS (SELECT *, sum((kept AND is_dense)::INT) OVER (PARTITION BY query_id) AS have, row_number() OVER (PARTITION BY query_id, kept, is_dense ORDER BY rank) AS spare FROM k)
    SELECT query_id, doc_id, score, rank, NOT kept AS appended FROM h WHERE kept OR (is_dense AND spare <= 8 - have)"""


@query("ann_topk", f"WITH {DENSE} SELECT query_id, doc_id, score, rank FROM der WHERE rank <= 10")
def ann_topk(spark, sf) -> DataFrame:
    """The nearest ten by the inverted file, its exact way."""
    vectors, queries = _vectors(spark, sf)
    return ann.search(queries, ann.build(vectors), 10, exact=True)


@query("ann_led", f"WITH {BM25}, {LED}, {GATE}")
def ann_led(spark, sf) -> DataFrame:
    """Lexical and dense recall side by side, united, gated by the threshold."""
    vectors, _ = _vectors(spark, sf)
    queries = vectors.join(m.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    lexical = tiers.top(_bm25(spark, sf), 20).select("query_id", "doc_id")
    return fusion.gate(fusion.union_pinned(lexical, ann.search(queries, ann.build(vectors), 20, exact=True), 0.3), 0.3, 3, 12, 8)


# --- fusion -----------------------------------------------------------------------------------

TIERS = f"""tx AS (SELECT query_id, doc_id, count(*) * 3.0::DOUBLE AS score FROM tags JOIN q ON tag_value = term GROUP BY ALL)"""
FUSED = f"""{BM25}, tags AS (SELECT doc_id, lang AS tag_value FROM d UNION ALL SELECT doc_id, shard FROM d UNION ALL SELECT doc_id, term FROM post WHERE length(term) BETWEEN 10 AND 13), {TIERS}, {ANCHOR},
bt AS (SELECT query_id, doc_id, score, rank FROM bmr WHERE rank <= 100),
txr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM tx),
anr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM an),
ids AS (SELECT query_id, doc_id FROM bt UNION SELECT query_id, doc_id FROM tx UNION SELECT query_id, doc_id FROM an),
fused AS (SELECT query_id, doc_id, round_even(coalesce(1.0::DOUBLE / (60 + bt.rank), 0) + coalesce(1.0::DOUBLE / (60 + txr.rank), 0) + coalesce(0.5::DOUBLE / (60 + anr.rank), 0), 6) AS score
  FROM ids LEFT JOIN bt USING (query_id, doc_id) LEFT JOIN txr USING (query_id, doc_id) LEFT JOIN anr USING (query_id, doc_id))"""


def _tiers(spark, sf) -> dict[str, DataFrame]:
    terms = m.query_terms(spark, sf)
    return {
        "fulltext": tiers.top(_bm25(spark, sf), 100).select("query_id", "doc_id", "score"),
        "tag": tiers.tag_exact(terms, m.tags(spark, sf)),
        "anchor": _anchor(spark, sf),
    }


WEIGHTS = {"fulltext": 1.0, "tag": 1.0, "anchor": 0.5}


def _fused(spark, sf) -> DataFrame:
    return fusion.rrf(_tiers(spark, sf), WEIGHTS)


@query("fusion_rrf", f"WITH {FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 12")
def fusion_rrf(spark, sf) -> DataFrame:
    return tiers.top(_fused(spark, sf), 12)


@query(
    "fusion_rrf_gated",
    f"""WITH {FUSED}, g AS (SELECT query_id, doc_id, round_even(coalesce(1.0::DOUBLE / (60 + bt.rank), 0) + coalesce(1.0::DOUBLE / (60 + txr.rank), 0), 6) AS score
    FROM (SELECT query_id, doc_id FROM bt WHERE rank <= 20 AND score >= 2 UNION SELECT query_id, doc_id FROM txr WHERE rank <= 20 AND score >= 2) LEFT JOIN (SELECT * FROM bt WHERE rank <= 20 AND score >= 2) bt USING (query_id, doc_id)
    LEFT JOIN (SELECT * FROM txr WHERE rank <= 20 AND score >= 2) txr USING (query_id, doc_id)) SELECT * FROM g""",
)
def fusion_rrf_gated(spark, sf) -> DataFrame:
    """Only the first 20 ranks and scores of two or more count; a tier of weight zero has no effect."""
    return fusion.rrf(_tiers(spark, sf), {"anchor": 0.0}, top_m=20, least=2.0)


@query(
    "fusion_additive",
    f"WITH {FUSED} SELECT query_id, doc_id, round_even(coalesce(least(bt.score * 1.0, 6.0), 0) + coalesce(tx.score, 0) + coalesce(an.score, 0), 6) AS score FROM ids LEFT JOIN bt USING (query_id, doc_id) LEFT JOIN tx USING (query_id, doc_id) LEFT JOIN an USING (query_id, doc_id)",
)
def fusion_additive(spark, sf) -> DataFrame:
    return fusion.additive(_tiers(spark, sf), {"fulltext": (1.0, 6.0)})


@query(
    "rerank_additive",
    f"WITH {FUSED}, {AUTH} SELECT query_id, doc_id, round_even(fused.score + coalesce(au.score, 0), 6) AS score FROM fused LEFT JOIN (SELECT * FROM au WHERE score > 0) au USING (query_id, doc_id)",
)
def rerank_additive(spark, sf) -> DataFrame:
    return fusion.combine_additive(_fused(spark, sf), {"authority": _authority(spark, sf, tiers.top(_bm25(spark, sf), DEPTH))})


@query(
    "rerank_fused_tier",
    f"""WITH {FUSED}, {AUTH}, aur AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM au WHERE score > 0)
    SELECT query_id, doc_id, round_even(fused.score + coalesce(1.0::DOUBLE / (60 + aur.rank), 0), 6) AS score FROM fused LEFT JOIN aur USING (query_id, doc_id)""",
)
def rerank_fused_tier(spark, sf) -> DataFrame:
    return fusion.combine_tiers(_fused(spark, sf), {"authority": _authority(spark, sf, tiers.top(_bm25(spark, sf), DEPTH))})


@query("rerank_eps_band")
def rerank_eps_band(spark, sf) -> DataFrame:
    """Near ties of the fused list reordered by the authority bonus: a fold, which SQL can't express plainly."""
    fused = tiers.top(_fused(spark, sf), 50)
    bonus = _authority(spark, sf, fused).withColumnRenamed("score", "bonus")
    return fusion.eps_band(fused.join(bonus, ["query_id", "doc_id"], "left").fillna({"bonus": 0.0}), 0.05)


@query(
    "shortlist_filter",
    f"""WITH {FUSED}, s AS (SELECT query_id, doc_id FROM bmr WHERE rank <= 50), ok AS (SELECT f.* FROM fused f SEMI JOIN s ON f.query_id = s.query_id AND f.doc_id = s.doc_id)
    SELECT * FROM ok UNION ALL SELECT * FROM fused WHERE query_id NOT IN (SELECT query_id FROM ok)""",
)
def shortlist_filter(spark, sf) -> DataFrame:
    """Fused documents among the 50 best by full text; all of a query's where none is.

    Only the shortlist's ranks in the other tiers are counted. What is fused whole are queries without a shortlist.
    """
    terms = m.query_terms(spark, sf)
    best = graph.checkpointed(tiers.top(_bm25(spark, sf), 100).select("query_id", "doc_id", "score", "rank"))
    short = best.where("rank <= 50").select("query_id", "doc_id", "rank")
    rest = graph.checkpointed(terms.join(short.select("query_id").distinct(), "query_id", "left_anti"))
    total = m.documents(spark, sf).count()
    others = lambda asked: {"tag": tiers.tag_exact(asked, m.tags(spark, sf)), "anchor": tiers.lexical_anchor(asked, m.postings(spark, sf), total)}
    found = fusion.by_ranks({"fulltext": short} | {n: fusion.ranks_of(t, short) for n, t in others(terms).items()}, WEIGHTS)
    if rest.isEmpty():
        return found
    listed = best.join(rest.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "doc_id", "score")
    return found.union(fusion.rrf({"fulltext": listed} | others(rest), WEIGHTS))


@query(
    "flagship_retrieval",
    f"""WITH {FUSED}, {AUTH}, t AS (SELECT query_id, doc_id, round_even(fused.score + coalesce(au.score, 0) * 0.01, 6) AS score FROM fused JOIN d USING (doc_id) LEFT JOIN (SELECT * FROM au WHERE score > 0) au USING (query_id, doc_id) WHERE lifecycle < 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM t) SELECT query_id, doc_id, score, rank, source_id, n_chars FROM r JOIN d USING (doc_id) WHERE rank <= 8""",
)
def flagship_retrieval(spark, sf) -> DataFrame:
    """Full text, tags and rare terms fused, authority added, hot documents only; bodies are joined last."""
    docs = m.documents(spark, sf)
    fused = _fused(spark, sf)
    bonus = _authority(spark, sf, tiers.top(_bm25(spark, sf), DEPTH)).withColumnRenamed("score", "bonus")
    hot = docs.where("lifecycle < 2").select("doc_id")
    scored = fused.join(hot, "doc_id", "left_semi").join(bonus, ["query_id", "doc_id"], "left").select("query_id", "doc_id", fx.round6(F.col("score") + F.coalesce("bonus", F.lit(0.0)) * 0.01).alias("score"))
    return tiers.top(scored, 8).join(docs.select("doc_id", "source_id", "n_chars"), "doc_id").select("query_id", "doc_id", "score", "rank", "source_id", "n_chars")


SHARDS = f"""{BM25}, ct AS (SELECT shard, term, count(DISTINCT doc_id) AS n FROM hits JOIN d USING (doc_id) GROUP BY ALL), tot AS (SELECT shard, count(*) AS N FROM d GROUP BY 1), gt AS (SELECT sum(N) AS gN FROM tot),
g AS (SELECT term, greatest(ln((gN - sum(n) + 0.5) / (sum(n) + 0.5)), 1e-6) AS g FROM ct, gt GROUP BY term, gN),
l AS (SELECT ct.shard, term, greatest(ln((tot.N - ct.n + 0.5) / (ct.n + 0.5)), 1e-6) AS l FROM ct JOIN tot USING (shard)),
fa AS (SELECT query_id, shard, round_even(least(greatest(sum(g * g / l) / sum(g), 0.5), 3.0), 6) AS factor FROM q JOIN l USING (term) JOIN g USING (term) GROUP BY ALL)"""


def _by_shard(spark, sf):
    docs = m.documents(spark, sf).select("doc_id", "shard")
    terms = tiers.terms_side(m.query_terms(spark, sf).select("term").distinct())
    counts = m.postings(spark, sf).join(terms, "term", "left_semi").join(docs, "doc_id").groupBy("shard", "term").agg(F.countDistinct("doc_id").alias("n"))
    return counts, docs.groupBy("shard").agg(F.count("*").alias("total"))


@query("shard_idf_correction", f"WITH {SHARDS} SELECT * FROM fa")
def shard_idf_correction(spark, sf) -> DataFrame:
    counts, totals = _by_shard(spark, sf)
    return fusion.shard_correction(m.query_terms(spark, sf), counts, totals)


@query("global_idf", f"WITH {SHARDS} SELECT term, round_even(g, 6) AS idf FROM g")
def global_idf(spark, sf) -> DataFrame:
    counts, totals = _by_shard(spark, sf)
    n = F.col("n")
    every = counts.groupBy("term").agg(F.sum("n").alias("n")).join(F.broadcast(totals.agg(F.sum("total").alias("total"))))
    return every.select("term", fx.round6(F.greatest(F.log((F.col("total") - n + 0.5) / (n + 0.5)), F.lit(1e-6))).alias("idf"))


@query(
    "shard_merge",
    f"""WITH {SHARDS}, s AS (SELECT query_id, doc_id, shard, round_even(score * factor, 6) AS score FROM bm JOIN d USING (doc_id) JOIN fa USING (query_id, shard)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, doc_id) AS rs FROM s), g2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE rs <= 5)
    SELECT query_id, doc_id, shard, score, rank FROM g2 WHERE rank <= 12""",
)
def shard_merge(spark, sf) -> DataFrame:
    """Each shard's five best after its idf correction, then the twelve best of all."""
    counts, totals = _by_shard(spark, sf)
    factor = fusion.shard_correction(m.query_terms(spark, sf), counts, totals)
    shards = m.documents(spark, sf).select("doc_id", "shard")
    scored = _bm25(spark, sf).join(shards, "doc_id").join(factor, ["query_id", "shard"]).withColumn("score", fx.round6(F.col("score") * F.col("factor")))
    own = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), F.asc("doc_id")))
    best = fusion.best_of_shards(scored.withColumn("r", own).where("r <= 5"))
    return tiers.top(best, 12).select("query_id", "doc_id", "shard", "score", "rank")


@query(
    "shard_routing",
    f"WITH {m.TAGS}, {m.QUERY} SELECT query_id, shard, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, shard) AS position FROM (SELECT query_id, d.shard, count(*) AS hits FROM tags JOIN q ON tag_value = term JOIN d USING (doc_id) GROUP BY ALL)",
)
def shard_routing(spark, sf) -> DataFrame:
    hits = m.tags(spark, sf).join(tiers.terms_side(m.query_terms(spark, sf)), F.col("tag_value") == F.col("term")).join(m.documents(spark, sf).select("doc_id", "shard"), "doc_id")
    g = hits.groupBy("query_id", "shard").agg(F.count("*").alias("hits"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), F.asc("shard"))))


@query(
    "subquery_merge",
    f"""WITH {BM25}, s AS (SELECT query_id // 4 AS query_id, query_id AS sub_id, doc_id, score FROM bmr WHERE rank <= 10), g3 AS (SELECT query_id, doc_id, count(DISTINCT sub_id) AS hit_count, max(score) AS score FROM s GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, score DESC, doc_id) AS position FROM g3""",
)
def subquery_merge(spark, sf) -> DataFrame:
    subs = tiers.top(_bm25(spark, sf), 10).select(F.floor(F.col("query_id") / 4).alias("query_id"), F.col("query_id").alias("sub_id"), "doc_id", "score")
    return fusion.subquery_merge(subs)


@query(
    "blend_refiners",
    f"""WITH {FUSED} SELECT query_id, doc_id, round_even(score + least(((doc_id % 7) / 10.0)::DOUBLE, 0.5) + least((doc_id % 3)::DOUBLE, 1.5), 9) AS legacy,
    round_even(score * (1 + least(((doc_id % 7) / 10.0)::DOUBLE, 0.5) / 10) * (1 + least((doc_id % 3)::DOUBLE, 1.5) / 10), 9) AS relative FROM fused""",
)
def blend_refiners(spark, sf) -> DataFrame:
    rows = _fused(spark, sf).withColumn("spectrum", (F.col("doc_id") % 7) / 10.0).withColumn("bins", (F.col("doc_id") % 3).cast("double"))
    caps = {"spectrum": 0.5, "bins": 1.5}
    a = fusion.blend(rows, caps).select("query_id", "doc_id", F.col("score").alias("legacy"))
    return a.join(fusion.blend(rows, caps, "scale_relative").select("query_id", "doc_id", F.col("score").alias("relative")), ["query_id", "doc_id"])
