"""Write-side queries: upserts, merges, deletes, chunking, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators import maintenance as mt
from marlstone.operators import tiers
from marlstone.plans import model as m
from marlstone.plans.retrieval import BM25, _bm25
from marlstone.registry import query


@query(
    "document_upsert",
    """WITH b AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, o_totalprice AS value, CASE WHEN o_orderdate < DATE '1996-01-01' THEN 0 ELSE 1 END AS fresh FROM orders)
    SELECT doc_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fresh DESC, seq DESC) AS r FROM b) WHERE r = 1""",
)
def document_upsert(spark, sf) -> DataFrame:
    o = m.table(spark, sf, "orders")
    row = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"), "o_orderdate")
    cut = F.lit("1996-01-01").cast("date")
    return mt.upsert(row.where(F.col("o_orderdate") < cut).drop("o_orderdate"), row.where(F.col("o_orderdate") >= cut).drop("o_orderdate"), ["doc_id"], "seq")


@query("content_dedup_last_source", f"WITH {m.DOCS} SELECT doc_hash, doc_id, source_id FROM (SELECT substr(sha256(content), 1, 16) AS doc_hash, doc_id, source_id, row_number() OVER (PARTITION BY sha256(content) ORDER BY doc_id DESC) AS r FROM d) WHERE r = 1")
def content_dedup_last_source(spark, sf) -> DataFrame:
    """Identical contents collapse under their hash id; the last source wins (max_by combines before its shuffle)."""
    d = m.documents(spark, sf).select(F.substring(F.sha2("content", 256), 1, 16).alias("doc_hash"), F.sha2("content", 256).alias("h"), "doc_id", "source_id")
    return d.groupBy("h", "doc_hash").agg(F.max("doc_id").alias("doc_id"), F.max_by("source_id", "doc_id").alias("source_id")).drop("h")


SNAP = """st AS (SELECT doc_id, text AS content, (doc_id * 7 % 1000)::DOUBLE AS last_accessed FROM documents WHERE doc_id % 3 <> 0),
sn AS (SELECT doc_id, text AS content, CASE WHEN doc_id % 10 = 0 THEN 'bad' ELSE sha256(text) END AS content_hash, (doc_id * 11 % 1000)::DOUBLE AS last_accessed FROM documents WHERE doc_id % 2 = 0)"""


def _snapshots(spark, sf):
    d = m.table(spark, sf, "documents")
    a = d.where("doc_id % 3 <> 0").select("doc_id", F.col("text").alias("content"), (F.col("doc_id") * 7 % 1000).cast("double").alias("last_accessed"))
    b = d.where("doc_id % 2 = 0").select("doc_id", F.col("text").alias("content"), F.when(F.col("doc_id") % 10 == 0, "bad").otherwise(F.sha2("text", 256)).alias("content_hash"), (F.col("doc_id") * 11 % 1000).cast("double").alias("last_accessed"))
    return a, b


@query(
    "snapshot_merge_newest",
    f"""WITH {SNAP}, g AS (SELECT * FROM sn WHERE sha256(content) = content_hash), j AS (SELECT coalesce(st.doc_id, g.doc_id) AS doc_id, st.last_accessed AS t1, g.last_accessed AS t2, coalesce(st.last_accessed IS NULL OR g.last_accessed > st.last_accessed, false) AS take FROM st FULL JOIN g ON st.doc_id = g.doc_id)
    SELECT doc_id, CASE WHEN take THEN t2 ELSE t1 END AS last_accessed, CASE WHEN take AND t1 IS NULL THEN 'added' WHEN take THEN 'replaced' WHEN t2 IS NOT NULL THEN 'skipped' ELSE 'kept' END AS outcome FROM j""",
)
def snapshot_merge_newest(spark, sf) -> DataFrame:
    return mt.snapshot_merge(*_snapshots(spark, sf), "newest").select("doc_id", "last_accessed", "outcome")


@query("snapshot_merge_report", f"WITH {SNAP}, g AS (SELECT * FROM sn WHERE sha256(content) = content_hash) SELECT CASE WHEN st.doc_id IS NULL THEN 'added' WHEN g.doc_id IS NULL THEN 'kept' ELSE 'skipped' END AS outcome, count(*) AS n FROM st FULL JOIN g ON st.doc_id = g.doc_id GROUP BY 1")
def snapshot_merge_report(spark, sf) -> DataFrame:
    return mt.snapshot_merge(*_snapshots(spark, sf), "skip_existing").groupBy("outcome").agg(F.count("*").alias("n"))


@query("snapshot_diff", f"WITH {SNAP} SELECT count(*) FILTER (WHERE st.doc_id IS NOT NULL AND sn.doc_id IS NOT NULL) AS shared, count(*) FILTER (WHERE sn.doc_id IS NULL) AS only_left, count(*) FILTER (WHERE st.doc_id IS NULL) AS only_right FROM st FULL JOIN sn ON st.doc_id = sn.doc_id")
def snapshot_diff(spark, sf) -> DataFrame:
    return mt.snapshot_diff(*_snapshots(spark, sf))


@query("edge_upsert", f"WITH {m.EDGES}, u AS (SELECT a, b, weight, 0 AS p FROM edges UNION ALL SELECT a, b + 1, weight + 10, 1 FROM edges WHERE a % 3 = 0) SELECT a, b, arg_max(weight, p) AS weight FROM u GROUP BY a, b")
def edge_upsert(spark, sf) -> DataFrame:
    e = m.edges(spark, sf)
    return mt.merge_edges(e, e.where("a % 3 = 0").select("a", (F.col("b") + 1).alias("b"), (F.col("weight") + 10).alias("weight")))


@query("delete_cascade", f"WITH {m.EDGES} SELECT a, b, weight FROM edges WHERE a % 17 <> 0 AND b % 17 <> 0")
def delete_cascade(spark, sf) -> DataFrame:
    gone = m.table(spark, sf, "part").where("p_partkey % 17 = 0").select(F.col("p_partkey").alias("doc_id"))
    return mt.delete_cascade(gone, m.edges(spark, sf))


@query("orphan_sweep", f"WITH {m.POSTINGS} SELECT doc_id, count(*) AS n FROM post WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def orphan_sweep(spark, sf) -> DataFrame:
    return mt.orphans(m.postings(spark, sf), m.table(spark, sf, "labels")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    "symbol_graph",
    "SELECT DISTINCT r.l_linenumber + r.l_orderkey * 10 AS a, d.l_linenumber + d.l_orderkey * 10 AS b FROM lineitem r JOIN lineitem d ON r.l_orderkey = d.l_orderkey AND r.l_suppkey % 20 = d.l_partkey % 20 WHERE r.l_linenumber <> d.l_linenumber",
)
def symbol_graph(spark, sf) -> DataFrame:
    """Lines of an order as chunks of a source: a line names symbol l_suppkey % 20 and defines l_partkey % 20."""
    li = m.table(spark, sf, "lineitem")
    chunk = (F.col("l_linenumber") + F.col("l_orderkey") * 10).alias("doc_id")
    return mt.symbol_edges(li.select(F.col("l_orderkey").alias("source_id"), (F.col("l_partkey") % 20).alias("symbol"), chunk), li.select(F.col("l_orderkey").alias("source_id"), (F.col("l_suppkey") % 20).alias("symbol"), chunk))


@query(
    "touch_documents",
    f"WITH {m.DOCS}, {m.LOG}, a AS (SELECT doc_id, count(*) AS n, max(ts) AS last FROM ev GROUP BY 1) SELECT d.doc_id, access_count + coalesce(n, 0) AS access_count, last AS last_accessed, round_even(least(1.0, 0.5 + 0.1::DOUBLE * coalesce(n, 0)), 6)::DOUBLE AS decay, least(coalesce(n, 0), 100)::INT AS recent, CASE WHEN n > 0 THEN 0 ELSE lifecycle END AS lifecycle FROM d LEFT JOIN a ON a.doc_id = d.doc_id",
)
def touch_documents(spark, sf) -> DataFrame:
    return mt.touched(m.documents(spark, sf).withColumn("decay", F.lit(0.5)), m.query_log(spark, sf))


@query("store_stats", f"WITH {m.DOCS}, g AS (SELECT lifecycle, count(*) AS documents, sum(length(content))::BIGINT AS chars, count(*) FILTER (WHERE length(content) = 0) AS empty FROM d GROUP BY 1) SELECT *, round_even(chars / sum(chars) OVER ()::DOUBLE, 6) AS share FROM g")
def store_stats(spark, sf) -> DataFrame:
    return mt.store_stats(m.documents(spark, sf))


@query("reassemble_documents", "SELECT conv_id AS parent, count(*) AS chunks, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def reassemble_documents(spark, sf) -> DataFrame:
    return mt.reassemble(m.table(spark, sf, "conversations").select(F.col("conv_id").alias("parent"), F.col("turn").alias("sequence"), F.col("text").alias("content")))


@query("chunk_paragraphs")
def chunk_paragraphs(spark, sf) -> DataFrame:
    """A fold over each document's paragraphs; tested against a plain loop."""
    return mt.chunk_paragraphs(m.documents(spark, sf))


@query("pack_budget")
def pack_budget(spark, sf) -> DataFrame:
    """Greedy packing of the best sixteen under 6000 characters; tested against a plain loop."""
    sizes = m.documents(spark, sf).select("doc_id", F.col("n_chars").alias("size"))
    return mt.pack_budget(tiers.top(_bm25(spark, sf), 16).join(sizes, "doc_id"), 6000)


CL = r"""cl AS (SELECT doc_id, claim_type, unnest(list_distinct(keys)) AS entity_key FROM (SELECT doc_id, 'url' AS claim_type, regexp_extract_all(content, '(https?://[^\s<>"'']+)', 1) AS keys FROM d UNION ALL SELECT doc_id, 'email', regexp_extract_all(content, '([A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,})', 1) FROM d
  UNION ALL SELECT doc_id, 'ip', regexp_extract_all(content, '(\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b)', 1) FROM d UNION ALL SELECT doc_id, 'number', regexp_extract_all(content, '(\b\d{12,19}\b)', 1) FROM d)),
cc AS (SELECT substr(md5(doc_id || '|' || claim_type || '|' || entity_key), 1, 16) AS claim_id, doc_id, claim_type, entity_key, claim_type || ' ' || lower(entity_key) AS claim_text FROM cl)"""


@query("claim_extraction", f"WITH {m.DOCS}, {CL} SELECT * FROM cc")
def claim_extraction(spark, sf) -> DataFrame:
    return mt.claims(m.documents(spark, sf))


NOTES = """notes AS (SELECT doc_id, ['code', 'config', 'doc', 'benchmark', 'other'][(doc_id % 5 + 1)::INT] AS source_kind, ['lang=' || lang, 'size: ' || n_chars, 'no pair'] AS key_values,
  CASE doc_id % 5 WHEN 0 THEN 'import os' || chr(10) || 'def load_' || doc_id || '(x):' || chr(10) || 'MAX_SIZE = ' || n_chars || chr(10) || '  class Inner' || doc_id % 7 || ':' WHEN 1 THEN 'name = "' || lang || '"' || chr(10) || '  inner = 1' || chr(10) || '# off = 2' || chr(10) || 'limit: ' || n_chars
  WHEN 2 THEN '# Title ' || doc_id || chr(10) || '### Deep' || chr(10) || 'listens on port ' || 8000 + doc_id % 50 || ' here' WHEN 3 THEN 'recall@10: 0.' || doc_id || chr(10) || 'recall: 0.' || doc_id || chr(10) || 'model = plain' ELSE 'def nothing():' END AS content FROM documents)"""


@query(
    "literal_claims",
    rf"""WITH {NOTES}, l AS (SELECT doc_id, source_kind, unnest(string_split(content, chr(10))) AS x FROM notes),
    c AS (SELECT doc_id, 'config_value' AS claim_type, regexp_extract(x, '^\s*([A-Za-z_][\w.-]*)\s*[:=]\s*(.+?)\s*$', 1) AS entity_key, regexp_extract(x, '^\s*([A-Za-z_][\w.-]*)\s*[:=]\s*(.+?)\s*$', 2) AS v, 1.0::DOUBLE AS specificity, 0.95::DOUBLE AS confidence FROM (SELECT doc_id, unnest(key_values) AS x FROM notes) WHERE regexp_matches(x, '^\s*([A-Za-z_][\w.-]*)\s*[:=]\s*(.+?)\s*$')
      UNION ALL SELECT doc_id, 'config_value', regexp_extract(x, '^([A-Z][A-Z0-9_]{{2,}})\s*=\s*(.+)$', 1), regexp_extract(x, '^([A-Z][A-Z0-9_]{{2,}})\s*=\s*(.+)$', 2), 1.0, 0.95 FROM l WHERE source_kind = 'code' AND regexp_matches(x, '^([A-Z][A-Z0-9_]{{2,}})\s*=\s*(.+)$')
      UNION ALL SELECT doc_id, 'config_value', regexp_extract(x, '^\s*([A-Za-z_][\w.-]*)\s*[:=]\s*(.+?)\s*$', 1), trim(regexp_extract(x, '^\s*([A-Za-z_][\w.-]*)\s*[:=]\s*(.+?)\s*$', 2), '"'), 1.0, 0.95 FROM l WHERE source_kind = 'config' AND NOT regexp_matches(x, '^[ \t#;]') AND regexp_matches(x, '^\s*([A-Za-z_][\w.-]*)\s*[:=]\s*(.+?)\s*$')
      UNION ALL SELECT doc_id, 'benchmark_result', regexp_extract(x, '^\s*([A-Za-z_][\w.-]*)\s*[:=]\s*(.+?)\s*$', 1), regexp_extract(x, '^\s*([A-Za-z_][\w.-]*)\s*[:=]\s*(.+?)\s*$', 2), 1.0, 0.9 FROM l WHERE source_kind = 'benchmark' AND regexp_matches(x, '^\s*([A-Za-z_][\w.-]*)\s*[:=]\s*(.*\d.*?)\s*$')),
    s AS (SELECT doc_id, claim_type, entity_key, entity_key || ' = ' || v AS claim_text, specificity, confidence FROM c
      UNION ALL SELECT doc_id, 'api_contract', regexp_extract(x, '^\s*(?:def|class|async\s+def)\s+([A-Za-z_]\w*)\s*[\(:]', 1), regexp_extract(x, '^\s*(?:def|class|async\s+def)\s+([A-Za-z_]\w*)\s*[\(:]', 1) || ' defined in /n/' || doc_id, 0.9, 0.95 FROM l WHERE source_kind = 'code' AND regexp_matches(x, '^\s*(?:def|class|async\s+def)\s+([A-Za-z_]\w*)\s*[\(:]')
      UNION ALL SELECT doc_id, 'operational_state', substr(regexp_extract(x, '^(#{{1,2}})\s+(.+)$', 2), 1, 64), 'section: ' || regexp_extract(x, '^(#{{1,2}})\s+(.+)$', 2), 0.7, 0.8 FROM l WHERE source_kind = 'doc' AND regexp_matches(x, '^(#{{1,2}})\s+(.+)$')
      UNION ALL SELECT doc_id, 'path_value', 'port:' || regexp_extract(x, '(?i)\bport[\s:=]+(\d{{2,5}})\b', 1), 'port ' || regexp_extract(x, '(?i)\bport[\s:=]+(\d{{2,5}})\b', 1), 1.0, 0.9 FROM l WHERE source_kind = 'doc' AND regexp_matches(x, '(?i)\bport[\s:=]+(\d{{2,5}})\b'))
    SELECT DISTINCT doc_id, claim_type, entity_key, claim_text, specificity, confidence FROM s""",
)
def literal_claims(spark, sf) -> DataFrame:
    """Claims of notes of four kinds, made up from each document's id, language and length."""
    d, n = F.col("doc_id"), F.lit("\n")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    code = F.concat(text("import os"), n, text("def load_", d, "(x):"), n, text("MAX_SIZE = ", F.col("n_chars")), n, text("  class Inner", d % 7, ":"))
    config = F.concat(text('name = "', F.col("lang"), '"'), n, text("  inner = 1"), n, text("# off = 2"), n, text("limit: ", F.col("n_chars")))
    doc = F.concat(text("# Title ", d), n, text("### Deep"), n, text("listens on port ", 8000 + d % 50, " here"))
    bench = F.concat(text("recall@10: 0.", d), n, text("recall: 0.", d), n, text("model = plain"))
    kinds = F.element_at(F.array(*map(F.lit, ("code", "config", "doc", "benchmark", "other"))), (d % 5 + 1).cast("int"))
    content = F.when(d % 5 == 0, code).when(d % 5 == 1, config).when(d % 5 == 2, doc).when(d % 5 == 3, bench).otherwise("def nothing():")
    notes = m.table(spark, sf, "documents").select("doc_id", kinds.alias("source_kind"), content.alias("content"), text("/n/", d).alias("source_id"), F.array(text("lang=", F.col("lang")), text("size: ", F.col("n_chars")), F.lit("no pair")).alias("key_values"))
    return mt.literal_claims(notes).drop("claim_id")


@query(
    "claim_edges",
    rf"""WITH {m.DOCS}, {CL}, cx AS (SELECT claim_id, doc_id, entity_key, list_distinct(list_filter(regexp_split_to_array(lower(CASE WHEN doc_id % 3 = 0 THEN claim_text ELSE claim_text || ' seen in ' || doc_id END), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')) AS w, (doc_id % 5)::DOUBLE AS t FROM cc),
    ok AS (SELECT entity_key FROM cx GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), j AS (SELECT x.claim_id AS a, y.claim_id AS b, x.entity_key, round_even(len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w))::DOUBLE, 6) AS similarity, x.t AS ta, y.t AS tb FROM cx x JOIN cx y ON x.entity_key = y.entity_key AND x.claim_id < y.claim_id AND x.doc_id <> y.doc_id WHERE x.entity_key IN (SELECT entity_key FROM ok))
    SELECT a, b, entity_key, CASE WHEN similarity >= 0.8 THEN CASE WHEN ta <> tb THEN 'supersedes' ELSE 'duplicates' END ELSE 'contradicts' END AS edge_type, similarity FROM j WHERE similarity >= 0.8 OR similarity <= 0.5""",
)
def claim_edges(spark, sf) -> DataFrame:
    c = mt.claims(m.documents(spark, sf)).withColumn("observed_at", (F.col("doc_id") % 5).cast("double"))
    text = F.when(F.col("doc_id") % 3 == 0, F.col("claim_text")).otherwise(F.concat("claim_text", F.lit(" seen in "), F.col("doc_id").cast("string")))
    return mt.claim_edges(c.withColumn("claim_text", text), different=0.5)


@query("lifecycle_repair", f"WITH {m.DOCS} SELECT doc_id, CASE WHEN doc_id % 13 IN (0, 1, 2) THEN doc_id % 13 ELSE 0 END::INT AS lifecycle, coalesce(verified_at, 0.0) AS verified_at FROM d")
def lifecycle_repair(spark, sf) -> DataFrame:
    """Lifecycles out of range become 0 and missing signals get their default."""
    raw = (F.col("doc_id") % 13).cast("int")
    return m.documents(spark, sf).select("doc_id", F.when(raw.isin(0, 1, 2), raw).otherwise(0).alias("lifecycle"), F.coalesce("verified_at", F.lit(0.0)).alias("verified_at"))


@query("index_drift", "SELECT (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS missing, (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)) AS orphans, (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)) >= 0.05 * (SELECT count(*) FROM labels) AS rebuild")
def index_drift(spark, sf) -> DataFrame:
    """Rows an index lacks, rows it has for no document, and whether that calls for a rebuild (5 %)."""
    d, l = m.table(spark, sf, "documents").select("doc_id"), m.table(spark, sf, "labels").select("doc_id")  # noqa: E741
    j = d.withColumn("d", F.lit(1)).join(l.withColumn("l", F.lit(1)), "doc_id", "full_outer")
    orphan = F.count_if(F.col("d").isNull())
    return j.agg(F.count_if(F.col("l").isNull()).alias("missing"), orphan.alias("orphans"), (orphan >= 0.05 * F.count("l")).alias("rebuild"))


@query("source_schemes", "SELECT page_id, CASE WHEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) IN ('http', 'https') THEN 'http' WHEN starts_with(u, '/') OR starts_with(u, 'file:') THEN 'file' WHEN starts_with(u, 's3') THEN 's3' ELSE 'unknown' END AS scheme FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/data/' || page_id WHEN 2 THEN replace(replace(url, 'https', 's3'), 'http', 's3a') ELSE 'odd' END AS u FROM pages)")
def source_schemes(spark, sf) -> DataFrame:
    from marlstone.sources.files import scheme

    k = F.col("page_id") % 4
    u = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/data/"), F.col("page_id").cast("string"))).when(k == 2, F.replace(F.replace("url", F.lit("https"), F.lit("s3")), F.lit("http"), F.lit("s3a"))).otherwise("odd")
    return m.table(spark, sf, "pages").select("page_id", u.alias("u")).select("page_id", scheme(F.col("u")).alias("scheme"))


@query("folder_sync_diff", "SELECT coalesce(a.source_id, b.source_id) AS source_id, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT 'f' || doc_id AS source_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT 'f' || doc_id AS source_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0) b ON a.source_id = b.source_id")
def folder_sync_diff(spark, sf) -> DataFrame:
    from marlstone.sources.files import sync_diff

    d = m.table(spark, sf, "documents").withColumn("source_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    now = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return sync_diff(d.where("doc_id % 5 <> 0").select("source_id", F.sha2("text", 256).alias("content_hash")), d.where("doc_id % 4 <> 0").select("source_id", F.sha2(now, 256).alias("content_hash")))


@query("cache_validity", f"WITH {m.DOCS} SELECT doc_id, {m.NOW} - created_at <= CASE doc_id % 3 WHEN 0 THEN 604800 WHEN 1 THEN 43200 ELSE 900 END AS valid FROM d")
def cache_validity(spark, sf) -> DataFrame:
    from marlstone.sources.files import cache_state

    kind = F.element_at(F.array(F.lit("stable"), F.lit("medium"), F.lit("hot")), (F.col("doc_id") % 3 + 1).cast("int"))
    return cache_state(m.documents(spark, sf).select("doc_id", kind.alias("volatility"), F.col("created_at").alias("cached_at")), m.NOW).select("doc_id", "valid")


@query("source_revalidation", f"WITH {m.DOCS} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN verified_at IS NULL THEN 'unknown' WHEN created_at + 86400 * (doc_id % 5) > verified_at THEN 'stale' ELSE 'fresh' END AS state FROM d")
def source_revalidation(spark, sf) -> DataFrame:
    from marlstone.sources.files import revalidate

    d = m.documents(spark, sf)
    files = d.where("doc_id % 9 <> 0").select("source_id", (F.col("created_at") + 86400 * (F.col("doc_id") % 5)).alias("mtime"))
    return revalidate(d.select("doc_id", "source_id", F.col("verified_at").alias("observed_at")), files)
