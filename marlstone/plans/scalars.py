"""Scalar functions of the inventory applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.plans import model as m
from marlstone.registry import query

STOP = ", ".join(f"'{w}'" for w in fx.STOP_WORDS)
NOISE = ", ".join(f"'{w}'" for w in fx.PATH_NOISE)


@query("text_signals", rf"SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')), lambda w: length(w) > 2 AND NOT list_contains([{STOP}], w))), ' ') AS terms FROM benchmark")
def text_signals(spark, sf) -> DataFrame:
    return m.table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(fx.signals(F.col("text"))), " ").alias("terms"))


OTHER = "CASE WHEN length(c) <= 3 THEN NULL WHEN ends_with(c, 'ies') AND length(c) > 4 THEN substr(c, 1, length(c) - 3) || 'y' WHEN ends_with(c, 's') AND NOT ends_with(c, 'ss') AND NOT ends_with(c, 'us') THEN substr(c, 1, length(c) - 1) ELSE c || 's' END"


@query(
    "query_expansion",
    rf"""WITH t AS (SELECT item_id, lower(text) || ' ' || replace(lower(substr(text, 1, 60)), ' ', CASE item_id % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE '/' END) AS x FROM benchmark),
    k AS (SELECT item_id, list_filter(regexp_extract_all(x, '[a-z0-9_/\-]+'), lambda w: length(w) > 2 AND NOT list_contains([{STOP}], w)) AS kw FROM t),
    c AS (SELECT DISTINCT item_id, unnest(list_concat([w], regexp_split_to_array(w, '[_\-/]+'))) AS c FROM (SELECT item_id, unnest(kw) AS w FROM k)),
    e AS (SELECT item_id, c AS e FROM c UNION SELECT item_id, {{OTHER}} FROM c WHERE c <> '')
    SELECT item_id, (SELECT array_to_string(kw[1:5], ' ') FROM k WHERE k.item_id = e.item_id) AS domains, string_agg(e, ' ' ORDER BY e) AS entities FROM e WHERE length(e) >= 4 AND NOT list_contains([{STOP}], e) GROUP BY item_id""".replace("{OTHER}", OTHER),
)
def query_expansion(spark, sf) -> DataFrame:
    """Keywords of the benchmark's texts and of a compound made of each one's start."""
    text = F.lower("text")
    join = F.when(F.col("item_id") % 3 == 0, "_").when(F.col("item_id") % 3 == 1, "-").otherwise("/")
    both = F.concat(text, F.lit(" "), F.replace(F.lower(F.substring("text", 1, 60)), F.lit(" "), join))
    found = m.table(spark, sf, "benchmark").select("item_id", fx.query_signals(both).alias("s"))
    return found.select("item_id", F.array_join("s.domains", " ").alias("domains"), F.array_join(F.array_sort("s.entities"), " ").alias("entities"))


@query("plural_variants", f"WITH t AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) || CASE p_partkey % 4 WHEN 0 THEN 'ies' WHEN 1 THEN 'es' WHEN 2 THEN 's' ELSE '' END AS c FROM part) SELECT c AS term, coalesce({OTHER}, '') AS forms FROM t")
def plural_variants(spark, sf) -> DataFrame:
    k = F.col("p_partkey") % 4
    term = F.concat(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), F.when(k == 0, "ies").when(k == 1, "es").when(k == 2, "s").otherwise(""))
    return m.table(spark, sf, "part").select(term.alias("term")).distinct().select("term", F.array_join(F.array_sort(fx.plural_variants(F.col("term"))), " ").alias("forms"))


@query(
    "path_functions",
    rf"WITH {m.DOCS} SELECT doc_id, regexp_extract(source_id, '([^/]*)\.[^.]*$', 1) AS stem, len(list_filter(string_split(source_id, '/'), lambda p: p <> '')) AS parts, array_to_string(list_filter(list_distinct(regexp_split_to_array(lower(source_id), '[^\p{{L}}\p{{N}}]+')), lambda w: length(w) >= 2 AND NOT list_contains([{NOISE}], w)).list_sort(), ' ') AS tokens, lower(trim(source_id)) AS key FROM d",
)
def path_functions(spark, sf) -> DataFrame:
    p = F.col("source_id")
    return m.documents(spark, sf).select("doc_id", fx.filename_stem(p).alias("stem"), F.size(fx.path_parts(p)).cast("long").alias("parts"), F.array_join(F.array_sort(fx.path_tokens(p)), " ").alias("tokens"), fx.normalise_source(p).alias("key"))


@query("token_estimates", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens, round_even(1 + least(length(lang), 16) / 8.0::DOUBLE, 6) AS weight FROM documents")
def token_estimates(spark, sf) -> DataFrame:
    return m.table(spark, sf, "documents").select("doc_id", fx.estimate_tokens(F.col("text")).alias("tokens"), fx.round6(fx.term_weight(F.col("lang"))).alias("weight"))


@query("hash_functions", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_id, sha256(text) AS content_hash, md5(source || ':' || doc_id) AS key_md5 FROM documents")
def hash_functions(spark, sf) -> DataFrame:
    return m.table(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("content_id"), F.sha2("text", 256).alias("content_hash"), F.md5(F.concat_ws(":", "source", F.col("doc_id").cast("string")).cast("binary")).alias("key_md5"))


KV = r"""'(\w+)\s*=\s*"?([\w./-]+)'"""


@query("key_values", f"SELECT doc_id, lower(trim(k)) AS key, v AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, {KV}, 1)) AS k, unnest(regexp_extract_all(text, {KV}, 2)) AS v FROM documents)")
def key_values(spark, sf) -> DataFrame:
    """key = value settings in texts."""
    pair = lambda g: F.regexp_extract_all("text", F.lit(r"(\w+)\s*=\s*\"?([\w./-]+)"), F.lit(g))
    rows = m.table(spark, sf, "documents").select("doc_id", F.explode(F.arrays_zip(pair(1).alias("k"), pair(2).alias("v"))).alias("kv"))
    return rows.select("doc_id", F.lower(F.trim("kv.k")).alias("key"), F.col("kv.v").alias("value"))


@query("markup_headings", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, length(html) AS size FROM pages")
def markup_headings(spark, sf) -> DataFrame:
    return m.table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.length("html").cast("long").alias("size"))


@query("provenance_kind", f"WITH {m.DOCS}, k AS (SELECT doc_id, CASE WHEN ends_with(source_id, '.py') THEN 'code' WHEN ends_with(source_id, '.md') THEN 'doc' ELSE 'text' END AS kind FROM d) SELECT doc_id, kind, CASE kind WHEN 'code' THEN 'hot' WHEN 'doc' THEN 'medium' ELSE 'stable' END AS volatility, CASE kind WHEN 'code' THEN 'primary' WHEN 'doc' THEN 'derived' ELSE 'inferred' END AS authority FROM k")
def provenance_kind(spark, sf) -> DataFrame:
    kind = F.when(F.col("source_id").endswith(".py"), "code").when(F.col("source_id").endswith(".md"), "doc").otherwise("text")
    pick = lambda a, b, c: F.when(F.col("kind") == "code", a).when(F.col("kind") == "doc", b).otherwise(c)
    return m.documents(spark, sf).select("doc_id", kind.alias("kind")).select("doc_id", "kind", pick("hot", "medium", "stable").alias("volatility"), pick("primary", "derived", "inferred").alias("authority"))


@query("model_capability", "SELECT p_partkey, CASE WHEN b IS NULL THEN 'unknown' WHEN b < 8 THEN 'small' WHEN b < 40 THEN 'medium' ELSE 'large' END AS class FROM (SELECT p_partkey, try_cast(nullif(regexp_extract(lower(p_brand) || '-' || p_size || 'b', '(\\d+)b$', 1), '') AS DOUBLE) AS b FROM part)".replace("\\\\", "\\"))
def model_capability(spark, sf) -> DataFrame:
    """A capability class from the size suffix of a model name."""
    name = F.concat(F.lower("p_brand"), F.lit("-"), F.col("p_size").cast("string"), F.lit("b"))
    b = F.try_to_number(F.nullif(F.regexp_extract(name, r"(\d+)b$", 1), F.lit("")), F.lit("999999")).cast("double")
    return m.table(spark, sf, "part").select("p_partkey", F.when(b.isNull(), "unknown").when(b < 8, "small").when(b < 40, "medium").otherwise("large").alias("class"))


@query("extractive_trim", r"SELECT page_id, string_agg(l, chr(10) ORDER BY i) AS text FROM (SELECT page_id, unnest(string_split(html, '<p>')) AS l, generate_subscripts(string_split(html, '<p>'), 1) AS i FROM pages) WHERE i <= 3 OR contains(l, '</article>') GROUP BY 1")
def extractive_trim(spark, sf) -> DataFrame:
    """A prefix of pieces and the later ones a query rescues."""
    pieces = F.split("html", "<p>")
    kept = F.filter(F.transform(pieces, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["i"] < 3) | s["x"].contains("</article>"))
    return m.table(spark, sf, "pages").select("page_id", F.array_join(F.transform(kept, lambda s: s["x"]), "\n").alias("text"))
