"""Flux ranking, query surfaces and interference trim over the best documents of each query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import spectra as sp
from marlstone.operators import tiers
from marlstone.operators.graph import checkpointed
from marlstone.plans import model as m
from marlstone.plans.retrieval import BM25, _bm25
from marlstone.registry import query

POOL = 16
WIDTH = 3.0


def _bin(x: str) -> str:
    return f"('0x' || md5('spectrum' || lower({x}))[1:2])::INT"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOPS = ", ".join(map(_text, sp.STOP_WORDS))
SURFACE = rf"""kw AS (SELECT item_id AS query_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: trim(x, {_text(sp.MARKS)})), lambda x: length(x) > 2 AND x NOT IN ({STOPS})) AS k FROM benchmark),
qt AS (SELECT query_id, unnest(list_concat(k[1:5], list_filter(k, lambda x: length(x) > 4))) AS t FROM kw),
pk AS (SELECT query_id, {_bin("t")} AS b, 1.0::DOUBLE AS h, true AS own FROM qt UNION ALL SELECT query_id, {_bin("t || 's'")}, 0.5, false FROM qt WHERE t NOT LIKE '%s'),
pb AS (SELECT query_id, b, sum(h) AS h, bool_or(own) AS own, bool_or(NOT own) AS near FROM pk GROUP BY ALL),
qi AS (SELECT item_id AS query_id, i FROM benchmark, range(0, 256) r(i)),
qs AS (SELECT query_id, i, round_even(coalesce(sum(h * exp(-0.5 * pow((i - b) / {WIDTH}::DOUBLE, 2))), 0.0), 6) AS v,
  round_even(greatest(0.8, max(CASE WHEN own AND abs(i - b) <= 10 THEN 0.8 + (1.5 - 0.8::DOUBLE) * exp(-0.5 * pow((i - b) / {WIDTH}::DOUBLE, 2)) END), max(CASE WHEN near AND abs(i - b) <= 7 THEN 0.8 + (1.2 - 0.8::DOUBLE) * exp(-0.5 * pow((i - b) / {WIDTH}::DOUBLE, 2)) END)), 6) AS w
  FROM qi LEFT JOIN pb USING (query_id) GROUP BY 1, 2)"""
DECAY = "round_even(access_count / 22.0::DOUBLE, 2)"


def surfaces(spark, sf) -> DataFrame:
    """Surfaces of all benchmark queries; a term's synonym is its other number where that ends in s."""
    q = m.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    words = q.select(F.explode(sp.terms(F.col("text"))).alias("term")).where(~F.col("term").endswith("s")).distinct()
    return sp.query_surfaces(q, words.withColumn("synonym", F.concat("term", F.lit("s"))), WIDTH)


def _pool(spark, sf, depth: int) -> DataFrame:
    return tiers.top(_bm25(spark, sf), depth).select("query_id", "doc_id", "rank")


def _fragments(content: str):
    return F.filter(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: F.trim(x) != "")


@query("query_surface", f"WITH {SURFACE} SELECT query_id, i::BIGINT AS bin, v AS height, w AS weight FROM qs")
def query_surface(spark, sf) -> DataFrame:
    """Spectrum and weights of each query, a row a bin."""
    return surfaces(spark, sf).select("query_id", F.posexplode(F.arrays_zip("spectrum", "weights")).alias("bin", "x")).select("query_id", F.col("bin").cast("long").alias("bin"), F.col("x.spectrum").alias("height"), F.col("x.weights").alias("weight"))


def _rank_sql(score: str, more: str = "") -> str:
    return f"""WITH {BM25}, {SURFACE}, tg AS (SELECT doc_id, lang AS t FROM d UNION ALL SELECT doc_id, shard FROM d UNION ALL SELECT doc_id, term FROM post WHERE length(term) BETWEEN 10 AND 13),
cand AS (SELECT query_id, doc_id, rank FROM bmr WHERE rank <= {POOL}),
tb AS (SELECT doc_id, {_bin("t")} AS b, count(*) * any_value({DECAY}) AS h FROM tg JOIN d USING (doc_id) WHERE t IS NOT NULL AND doc_id IN (SELECT doc_id FROM cand) GROUP BY 1, 2),
ds AS (SELECT doc_id, i, round_even(sum(h * exp(-0.5 * pow((i - b) / {WIDTH}::DOUBLE, 2))), 6) AS v FROM tb, range(0, 256) r(i) GROUP BY 1, 2),
x AS (SELECT query_id, doc_id, rank, i, qs.v * w AS a, ds.v * w AS b FROM cand JOIN qs USING (query_id) JOIN ds USING (doc_id, i)), {more}
f AS ({score}), g AS (SELECT *, score > 0.05 AS hit, count(*) OVER (PARTITION BY query_id) AS n, count(*) FILTER (WHERE score > 0.05) OVER (PARTITION BY query_id) AS hits, row_number() OVER (PARTITION BY query_id, score > 0.05 ORDER BY rank, doc_id) AS place FROM f),
h AS (SELECT *, CASE WHEN n <= 5 THEN 'kept' WHEN hit THEN 'scored' WHEN hits < n * 0.5 AND place <= 5 - hits THEN 'padded' END AS how FROM g),
p AS (SELECT query_id, doc_id, rank, how, CASE how WHEN 'padded' THEN 0.1 ELSE score END::DOUBLE AS score FROM h WHERE how IS NOT NULL)
SELECT query_id, doc_id, score, how, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE how WHEN 'kept' THEN 0.0 ELSE -score END, how = 'padded', rank, doc_id) AS position FROM p) WHERE position <= 5"""


def _ranked(spark, sf, metric: str) -> DataFrame:
    pool = checkpointed(_pool(spark, sf, POOL))  # POOL rows a query
    some = pool.select("doc_id").distinct()
    docs = m.documents(spark, sf).join(some, "doc_id", "left_semi").select("doc_id", (F.col("access_count") / 22.0).alias("decay"), _fragments("content").alias("fragments"))
    spectra = sp.document_spectra(docs, m.tags(spark, sf).join(some, "doc_id", "left_semi"), WIDTH)
    return sp.resonance_rank(pool, surfaces(spark, sf), spectra, metric=metric)


COSINE = "SELECT query_id, doc_id, rank, CASE WHEN sum(a * a) > 0 AND sum(b * b) > 0 THEN round_even(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) ELSE 0.0 END AS score FROM x GROUP BY 1, 2, 3"
CIRCLE = """s AS (SELECT query_id, doc_id, rank, sum(a) AS sa, sum(b) AS sb FROM x GROUP BY 1, 2, 3),
c AS (SELECT query_id, doc_id, sum(a / sa - b / sb) OVER (PARTITION BY query_id, doc_id ORDER BY i) AS c FROM x JOIN s USING (query_id, doc_id) WHERE sa > 0 AND sb > 0),
w1 AS (SELECT query_id, doc_id, sum(abs(c - md)) AS w1 FROM c JOIN (SELECT query_id, doc_id, median(c) AS md FROM c GROUP BY 1, 2) USING (query_id, doc_id) GROUP BY 1, 2),"""


@query("flux_rank", _rank_sql(COSINE))
def flux_rank(spark, sf) -> DataFrame:
    """The best five of each query's pool by weighted cosine of spectra."""
    return _ranked(spark, sf, "cosine")


@query("flux_rank_circular", _rank_sql("SELECT query_id, doc_id, rank, coalesce(round_even(1 / (1 + w1), 6), 0.0) AS score FROM s LEFT JOIN w1 USING (query_id, doc_id)", CIRCLE))
def flux_rank_circular(spark, sf) -> DataFrame:
    """The same by distance on the circle of bins."""
    return _ranked(spark, sf, "w1")


@query(
    "interference_trim",
    f"""WITH {BM25}, {SURFACE}, kn AS (SELECT c, i, round_even(exp(-0.5 * pow((i - c) / {WIDTH}::DOUBLE, 2)), 6) AS k FROM range(0, 256) a(c), range(0, 256) b(i)),
nr AS (SELECT query_id, c, CASE WHEN sum(v * v) > 0 THEN round_even(sum(v * k) / (sqrt(sum(v * v)) * sqrt(sum(k * k))), 6) ELSE 0.0 END AS r FROM qs JOIN kn USING (i) GROUP BY 1, 2),
fr AS (SELECT query_id, doc_id, content, list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: trim(x) <> '') AS f FROM bmr JOIN d USING (doc_id) WHERE rank <= 5),
un AS (SELECT query_id, doc_id, unnest(f) AS x, generate_subscripts(f, 1) AS pos FROM fr),
stay AS (SELECT query_id, doc_id, list(x ORDER BY pos) AS s FROM un JOIN nr USING (query_id) WHERE c = {_bin("x")} AND r >= 0.21 GROUP BY 1, 2)
SELECT query_id, doc_id, len(k)::BIGINT AS kept, CASE WHEN len(k) > 0 THEN array_to_string(k, ' | ') ELSE coalesce(content[1:500], '') END AS text FROM (SELECT query_id, doc_id, content, coalesce(s, f[1:2]) AS k FROM fr LEFT JOIN stay USING (query_id, doc_id))""",
)
def interference_trim(spark, sf) -> DataFrame:
    """The five best documents of each query, cut to the lines that resonate with it."""
    top = _pool(spark, sf, 5).join(m.documents(spark, sf).select("doc_id", "content"), "doc_id")
    return sp.interference_trim(top.withColumns({"fragments": _fragments("content"), "complement": F.lit(None).cast("string")}), surfaces(spark, sf))
