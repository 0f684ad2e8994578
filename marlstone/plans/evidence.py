"""Confidence, packet, spectrum and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators import evidence as e
from marlstone.operators import tiers
from marlstone.plans import model as m
from marlstone.plans.retrieval import BM25, COS, _bm25
from marlstone.registry import query

VOL = "CASE doc_id % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'medium' ELSE 'hot' END"
TAU = "CASE doc_id % 3 WHEN 0 THEN 604800.0 WHEN 1 THEN 43200.0 ELSE 900.0 END"
ME = f"""me AS (SELECT *, {VOL} AS volatility, CASE WHEN verified_at IS NOT NULL THEN exp(-greatest({m.NOW} - verified_at, 0) / {TAU}) END AS fresh,
  CASE doc_id % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'derived' ELSE 'inferred' END AS authority, CASE doc_id % 5 WHEN 0 THEN 'literal' WHEN 1 THEN 'span' WHEN 2 THEN 'doc' WHEN 3 THEN 'summary' ELSE 'other' END AS specificity,
  doc_id % 11 = 0 AS invalid, ((doc_id * 13) % 100 / 100.0)::DOUBLE AS coordinate FROM d)"""
META = f"{m.DOCS}, {ME}"


def _meta(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (d % n + 1).cast("int"))
    rows = m.documents(spark, sf).withColumn("volatility", pick(3, "stable", "medium", "hot")).withColumn("authority", pick(4, "primary", "derived", "inferred", "inferred")).withColumn("specificity", pick(5, "literal", "span", "doc", "summary", "other"))
    return rows.withColumn("fresh", e.freshness(F.col("verified_at"), F.col("volatility"), m.NOW)).withColumn("invalid", d % 11 == 0).withColumn("coordinate", (d * 13) % 100 / 100.0)


@query("freshness_score", f"WITH {META} SELECT doc_id, volatility, round_even(fresh, 6) AS fresh FROM me")
def freshness_score(spark, sf) -> DataFrame:
    return _meta(spark, sf).select("doc_id", "volatility", fx.round6("fresh").alias("fresh"))


TRUTH = """round_even(coalesce(fresh, 0.0) * CASE authority WHEN 'primary' THEN 1.0 WHEN 'derived' THEN 0.75 WHEN 'inferred' THEN 0.45 ELSE 0.75 END * CASE specificity WHEN 'literal' THEN 1.0 WHEN 'span' THEN 0.9 WHEN 'doc' THEN 0.75 WHEN 'summary' THEN 0.5 ELSE 0.6 END * CASE WHEN invalid THEN 0.25 ELSE 1.0 END, 6)"""


def _status_sql(verified: float, stale: float, high: bool) -> str:
    doubt = "needs_refresh" if high else "stale_risk"
    base = f"CASE WHEN invalid THEN 'needs_refresh' WHEN fresh IS NULL OR authority = 'inferred' THEN '{doubt}' WHEN fresh >= {verified} THEN 'verified' WHEN fresh >= {stale} THEN 'stale_risk' ELSE 'needs_refresh' END"
    if high:
        return f"CASE WHEN coordinate < 0.30 THEN 'needs_refresh' ELSE {base} END"
    return f"CASE WHEN coordinate < 0.30 AND {base} = 'verified' THEN 'stale_risk' ELSE {base} END"


@query("live_truth", f"WITH {META} SELECT doc_id, {TRUTH}::DOUBLE AS live_truth FROM me")
def live_truth(spark, sf) -> DataFrame:
    return _meta(spark, sf).select("doc_id", e.live_truth(F.col("fresh"), F.col("authority"), F.col("specificity"), F.col("invalid")).alias("live_truth"))


RISK = "round_even(least(1.0, {0} * (1 - coalesce(fresh, 0.0)) + {1})::DOUBLE, 6)"


@query(
    "packet_status",
    f"""WITH {META} SELECT doc_id, {_status_sql(0.70, 0.35, True)} AS edit_status, {_status_sql(0.55, 0.20, False)} AS review_status, {_status_sql(0.35, 0.12, False)} AS explain_status,
    {RISK.format(0.85, "CASE WHEN specificity = 'literal' THEN 0.0 ELSE 0.15 END")} AS edit_risk, {RISK.format(0.45, "0.0")} AS explain_risk FROM me""",
)
def packet_status(spark, sf) -> DataFrame:
    fresh, literal = F.col("fresh"), F.col("specificity") == "literal"
    of = lambda task: e.status(fresh, task, F.col("coordinate"), F.col("authority"), F.col("invalid")).alias(f"{task}_status")
    return _meta(spark, sf).select("doc_id", of("edit"), of("review"), of("explain"), e.action_risk(fresh, "edit", literal).alias("edit_risk"), e.action_risk(fresh, "explain", literal).alias("explain_risk"))


@query(
    "evidence_packet",
    f"""WITH {BM25}, {ME}, p AS (SELECT query_id, doc_id, score, {_status_sql(0.70, 0.35, True)} AS status, {TRUTH}::DOUBLE AS live_truth FROM bmr JOIN me USING (doc_id) WHERE rank <= 8)
    SELECT query_id, doc_id, score, status, CASE WHEN status = 'verified' THEN 'verified' ELSE 'stale_risk' END AS bucket, live_truth,
      row_number() OVER (PARTITION BY query_id, CASE WHEN status = 'verified' THEN 'verified' ELSE 'stale_risk' END ORDER BY CASE WHEN status = 'needs_refresh' THEN 0 ELSE 1 END, live_truth DESC, score DESC, doc_id) AS position FROM p""",
)
def evidence_packet(spark, sf) -> DataFrame:
    """The eight best documents of each query by status: what is verified, and what is stale or needs a refresh (first)."""
    from pyspark.sql import Window

    c = F.col("fresh"), F.col("coordinate")
    meta = _meta(spark, sf).select("doc_id", e.status(c[0], "edit", c[1], F.col("authority"), F.col("invalid")).alias("status"), e.live_truth(c[0], F.col("authority"), F.col("specificity"), F.col("invalid")).alias("live_truth"))
    p = tiers.top(_bm25(spark, sf), 8).join(meta, "doc_id").withColumn("bucket", F.when(F.col("status") == "verified", "verified").otherwise("stale_risk"))
    w = Window.partitionBy("query_id", "bucket").orderBy(F.when(F.col("status") == "needs_refresh", 0).otherwise(1), F.desc("live_truth"), F.desc("score"), F.asc("doc_id"))
    return p.select("query_id", "doc_id", "score", "status", "bucket", "live_truth", F.row_number().over(w).alias("position"))


@query(
    "density_gate",
    f"""WITH {m.TAGS}, t AS (SELECT doc_id, count(*) AS tags FROM tags GROUP BY 1), s AS (SELECT doc_id, tags, access_count, n_chars, 0.4 * tags / greatest(n_chars / 1000.0, 1.0) + 0.3 * (doc_id % 4) / greatest(n_chars / 1000.0, 1.0) + 0.2 * least(access_count / 10.0, 1.0) + CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 0.0 END AS density, source_id FROM d JOIN t USING (doc_id))
    SELECT doc_id, round_even(density::DOUBLE, 6) AS density, CASE WHEN access_count >= 20 THEN 0 WHEN contains(source_id, '/fr/') THEN 2 WHEN density >= 1.0 THEN 0 WHEN density >= 0.5 THEN 1 ELSE 2 END AS lifecycle FROM s""",
)
def density_gate(spark, sf) -> DataFrame:
    """Gated before it is rounded. Ties are those of the double, as in the SQL: 16.7015625 lies above one, ``round6`` takes its digits for one."""
    n = m.tags(spark, sf).groupBy("doc_id").agg(F.count("*").alias("tags"))
    d = m.documents(spark, sf).join(n, "doc_id")
    score = e.density(F.col("tags"), F.col("doc_id") % 4, F.col("n_chars"), F.col("access_count"), F.col("doc_id") % 2 == 0)
    busy = F.when(F.col("access_count") >= 20, 5).otherwise(0)
    return d.select("doc_id", (F.rint(score * 1e6) / 1e6).alias("density"), e.density_gate(score, F.col("source_id").contains("/fr/"), busy, F.lit(0)).alias("lifecycle"))


@query(
    "budget_tiers",
    f"""WITH {BM25}, c AS (SELECT * FROM bmr WHERE rank <= 16), s AS (SELECT *, max(score) OVER w AS top, count(*) OVER w AS n, avg(score) OVER w AS mean FROM c WINDOW w AS (PARTITION BY query_id)),
    a AS (SELECT *, sum((score >= 0.15 * top)::INT) OVER (PARTITION BY query_id) AS above, CASE WHEN mean > 0 THEN round_even(top / mean, 6) ELSE 0 END AS ratio FROM s),
    t AS (SELECT *, CASE WHEN n <= 3 THEN 'pass' WHEN ratio >= 3.0 THEN 'tight' WHEN ratio >= 1.8 THEN 'focused' ELSE 'broad' END AS tier FROM a)
    SELECT query_id, doc_id, score, rank, ratio, tier FROM t WHERE n <= 3 OR ((score >= 0.15 * top OR above < 3) AND rank <= CASE tier WHEN 'tight' THEN 3 WHEN 'focused' THEN 6 ELSE 1000000 END)""",
)
def budget_tiers(spark, sf) -> DataFrame:
    return e.budget_tiers(tiers.top(_bm25(spark, sf), 16))


@query(
    "abstain_gate",
    f"""WITH {BM25}, g AS (SELECT query_id, max(score) AS top, round_even(avg(score), 9) AS mean, min(score) AS low FROM bmr WHERE rank <= 16 GROUP BY 1), r AS (SELECT *, round_even(CASE WHEN mean - low > 1e-9 THEN (top - low) / (mean - low) ELSE 0 END, 6) AS rrf_ratio FROM g)
    SELECT query_id, top, rrf_ratio, top < 2.5 AND top < 1.8 * mean AS abstain_additive, rrf_ratio < 1.5 AS abstain_rrf FROM r""",
)
def abstain_gate(spark, sf) -> DataFrame:
    return e.abstain(tiers.top(_bm25(spark, sf), 16))


@query(
    "legibility_marks",
    f"""WITH {BM25}, z AS (SELECT query_id, doc_id, round_even(CASE WHEN stddev_samp(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_samp(score) OVER w ELSE 0 END, 4) AS z FROM bmr WHERE rank <= 12 WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, doc_id, z, CASE WHEN z >= 1 THEN 'full' WHEN z >= 0 THEN 'half' ELSE 'empty' END AS mark FROM z""",
)
def legibility_marks(spark, sf) -> DataFrame:
    return e.legibility(tiers.top(_bm25(spark, sf), 12)).select("query_id", "doc_id", "z", "mark")


@query(
    "know_miss",
    f"""WITH {BM25}, {ME}, c AS (SELECT query_id, doc_id, score, rank, fresh, coordinate FROM bmr JOIN me USING (doc_id) WHERE rank <= 2),
    x AS (SELECT query_id, count(*) AS found, max(score) FILTER (WHERE rank = 1) AS s, max(score) FILTER (WHERE rank = 1) - coalesce(max(score) FILTER (WHERE rank = 2), 0) AS gap, max(coordinate) FILTER (WHERE rank = 1) AS coord, min(fresh) AS fresh, max(doc_id) FILTER (WHERE rank = 1) AS top FROM c GROUP BY 1),
    p AS (SELECT query_id, found, top, s, fresh, round_even(1 / (1 + exp(-(-2.0 + 2.0 * tanh(s / 1.0) + 1.5 * tanh(gap / 0.5) + 0.7 * (top % 2) + 1.8 * coord + 1.5 * coalesce(fresh, 0)))), 6) AS confidence FROM x)
    SELECT query_id, confidence, CASE WHEN s < 1.0 THEN 'abstain' WHEN top % 19 = 0 THEN 'denatured' WHEN top % 17 = 0 THEN 'superseded' WHEN coalesce(fresh, 1) < 0.000001 THEN 'stale' WHEN confidence < 0.55 AND top % 13 = 2 THEN 'cold' WHEN confidence < 0.55 THEN 'sparse' ELSE 'know' END AS outcome FROM p""",
)
def know_miss(spark, sf) -> DataFrame:
    """Confidence in the best document of each query, and know or the first reason why not; health, succession and tier come from ids here."""
    c = tiers.top(_bm25(spark, sf), 2).join(_meta(spark, sf).select("doc_id", "fresh", "coordinate"), "doc_id")
    at = lambda col, r: F.max(F.when(F.col("rank") == r, F.col(col)))
    x = c.groupBy("query_id").agg(F.count("*").alias("found"), at("score", 1).alias("s"), (at("score", 1) - F.coalesce(at("score", 2), F.lit(0.0))).alias("gap"), at("coordinate", 1).alias("coord"), F.min("fresh").alias("fresh"), at("doc_id", 1).alias("top"))
    top = F.col("top")
    p = x.withColumn("confidence", e.confidence(F.col("s"), F.col("gap"), top % 2, F.col("coord"), F.col("fresh")))
    out = e.know_or_miss(F.col("found"), F.col("confidence"), F.col("s") < 1.0, top % 19 == 0, top % 17 == 0, F.coalesce("fresh", F.lit(1.0)) < 0.000001, top % 13 == 2)
    return p.select("query_id", "confidence", out.alias("outcome"))


@query(
    "context_health",
    f"""WITH {BM25}, {ME}, r AS (SELECT query_id, (doc_id % 2)::DOUBLE AS covered, least(n_chars / 4000.0, 1.0)::DOUBLE AS dense, fresh FROM bmr JOIN me USING (doc_id) WHERE rank <= 8),
    g AS (SELECT query_id, avg(covered) AS coverage, avg(dense) AS density, min(fresh) AS freshness FROM r GROUP BY 1),
    h AS (SELECT *, round_even(pow(greatest(coalesce(coverage, 0), 0.01) * greatest(coalesce(density, 0), 0.01) * greatest(coalesce(freshness, 0), 0.01), 1.0::DOUBLE / 3), 6) AS ellipticity FROM g)
    SELECT query_id, round_even(coverage, 9) AS coverage, round_even(density, 9) AS density, round_even(freshness, 9) AS freshness, ellipticity, CASE WHEN ellipticity >= 0.7 THEN 'aligned' WHEN ellipticity >= 0.4 THEN 'sparse' WHEN coalesce(freshness, 0) < 0.2 THEN 'stale' ELSE 'denatured' END AS status FROM h""",
)
def context_health(spark, sf) -> DataFrame:
    rows = tiers.top(_bm25(spark, sf), 8).join(_meta(spark, sf).select("doc_id", "n_chars", "fresh"), "doc_id")
    return e.health(rows.select("query_id", (F.col("doc_id") % 2).cast("double").alias("covered"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("dense"), "fresh"))


AGE = f"CASE WHEN verified_at IS NOT NULL THEN greatest(floor(({m.NOW}::DOUBLE - verified_at) / 86400.0), 0)::BIGINT END"


@query("calibration_age", f"WITH {META} SELECT doc_id, {AGE} AS age_days, coalesce({AGE} > 30, false) AS stale FROM me")
def calibration_age(spark, sf) -> DataFrame:
    """Age of fits made at each document's time; unknown times give no age and no warning."""
    return m.documents(spark, sf).select("doc_id", e.calibration_age(F.col("verified_at"), m.NOW).alias("c")).select("doc_id", "c.age_days", "c.stale")


@query(
    "logical_coherence",
    """SELECT l_orderkey AS query_id, round_even(greatest(0.0, least(1.0, (avg(CASE l_suppkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 1.0 WHEN 3 THEN -0.3 WHEN 4 THEN -0.5 WHEN 5 THEN 0.5 ELSE 0.0 END::DOUBLE * (l_discount * 10)::DOUBLE) + 0.5) / 1.5))::DOUBLE, 6) AS coherence FROM lineitem GROUP BY 1""",
)
def logical_coherence(spark, sf) -> DataFrame:
    """Lines of an order as judged pairs of a query's documents: relation and confidence."""
    rows = m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 7).cast("int").alias("relation"), (F.col("l_discount") * 10).cast("double").alias("confidence"))
    return e.coherence(rows)


@query(
    "query_classes",
    r"""SELECT query_id, CASE WHEN contains(t, '+')::INT + contains(t, '-')::INT + contains(t, '*')::INT + contains(t, '/')::INT + contains(t, '%')::INT + regexp_matches(t, '\bcalculate\b')::INT + regexp_matches(t, '\btotal\b')::INT + regexp_matches(t, '\bsum\b')::INT + contains(t, 'critical path')::INT >= 2 THEN 'arithmetic'
    WHEN regexp_replace(w[1], '[?.,!:;]+$', '') IN ('who', 'what', 'where', 'when', 'which') AND len(w) < 15 THEN 'factual'
    WHEN contains(t, 'how do i') OR contains(t, 'how to') OR contains(t, 'steps') OR contains(t, 'walk me through') THEN 'procedural'
    WHEN contains(t, 'and then') OR contains(t, 'because') OR contains(t, 'after that') OR contains(t, 'compare') OR contains(t, ' vs ') OR regexp_matches(t, '\bbetween\s+\S+\s+and\s+\S+') OR len(w) > 25 THEN 'multi_hop' ELSE 'default' END AS class
    FROM (SELECT item_id AS query_id, lower(text) AS t, regexp_extract_all(lower(text), '\S+') AS w FROM benchmark)""",
)
def query_classes(spark, sf) -> DataFrame:
    return m.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), e.query_class(F.col("text")).alias("class"))


@query(
    "budget_caps",
    """SELECT event_id, CASE WHEN s < 0.25 THEN NULL WHEN s < 0.4 THEN 12 WHEN s < 0.6 THEN 6 WHEN s < 0.8 THEN 3 ELSE 1 END AS zone_cap, round_even(greatest(0.2, 1.0 * pow((event_id % 12 + 1)::DOUBLE, -0.7)), 6) AS foveated, greatest(1000, floor(floor((event_id % 9000) * 3.6::DOUBLE) / greatest(event_id % 12, 1)))::BIGINT AS splice
    FROM (SELECT event_id, (event_id % 1000) / 1000.0::DOUBLE AS s FROM events)""",
)
def budget_caps(spark, sf) -> DataFrame:
    i = F.col("event_id")
    return m.table(spark, sf, "events").select("event_id", e.zone_cap((i % 1000).cast("double"), F.lit(1000.0)).alias("zone_cap"), e.foveated_cap(i % 12 + 1, 0.7, 0.2).alias("foveated"), e.splice_target((i % 9000).cast("double"), i % 12).alias("splice"))


BINS = "bins AS (SELECT doc_id, term, tf, ('0x' || md5('spectrum' || term)[1:2])::INT AS bin FROM post)"


@query("spectrum_bins", f"WITH {m.POSTINGS}, {BINS} SELECT bin, count(*) AS rows, sum(tf)::BIGINT AS tf, count(DISTINCT term) AS terms FROM bins GROUP BY bin")
def spectrum_bins(spark, sf) -> DataFrame:
    return m.postings(spark, sf).groupBy(e.bin_of(F.col("term")).alias("bin")).agg(F.count("*").alias("rows"), F.sum("tf").alias("tf"), F.countDistinct("term").alias("terms"))


SPEC = rf"""tg AS (SELECT item_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 6))) AS ts FROM benchmark),
sp AS (SELECT id, i, round_even(sum(exp(-0.5 * pow((i - ('0x' || md5('spectrum' || t)[1:2])::INT) / 1.25::DOUBLE, 2))), 6) AS v FROM (SELECT id, unnest(ts) AS t FROM tg), range(0, 256) r(i) GROUP BY ALL),
nm AS (SELECT id, sqrt(sum(v * v)) AS n FROM sp GROUP BY id)"""


@query("spectrum_resonance", f"WITH {SPEC} SELECT x.id AS a, y.id AS b, round_even(sum(x.v * y.v) / (any_value(p.n) * any_value(q2.n)), 4) AS resonance FROM sp x JOIN sp y ON x.i = y.i AND x.id < y.id JOIN nm p ON p.id = x.id JOIN nm q2 ON q2.id = y.id WHERE p.n > 0 AND q2.n > 0 GROUP BY 1, 2 HAVING round_even(sum(x.v * y.v) / (any_value(p.n) * any_value(q2.n)), 4) > 0.1")
def spectrum_resonance(spark, sf) -> DataFrame:
    """Cosine of the query spectra, pairs above .1: the query set against itself, one block (a bounded set of queries)."""
    words = F.array_sort(F.array_distinct(F.filter(fx.tokens(F.col("text")), lambda w: F.length(w) >= 6)))
    q = m.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), words.alias("ts"))
    s = q.select("id", e.spectrum(F.transform("ts", e.bin_of), F.transform("ts", lambda _: F.lit(1.0))).alias("v"))
    x, y = s.toDF("a", "va"), s.toDF("b", "vb")
    pairs = x.join(tiers.terms_side(y, 20_000), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.bround(tiers.cosine(F.col("va"), F.col("vb")), 4).alias("resonance")).where("resonance > 0.1")


@query("spectrum_circular_distance")
def spectrum_circular_distance(spark, sf) -> DataFrame:
    """1 / (1 + W1) on the circle between each query and the next; tested against numpy."""
    words = F.array_distinct(F.filter(fx.tokens(F.col("text")), lambda w: F.length(w) >= 6))
    q = m.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), words.alias("ts"))
    s = q.select("id", e.spectrum(F.transform("ts", e.bin_of), F.transform("ts", lambda _: F.lit(1.0))).alias("v"))
    return s.toDF("a", "va").join(s.toDF("b", "vb"), F.col("b") == F.col("a") + 1).select("a", "b", e.circular_w1(F.col("va"), F.col("vb")).alias("similarity"))


SCORED = "sc AS (SELECT quality AS label, round_even(least(1.0, length(regexp_replace(text, '[^a-zA-Z ]', '', 'g')) / greatest(length(text), 1)::DOUBLE), 3) AS score FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf) -> DataFrame:
    share = F.length(F.regexp_replace("text", "[^a-zA-Z ]", "")) / F.greatest(F.length("text"), F.lit(1))
    return m.table(spark, sf, "documents").join(m.table(spark, sf, "labels"), "doc_id").select(F.col("quality").alias("label"), F.bround(F.least(share, F.lit(1.0)), 3).alias("score"))


@query("eval_auc", f"WITH {SCORED}, g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM sc GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM g) SELECT round_even((sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))), 6) AS auc, sum(pos)::BIGINT AS positives, (sum(n) - sum(pos))::BIGINT AS negatives FROM r")
def eval_auc(spark, sf) -> DataFrame:
    return e.auc(_scored(spark, sf))


@query("eval_ece", f"WITH {SCORED}, g AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS conf, avg(label) AS acc FROM sc GROUP BY 1) SELECT round_even(sum(n * abs(acc - conf)) / sum(n), 6) AS ece, count(*) AS bins FROM g")
def eval_ece(spark, sf) -> DataFrame:
    return e.ece(_scored(spark, sf))


@query(
    "eval_mrr_recall",
    f"""WITH {BM25}, gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents x ON contains(x.text, b.text)), f AS (SELECT item_id AS query_id, min(rank) AS rank FROM benchmark b LEFT JOIN (SELECT query_id, doc_id, rank FROM bmr JOIN gold USING (query_id, doc_id) WHERE rank <= 16) g ON g.query_id = item_id GROUP BY 1)
    SELECT round_even(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round_even(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END::DOUBLE), 6) AS recall_1, round_even(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END::DOUBLE), 6) AS recall_3, round_even(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END::DOUBLE), 6) AS recall_10 FROM f""",
)
def eval_mrr_recall(spark, sf) -> DataFrame:
    """Gold documents hold the query's text; a query's rank is that of its first gold document among the best 16."""
    b = m.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    top = tiers.top(_bm25(spark, sf), 16).select("query_id", "doc_id", "rank")
    held = top.join(m.documents(spark, sf).select("doc_id", "content"), "doc_id").join(tiers.terms_side(b, 20_000), "query_id").where(F.contains("content", "needle"))
    return e.mrr_recall(b.select("query_id").join(held.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left"))


@query("random_pair_threshold", f"WITH qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 25 = 0), p AS (SELECT {COS} AS score FROM embeddings, qv WHERE vec_id <> query_id) SELECT round_even(avg(score), 6) AS mu, round_even(stddev_samp(score), 6) AS sigma, round_even(avg(score) + 3 * stddev_samp(score), 6) AS threshold, count(*) AS pairs FROM p")
def random_pair_threshold(spark, sf) -> DataFrame:
    v = m.table(spark, sf, "embeddings")
    q = v.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return e.random_vector_threshold(v.select(F.col("vec_id").alias("doc_id"), "embedding"), q)
