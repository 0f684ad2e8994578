"""Second-chance retrieval, calibration and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators.running import running
from marlstone.operators import tiers


def semantic_boost(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, least: float = 0.3, weak: float = 20.0) -> DataFrame:
    """Bonus of candidates of weak queries (top score below ``weak``): sim * 2 * max(.5, 1 - top / 40) where sim > ``least``."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    c = candidates.withColumn("_top", top).where(F.col("_top") < weak)
    j = c.join(vectors, "doc_id").join(tiers.terms_side(queries, 20_000), "query_id").withColumn("sim", fx.round6(tiers.cosine(F.col("embedding"), F.col("q"))))
    return j.where(F.col("sim") > least).select("query_id", "doc_id", fx.round6(F.col("sim") * 2.0 * F.greatest(F.lit(0.5), 1 - F.col("_top") / 40)).alias("score"))


def semantic_fill(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int, least: float = 0.4) -> DataFrame:
    """For queries with fewer than limit / 2 candidates the nearest other documents above ``least``, up to ``limit`` in all; score 3 sim."""
    have = candidates.groupBy("query_id").agg(F.count("*").alias("have"))
    thin = queries.join(have, "query_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < limit / 2)
    near = tiers.dense(thin.select("query_id", "q"), vectors, 2 * limit, least=least).where(F.col("score") > least)
    new = near.join(candidates.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").drop("rank")
    return tiers.top(new, limit).join(F.broadcast(have), "query_id", "left").where(F.col("rank") <= limit - F.coalesce("have", F.lit(0))).select("query_id", "doc_id", fx.round6(F.col("score") * 3.0).alias("score"))


def lexical_rescue(tag_hits: DataFrame, text_hits: DataFrame, known: DataFrame, config_like: Column) -> DataFrame:
    """Two ranked lists of sources, each once, known ones left out: tag hits first for config-like queries, else text hits.

    ``tag_hits(query_id, source_id, hits, bonus)``, ``text_hits(query_id, source_id, score)``.
    """
    a = tag_hits.select("query_id", "source_id", (F.col("hits") + F.col("bonus")).cast("double").alias("s"), F.lit("tag").alias("list"))
    b = text_hits.select("query_id", "source_id", F.col("score").alias("s"), F.lit("text").alias("list"))
    both = a.union(b).withColumn("key", fx.normalise_source(F.col("source_id")))
    first = F.when((F.col("list") == "tag") == config_like, 0).otherwise(1)
    both = both.withColumn("first", first).join(known.select("query_id", fx.normalise_source(F.col("source_id")).alias("key")), ["query_id", "key"], "left_anti")
    once = both.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("first", F.desc("s")))).where("_r = 1")
    return once.select("query_id", "source_id", "list", F.row_number().over(Window.partitionBy("query_id").orderBy("first", F.desc("s"), "source_id")).alias("position"))


def chunk_fetch(tag_hits: DataFrame, text_hits: DataFrame, k: int) -> DataFrame:
    """Tag hits plus 1 / (1 + |text score|) of each chunk, the k best. Rows that both sides have dealt alike by ``doc_id`` are summed where they lie."""
    tags = tag_hits.select("query_id", "doc_id", F.col("hits").cast("double").alias("hits"), F.lit(None).cast("double").alias("t"))
    both = tags.union(text_hits.select("query_id", "doc_id", F.lit(None).cast("double"), F.col("score"))).groupBy("query_id", "doc_id").agg(F.max("hits").alias("hits"), F.max("t").alias("t"))
    return tiers.top(both.select("query_id", "doc_id", fx.round6(F.coalesce("hits", F.lit(0.0)) + F.coalesce(1 / (1 + F.abs("t")), F.lit(0.0))).alias("score")), k)


def cold_fall_through(hot: DataFrame, cold: DataFrame, least_hot: int) -> DataFrame:
    """Hot results, and the cold ones of queries with at most ``least_hot`` hot results."""
    enough = hot.groupBy("query_id").count().where(F.col("count") > least_hot).select("query_id")
    return hot.select("query_id", "doc_id", "score", F.lit("hot").alias("tier")).union(cold.join(enough, "query_id", "left_anti").select("query_id", "doc_id", "score", F.lit("cold").alias("tier")))


def relevance_window(docs: DataFrame, terms: DataFrame, width: int = 40, step: int = 20) -> DataFrame:
    """The window of ``width`` tokens with the highest sum of term weights in each document: (query_id, doc_id, start, weight).

    Tokens are cut into overlapping windows by position, filtered to query terms by an equi-join, and summed.
    """
    words = docs.select("doc_id", F.posexplode(fx.tokens(F.col("content"))).alias("pos", "term"))
    hits = words.join(tiers.terms_side(terms), "term")
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("pos") - width + 1) / step) * step), F.floor(F.col("pos") / step) * step, F.lit(step))
    w = hits.select("query_id", "doc_id", "term", F.explode(starts).alias("start")).groupBy("query_id", "doc_id", "start").agg(fx.round6(F.sum(fx.term_weight(F.col("term")))).alias("weight"))
    best = F.struct(F.col("weight").alias("w"), (-F.col("start")).alias("s"))
    return w.groupBy("query_id", "doc_id").agg(F.max(best).alias("b")).select("query_id", "doc_id", (-F.col("b.s")).cast("long").alias("start"), F.col("b.w").alias("weight"))


def source_change_compaction(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents whose source changed after their last access: decay at most .5, lifecycle 1."""
    j = docs.join(sources.select("source_id", "mtime"), "source_id", "left")
    changed = F.coalesce(F.col("mtime") > F.col("last_accessed"), F.lit(False))
    return j.select("doc_id", F.when(changed, F.least("decay", F.lit(0.5))).otherwise(F.col("decay")).alias("decay"), F.when(changed, 1).otherwise(F.col("lifecycle")).alias("lifecycle"), changed.alias("changed"))


def calibration(rows: DataFrame, features: list[str], label: str = "label", ridge: float = 0.01) -> list[float]:
    """Intercept and coefficients of a logistic regression, fitted on the cluster."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows.select(*features, F.col(label).cast("double").alias("label")))
    model = LogisticRegression(maxIter=100, regParam=ridge).fit(data)
    return [float(model.intercept), *map(float, model.coefficients)]


def risk_coverage(rows: DataFrame, points: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Error rate among the most confident share of (score, label) rows, ties together: (coverage, risk, n)."""
    g = rows.groupBy("score").agg(F.count("*").alias("n"), F.sum(1 - F.col("label")).alias("wrong"))
    g = running(g, [F.desc("score")], {"cn": F.col("n"), "cw": F.col("wrong")})
    p = g.join(F.broadcast(g.agg(F.max("cn").alias("all")))).select("cn", "cw", "all", F.explode(F.array(*map(F.lit, points))).alias("coverage")).where(F.col("cn") >= F.col("coverage") * F.col("all"))
    return p.groupBy("coverage").agg(F.min_by("cw", "cn").alias("w"), F.min("cn").alias("n")).select("coverage", fx.round6(F.col("w") / F.col("n")).alias("risk"), "n")
