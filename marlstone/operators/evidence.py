"""Confidence, freshness, packets and spectra as column expressions, and the operators built of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators import tiers
from marlstone.operators.running import running

# Time constants by volatility (seconds), authority and specificity scores.
TAU = {"stable": 7 * 86400.0, "medium": 12 * 3600.0, "hot": 15 * 60.0}
AUTHORITY = {"primary": 1.0, "derived": 0.75, "inferred": 0.45}
SPECIFICITY = {"literal": 1.0, "span": 0.9, "doc": 0.75, "summary": 0.5, "inferred": 0.45}


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def freshness(verified_at: Column, volatility: Column, now: float) -> Column:
    """exp(-age / tau); null where the time is unknown."""
    age = F.greatest(F.lit(now) - verified_at, F.lit(0.0))
    return F.when(verified_at.isNotNull(), F.exp(-age / lookup(volatility, TAU, TAU["medium"])))


def live_truth(fresh: Column, authority: Column, specificity: Column, invalid: Column) -> Column:
    """Product of the three (unknown freshness counts 0), a quarter of it where invalidated."""
    p = F.coalesce(fresh, F.lit(0.0)) * lookup(authority, AUTHORITY, 0.75) * lookup(specificity, SPECIFICITY, 0.6)
    return fx.round6(F.when(invalid, p * 0.25).otherwise(p))


# How much may go wrong by kind of task, the kinds of high risk, and from which freshness on
# a source is verified or a stale risk.
TASK_RISK = {"plan": 0.30, "explain": 0.45, "review": 0.60, "edit": 0.85, "debug": 0.90, "ops": 1.00, "quote": 0.95}
HIGH_RISK = frozenset({"edit", "debug", "ops", "quote"})
FLOORS = {"high": (0.70, 0.35), "review": (0.55, 0.20), "other": (0.35, 0.12)}
LEAST_AUTHORITY, LEAST_COORDINATE, LEAST_FILE = 0.55, 0.30, 0.15


def risk_of(task: str) -> str:
    return "high" if task in HIGH_RISK else "review" if task == "review" else "other"


def status(fresh: Column, task: str, coordinate: Column, authority: Column | None = None, invalid: Column | None = None, files: Column | None = None) -> Column:
    """verified / stale_risk / needs_refresh of a source for a kind of task.

    Invalidated sources need a refresh. Unknown freshness and weak authority do so for tasks of high
    risk and are a stale risk else; then the task's floors of freshness count. Where the coordinates
    or the files named fall short, nothing is verified, and a task of high risk needs a refresh.
    """
    risk = risk_of(task)
    doubt = "needs_refresh" if risk == "high" else "stale_risk"
    verified, stale = FLOORS[risk]
    weak = lookup(authority, AUTHORITY, 0.75) < LEAST_AUTHORITY if authority is not None else F.lit(False)
    gone = F.coalesce(invalid, F.lit(False)) if invalid is not None else F.lit(False)
    base = F.when(gone, "needs_refresh").when(fresh.isNull() | weak, doubt).when(fresh >= verified, "verified").when(fresh >= stale, "stale_risk").otherwise("needs_refresh")
    off = coordinate < LEAST_COORDINATE
    if files is not None:
        off = off | (files < LEAST_FILE)
    return F.when(off & F.lit(risk == "high"), "needs_refresh").when(off & (base == "verified"), "stale_risk").otherwise(base)


def action_risk(fresh: Column, task: str, literal: Column) -> Column:
    """What acting on a source may cost: the task's risk for what isn't fresh, and .15 more where a task of high risk has no literal source; 1 at most."""
    extra = F.when(literal, 0.0).otherwise(0.15) if task in HIGH_RISK else F.lit(0.0)
    return fx.round6(F.least(F.lit(1.0), TASK_RISK.get(task, 0.5) * (1 - F.coalesce(fresh, F.lit(0.0))) + extra))


def density(tags: Column, keys: Column, chars: Column, accesses: Column, summary: Column) -> Column:
    """.4 tags/k + .3 keys/k + .2 min(accesses/10, 1) + .1 for a summary, k thousands of characters (one at least).

    Tenths of counts are divided out of whole numbers: .4 as a double is more than .4, and so might its products be.
    """
    k = F.greatest(chars / 1000.0, F.lit(1.0))
    return 4 * tags / 10.0 / k + 3 * keys / 10.0 / k + 0.2 * F.least(accesses / 10.0, F.lit(1.0)) + F.when(summary, 0.1).otherwise(0.0)


def density_gate(score: Column, denied: Column, accesses: Column, rate: Column) -> Column:
    """Lifecycle 0, 1 or 2 by density; denied paths are cold; busy documents stay open."""
    return F.when((accesses >= 5) | (rate >= 3), 0).when(denied, 2).when(score >= 1.0, 0).when(score >= 0.5, 1).otherwise(2)


def zone_cap(prompt: Column, window: Column) -> Column:
    """How many documents a prompt that fills part of the window may add; null for no cap."""
    share = prompt / window
    return F.when(share < 0.25, F.lit(None).cast("int")).when(share < 0.4, 12).when(share < 0.6, 6).when(share < 0.8, 3).otherwise(1)


def foveated_cap(position: Column, alpha: float, least: float, most: float = 1.0) -> Column:
    """max(least, most * position^-alpha)."""
    return fx.round6(F.greatest(F.lit(least), F.lit(most) * F.pow(position.cast("double"), F.lit(-alpha))))


def splice_target(tokens: Column, n: Column) -> Column:
    """Characters for each of n documents: max(1000, floor(tokens * 3.6) div n)."""
    return F.greatest(F.lit(1000), F.floor(F.floor(tokens * 3.6) / F.greatest(n, F.lit(1)))).cast("long")


# Signals of the classes of queries.
OPERATORS = ["+", "-", "*", "/", "%"]
QUANTITIES = [r"\bcalculate\b", r"\btotal\b", r"\bsum\b", "critical path"]
ASKING = ["who", "what", "where", "when", "which"]
STEPS = ["how do i", "how to", "steps", "walk me through"]
CONNECTIVES = ["and then", "because", "after that", "compare", " vs "]
BETWEEN = r"\bbetween\s+\S+\s+and\s+\S+"


def query_class(text: Column) -> Column:
    """arithmetic (two signals of operators and quantities), factual (a question word leads fewer than 15 words),
    procedural, multi_hop (a connective, "between x and y", or more than 25 words) or default: the first that holds."""
    t = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    signals = sum((F.contains(t, F.lit(x)).cast("int") for x in OPERATORS), F.lit(0)) + sum((t.rlike(x).cast("int") for x in QUANTITIES), F.lit(0))
    first = F.regexp_replace(F.coalesce(F.get(words, 0), F.lit("")), r"[?.,!:;]+$", "")
    holds = lambda found: F.greatest(*(F.contains(t, F.lit(x)) for x in found))
    return (
        F.when(signals >= 2, "arithmetic")
        .when(first.isin(ASKING) & (F.size(words) < 15), "factual")
        .when(holds(STEPS), "procedural")
        .when(holds(CONNECTIVES) | t.rlike(BETWEEN) | (F.size(words) > 25), "multi_hop")
        .otherwise("default")
    )


CLASS_CAPS = {"arithmetic": 2, "factual": 5, "procedural": 6, "multi_hop": 8, "default": 8}


def budget_tiers(rows: DataFrame, by: str = "query_id", floor: float = 0.15, tight: float = 3.0, focused: float = 1.8) -> DataFrame:
    """Candidates (rank, score) a query may spend: at most three pass as they are; else scores under ``floor``
    of the top drop unless fewer than three would stay, and the top / mean ratio picks 3 (tight), 6 (focused) or all (broad)."""
    w = Window.partitionBy(by)
    r = rows.withColumn("_top", F.max("score").over(w)).withColumn("_n", F.count("*").over(w)).withColumn("_mean", F.avg("score").over(w))
    above = F.sum((F.col("score") >= floor * F.col("_top")).cast("int")).over(w)
    r = r.withColumn("_above", above).withColumn("ratio", F.when(F.col("_mean") > 0, fx.round6(F.col("_top") / F.col("_mean"))).otherwise(0.0))
    tier = F.when(F.col("_n") <= 3, "pass").when(F.col("ratio") >= tight, "tight").when(F.col("ratio") >= focused, "focused").otherwise("broad")
    r = r.withColumn("tier", tier)
    most = F.when(F.col("tier") == "tight", 3).when(F.col("tier") == "focused", 6).otherwise(1_000_000)
    ok = (F.col("_n") <= 3) | (((F.col("score") >= floor * F.col("_top")) | (F.col("_above") < 3)) & (F.col("rank") <= most))
    return r.where(ok).select(by, "doc_id", "score", "rank", "ratio", "tier")


def abstain(rows: DataFrame, by: str = "query_id", floor: float = 2.5) -> DataFrame:
    """Per query: additive abstains if top < floor and top/mean < 1.8; rrf if (top - min) / (mean - min) < 1.5, degenerate 0."""
    g = rows.groupBy(by).agg(F.max("score").alias("top"), F.bround(F.avg("score"), 9).alias("mean"), F.min("score").alias("low"))
    r = F.when(F.col("mean") - F.col("low") > 1e-9, (F.col("top") - F.col("low")) / (F.col("mean") - F.col("low"))).otherwise(0.0)
    return g.select(by, "top", fx.round6(r).alias("rrf_ratio"), ((F.col("top") < floor) & (F.col("top") < 1.8 * F.col("mean"))).alias("abstain_additive"), (fx.round6(r) < 1.5).alias("abstain_rrf"))


# Coefficients of the confidence, scales of score and gap, and from where on it is told.
BETAS = {"b0": -2.0, "score": 2.0, "gap": 1.5, "agree": 0.7, "coord": 1.8, "fresh": 1.5}
SCORE_SCALE, GAP_SCALE, EMIT_FLOOR = 1.0, 0.5, 0.55


def confidence(score: Column, gap: Column, agree: Column, coord: Column, fresh: Column, s_ref: float = SCORE_SCALE, g_ref: float = GAP_SCALE) -> Column:
    """Logistic of the saturated score and gap, agreement, coordinates and freshness (both within 0 and 1); unknown freshness adds nothing."""
    b = BETAS
    part = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    z = b["b0"] + b["score"] * F.tanh(score / s_ref) + b["gap"] * F.tanh(gap / g_ref) + b["agree"] * agree + b["coord"] * part(coord) + b["fresh"] * part(fresh)
    return fx.round6(1 / (1 + F.exp(-z)))


def know_or_miss(found: Column, conf: Column, abstain: Column, denatured: Column, superseded: Column, stale: Column, cold: Column, floor: float = EMIT_FLOOR) -> Column:
    """know, or why not: the first of abstain, denatured, no_promoter_match, superseded, stale; under the floor cold or sparse."""
    out = F.when(abstain, "abstain").when(denatured, "denatured").when(F.coalesce(found, F.lit(0)) == 0, "no_promoter_match")
    return out.when(superseded, "superseded").when(stale, "stale").when((conf < floor) & cold, "cold").when(conf < floor, "sparse").otherwise("know")


def iso_time(text: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 date or time with hyphens; UTC without an offset, null if it is none."""
    t = F.trim(text)
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:\d{2})$"), t).when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.concat(t, F.lit("Z")))
    return F.unix_micros(full.try_cast("timestamp")) / 1e6


def calibration_age(fitted_at: Column, now: float, most_days: int = 30) -> Column:
    """(age in whole days, stale) of a calibration: no age and no warning where its time is unknown; one of the future is 0 days old."""
    days = F.greatest(F.floor((F.lit(now) - fitted_at) / 86400.0), F.when(fitted_at.isNotNull(), F.lit(0)))
    return F.struct(days.cast("long").alias("age_days"), F.coalesce(days > most_days, F.lit(False)).alias("stale"))


def monotonicity_violations(betas: dict[str, float]) -> list[str]:
    """Features whose coefficient is negative: more evidence would lower the confidence."""
    return [k for k, v in betas.items() if k != "b0" and v < 0]


def legibility(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """z-score of each candidate among its query's (sample deviation) and its mark: full from 1, half from 0, else empty."""
    w = Window.partitionBy(by)
    sd = F.stddev_samp("score").over(w)
    z = F.when(sd > 1e-12, (F.col("score") - F.avg("score").over(w)) / sd).otherwise(0.0)
    return rows.withColumn("z", F.bround(z, 4)).withColumn("mark", F.when(F.col("z") >= 1, "full").when(F.col("z") >= 0, "half").otherwise("empty"))


def health(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """Coverage, density and freshness of each query's context, their geometric mean (parts at least .01), and a status."""
    g = rows.groupBy(by).agg(F.avg("covered").alias("coverage"), F.avg("dense").alias("density"), F.min("fresh").alias("freshness"))
    part = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.01))
    e = F.pow(part("coverage") * part("density") * part("freshness"), F.lit(1 / 3))
    g = g.withColumn("ellipticity", fx.round6(e))
    s = F.when(F.col("ellipticity") >= 0.7, "aligned").when(F.col("ellipticity") >= 0.4, "sparse").when(F.coalesce("freshness", F.lit(0.0)) < 0.2, "stale").otherwise("denatured")
    return g.select(by, *(F.bround(c, 9).alias(c) for c in ("coverage", "density", "freshness")), "ellipticity", s.alias("status"))


# Weights of the natural-logic relations by number (entailment, reverse entailment,
# equivalence, alternation, negation, cover, independence).
COHERENCE = [1.0, 0.8, 1.0, -0.3, -0.5, 0.5, 0.0]


def coherence(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """Logical coherence of each query's judged pairs (relation, confidence): the mean weighted confidence, from [-0.5, 1] to [0, 1]."""
    weight = F.coalesce(F.get(F.array(*map(F.lit, COHERENCE)), F.col("relation")), F.lit(0.0))
    raw = F.avg(weight * F.col("confidence"))
    return rows.groupBy(by).agg(fx.round6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw + 0.5) / 1.5))).alias("coherence"))


# --- spectra ----------------------------------------------------------------------------------


def bin_of(term: Column) -> Column:
    """Frequency bin of a term: the first byte of a salted md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("spectrum"), F.lower(term)).cast("binary")), 1, 2), 16, 10).cast("int")


def spectrum(bins: Column, weights: Column, sigma: float = 1.25, size: int = 256) -> Column:
    """Sum over terms of weight * exp(-((i - bin) / sigma)^2 / 2) for each of ``size`` bins; entries of six decimals."""
    pairs = F.arrays_zip(bins.alias("b"), weights.alias("w"))
    peak = lambda i: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"] * F.exp(-0.5 * F.pow((i - p["b"]) / sigma, F.lit(2.0))))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: fx.round6(peak(i)))


def circular_w1(a: Column, b: Column) -> Column:
    """1 / (1 + W1) of two spectra on the circle: cumulative differences about their median."""
    norm = lambda x: F.transform(x, lambda v: v / F.greatest(F.aggregate(x, F.lit(0.0), lambda s, y: s + y), F.lit(1e-12)))
    diff = F.zip_with(norm(a), norm(b), lambda x, y: x - y)
    run = F.aggregate(diff, F.array().cast("array<double>"), lambda acc, d: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + d)))
    middle = lambda c: F.element_at(F.transform(F.array(F.array_sort(c)), lambda o: (F.get(o, F.lit(127)) + F.get(o, F.lit(128))) / 2), 1)
    about = lambda c, m: F.aggregate(c, F.lit(0.0), lambda s, v: s + F.abs(v - m))
    from_median = lambda c: F.element_at(F.transform(F.array(middle(c)), lambda m: about(c, m)), 1)  # noqa: E731  sorted once
    return F.element_at(F.transform(F.array(run), lambda c: fx.round6(1 / (1 + from_median(c)))), 1)


# --- evaluation -------------------------------------------------------------------------------


def auc(rows: DataFrame) -> DataFrame:
    """Area under the curve of (score, label) with average ranks for ties, from per-score counts: no global sort of rows.

    Scores are grouped first; the running count over distinct scores goes by ranges of them.
    """
    g = rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    g = running(g, [F.asc("score")], {"upto": F.col("n")})
    g = g.withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n") - F.sum("pos")
    return g.agg(fx.round6((F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2) / (p * n)).alias("auc"), p.cast("long").alias("positives"), n.cast("long").alias("negatives"))


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error: mean |accuracy - confidence| of equal-width bins, weighted by rows."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    g = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg("label").alias("acc"))
    return g.agg(fx.round6(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"), F.count("*").alias("bins"))


def mrr_recall(found: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Mean reciprocal rank and recall at each k of (query_id, rank); a null rank is a miss."""
    r = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    return found.agg(fx.round6(F.avg(r)).alias("mrr"), *(fx.round6(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))).alias(f"recall_{k}") for k in ks))


def random_pair_threshold(pairs: DataFrame, k: float = 3.0) -> DataFrame:
    """mu, sigma (sample) and mu + k sigma of the cosine of unrelated pairs."""
    mu, sd = F.avg("score"), F.stddev_samp("score")
    return pairs.agg(fx.round6(mu).alias("mu"), fx.round6(sd).alias("sigma"), fx.round6(mu + k * sd).alias("threshold"), F.count("*").alias("pairs"))


#: Pairs up to which each one's cosine is taken and rounded; beyond, their moments come from those of the vectors.
EXACT_PAIRS = 20_000_000


def _moments(vectors: DataFrame) -> DataFrame:
    """(kind, at, value) of unit vectors ``v``: their number (kind 0), sum (1) and sum of outer products (2), a place each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts = 0, None
        for batch in batches:
            n += len(batch)
            x = tiers.unit_rows(batch.column(0))
            if x.shape[1]:
                own = [x.sum(0), (x.T @ x).ravel()]
                parts = own if parts is None else [a + b for a, b in zip(parts, own, strict=True)]
        for kind, value in enumerate([np.array([float(n)]), *(parts or [])]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), kind, np.int32)), pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], names=["kind", "at", "value"])

    return vectors.mapInArrow(run, "kind int, at int, value double").groupBy("kind", "at").agg(F.sum("value").alias("value"))


def random_vector_threshold(vectors: DataFrame, queries: DataFrame, k: float = 3.0) -> DataFrame:
    """``random_pair_threshold`` of all pairs of ``vectors(doc_id, embedding)`` and ``queries(query_id, q)`` of different ids.

    Over all pairs the sum of x.y is the product of the sums of x and y, and that of (x.y)^2 the product of their sums of
    outer products; pairs of one id are taken off. So no pair is left out, and work and memory follow the vectors.
    Up to ``EXACT_PAIRS`` pairs each cosine is rounded to six decimals on its own, which moments can't do: by
    them the mean differs by what those roundings leave, under 1e-9 for pairs that are mostly different.
    """
    x = vectors.where("doc_id IS NOT NULL").select("doc_id", "embedding")
    y = queries.where("query_id IS NOT NULL").select("query_id", "q")
    score = tiers.cosine(F.col("embedding"), F.col("q"))
    if x.count() * y.count() <= EXACT_PAIRS:
        return random_pair_threshold(x.join(tiers.terms_side(y, 20_000), F.col("doc_id") != F.col("query_id")).select(fx.round6(score).alias("score")), k)
    every = _moments(x.select("embedding")).join(_moments(y.select("q")).withColumnRenamed("value", "other"), ["kind", "at"])
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value") * F.col("other"))), F.lit(0.0))
    every = every.agg(*(of(i).alias(f"all_{i}") for i in range(3)))
    same = x.join(y, F.col("doc_id") == F.col("query_id")).select(score.alias("s"))
    same = same.agg(F.count("*").alias("own_0"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("own_1"), F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("own_2"))
    n, one, two = (F.col(f"all_{i}") - F.col(f"own_{i}") for i in range(3))
    mu, sd = F.try_divide(one, n), F.sqrt(F.greatest(F.try_divide(two - F.try_divide(one * one, n), n - 1), F.lit(0.0)))
    return every.join(F.broadcast(same)).select(fx.round6(mu).alias("mu"), fx.round6(sd).alias("sigma"), fx.round6(mu + k * sd).alias("threshold"), F.round(n).cast("long").alias("pairs"))
