"""Rank fusion, rerank combinators and blends."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators.graph import checkpointed

#: Rows that a task of ``ranks_of`` sorts at a time.
ROWS_AT_ONCE = 500_000


def ranked(tier: DataFrame, by: str = "query_id") -> DataFrame:
    """Unique ranks by (score desc, id asc)."""
    return tier.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.asc("doc_id"))))


def _wide(tiers: dict[str, DataFrame], value: str) -> DataFrame:
    """(query_id, doc_id, one column a tier): one union and one aggregation, however many tiers."""
    rows = reduce(DataFrame.union, (t.select("query_id", "doc_id", F.lit(name).alias("tier"), F.col(value).cast("double").alias("v")) for name, t in tiers.items()))
    return rows.groupBy("query_id", "doc_id").agg(*(F.max(F.when(F.col("tier") == name, F.col("v"))).alias(name) for name in tiers))


def _sum(columns: list[Column]) -> Column:
    """A sum in the given order, whatever the plan."""
    return reduce(lambda a, b: a + b, columns)


def rrf(tiers: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = 60, top_m: int | None = None, least: float | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum over tiers of weight / (k + rank), in tier order.

    Only the first ``top_m`` ranks and raw scores of at least ``least`` count if given; a tier of weight 0 has no effect.
    """
    weights = weights or {}
    used = {n: ranked(t) for n, t in tiers.items() if weights.get(n, 1.0)}
    if top_m:
        used = {n: t.where(F.col("rank") <= top_m) for n, t in used.items()}
    if least is not None:
        used = {n: t.where(F.col("score") >= least) for n, t in used.items()}
    return by_ranks(used, weights, k)


def by_ranks(ranks: dict[str, DataFrame], weights: dict[str, float], k: int = 60) -> DataFrame:
    """The sum of weight / (k + rank) over tables (query_id, doc_id, rank), in their order."""
    wide = _wide(ranks, "rank")
    return wide.select("query_id", "doc_id", fx.round6(_sum([F.coalesce(F.lit(float(weights.get(n, 1.0))) / (k + F.col(n)), F.lit(0.0)) for n in ranks])).alias("score"))


def ranks_of(tier: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ranks that ``ranked`` gives the rows of ``tier`` that are in ``wanted(query_id, doc_id)``, ids being numbers.

    They are counted, not sorted: ``wanted`` (a depth of each query) is broadcast, each task counts its rows before
    each of them, and the counts are summed. So no row of the tier is shuffled for its rank, and a query is no single task.
    """
    own = checkpointed(tier.join(F.broadcast(wanted.select("query_id", "doc_id")), ["query_id", "doc_id"]).select("query_id", "doc_id", "score"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    mark = [c.to_numpy() for c in own.orderBy("query_id", F.desc("score"), "doc_id").toArrow().combine_chunks().columns]
    shared = tier.sparkSession.sparkContext.broadcast(mark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, doc, score = shared.value
        found, held, rows = np.zeros(len(query), np.int64), [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                rows += len(batch)
            if held and (batch is None or rows >= ROWS_AT_ONCE):
                q, d, s = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("query_id", "doc_id", "score"))
                held, rows = [], 0
                order = np.lexsort((np.r_[np.zeros(len(q), bool), np.ones(len(query), bool)], np.r_[d, doc], -np.r_[s, score], np.r_[q, query]))
                is_mark = order >= len(q)
                ahead = np.cumsum(~is_mark)[is_mark]  # of all queries up to this one
                found[order[is_mark] - len(q)] += ahead - np.searchsorted(np.sort(q), query[order[is_mark] - len(q)])
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(query[some]), pa.array(doc[some]), pa.array(found[some])], names=["query_id", "doc_id", "n"])

    if not len(mark[0]):
        return own.select("query_id", "doc_id", F.lit(0).cast("long").alias("rank"))
    counts = tier.select("query_id", "doc_id", "score").mapInArrow(count, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, n long")
    return checkpointed(counts.groupBy("query_id", "doc_id").agg(F.sum("n").alias("rank")))


def additive(tiers: dict[str, DataFrame], caps: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Sum of the tiers' scores; ``caps`` gives (scale, cap) of a tier: min(score * scale, cap)."""
    caps = caps or {}
    wide = _wide(tiers, "score")
    part = lambda n: F.least(F.col(n) * caps[n][0], F.lit(float(caps[n][1]))) if n in caps else F.col(n)
    return wide.select("query_id", "doc_id", fx.round6(_sum([F.coalesce(part(n), F.lit(0.0)) for n in tiers])).alias("score"))


def combine_additive(fused: DataFrame, bonuses: dict[str, DataFrame]) -> DataFrame:
    """Fused scores plus all bonuses of their documents."""
    wide = _wide(bonuses, "score")
    total = _sum([F.coalesce(F.col(n), F.lit(0.0)) for n in bonuses])
    return fused.join(wide, ["query_id", "doc_id"], "left").select("query_id", "doc_id", fx.round6(F.col("score") + total).alias("score"))


def combine_tiers(fused: DataFrame, bonuses: dict[str, DataFrame], weight: float = 1.0, k: int = 60) -> DataFrame:
    """Each bonus class becomes a rank tier of its positive members among the fused documents."""
    members = {n: ranked(t.where("score > 0").join(fused.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")) for n, t in bonuses.items()}
    wide = _wide(members, "rank")
    total = _sum([F.coalesce(F.lit(weight) / (k + F.col(n)), F.lit(0.0)) for n in bonuses])
    return fused.join(wide, ["query_id", "doc_id"], "left").select("query_id", "doc_id", fx.round6(F.col("score") + total).alias("score"))


def eps_band(rows: DataFrame, delta: float = 0.05, by: str = "query_id") -> DataFrame:
    """Near ties reordered: from the best down, documents within ``delta`` of a band's leader form a
    band, ordered by ``bonus``; the next document leads the next band. Adds ``position``.

    Bands depend on the leader before them, a fold over the sorted list of one query's candidates
    (bounded by the retrieval depth), done with ``aggregate``.
    """
    item = F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d"), F.col("bonus").alias("b"))
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    state = F.struct(F.lit(float("inf")).alias("lead"), F.lit(0).alias("band"), F.array().cast("array<struct<band:int,b:double,s:double,d:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        score = -x["s"]
        new = (acc["band"] == 0) | (score < acc["lead"] * (1 - delta))
        band = F.when(new, acc["band"] + 1).otherwise(acc["band"])
        placed = F.struct(band.alias("band"), (-x["b"]).alias("b"), x["s"].alias("s"), x["d"].alias("d"))
        return F.struct(F.when(new, score).otherwise(acc["lead"]).alias("lead"), band.alias("band"), F.concat(acc["out"], F.array(placed)).alias("out"))

    folded = lists.select(by, F.posexplode(F.array_sort(F.aggregate("items", state, step, lambda a: a["out"]))).alias("i", "x"))
    return folded.select(by, F.col("x.d").alias("doc_id"), F.col("x.band").alias("band"), (F.col("i") + 1).alias("position"))


def gate(rows: DataFrame, threshold: float, least: int, most: int, floor: int, by: str = "query_id") -> DataFrame:
    """ANN gate over ``rows(score, is_dense)``: keep scores of at least ``threshold`` and the first ``least``,
    ``most`` at most; if fewer than ``floor`` dense hits are kept, the next dense ones follow."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("doc_id"))
    r = rows.withColumn("rank", F.row_number().over(w))
    kept = ((F.col("score") >= threshold) | (F.col("rank") <= least)) & (F.col("rank") <= most)
    r = r.withColumn("kept", kept)
    have = F.sum((F.col("kept") & F.col("is_dense")).cast("int")).over(Window.partitionBy(by))
    spare = F.row_number().over(Window.partitionBy(by, F.col("kept"), F.col("is_dense")).orderBy("rank"))
    extra = ~F.col("kept") & F.col("is_dense") & (F.col("_spare") <= floor - F.col("_have"))
    return r.withColumn("_have", have).withColumn("_spare", spare).where(F.col("kept") | extra).select(by, "doc_id", "score", "rank", (~F.col("kept")).alias("appended"))


def union_pinned(lexical: DataFrame, dense: DataFrame, threshold: float) -> DataFrame:
    """Lexical and dense candidates: the dense score where there is one, else just below the threshold."""
    a, b = lexical.select("query_id", "doc_id", F.lit(True).alias("_lex")), dense.select("query_id", "doc_id", F.col("score").alias("_s"))
    j = a.join(b, ["query_id", "doc_id"], "full_outer")
    return j.select("query_id", "doc_id", fx.round6(F.coalesce("_s", F.lit(threshold - 0.01))).alias("score"), F.col("_s").isNotNull().alias("is_dense"))


def shard_correction(terms: DataFrame, by_shard: DataFrame, totals: DataFrame, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """(query_id, shard, factor): the mean of global idf / local idf over a query's terms, weighted by global idf, clipped.

    ``by_shard(shard, term, n)`` counts documents, ``totals(shard, total)`` their number.
    """
    idf = lambda n, total: F.greatest(F.log((total - n + 0.5) / (n + 0.5)), F.lit(1e-6))
    every = by_shard.groupBy("term").agg(F.sum("n").alias("gn")).crossJoin(F.broadcast(totals.agg(F.sum("total").alias("gtotal"))))
    every = every.select("term", idf(F.col("gn"), F.col("gtotal")).alias("g"))
    local = by_shard.join(totals, "shard").select("shard", "term", idf(F.col("n"), F.col("total")).alias("l"))
    rows = terms.join(local, "term").join(every, "term")
    factor = F.sum(F.col("g") * F.col("g") / F.col("l")) / F.sum("g")
    return rows.groupBy("query_id", "shard").agg(fx.round6(F.least(F.greatest(factor, F.lit(low)), F.lit(high))).alias("factor"))


def best_of_shards(rows: DataFrame) -> DataFrame:
    """Best score of each document over shards, and the shard that has it (the first by name on ties)."""
    pick = F.min_by(F.col("shard"), F.struct((-F.col("score")).alias("s"), F.col("shard").alias("h")))
    return rows.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), pick.alias("shard"))


def blend(rows: DataFrame, refiners: dict[str, float], mode: str = "legacy") -> DataFrame:
    """Refiner columns added to ``score``: each at most its cap, plainly or relative to the score (x (1 + min(b, cap) / 10))."""
    score = F.col("score")
    for name, cap in refiners.items():
        bonus = F.least(F.coalesce(F.col(name), F.lit(0.0)), F.lit(cap))
        score = score + bonus if mode == "legacy" else score * (1 + bonus / 10) if mode == "scale_relative" else score
    return rows.withColumn("score", F.bround(score, 9))


def subquery_merge(rows: DataFrame) -> DataFrame:
    """Documents of several sub-queries by how many found them, then by their best score: ``position``."""
    g = rows.groupBy("query_id", "doc_id").agg(F.countDistinct("sub_id").alias("hit_count"), F.max("score").alias("score"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hit_count"), F.desc("score"), F.asc("doc_id"))))
