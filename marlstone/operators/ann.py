"""Nearest vectors by an inverted file: cells around centroids, probed in the order in which they can hold better ones.

Vectors are made unit length, so that cosine is a dot product, and put into the cell of their nearest
centroid. For a query q and a vector x of a cell with centroid c, q.x is at most q.c + |x - c|; the largest
|x - c| of a cell hence bounds what it can hold. A first pass reads the cells nearest to a query. In the
exact way a second one reads every other cell whose bound reaches the score that the query's k-th vector
had so far, and no others. Cells with many vectors are cut into parts, so no task gets a hot cell whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import tiers
from marlstone.operators.graph import checkpointed

#: Vectors from which centroids are fitted, centroids at most, and rounds of fitting. Every vector is indexed.
SAMPLE, MOST_CELLS, ROUNDS = 100_000, 4096, 10
#: Vectors of a part of a cell, and queries that a task scores against it at a time.
PART, QUERIES = 16_384, 4096
#: Cells that the first pass reads for each query.
PROBES = 8
#: How far a bound may lie off by rounding.
SLACK = 2e-6


class Index(NamedTuple):
    """``cells(cell, center, radius, parts)`` and ``rows(cell, part, doc_id, unit)``."""

    cells: DataFrame
    rows: DataFrame


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector as it is."""
    n, d = tiers.norm(v), v.cast("array<double>")
    return F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> Index:
    """An index of ``vectors(doc_id, embedding)``; null vectors are left out. ``cells`` is the root of their number where it is not given.

    Centroids are fitted on about ``sample`` vectors taken by a hash of the id; what they are changes no exact result.
    """
    rows = checkpointed(vectors.where("embedding IS NOT NULL").select("doc_id", unit(F.col("embedding")).alias("unit")))
    n = rows.count()
    few = rows if n <= sample else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample)
    k = max(2, min(MOST_CELLS, cells or int(n**0.5)))
    spark, id_type = vectors.sparkSession, vectors.schema["doc_id"].dataType.simpleString()
    if n == 0:
        return Index(spark.createDataFrame([], "cell int, center array<double>, radius double, parts int"), spark.createDataFrame([], f"cell int, part int, doc_id {id_type}, unit array<double>"))
    different = few.select("unit").distinct().limit(k + 1).collect()
    if len(different) <= k:  # each its own centroid
        centers = np.array(sorted(r.unit for r in different))
    else:
        model = KMeans(k=k, seed=seed, maxIter=ROUNDS, featuresCol="features").fit(few.select(array_to_vector("unit").alias("features")))
        centers = np.array(model.clusterCenters())  # at most MOST_CELLS rows
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches):
        at = shared.value
        size = (at * at).sum(1)
        for batch in batches:
            x = _matrix(batch.column("unit"))
            cell = np.argmin(size - 2 * (x @ at.T), axis=1)
            away = np.sqrt(((x - at[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(away), *batch.columns], names=["cell", "away", "doc_id", "unit"])

    found = checkpointed(rows.mapInArrow(assign, f"cell int, away double, doc_id {id_type}, unit array<double>"))
    held = found.groupBy("cell").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
    table = checkpointed(middle.join(held, "cell").select("cell", "center", "radius", "parts"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    return Index(table, found.join(F.broadcast(table.select("cell", "parts")), "cell").select("cell", part.alias("part"), "doc_id", "unit"))  # MOST_CELLS rows


def _probe(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, q, cell, parts, near, bound): every query against every centroid, in Arrow batches."""
    known = cells.collect()  # at most MOST_CELLS rows
    shared = queries.sparkSession.sparkContext.broadcast((np.array([r.center for r in known]), np.array([r.radius for r in known]), np.array([r.cell for r in known]), np.array([r.parts for r in known])))
    id_type = queries.schema["query_id"].dataType.simpleString()

    def run(batches):
        centers, radius, cell, parts = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                near = _matrix(some.column("q")) @ centers.T
                m, k = near.shape
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([some.column("query_id").take(row), pa.array(np.tile(cell, m), pa.int32()), pa.array(np.tile(parts, m), pa.int32()), pa.array(near.ravel()), pa.array((near + radius).ravel())], names=["query_id", "cell", "parts", "near", "bound"])

    return queries.mapInArrow(run, f"query_id {id_type}, cell int, parts int, near double, bound double") if known else None


def _scored(pairs: DataFrame, queries: DataFrame, rows: DataFrame, k: int, least: float | None) -> DataFrame:
    """(query_id, doc_id, score): the best k of each probed part for each query of ``pairs(query_id, cell, parts)``."""
    query_type, id_type = (d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (rows, "doc_id")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, ids = _matrix(left["unit"]), left["doc_id"].to_numpy()
        q_ids, d_ids, scores = [], [], []
        for at in range(0, len(right) if len(left) else 0, QUERIES):
            some = right.slice(at, QUERIES)
            score = np.round(_matrix(some["q"]) @ x.T, 6) + 0.0
            for i, own in enumerate(score):
                best = np.flatnonzero(own >= np.partition(own, -k)[-k]) if len(own) > k else np.arange(len(own))
                best = best[np.lexsort((ids[best], -own[best]))][:k]
                best = best if least is None else best[own[best] >= least]
                q_ids += [some["query_id"][i].as_py()] * len(best)
                d_ids.append(ids[best])
                scores.append(own[best])
        flat = [np.concatenate(v) if v else np.zeros(0, t) for v, t in ((d_ids, ids.dtype), (scores, float))]
        return pa.table({"query_id": pa.array(q_ids, right.schema.field("query_id").type), "doc_id": pa.array(flat[0], left.schema.field("doc_id").type), "score": pa.array(flat[1], pa.float64())})

    asked = pairs.join(queries, "query_id").select("query_id", "q", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return rows.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(run, f"query_id {query_type}, doc_id {id_type}, score double")


def search(queries: DataFrame, index: Index, k: int, probes: int = PROBES, exact: bool = False, least: float | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest by cosine (six decimals; ties by id) of each of ``queries(query_id, q)``.

    Without ``exact``, among the ``probes`` nearest cells; with it, among all vectors. ``least`` is a floor
    of the score. Null queries find nothing; query ids must be unique.
    """
    asked = checkpointed(queries.where("q IS NOT NULL").select("query_id", unit(F.col("q")).alias("q")))
    every = _probe(asked, index.cells)
    if every is None:
        return tiers.top(index.rows.join(asked, F.lit(False)).select("query_id", "doc_id", F.lit(0.0).alias("score")), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "cell")
    every = checkpointed(every.withColumn("nth", F.row_number().over(order)))
    found = _scored(every.where(F.col("nth") <= probes).select("query_id", "cell", "parts"), asked, index.rows, k, least)
    if exact:
        found = checkpointed(tiers.top(found, k))
        so_far = found.groupBy("query_id").agg(F.min("score").alias("reached"), F.count("*").alias("n"))
        rest = every.where(F.col("nth") > probes).join(so_far, "query_id", "left")
        open_ = F.coalesce(F.col("n"), F.lit(0)) < k
        rest = rest.where((open_ | (F.col("bound") + SLACK >= F.col("reached"))) & (F.lit(True) if least is None else F.col("bound") + SLACK >= least))
        found = found.select("query_id", "doc_id", "score").union(_scored(rest.select("query_id", "cell", "parts"), asked, index.rows, k, least))
    return tiers.top(found, k)
