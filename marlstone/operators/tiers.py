"""Relevance tiers: each takes query terms and an index and returns (query_id, doc_id, score).

Query terms are one batch of queries. They are broadcast when counted to be few; the document side
is never broadcast, and posting lists are never joined to posting lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators import dealing, index
from marlstone.operators.graph import checkpointed
from marlstone.operators.running import running

#: Query terms up to which they are broadcast.
BROADCAST_TERMS = 500_000
#: Pairs of a query and a document that a task sums, and at most, where fewer would mean to deal rows twice.
PAIRS, MOST_PAIRS = 250_000, 1_000_000


def terms_side(terms: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    return F.broadcast(terms) if terms.limit(most + 1).count() <= most else terms


def by_document(hits: DataFrame, documents: int, queries: DataFrame) -> DataFrame:
    """``hits`` dealt by ``doc_id``, so that what is grouped by query and document is grouped in the task that it lies in.

    A task has about ``PAIRS`` pairs of a query and a document. Up to ``FILE_TASKS`` tasks rows are dealt once, so there
    are no more until a task would have ``MOST_PAIRS``.
    """
    pairs = documents * max(1, queries.select("query_id").distinct().count())
    tasks = max(hits.sparkSession.sparkContext.defaultParallelism, min(dealing.FILE_TASKS, -(-pairs // PAIRS)), -(-pairs // MOST_PAIRS))
    return dealing.dealt(hits, tasks, "doc_id")


def top(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", doc_id: str = "doc_id") -> DataFrame:
    """The k best of each query by (score desc, id asc), with ``rank``; Spark prunes before its shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(doc_id))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(terms: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75, idf: DataFrame | None = None) -> DataFrame:
    """``bm25_of`` an index built of ``docs(doc_id, content)`` for this call."""
    return bm25_of(terms, index.postings(docs), index.doc_stats(docs), k1, b, idf)


def bm25_of(terms: DataFrame, postings: DataFrame, lengths: DataFrame, k1: float = 1.2, b: float = 0.75, idf: DataFrame | None = None) -> DataFrame:
    """BM25 by an index (``postings(doc_id, dl, term, tf)``, ``lengths(doc_id, dl)``); idf = ln((N - n + .5) / (n + .5)),
    at least 1e-6, or given as (term, idf).

    Postings are filtered to query terms where they are read, then dealt by document (``by_document``): neither a
    reader nor a summing task holds more pairs for more documents.
    """
    hits = postings.join(terms_side(terms.select("term").distinct()), "term")
    stats = lengths.agg(F.count("*").alias("total"), F.avg("dl").alias("avgdl"))
    if idf is None:
        n = F.col("n")
        counts = hits.groupBy("term").agg(F.count("*").alias("n"))
        idf = counts.join(F.broadcast(stats.select("total"))).select("term", F.greatest(F.log((F.col("total") - n + 0.5) / (n + 0.5)), F.lit(1e-6)).alias("idf"))
    worth = checkpointed(terms.join(idf, "term"))  # one row a query and term
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    dealt = by_document(hits.select("doc_id", "dl", "term", "tf"), lengths.count(), terms)
    weighed = dealt.join(terms_side(worth), "term").join(F.broadcast(stats.select("avgdl")))
    return weighed.groupBy("query_id", "doc_id").agg(fx.round6(F.sum(F.col("idf") * F.col("tf") * (k1 + 1) / norm)).alias("score"))


def tag_exact(terms: DataFrame, tags: DataFrame, weight: float = 3.0) -> DataFrame:
    """Tags equal to a term, counted; times ``weight``."""
    return tags.join(terms_side(terms), F.col("tag_value") == F.col("term")).groupBy("query_id", "doc_id").agg((F.count("*") * weight).alias("score"))


def tag_idf(terms: DataFrame, tags: DataFrame, total: int, weight: float = 3.0) -> DataFrame:
    """Tags equal to a term, each worth ln(N / df) / ln N; times ``weight``."""
    df = tags.groupBy("tag_value").agg(F.countDistinct("doc_id").alias("df"))
    worth = df.join(terms_side(terms.select("term").distinct()), F.col("tag_value") == F.col("term")).select("term", (F.log(F.lit(float(total)) / F.col("df")) / F.log(F.lit(float(max(total, 2))))).alias("w"))
    hits = tags.select("doc_id", F.col("tag_value").alias("term")).join(terms_side(terms), "term")
    return hits.join(F.broadcast(worth) if worth.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else worth, "term").groupBy("query_id", "doc_id").agg(fx.round6(F.sum("w") * weight).alias("score"))


def tag_prefix(terms: DataFrame, tags: DataFrame, weight: float = 1.5, shortest: int = 3) -> DataFrame:
    """Tags that start with a term (a tag counts for each such term); times ``weight``.

    Every tag is exploded into its prefixes, so a range predicate becomes an equi-join.
    """
    prefixes = F.transform(F.sequence(F.lit(shortest), F.length("tag_value")), lambda n: F.substring(F.col("tag_value"), F.lit(1), n))
    rows = tags.where(F.length("tag_value") >= shortest).select("doc_id", F.explode(prefixes).alias("term"))
    return rows.join(terms_side(terms), "term").groupBy("query_id", "doc_id").agg((F.count("*") * weight).alias("score"))


def filename_anchor(terms: DataFrame, stems: DataFrame, weight: float = 4.0, most: int = 64) -> DataFrame:
    """Documents whose file stem is a term, of at most ``most`` terms a query in alphabetical order."""
    w = Window.partitionBy("query_id").orderBy("term")
    few = terms.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    return stems.join(terms_side(few), F.col("filename_stem") == F.col("term")).groupBy("query_id", "doc_id").agg((F.count("*") * weight).alias("score"))


def path_key(terms: DataFrame, keys: DataFrame, cap: float = 12.0, most: int = 200) -> DataFrame:
    """Pairs (path token, key) both among the terms: the sum of 10 / max(card, 2) over pairs of at most ``most`` documents, at most ``cap``."""
    cards = keys.groupBy("path_token", "kv_key").agg(F.count("*").alias("card")).where(F.col("card") <= most)
    side = terms_side(terms)
    hits = keys.join(cards, ["path_token", "kv_key"]).join(side.select("query_id", F.col("term").alias("path_token")), "path_token")
    hits = hits.join(side.select("query_id", F.col("term").alias("kv_key")), ["query_id", "kv_key"])
    return hits.groupBy("query_id", "doc_id").agg(fx.round6(F.least(F.sum(10.0 / F.greatest("card", F.lit(2))), F.lit(cap))).alias("score"))


def sparse(terms: DataFrame, vectors: DataFrame, least: float = 0.01, most_df: float = 0.0, total: int = 0) -> DataFrame:
    """Dot products of sparse vectors (doc_id, term, weight) and weighted query terms (query_id, term, q), above ``least``.

    With ``most_df`` terms in more than that share of ``total`` documents are left out, unless all of a query's are.
    """
    hits = vectors.join(terms_side(terms.select("term").distinct()), "term", "left_semi").select("doc_id", "term", "weight")
    hits = by_document(hits, total or vectors.agg(F.approx_count_distinct("doc_id")).first()[0], terms)
    if most_df and total:
        df = hits.groupBy("term").agg((F.countDistinct("doc_id") / F.lit(float(total))).alias("_df"))
        marked = terms.join(df, "term", "left").withColumn("_ok", F.coalesce(F.col("_df"), F.lit(0.0)) <= most_df)
        any_ok = F.max("_ok").over(Window.partitionBy("query_id"))
        terms = checkpointed(marked.withColumn("_any", any_ok).where("_ok OR NOT _any").drop("_df", "_ok", "_any"))
    dots = hits.join(terms_side(terms), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return dots.where(F.col("score") > least).withColumn("score", fx.round6("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; zero for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


#: Queries of a block of a brute-force search, and scores that a task holds at a time.
QUERY_BLOCK, SCORES_AT_ONCE = 20_000, 4_000_000


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors at length one as rows; a zero or null vector is zeros."""
    full = column.drop_null()
    flat = full.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), len(flat) // max(1, len(full))))
    x = flat.reshape(len(full), -1) if len(full) else out
    n = np.sqrt((x * x).sum(1, keepdims=True))
    out[np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))] = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    return out


class _Best:
    """The k best (score desc, id asc) of each query so far."""

    def __init__(self, queries: int, k: int, least: float | None, ids: np.dtype):
        self.k, self.query, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, ids)
        self.floor = np.full(queries, -np.inf if least is None else least)  # a score below it is not among them
        self.last = np.full(queries, np.iinfo(ids).max if ids.kind in "iu" else np.inf)  # the largest id that a score at the floor may have

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """``score``: a row a query, a column for each of ``ids``."""
        least = self.floor
        if score.shape[1] > self.k and len(self.ids) < self.k * len(least):
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        query, at = np.nonzero(score >= least[:, None])
        own, found = score[query, at], ids[at]
        keep = (own > self.floor[query]) | (found <= self.last[query])
        query, own, found = (np.concatenate(v) for v in ((self.query, query[keep]), (self.score, own[keep]), (self.ids, found[keep])))
        order = np.lexsort((found, -own, query))
        query, own, found = query[order], own[order], found[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        full = nth == self.k - 1
        self.floor[query[full]], self.last[query[full]] = own[full], found[full]
        self.query, self.score, self.ids = query[nth < self.k], own[nth < self.k], found[nth < self.k]


def dense(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """The k nearest of ``vectors(doc_id, embedding)`` to each of ``queries(query_id, q)`` by cosine (six decimals; ties by id).

    A blocked brute-force search: queries are dealt into blocks of about ``QUERY_BLOCK``, each of which is
    broadcast; every task scores its vectors against them as matrices of ``SCORES_AT_ONCE`` scores and hands on its
    best k a query. A null or zero vector scores zero.
    """
    spark, ids = vectors.sparkSession, vectors.schema["doc_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block"))
    dealt = dealt if blocks == 1 else checkpointed(dealt)
    out = None
    for block in range(blocks):
        table = dealt.where(F.col("_block") == block).select("query_id", "q").toArrow().combine_chunks()  # QUERY_BLOCK rows
        if not len(table):
            continue
        shared = spark.sparkContext.broadcast((table["query_id"].combine_chunks(), unit_rows(table["q"].combine_chunks())))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, q = shared.value
            best, rows = None, max(64, SCORES_AT_ONCE // len(q))
            for batch in batches:
                for at in range(0, len(batch), rows):
                    some = batch.slice(at, rows)
                    own = some.column("doc_id").to_numpy(zero_copy_only=False)
                    x = unit_rows(some.column("embedding"))
                    score = q @ x.T if x.shape[1] == q.shape[1] else np.zeros((len(q), len(x)))
                    best = best or _Best(len(q), k, least, own.dtype)
                    best.add(np.round(score, 6) + 0.0, own)
            if best is not None:
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(best.query)), pa.array(best.ids), pa.array(best.score)], names=["query_id", "doc_id", "score"])

        found = vectors.select("doc_id", "embedding").where("doc_id IS NOT NULL").mapInArrow(search, f"query_id {query_type}, doc_id {ids}, score double")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], f"query_id {query_type}, doc_id {ids}, score double")
    return top(out, k)


def lexical_anchor(terms: DataFrame, postings: DataFrame, total: int, cap: float = 3.0) -> DataFrame:
    """Rare terms: idf = ln(N / df), boost min(1.5 idf, cap) where it is above one, summed where a document's lie (``by_document``)."""
    df = postings.join(terms_side(terms.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
    boost = F.least(1.5 * F.log(F.lit(float(max(total, 100))) / F.col("df")), F.lit(cap))
    rare = df.select("term", boost.alias("boost")).where("boost > 1")
    hits = by_document(postings.join(rare, "term").select("doc_id", "term", "boost"), total, terms)
    return hits.join(terms_side(terms), "term").groupBy("query_id", "doc_id").agg(fx.round6(F.sum("boost")).alias("score"))


def authority(candidates: DataFrame, terms: DataFrame, docs: DataFrame, now: float) -> DataFrame:
    """Bonuses of candidates: 2.0 for a term in the path, 1.5 for one among the first three domains, 0.5 if created within 48 hours."""
    lists = terms.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    rows = candidates.select("query_id", "doc_id").join(docs, "doc_id").join(terms_side(lists), "query_id")
    path = F.exists("terms", lambda t: F.contains(F.lower("source_id"), t))
    domain = F.arrays_overlap(F.slice("domains", 1, 3), F.col("terms"))
    score = F.when(path, 2.0).otherwise(0.0) + F.when(domain, 1.5).otherwise(0.0) + F.when(F.lit(now) - F.col("created_at") < 48 * 3600, 0.5).otherwise(0.0)
    return rows.select("query_id", "doc_id", score.alias("score")).where("score > 0")


def edge_boost(candidates: DataFrame, edges: DataFrame, each: float = 1.0, cap: float = 3.0) -> DataFrame:
    """``each`` for every edge with both ends among a query's candidates, ``cap`` at most; weights don't count.

    Queries are numbered, 64 to a word, and a document's are the bits of its words. So an edge meets the words of
    its ends, not their queries, and what both ends share is unfolded where a document's edges already lie together.
    """
    queries = candidates.select("query_id").distinct()
    numbered = running(queries, [F.asc("query_id")], {"nth": F.lit(1)}).withColumns({"word": F.floor((F.col("nth") - 1) / 64), "bit": F.pmod(F.col("nth") - 1, F.lit(64)).cast("int")})
    numbered = checkpointed(numbered.select("query_id", "word", "bit"))
    c = candidates.select("query_id", "doc_id").where("doc_id IS NOT NULL").join(terms_side(numbered), "query_id")
    words = checkpointed(c.groupBy("doc_id", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    a = words.select(F.col("doc_id").alias("a"), "word", F.col("bits").alias("bits_a"))
    b = words.select(F.col("doc_id").alias("b"), "word", F.col("bits").alias("bits_b"))
    both = edges.select("a", "b").join(a, "a").join(b, ["b", "word"]).select("a", "b", "word", F.col("bits_a").bitwiseAND(F.col("bits_b")).alias("bits")).where("bits <> 0")
    ends = both.select(F.explode(F.array("a", "b")).alias("doc_id"), "word", "bits").repartition("doc_id", "word")
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1)).alias("bit")
    counted = ends.select("doc_id", "word", bit).groupBy("doc_id", "word", "bit").agg(F.count("*").alias("n"))
    return counted.join(terms_side(numbered), ["word", "bit"]).select("query_id", "doc_id", F.least(F.col("n") * each, F.lit(cap)).alias("score"))


def entity_graph(candidates: DataFrame, entities: DataFrame, terms: DataFrame, weight: float = 0.5) -> DataFrame:
    """``weight`` for every entity of a candidate that is a term."""
    hits = candidates.select("query_id", "doc_id").join(entities, "doc_id").join(terms_side(terms).withColumnRenamed("term", "entity"), ["query_id", "entity"])
    return hits.groupBy("query_id", "doc_id").agg((F.count("*") * weight).alias("score"))


def access_rate(candidates: DataFrame, accesses: DataFrame, now: float, window: float = 3600.0, weight: float = 0.05, most: int = 5) -> DataFrame:
    """``weight`` for each access of the last ``window`` seconds, ``most`` at most."""
    recent = accesses.where((F.col("ts") > now - window) & (F.col("ts") <= now)).groupBy("doc_id").agg(F.count("*").alias("n"))
    return candidates.select("query_id", "doc_id").join(recent, "doc_id").select("query_id", "doc_id", fx.round6(F.least("n", F.lit(most)) * weight).alias("score"))


def visible(docs: DataFrame, attribution: DataFrame, party) -> DataFrame:
    """Documents attributed to the party or to nobody."""
    return docs.join(attribution, "doc_id", "left").where((F.col("party_id") == party) | F.col("party_id").isNull())
