"""Relational queries: joins, set operations, top-k and ordering rules of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators import tiers
from marlstone.plans import model as m
from marlstone.plans.retrieval import BM25, _bm25
from marlstone.registry import query


@query("hot_scan", f"WITH {m.DOCS} SELECT doc_id, source_id, lifecycle FROM d WHERE lifecycle < 2")
def hot_scan(spark, sf) -> DataFrame:
    return m.documents(spark, sf).where("lifecycle < 2").select("doc_id", "source_id", "lifecycle")


@query("id_lookup", f"WITH {m.DOCS} SELECT d.doc_id, source_id, n_chars FROM d WHERE doc_id IN (SELECT (props::JSON->>'k')::BIGINT FROM events)")
def id_lookup(spark, sf) -> DataFrame:
    ids = m.query_log(spark, sf).select("doc_id").distinct()
    return m.documents(spark, sf).join(ids, "doc_id", "left_semi").select("doc_id", "source_id", "n_chars")


@query("structural_deny_list", f"WITH {m.DOCS} SELECT doc_id, source_id FROM d WHERE NOT regexp_matches(source_id, '(?i)(/node_modules/|/fr/|\\.min\\.|/src1[0-9]/)')")
def structural_deny_list(spark, sf) -> DataFrame:
    return m.documents(spark, sf).where(~F.col("source_id").rlike(r"(?i)(/node_modules/|/fr/|\.min\.|/src1[0-9]/)")).select("doc_id", "source_id")


@query("attribution_join", "SELECT o_orderkey AS doc_id, c_custkey AS participant_id, n_nationkey AS party_id, r_name AS org, o_orderdate::TIMESTAMP AS authored_at FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def attribution_join(spark, sf) -> DataFrame:
    """Order, customer, nation, region as attribution, participant, party, organisation; dimensions of fixed size are broadcast."""
    t = lambda n: m.table(spark, sf, n)
    org = F.broadcast(t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    return t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(org, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("doc_id"), F.col("c_custkey").alias("participant_id"), F.col("n_nationkey").alias("party_id"), F.col("r_name").alias("org"), F.col("o_orderdate").cast("timestamp_ntz").alias("authored_at")
    )


@query("attribution_left_join", "SELECT c_custkey AS participant_id, count(o_orderkey) AS documents, max(o_orderdate)::TIMESTAMP AS newest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def attribution_left_join(spark, sf) -> DataFrame:
    o = m.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("documents"), F.max("o_orderdate").alias("newest"))
    c = m.table(spark, sf, "customer").select(F.col("c_custkey").alias("participant_id"))
    return c.join(o, F.col("participant_id") == F.col("o_custkey"), "left").select("participant_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.col("newest").cast("timestamp_ntz").alias("newest"))


@query("recent_by_handle", "SELECT * FROM (SELECT o_custkey AS participant_id, o_orderkey AS doc_id, o_orderdate::TIMESTAMP AS authored_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def recent_by_handle(spark, sf) -> DataFrame:
    o = m.table(spark, sf, "orders").select(F.col("o_custkey").alias("participant_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("authored_at"))
    return tiers.top(o, 3, "participant_id", "authored_at")


@query("semi_join", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def semi_join(spark, sf) -> DataFrame:
    return m.table(spark, sf, "part").join(m.table(spark, sf, "lineitem").where("l_quantity >= 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def anti_join(spark, sf) -> DataFrame:
    return m.table(spark, sf, "part").join(m.table(spark, sf, "lineitem").where("l_quantity >= 49"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("interval_next_event", f"WITH {m.LOG} SELECT * FROM (SELECT event_id, session_id, lead(event_id) OVER w AS next_event, lead(ts) OVER w - ts <= 3600 AS within FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)) WHERE within")
def interval_next_event(spark, sf) -> DataFrame:
    """As-of join of each event to its session's next one: a window, not a range join."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    e = m.query_log(spark, sf)
    return e.select("event_id", "session_id", F.lead("event_id").over(w).alias("next_event"), (F.lead("ts").over(w) - F.col("ts") <= 3600).alias("within")).where("within")


@query("successor_lookup", "SELECT o.o_orderkey AS doc_id, min(n.o_orderkey) AS successor FROM orders o LEFT JOIN orders n ON n.o_custkey = o.o_custkey AND n.o_orderkey > o.o_orderkey GROUP BY 1")
def successor_lookup(spark, sf) -> DataFrame:
    """The next order of the same customer: ``lead`` over the customer, not a theta self-join."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return m.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lead("o_orderkey").over(w).alias("successor"))


@query("freshest_copy", "SELECT doc_id, supplier, stamp FROM (SELECT l_partkey AS doc_id, l_suppkey AS supplier, l_shipdate::TIMESTAMP AS stamp, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_suppkey, l_orderkey) AS r FROM lineitem) WHERE r = 1")
def freshest_copy(spark, sf) -> DataFrame:
    """Of a document's copies in several stores the one verified last (min by a struct: combines before its shuffle)."""
    order = F.struct((-F.unix_date(F.col("l_shipdate").cast("date"))).alias("d"), "l_suppkey", "l_orderkey")
    return m.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.min_by("l_suppkey", order).alias("supplier"), F.max("l_shipdate").cast("timestamp_ntz").alias("stamp"))


@query("owner_shard", f"WITH {m.DOCS}, c AS (SELECT sha256(content) AS h, min(shard) AS shard, count(DISTINCT shard) AS shards FROM d GROUP BY 1) SELECT doc_id, c.shard AS owner, shards FROM d JOIN c ON sha256(content) = h")
def owner_shard(spark, sf) -> DataFrame:
    d = m.documents(spark, sf).select("doc_id", F.sha2("content", 256).alias("h"), "shard")
    return d.select("doc_id", "h").join(d.groupBy("h").agg(F.min("shard").alias("owner"), F.countDistinct("shard").alias("shards")), "h").select("doc_id", "owner", "shards")


@query("lateral_neighbours", "SELECT doc_id, other, position FROM (SELECT l_orderkey AS doc_id, list(l_partkey ORDER BY l_linenumber, l_partkey)[1:3] AS o FROM lineitem GROUP BY 1), unnest(o) WITH ORDINALITY u(other, position)")
def lateral_neighbours(spark, sf) -> DataFrame:
    """The first three links of each document, exploded from its own array."""
    links = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]), 1, 3)
    g = m.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(links.alias("o"))
    return g.select("doc_id", F.posexplode("o").alias("p", "other")).select("doc_id", "other", (F.col("p") + 1).cast("long").alias("position"))


@query("union_all_ranges", "SELECT tag, p_partkey FROM (SELECT split_part(p_name, ' ', 1) AS tag, p_partkey FROM part) WHERE tag >= 'b' AND tag < 'c' UNION ALL SELECT tag, p_partkey FROM (SELECT split_part(p_name, ' ', 1) AS tag, p_partkey FROM part) WHERE tag >= 'bl' AND tag < 'bm'")
def union_all_ranges(spark, sf) -> DataFrame:
    """Prefix ranges with multiplicity: a tag in two ranges counts twice."""
    t = m.table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("tag"), "p_partkey")
    return t.where("tag >= 'b' AND tag < 'c'").union(t.where("tag >= 'bl' AND tag < 'bm'"))


@query("ordered_first_wins", f"WITH {m.DOCS}, r AS (SELECT lower(trim(replace(CASE WHEN doc_id % 2 = 0 THEN upper(shard) ELSE shard || ' ' END, chr(92), '/'))) AS key, doc_id AS position FROM d) SELECT key, min(position) AS position FROM r GROUP BY 1")
def ordered_first_wins(spark, sf) -> DataFrame:
    """Union without repeats under a normalised key; the first position wins."""
    d = m.documents(spark, sf)
    raw = F.when(F.col("doc_id") % 2 == 0, F.upper("shard")).otherwise(F.concat("shard", F.lit(" ")))
    return d.select(fx.normalise_source(raw).alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("position"))


@query("jaccard_neighbours", r"WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round_even(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))::DOUBLE, 6) AS jaccard FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))::DOUBLE >= 0.1")
def jaccard_neighbours(spark, sf) -> DataFrame:
    """Token-set Jaccard of the query set against itself: a self-join on shared tokens, not all pairs."""
    w = m.table(spark, sf, "benchmark").select("item_id", F.array_distinct(fx.tokens(F.col("text"))).alias("t"))
    x = w.select(F.col("item_id").alias("a"), F.size("t").alias("na"), F.explode("t").alias("w"))
    y = w.select(F.col("item_id").alias("b"), F.size("t").alias("nb"), F.explode("t").alias("w"))
    g = x.join(y, "w").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
    j = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    return g.where(j >= 0.1).select("a", "b", fx.round6(j).alias("jaccard"))


@query("set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def set_difference(spark, sf) -> DataFrame:
    return m.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).exceptAll(m.table(spark, sf, "orders").where("o_totalprice > 100000").select("o_custkey").distinct())


@query("dense_rank_average", "SELECT p_partkey, dense_rank() OVER w AS dense, rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS average FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def dense_rank_average(spark, sf) -> DataFrame:
    """Ranks with ties shared, and ties' average rank."""
    w = Window.partitionBy("p_brand").orderBy("p_size")
    ties = F.count("*").over(Window.partitionBy("p_brand", "p_size"))
    return m.table(spark, sf, "part").select("p_partkey", F.dense_rank().over(w).alias("dense"), (F.rank().over(w) + (ties - 1) / 2.0).alias("average"))


@query("miss_weights", "SELECT p_partkey, CASE WHEN r <= 5 THEN 0.0 ELSE round_even(least(1.0, 5.0::DOUBLE / r), 6) END AS weight FROM (SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r FROM part)")
def miss_weights(spark, sf) -> DataFrame:
    from marlstone.operators.graph import miss_weight

    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))
    return m.table(spark, sf, "part").select("p_partkey", F.dense_rank().over(w).alias("r")).select("p_partkey", fx.round6(miss_weight(F.col("r"), 5)).alias("weight"))


@query("cumulative_distribution", f"WITH {m.POSTINGS}, b AS (SELECT ('0x' || md5('spectrum' || term)[1:2])::INT AS bin, sum(tf) AS v FROM post GROUP BY 1) SELECT bin, round_even(sum(v) OVER (ORDER BY bin) / sum(v) OVER ()::DOUBLE, 6) AS cdf FROM b")
def cumulative_distribution(spark, sf) -> DataFrame:
    """CDF over the 256 spectrum bins (the window is over the aggregate, never the rows)."""
    from marlstone.operators.evidence import bin_of

    g = m.postings(spark, sf).groupBy(bin_of(F.col("term")).alias("bin")).agg(F.sum("tf").alias("v"))
    return g.select("bin", fx.round6(F.sum("v").over(Window.orderBy("bin")) / F.sum("v").over(Window.partitionBy(F.lit(1)))).alias("cdf"))


@query("reserved_slots", f"WITH {BM25}, p AS (SELECT query_id, doc_id, score, doc_id % 5 = 0 AS promoted, row_number() OVER (PARTITION BY query_id, doc_id % 5 = 0 ORDER BY score DESC, doc_id) AS r FROM bm) SELECT query_id, doc_id, score, promoted FROM p WHERE (promoted AND r <= 2) OR (NOT promoted AND r <= 6)")
def reserved_slots(spark, sf) -> DataFrame:
    """Two slots for promoted documents, six for the others."""
    w = Window.partitionBy("query_id", "promoted").orderBy(F.desc("score"), F.asc("doc_id"))
    p = _bm25(spark, sf).withColumn("promoted", F.col("doc_id") % 5 == 0).withColumn("r", F.row_number().over(w))
    return p.where("(promoted AND r <= 2) OR (NOT promoted AND r <= 6)").select("query_id", "doc_id", "score", "promoted")


@query("head_rerank", f"WITH {BM25}, h AS (SELECT *, CASE WHEN rank <= 5 THEN row_number() OVER (PARTITION BY query_id, rank <= 5 ORDER BY doc_id % 97 DESC, doc_id) ELSE rank END AS position FROM bmr WHERE rank <= 12) SELECT query_id, doc_id, score, position FROM h")
def head_rerank(spark, sf) -> DataFrame:
    """The first five places reordered by a second score; their slots, and all other ranks, stay."""
    t = tiers.top(_bm25(spark, sf), 12).withColumn("head", F.col("rank") <= 5)
    w = Window.partitionBy("query_id", "head").orderBy(F.desc(F.col("doc_id") % 97), F.asc("doc_id"))
    return t.select("query_id", "doc_id", "score", F.when(F.col("head"), F.row_number().over(w)).otherwise(F.col("rank")).alias("position"))


@query("tie_break_ladder", f"WITH {m.EDGES}, deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1) SELECT p_partkey AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, coalesce(degree, 0) DESC, p_retailprice DESC, p_partkey) AS position FROM part LEFT JOIN deg ON node = p_partkey")
def tie_break_ladder(spark, sf) -> DataFrame:
    """Equal scores by degree, then freshness, then id."""
    from marlstone.operators.graph import degrees

    p = m.table(spark, sf, "part").join(degrees(m.edges(spark, sf)), F.col("node") == F.col("p_partkey"), "left")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), F.desc(F.coalesce("degree", F.lit(0))), F.desc("p_retailprice"), F.asc("p_partkey"))
    return p.select(F.col("p_partkey").alias("doc_id"), F.row_number().over(w).alias("position"))


@query("parent_aggregate", "SELECT l_orderkey AS parent, round_even(sum(l_extendedprice) * (1 + 0.1 * ln(1 + count(*))), 4) AS score, count(*) AS children FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def parent_aggregate(spark, sf) -> DataFrame:
    """Children's scores summed, raised by 0.1 ln(1 + n) from two children on."""
    g = m.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("parent")).agg(F.sum("l_extendedprice").alias("s"), F.count("*").alias("children"))
    return g.where("children >= 2").select("parent", F.bround(F.col("s") * (1 + 0.1 * F.log1p(F.col("children").cast("double"))), 4).alias("score"), "children")


@query("coverage_fractions", f"WITH {BM25} SELECT query_id, round_even(avg(CASE WHEN contains(source_id, '/en/') THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS folder, round_even(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS file FROM bmr JOIN d USING (doc_id) WHERE rank <= 8 GROUP BY 1")
def coverage_fractions(spark, sf) -> DataFrame:
    t = tiers.top(_bm25(spark, sf), 8).join(m.documents(spark, sf).select("doc_id", "source_id"), "doc_id")
    share = lambda c: fx.round6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return t.groupBy("query_id").agg(share(F.col("source_id").contains("/en/")).alias("folder"), share(F.col("doc_id") % 3 == 0).alias("file"))


@query("tier_totals", "SELECT l_shipdate_year AS tier, sum(q)::DOUBLE AS total, count(*) AS n FROM (SELECT year(l_shipdate) AS l_shipdate_year, l_quantity AS q FROM lineitem) GROUP BY 1")
def tier_totals(spark, sf) -> DataFrame:
    return m.table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("tier")).agg(F.sum("l_quantity").cast("double").alias("total"), F.count("*").alias("n"))


@query("narrowed_retrieval", f"WITH {BM25}, s AS (SELECT query_id, doc_id, score FROM bmr WHERE rank <= 16), n AS (SELECT * FROM s WHERE doc_id % 4 = 1) SELECT * FROM n UNION ALL SELECT * FROM s WHERE query_id NOT IN (SELECT query_id FROM n)")
def narrowed_retrieval(spark, sf) -> DataFrame:
    """Shortlist cut to the caller's paths; a query for which nothing is left keeps its shortlist."""
    s = tiers.top(_bm25(spark, sf), 16).select("query_id", "doc_id", "score")
    n = s.where("doc_id % 4 = 1")
    return n.union(s.join(n.select("query_id").distinct(), "query_id", "left_anti"))


@query("global_topk", "SELECT p_partkey AS doc_id, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def global_topk(spark, sf) -> DataFrame:
    """The 25 best of all (a top-k report; TakeOrderedAndProject)."""
    return m.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_retailprice").alias("score")).orderBy(F.desc("score"), F.asc("doc_id")).limit(25)
