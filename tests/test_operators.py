"""Operators on small hand-made cases and against plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators import dealing, evidence, fusion, graph, index, maintenance, sessions, tiers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_equal_scores_get_adjacent_ranks_by_id(spark):
    t = spark.createDataFrame([(1, 7, 2.0), (1, 3, 2.0), (1, 5, 1.0)], "query_id long, doc_id long, score double")
    assert [(r.doc_id, r["rank"]) for r in fusion.ranked(t).orderBy("rank").collect()] == [(3, 1), (7, 2), (5, 3)]


def test_rrf_weight_zero_and_monotone_rescale(spark):
    a = spark.createDataFrame([(1, i, float(i * i % 7)) for i in range(9)], "query_id long, doc_id long, score double")
    b = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "query_id long, doc_id long, score double")
    plain = rows(fusion.rrf({"a": a, "b": b}, {"b": 0.0}), "doc_id")
    assert plain == rows(fusion.rrf({"a": a}), "doc_id")
    scaled = a.withColumn("score", F.exp("score") * 3)
    assert rows(fusion.rrf({"a": a, "b": b}), "doc_id") == rows(fusion.rrf({"a": scaled, "b": b}), "doc_id")


def test_bm25_frequent_term_has_clamped_idf(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "aa")], "doc_id long, content string")
    terms = spark.createDataFrame([(1, "aa"), (1, "zz")], "query_id long, term string")
    out = tiers.bm25(terms, docs).collect()
    assert len(out) == 3 and all(r.score <= 2e-6 for r in out)


def test_prefix_counts_a_tag_for_each_term(spark):
    tags = spark.createDataFrame([(1, "domain", "network")], "doc_id long, tag_type string, tag_value string")
    terms = spark.createDataFrame([(1, "net"), (1, "network"), (1, "work")], "query_id long, term string")
    assert tiers.tag_prefix(terms, tags).collect()[0].score == 3.0


def test_visibility(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    owned = spark.createDataFrame([(1, 5), (2, 6)], "doc_id long, party_id long")
    assert sorted(r.doc_id for r in tiers.visible(docs, owned, 5).collect()) == [1, 3]


def test_gate_keeps_least_and_appends_dense(spark):
    r = spark.createDataFrame([(1, i, 0.5 - i / 10, i % 2 == 0) for i in range(5)], "query_id long, doc_id long, score double, is_dense boolean")
    out = fusion.gate(r, threshold=2.0, least=1, most=4, floor=3).orderBy("doc_id").collect()
    assert [(x.doc_id, x.appended) for x in out] == [(0, False), (2, True), (4, True)]


def test_eps_band_is_a_fold(spark):
    data = [(1, d, s, b) for d, s, b in ((1, 1.0, 0.0), (2, 0.97, 5.0), (3, 0.94, 9.0), (4, 0.92, 1.0))]
    out = fusion.eps_band(spark.createDataFrame(data, "query_id long, doc_id long, score double, bonus double"), 0.05).orderBy("position").collect()
    assert [(r.doc_id, r.band) for r in out] == [(2, 1), (1, 1), (3, 2), (4, 2)]


def test_dense_in_blocks_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "doc_id long, embedding array<double>")
    q = v.where("doc_id < 20").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    one = sorted(map(tuple, tiers.dense(q, v, 3).collect()))
    monkeypatch.setattr(tiers, "QUERY_BLOCK", 6)
    assert sorted(map(tuple, tiers.dense(q, v, 3).collect())) == one and len(one) == 60


def test_running_sums_by_ranges(spark):
    from marlstone.operators.running import running

    rng = random.Random(6)
    rows = [(rng.randrange(300), k, rng.randrange(9)) for k in range(1000)]
    out = running(spark.createDataFrame(rows, "a int, b int, n long"), [F.desc("a"), F.asc("b")], {"upto": F.col("n"), "place": F.lit(1)}).collect()
    want, total = {}, 0
    for place, (a, b, n) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        total += n
        want[b] = (total, place)
    assert {r.b: (r.upto, r.place) for r in out} == want


def test_cosine_of_zero_vector_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(tiers.cosine(F.col("a"), F.col("b")).alias("c")).first().c == 0.0


def test_chain_with_a_cycle_stops(spark):
    v = spark.createDataFrame([(1, None), (2, 1), (3, 2), (7, 8), (8, 7)], "id long, supersedes long")
    out = {r.id: (r.head, r.steps) for r in graph.chain(v).collect()}
    assert out[3] == (1, 2) and out[1] == (1, 0) and out[7] == (8, 1)


def test_chain_equals_a_plain_walk(spark):
    rng = random.Random(8)
    for most in (32, 5):
        rows = [(i, rng.choice([None, i - 1, rng.randrange(400), i])) for i in range(1, 400)] + [(1000 + i, 1000 + i - 1) for i in range(80)]
        nxt = dict(rows)

        def walk(i):
            at = i
            for k in range(most):
                if (n := nxt.get(at)) is None or n in (at, i):
                    return at, k
                at = n
            return at, most

        out = {r.id: (r.head, r.steps) for r in graph.chain(spark.createDataFrame(rows, "id long, supersedes long"), most).collect()}
        assert out == {i: walk(i) for i in nxt}


def test_update_mode_keeps_all_batches(spark, tmp_path):
    """Four files, one a trigger: the merged rows equal those of one batch over all."""
    from marlstone.streaming import events as ev

    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").toPandas()
    cut = -(-len(table) // 4)
    for k in range(4):
        spark.createDataFrame(table.iloc[k * cut : (k + 1) * cut], ev.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = lambda n: ev.last_seen(ev.events_stream(spark, f"{tmp_path}/events", n))
    many, one = (sorted(map(tuple, ev.run_available(stream(n), "update", ["session_id"]).collect())) for n in (1, 1000))
    assert many == one and len(many) == table["user_id"].nunique()


def test_status_and_risk_of_tasks(spark):
    row = [(0.72, "primary", False, 0.9), (0.5, "primary", False, 0.9), (0.3, "primary", False, 0.9), (0.9, "inferred", False, 0.9), (None, "primary", False, 0.9), (0.9, "primary", True, 0.9), (0.9, "primary", False, 0.2)]
    df = spark.createDataFrame(row, "fresh double, authority string, invalid boolean, coordinate double")
    of = lambda task: [r[0] for r in df.select(evidence.status(F.col("fresh"), task, F.col("coordinate"), F.col("authority"), F.col("invalid"))).collect()]
    assert of("edit") == ["verified", "stale_risk", "needs_refresh", "needs_refresh", "needs_refresh", "needs_refresh", "needs_refresh"]
    assert of("review") == ["verified", "stale_risk", "stale_risk", "stale_risk", "stale_risk", "needs_refresh", "stale_risk"]
    assert of("explain") == ["verified", "verified", "stale_risk", "stale_risk", "stale_risk", "needs_refresh", "stale_risk"]
    risk = df.limit(1).select(evidence.action_risk(F.col("fresh"), "edit", F.lit(False)).alias("a"), evidence.action_risk(F.col("fresh"), "plan", F.lit(False)).alias("b")).first()
    assert abs(risk.a - (0.85 * 0.28 + 0.15)) < 1e-6 and abs(risk.b - 0.3 * 0.28) < 1e-6


def test_query_classes(spark):
    texts = ["calculate the total of it", "5 + 3 * 2", "a-b only", "Who wrote it?", "who " + "x " * 20, "how do I start", "compare both", "between a and b it lies", "w " * 26, "plain words", "", None]
    want = ["arithmetic", "arithmetic", "default", "factual", "default", "procedural", "multi_hop", "multi_hop", "multi_hop", "default", "default", "default"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.c for r in df.select("i", evidence.query_class(F.col("t")).alias("c")).orderBy("i").collect()] == want


def test_know_or_miss_order(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.9), (1, 0.5)], "found int, conf double")
    of = lambda *flags: [r[0] for r in df.select(evidence.know_or_miss(F.col("found"), F.col("conf"), *map(F.lit, flags))).collect()]
    assert of(False, False, False, False, False) == ["no_promoter_match", "know", "sparse"]
    assert of(False, False, False, False, True) == ["no_promoter_match", "know", "cold"]
    assert of(False, False, True, True, True) == ["no_promoter_match", "superseded", "superseded"]
    assert of(True, True, True, True, True) == ["abstain"] * 3
    assert evidence.monotonicity_violations({"b0": -1, "score": -1.14, "gap": 0}) == ["score"]


def test_pagerank_equals_power_iteration(spark):
    rng = random.Random(2)
    e = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(40)} - {(i, i) for i in range(12)})
    restart = {0: 1.0, 3: 10.0}
    nodes = sorted({x for p in e for x in p} | set(restart))
    at = {n: i for i, n in enumerate(nodes)}
    p = np.array([restart.get(n, 0.0) for n in nodes]) / sum(restart.values())
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in e:
        m[at[b], at[a]] = 1
    out = m.sum(0)
    r = p.copy()
    for _ in range(12):
        r = 0.15 * p + 0.85 * (m @ np.where(out > 0, r / np.maximum(out, 1), 0) + r[out == 0].sum() * p)
    got = graph.pagerank(spark.createDataFrame(e, "a long, b long"), spark.createDataFrame(list(restart.items()), "node long, weight double"), rounds=12, tolerance=0)
    assert all(abs(x.rank - r[at[x.node]]) < 1e-5 for x in got.select("node", F.col("rank")).collect())


def test_clusters_and_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)], "a long, b long")
    assert {r.id: r.cluster for r in graph.clusters(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}
    assert {r.id: r.level for r in graph.levels(e).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 10: 0, 11: 1}


def test_rays_are_reproducible(spark):
    seeds = spark.createDataFrame([(1, 1)], "query_id long, node long")
    adj = spark.createDataFrame([(1, 1, 2, 2.0), (1, 1, 3, 1.0), (1, 2, 3, 1.0)], "query_id long, a long, b long, weight double")
    one, two = (rows(graph.evidence_rays(seeds, adj), "node") for _ in range(2))
    assert one == two and {r[1] for r in one} == {2, 3}


def test_requery_bound_is_inclusive(spark):
    ev = spark.createDataFrame([(1, 1, 0.0), (2, 1, 60.0), (3, 1, 121.0), (4, 2, 5.0)], "event_id long, session_id long, ts double")
    assert {r.event_id: r.bucket for r in sessions.requery_bucket(ev).collect()} == {1: "B", 2: "A", 3: "A", 4: "A"}
    assert {r.event_id: r.bucket for r in sessions.requery_bucket(ev, now=100.0).collect()}[3] is None


def test_temporal_context_equals_loop(spark):
    rng = np.random.default_rng(1)
    data = [(1, i, rng.normal(size=4).tolist()) for i in range(6)] + [(2, 0, [0.0] * 4)]
    got = {(r.session_id, r.turn): r.bonus for r in sessions.temporal_context(spark.createDataFrame(data, "session_id long, turn long, vector array<double>"), 4).collect()}
    t = np.zeros(4)
    for i, (_, _, v) in enumerate(data[:6]):
        v = np.array(v) / np.linalg.norm(v)
        c = np.linalg.norm(t)
        assert abs(got[1, i] - (max(0, 0.3 * v @ t / c) if c else 0)) < 1e-5
        u = v - (v @ t) / c**2 * t if c else v
        u /= np.linalg.norm(u)
        t = math.sqrt(0.75) * t / c + 0.5 * u if c else u
    assert got[2, 0] == 0.0


def test_budget_passes_three_and_abstain_on_ties(spark):
    r = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, 0.1, 2), (2, 1, 1.0, 1), (2, 2, 1.0, 2), (2, 3, 1.0, 3), (2, 4, 1.0, 4)], "query_id long, doc_id long, score double, rank long")
    assert {x.tier for x in evidence.budget_tiers(r).where("query_id = 1").collect()} == {"pass"}
    a = {x.query_id: x for x in evidence.abstain(r).collect()}
    assert a[2].rrf_ratio == 0.0 and a[2].abstain_rrf


def test_circular_distance_equals_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random(256), rng.random(256)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    d = np.cumsum(a / a.sum() - b / b.sum())
    assert abs(df.select(evidence.circular_w1(F.col("a"), F.col("b")).alias("s")).first().s - 1 / (1 + np.abs(d - np.median(d)).sum())) < 1e-5


def test_auc_with_ties_equals_pairs(spark):
    rng = random.Random(4)
    data = [(round(rng.random(), 1), rng.randrange(2)) for _ in range(200)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(evidence.auc(spark.createDataFrame(data, "score double, label int")).first().auc - want) < 1e-6


def test_upsert_last_source_wins(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "doc_id long, seq long, v string")
    new = spark.createDataFrame([(1, 0, "c"), (3, 5, "x"), (3, 4, "y")], "doc_id long, seq long, v string")
    assert rows(maintenance.upsert(old, new, ["doc_id"], "seq"), "doc_id") == [(1, 0, "c"), (2, 1, "b"), (3, 5, "x")]


@pytest.mark.parametrize("strategy,want", [("skip_existing", "old"), ("overwrite", "new"), ("newest", "old")])
def test_snapshot_strategies(spark, strategy, want):
    from hashlib import sha256

    a = spark.createDataFrame([(1, "old", 5.0)], "doc_id long, content string, last_accessed double")
    b = spark.createDataFrame([(1, "new", sha256(b"new").hexdigest(), 5.0), (2, "bad", "x", 9.0)], "doc_id long, content string, content_hash string, last_accessed double")
    assert [(r.doc_id, r.content) for r in maintenance.snapshot_merge(a, b, strategy).collect()] == [(1, want)]


def test_chunks_equal_loop(spark):
    texts = {1: "aaa\n\nbbb\nccc", 2: "x" * 25, 3: "", 4: None, 5: "\n".join("word" * 2 for _ in range(9))}
    got = {}
    for r in maintenance.chunk_paragraphs(spark.createDataFrame(list(texts.items()), "doc_id long, content string"), 10).orderBy("doc_id", "sequence").collect():
        got.setdefault(r.doc_id, []).append((r.content, r.hard_cut))
    for i, t in texts.items():
        out = []
        for p in (x for x in (t or "").split("\n") if x.strip()):
            cuts = [(p[k : k + 10], len(p) > 10) for k in range(0, len(p), 10)]
            for c, hard in cuts:
                if out and not hard and not out[-1][1] and len(out[-1][0]) + len(c) + 2 <= 10:
                    out[-1] = (out[-1][0] + "\n\n" + c, False)
                else:
                    out.append((c, hard))
        assert got.get(i, []) == out


def test_pack_budget_passes_over(spark):
    r = spark.createDataFrame([(1, 1, 1, 6), (1, 2, 2, 6), (1, 3, 3, 4)], "query_id long, doc_id long, rank long, size long")
    assert [x.doc_id for x in maintenance.pack_budget(r, 10).orderBy("position").collect()] == [1, 3]


def test_path_key_compaction_and_text(spark):
    keys = spark.createDataFrame([("a", "k", i) for i in range(5)] + [("b", "k", 1)], "path_token string, kv_key string, doc_id long")
    assert index.compact_path_keys(keys, 4).count() == 1
    df = spark.createDataFrame([("/Src/Foo_Bar.test.PY",), (None,), ("C:\\x\\y.md",)], "p string")
    assert [r.s for r in df.select(fx.filename_stem(F.col("p")).alias("s")).collect()] == ["foo_bar.test", None, "y"]


def test_calibration_age(spark):
    day, now = 86400.0, 1_710_000_000.0
    texts = ["2024-03-09T16:00:00Z", "2024-03-09T16:00:00", "2024-03-09 18:00:00+02:00", "2024-03-09T16:00:00.500", "2024-03-09", "soon", "2024-13-40", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in rows.select("i", evidence.iso_time(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [now, now, now, now + 0.5, now - 16 * 3600, None, None, None, None]
    ages = [(now - 30.9 * day, 30, False), (now - 31 * day, 31, True), (now + day, 0, False), (None, None, False)]
    rows = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(ages)], "i int, t double")
    found = [tuple(r.c) for r in rows.select("i", evidence.calibration_age(F.col("t"), now).alias("c")).orderBy("i").collect()]
    assert found == [x[1:] for x in ages]


def test_random_pairs_by_moments_equal_each_pair(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i // 2 if i < 20 else i, [float(x) for x in rng.normal(0.4, 1, size=6)]) for i in range(300)] + [(900, [0.0] * 6), (None, [1.0] * 6)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    q = v.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    want = evidence.random_vector_threshold(v, q).first()
    monkeypatch.setattr(evidence, "EXACT_PAIRS", 0)
    found = evidence.random_vector_threshold(v, q)
    got = found.first()
    assert got.pairs == want.pairs and all(abs(got[c] - want[c]) <= 1.1e-6 for c in ("mu", "sigma", "threshold"))
    assert "NOT (" not in found._jdf.queryExecution().optimizedPlan().toString()  # no join by unequal ids
    assert evidence.random_vector_threshold(v.limit(0), q.limit(0)).first().pairs == 0


def test_edge_boost_meets_words_of_queries(spark):
    rng = random.Random(8)
    cand = {(rng.choice([-7, 0, 3, *range(1000, 1150)]), rng.randrange(60)) for _ in range(1500)}
    edges = {tuple(sorted(rng.sample(range(70), 2))) for _ in range(250)}
    c, e = spark.createDataFrame(list(cand), "query_id long, doc_id long"), spark.createDataFrame(list(edges), "a long, b long")
    want = {}
    for q, d in cand:
        n = sum((a == d and (q, b) in cand) or (b == d and (q, a) in cand) for a, b in edges)
        if n:
            want[q, d] = min(float(n), 3.0)
    found = tiers.edge_boost(c, e)
    assert {(r.query_id, r.doc_id): r.score for r in found.collect()} == want and len({q for q, _ in want}) > 128
    assert "(other" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_dense_by_matrices_with_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(tiers, "SCORES_AT_ONCE", 300)
    rng = np.random.default_rng(3)
    few = [[float(x) for x in rng.normal(size=5)] for _ in range(9)]
    rows = [(int(i), few[i % 9]) for i in rng.permutation(400)] + [(500, None), (501, [0.0] * 5)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    q = v.where("doc_id % 40 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    for least in (None, 0.3):
        found = tiers.dense(q, v, 60, least)
        scored = v.crossJoin(q).select("query_id", "doc_id", fx.round6(tiers.cosine(F.col("embedding"), F.col("q"))).alias("score"))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, tiers.top(scored if least is None else scored.where(F.col("score") >= least), 60).collect()))
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_summed_where_their_document_lies(spark, monkeypatch):
    """BM25 and sparse dots are grouped behind one deal by document, in as many tasks as there are pairs for."""
    monkeypatch.setattr(tiers, "PAIRS", 10)
    docs = spark.createDataFrame([(i, f"alpha word{i % 3} " + "beta " * (i % 4)) for i in range(40)], "doc_id long, content string")
    terms = spark.createDataFrame([(q, t) for q in (1, 2) for t in ("alpha", "beta", f"word{q}", "none")], "query_id long, term string")
    vectors = index.postings(docs).select("doc_id", "term", F.col("tf").cast("double").alias("weight"))
    asked = terms.withColumn("q", F.lit(2.0))
    for found in (tiers.bm25(terms, docs), tiers.sparse(asked, vectors), tiers.sparse(asked, vectors, most_df=0.5, total=40)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" not in plan and "hashpartitioning(doc_id" in plan
        assert int(re.search(r"hashpartitioning\(doc_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)[1]) >= 8
    words = {i: ["alpha", f"word{i % 3}"] + ["beta"] * (i % 4) for i in range(40)}
    common = {"alpha"} | {t for t in ("beta", "word1", "word2") if sum(t in w for w in words.values()) > 20}
    want = {(q, i): x for q in (1, 2) for i, w in words.items() if (x := sum(2.0 * w.count(t) for t in {"alpha", "beta", f"word{q}"} - common))}
    assert {(r.query_id, r.doc_id): r.score for r in tiers.sparse(asked, vectors, most_df=0.5, total=40).collect()} == want


def test_pairs_of_a_task_stay_bounded_however_many(spark, monkeypatch):
    """Beyond the tasks dealt to through files a task still sums ``MOST_PAIRS`` pairs, and hits are dealt twice."""
    monkeypatch.setattr(tiers, "PAIRS", 2)
    monkeypatch.setattr(tiers, "MOST_PAIRS", 5)
    docs = spark.createDataFrame([(i, f"alpha word{i % 3} " + "beta " * (i % 4)) for i in range(40)], "doc_id long, content string")
    terms = spark.createDataFrame([(q, t) for q in (1, 2) for t in ("alpha", "beta", f"word{q}", "none")], "query_id long, term string")
    want = sorted(map(tuple, tiers.bm25(terms, docs).collect()))
    monkeypatch.setattr(dealing, "FILE_TASKS", 3)
    found = tiers.bm25(terms, docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc_id#\d+L, 16\), REPARTITION_BY_NUM", plan) and re.search(r"hashpartitioning\(_deal#\d+L, 3\), REPARTITION_BY_NUM", plan)
    assert "hashpartitioning(query_id" not in plan and len(want) == 80 and sorted(map(tuple, found.collect())) == want
