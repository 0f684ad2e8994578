"""The inverted file against brute force: its exact way equal, its quick way by recall; hot cells, odd vectors."""

import numpy as np
import pytest

from marlstone.operators import ann

VECTORS = "doc_id long, embedding array<float>"


def brute(rows, queries, k, least=None):
    out = set()
    for q_id, q in queries:
        scored = []
        for d, v in rows:
            if v is not None:
                v, w = np.array(v, np.float32).astype(float), np.array(q, np.float32).astype(float)
                n = np.sqrt(v @ v) * np.sqrt(w @ w)
                s = round(float(v @ w / n), 6) + 0.0 if n else 0.0
                if least is None or s >= least:
                    scored.append((-s, d))
        out |= {(q_id, d, -s + 0.0, i + 1) for i, (s, d) in enumerate(sorted(scored)[:k])}
    return out


def made(n, dim=16, seed=1, middle=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(middle, dim)) * 2
    return [(i, (centers[i % middle] + rng.normal(size=dim)).tolist()) for i in range(n)]


def got(spark, rows, queries, k, cells=None, **kw):
    index = ann.build(spark.createDataFrame(rows, VECTORS).repartition(3), cells)
    found = ann.search(spark.createDataFrame(queries, "query_id long, q array<float>"), index, k, **kw).collect()
    out = {(r.query_id, r.doc_id, r.score, r.rank) for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("kw", [{"probes": 1}, {"probes": 3, "least": 0.4}, {"probes": 100}])
def test_exact_way_equals_brute_force(spark, kw):
    rows = made(400)
    queries = [(i, v) for i, v in rows[::40]] + [(7777, [0.0] * 16), (7778, (-np.ones(16)).tolist())]
    assert got(spark, rows, queries, 10, 12, exact=True, **kw) == brute(rows, queries, 10, kw.get("least"))


def test_hot_vector_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 16)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(120)] + [(200, [0.0, 0.0, 0.0]), (201, None), (202, [-1.0, -2.0, -3.0]), (203, [3.0, 2.0, 1.0])]
    queries = [(1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0]), (3, [0.0, 0.0, 0.0])]
    assert got(spark, rows, queries, 5, 3, exact=True, probes=1) == brute(rows, queries, 5)
    assert got(spark, rows[:2], queries, 5, exact=True) == brute(rows[:2], queries, 5)


def test_empty(spark):
    assert got(spark, [], [(1, [1.0])], 3, exact=True) == set()
    assert got(spark, made(9), [(1, None)], 3) == set()


def test_recall_of_the_quick_way(spark):
    rows = made(3000, 24, middle=40)
    queries = [(i, v) for i, v in rows[::60]]
    want = brute(rows, queries, 10)
    found = got(spark, rows, queries, 10, probes=8)
    recall = len({x[:2] for x in found} & {x[:2] for x in want}) / len(want)
    assert recall >= 0.95, recall
    print("recall@10", recall)
