"""Nine-tier confidence against numpy: histories cut into blocks, releases by time, and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import confidence as c

LOG = "event_id long, session_id string, ts double, " + ", ".join(f"{t} double" for t in c.TIERS) + ", cos_q_c double, value string"


def log(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        session = r.choice(["hot", "hot", "hot", "a", "b", None])
        tiers = [None if r.random() < 0.1 else r.choice([0.0, 1.0, r.random() * 9]) for _ in c.TIERS]
        tiers[6] = 0.5  # never moves
        rows.append((i, session, None if r.random() < 0.02 else float(r.randrange(n // 2)), *tiers, r.choice([None, r.uniform(-1, 1)]), "x"))
    return [*rows, (n, "still", 1.0, *[1.0] * 9, None, "x"), (n + 1, "still", 2.0, *[1.0] * 9, None, "x"), (n + 2, "still", 3.0, *[1.0] * 9, None, "x")]


def expected(rows, last=50):
    out = {}
    for row in rows:
        key = row[1:3]
        if None in key or key in out:
            continue
        before = sorted((x[2], x[0], x[3:12]) for x in rows if x[1] == key[0] and x[2] is not None and x[2] < key[1])[-last:]
        m = np.array([[v or 0.0 for v in x[2]] for x in before]).reshape(len(before), 9)
        flat = len(before) < 2 or not m.std(axis=0).any()
        corr = np.zeros((9, 9))
        if not flat:
            for i in range(9):
                for j in range(9):
                    if m[:, i].std() > 1e-12 and m[:, j].std() > 1e-12:
                        corr[i, j] = np.corrcoef(m[:, i], m[:, j])[0, 1]
        out[key] = (len(before), flat, [corr[i, j] for i in range(9) for j in range(i + 1, 9)])
    return out


@pytest.mark.parametrize(("last", "block"), [(50, c.BLOCK), (50, 64), (7, 16)])
def test_histories_equal_numpy(spark, last, block):
    rows = log()
    want = expected(rows, last)
    got = {(r.session_id, r.ts): (r.n_rows, r.degenerate, [r[p] for p in c.PAIRS]) for r in c.histories(spark.createDataFrame(rows, LOG), last, block).collect()}
    assert len(c.PAIRS) == 36 and set(got) == set(want)
    for key, (n, flat, corr) in want.items():
        assert got[key][:2] == (n, flat) and np.allclose(got[key][2], corr, atol=1e-6), key
    assert got["still", 3.0][:2] == (2, True)


def test_histories_of_nothing(spark):
    assert c.histories(spark.createDataFrame([], LOG)).count() == 0


def sha(entries):
    return hashlib.sha256("\n".join(sorted(f"{k}:{round(v * 10**9)}" for k, v in entries.items())).encode()).hexdigest()


OLD, NEW = {"intercept": -1.0, "fts5": 0.25, "cos_q_c": 2.0, "fts5__splade": 1.5, "none": 7.0}, {"intercept": 30.0}


def scored(spark, releases, rows=None, history=True):
    rows = rows or log()
    coefficients = spark.createDataFrame([(v, k, x) for v, e in (("old", OLD), ("new", NEW)) for k, x in e.items()], "version string, feature string, coefficient double")
    known = c.models(coefficients, spark.createDataFrame(releases, "version string, valid_from double, schema_version int, sha256 string, label_set string"))
    df = spark.createDataFrame(rows, LOG)
    return {r.event_id: r for r in c.confidence(df, c.histories(df) if history else None, known).collect()}


def test_an_old_release_still_scores_old_queries(spark):
    rows = log()
    want = expected(rows)
    alone = scored(spark, [("old", 50.0, 1, sha(OLD).upper(), "half")])
    both = scored(spark, [("old", 50.0, 1, sha(OLD), "half"), ("new", 120.0, 1, None, "full")])
    assert len(both) == len(rows)
    for row in rows:
        i, key = row[0], row[1:3]
        r = both[i]
        if row[2] is None or row[2] < 50:
            assert (r.version, r.prob_b, r.logit, r.score_a, r.high_risk, r.refused) == (None,) * 6
        elif row[2] < 120:
            corr = want[key][2][c.PAIRS.index("fts5__splade")] if key in want else 0.0
            p = 1 / (1 + np.exp(1.0 - 0.25 * (row[3] or 0) - 2 * (row[12] or 0) - 1.5 * corr))
            assert r == alone[i] and r.version == "old" and r.label_set == "half"
            assert r.prob_b == pytest.approx(p, abs=2e-6) and r.score_a == pytest.approx(1 - p, abs=2e-6) and r.high_risk == (p > 0.5)
            held = min(max(p, 0.001), 0.999)
            assert r.logit == pytest.approx(np.log(held / (1 - held)), abs=2e-5)
        else:
            assert r.version == "new" and r.prob_b == pytest.approx(1.0) and r.logit == pytest.approx(np.log(999), abs=1e-5)


@pytest.mark.parametrize(("release", "why"), [(("old", 0.0, 2, None, "x"), "schema"), (("old", 0.0, None, None, "x"), "schema"), (("none", 0.0, 1, None, "x"), "no coefficients"), (("old", 0.0, 1, sha(NEW), "x"), "sha256")])
def test_refused_releases_score_nothing(spark, release, why):
    got = [r for r in scored(spark, [release], log(20), history=False).values() if r.version]
    assert got and all(r.refused == why and r.prob_b is None and r.logit is None and r.high_risk is None for r in got)


def test_no_release_and_no_rows(spark):
    assert all(r.version is None and r.prob_b is None for r in scored(spark, [], log(20), history=False).values())
    known = c.models(spark.createDataFrame([], "version string, feature string, coefficient double"), spark.createDataFrame([], "version string, valid_from double, schema_version int, sha256 string, label_set string"))
    assert c.confidence(spark.createDataFrame([], LOG), None, known).count() == 0
    assert c.confidence(spark.createDataFrame(log(5), LOG).withColumn("x", F.lit(1)), None, known).count() == 8
