"""Rolling medians against a plain loop: prefix counts, windows of a block or two, windows of many blocks, odd rows."""

import datetime as dt
import math
import random
from statistics import median

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import rolling_median as rm
from marlstone.llm.queries_clicks import OP13_SQL, op13_rolling_median

CLICKS = "click_id long, ts timestamp_ntz, kind string, value double"
START = dt.datetime(2024, 3, 31, 0, 30)
SF = "/root/testdata/sf0.001"


def plain(rows):
    once = {}
    for i, ts, kind, value in rows:
        if ts is not None:
            cents = None if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
            row = (ts, kind is not None, kind or "", cents is not None, cents or 0)
            once[i] = min(once.get(i, row), row)
    out = []
    for i, (ts, has_kind, kind, has_cents, cents) in once.items():
        own = [c for t, k, n, h, c in once.values() if (k, n) == (has_kind, kind) and h and ts - dt.timedelta(hours=1) < t <= ts]
        n, m2, mad, far = len(own), None, None, None
        if n >= 2:
            m2 = round(2 * median(own))
            mad = round(2 * median(abs(2 * c - m2) for c in own))
            far = 2 * abs(2 * cents - m2) > 3 * mad if has_cents else None
        out.append(str((i, kind if has_kind else None, n, m2, mad, far)))
    return sorted(out)


def got(df, **kw):
    return sorted(str((r.click_id, r.kind, r.n, r.median2, r.mad4, r.far)) for r in rm.rolling_median(df, **kw).collect())


def made(n, seconds, kinds=("a", "b", None), seed=1, same=0.2, values=lambda rng: round(rng.lognormvariate(3, 1), 2)):
    rng, ts, rows = random.Random(seed), START, []
    for i in range(n):
        if rng.random() > same:
            ts += dt.timedelta(microseconds=rng.randint(1, int(2e6 * seconds)))
        rows.append((i, ts, rng.choice(kinds), None if rng.random() < 0.05 else values(rng)))
    rng.shuffle(rows)
    return rows


def test_prefix_counts_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64, 65, 300):
        values, weights = rng.integers(-5, 40, n) * rng.integers(1, 1000), rng.integers(1, 5, n)
        a = rng.integers(0, n, 200)
        b = np.minimum(n, a + rng.integers(1, n + 1, 200))
        for w in (None, weights):
            found = rm.PrefixCounts(values, w)
            lists = [np.sort(np.repeat(values[x:y], 1 if w is None else w[x:y])) for x, y in zip(a, b)]
            nth = rng.integers(1, 1 << 30, 200) % np.array([len(x) for x in lists]) + 1
            assert found.nth(a, b, nth).tolist() == [x[k - 1] for x, k in zip(lists, nth)]
            bound = rng.choice(np.concatenate((values, values + 1, [-(10**9), 10**9])), 200)
            assert found.below(a, b, bound).tolist() == [int((x < v).sum()) for x, v in zip(lists, bound)]
            size, m2, mad = rm.medians(found, a, b)
            for x, s, m, d in zip(lists, size, m2, mad):
                assert s == len(x)
                if s >= 2:
                    assert m == round(2 * np.median(x)) and d == round(2 * np.median(np.abs(2 * x - m)))


@pytest.mark.parametrize("low,high", [(0, 0), (0, 1), (3, 17), (5, 6), (8, 24), (1, 1000), (512, 1024)])
def test_pieces_cover(low, high):
    assert [x for k, i in rm.pieces(low, high) for x in range(i << k, (i + 1) << k)] == list(range(low, high))


def test_bracket_holds_what_it_must():
    """With any others added to the runs' values, medians and the values at the radius lie in the bracket."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        runs = [np.sort(rng.integers(0, 300, rng.integers(1, 9))) for _ in range(rng.integers(6, 30))]
        low, high, size = (np.array([f(x) for x in runs]) for f in (np.min, np.max, len))
        spans = rm.bracket(low, high, size, 10)
        for _ in range(5):
            values = np.sort(np.concatenate([*runs, rng.integers(-50, 400, rng.integers(0, 11))]))
            n = len(values)
            m2 = values[(n + 1) // 2 - 1] + values[n // 2]
            devs = np.sort(np.abs(2 * values - m2))
            for v in (values[(n + 1) // 2 - 1], values[n // 2]):
                assert any(x <= v <= y for x, y in spans)
            for d in (devs[(n + 1) // 2 - 1], devs[n // 2]):
                for v in values[np.abs(2 * values - m2) == d]:
                    assert any(x <= v <= y for x, y in spans)


@pytest.mark.parametrize(("rows", "kw"), [
    (made(600, 60), {}), (made(900, 400), {"most_rows": 60}), (made(600, 60), {"most_rows": 0, "least_block": 32, "most_block": 128}), (made(900, 9, ("a",)), {"most_rows": 0, "least_block": 8, "most_block": 16}), (made(700, 2, ("a", None), same=0.5), {"most_rows": 9, "least_block": 16, "most_block": 16}),
    (made(500, 5, ("a",), values=lambda rng: float(rng.choice([1, 1, 1, 2, 7]))), {"most_rows": 9, "least_block": 8, "most_block": 8}), (made(400, 1, ("a",), values=lambda rng: rng.uniform(-1e9, 1e9)), {"most_rows": 9, "least_block": 16, "most_block": 16}),
    (made(300, 1, ("a",), same=1.0), {"most_rows": 9, "least_block": 16, "most_block": 16}),
])
def test_rolling_median_brute_force(spark, rows, kw):
    assert got(spark.createDataFrame(rows, CLICKS).repartition(5), **kw) == plain(rows)


def test_odd_rows(spark):
    hour = dt.timedelta(hours=1)
    rows = [(1, START, "a", 1.0), (1, START, "a", 1.0), (2, START + hour, "a", 2.0), (3, START + hour - dt.timedelta(microseconds=1), "a", 3.005), (4, None, "a", 4.0), (5, START, None, -0.005), (6, START, None, None), (None, START, "b", 1.0), (None, START, "b", 0.5),
            (7, START, "", float("nan")), (8, START, "", float("inf")), (9, START, "", 1e9), (10, START + hour, None, 2.5), (11, START, "c", None), (12, START - dt.timedelta(days=9), "a", -7.25)]
    docs = spark.createDataFrame(rows, CLICKS)
    assert got(docs) == plain(rows)
    for c in ("series", "place", "time", "role", "cents", "row", "n", "block", "_at"):
        docs = docs.withColumn(c, F.lit(5))
    assert got(docs) == plain(rows)
    assert got(spark.createDataFrame([], CLICKS)) == []


def test_times_without_zone_ignore_the_session(spark):
    rows = made(200, 60, ("a",))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # clocks change on that day
    try:
        assert got(spark.createDataFrame(rows, CLICKS)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW clicks AS SELECT * FROM '{SF}/clicks.parquet'")
    want = con.execute(OP13_SQL)
    names = [c[0] for c in want.description]
    at = [names.index(c) for c in ("click_id", "kind", "n", "median2", "mad4", "far")]
    assert sorted(str(tuple(r[i] for i in at)) for r in want.fetchall()) == sorted(str(tuple(r)) for r in op13_rolling_median(spark, SF).select("click_id", "kind", "n", "median2", "mad4", "far").collect())
