"""Resolution of claims and pairs across shards against plain loops."""

import itertools
import random

import pytest

from marlstone import registry
from marlstone.operators import resolution as rs
from marlstone.plans import knowledge

SF = "/root/testdata/sf0.001"
CLAIMS = "claim_id string, claim_type string, observed_at double, supersedes string"
EDGES = "a string, b string, edge_type string"


def head_of(claims):
    by = {}
    for c in claims:
        if c[3] is not None:
            by[c[3]] = max(by.get(c[3], ""), c[0])

    def walk(i):
        at = i
        while at in by and by[at] not in (i, at):
            at = by[at]
        return at

    return {c[0]: walk(c[0]) for c in claims}


def clusters_of(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, kind in edges:
        if kind in rs.CONFLICTS and a != b and (a in ids or b in ids):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            parent[find(a)] = find(b)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def plain(claims, edges):
    heads, rows = head_of(claims), {c[0]: c for c in claims}
    tied = clusters_of({i for i, h in heads.items() if i == h}, edges)
    out = {(i, None, False, f"superseded_by {h}") for i, h in heads.items() if i != h}
    for name in set(tied.values()):
        ranked = sorted((i for i in tied if tied[i] == name), key=lambda i: ({"primary": 0, "derived": 1, "inferred": 2}.get((rows[i][1] or "").lower(), 99), -(rows[i][2] or 0), i))
        out |= {(i, name, k == 0, None if k == 0 else f"contradicts_winner {ranked[0]}") for k, i in enumerate(ranked)}
    return out


def made(n, seed):
    rng = random.Random(seed)
    ids = [f"c{i:03}" for i in range(n)]
    claims = []
    for k, i in enumerate(ids):
        claims.append((i, rng.choice(["primary", "Derived", "inferred", "x", None]), rng.choice([None, 1.0, 2.0, 3.0]), rng.choice(ids[:k]) if k and rng.random() < 0.4 else None))
    edges = [(*rng.sample(ids, 2), rng.choice(["contradicts", "duplicates", "supersedes"])) for _ in range(n // 2)] + [("c001", "c001", "contradicts"), ("c002", "outside", "contradicts"), ("c003", "outside", "duplicates")]
    return claims, edges


def same(claims, edges):
    got = rs.latest_then_authority(claims, edges).collect()
    assert len(got) == len({r.claim_id for r in got})
    return {tuple(r) for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_then_authority(spark, seed):
    claims, edges = made(60, seed)
    assert same(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(edges, EDGES)) == plain(claims, edges)


def test_no_edges_and_no_claims(spark):
    claims, _ = made(10, 3)
    none = spark.createDataFrame([], EDGES)
    assert same(spark.createDataFrame(claims, CLAIMS), none) == plain(claims, [])
    assert same(spark.createDataFrame([], CLAIMS), none) == set()


def test_flags(spark):
    claims, edges = made(50, 4)
    heads, tied = head_of(claims), clusters_of({c[0] for c in claims}, edges)
    near = {}
    for a, b, kind in edges:
        if kind == "contradicts" and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    got = rs.keep_all_with_flags(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(edges, EDGES)).collect()
    assert {tuple(r) for r in got} == {(i, tied[i], h if h != i else None, len(near.get(i, ()))) for i, h in heads.items()}


def test_neighbours_and_scan(spark):
    claims, edges = made(40, 5)
    seeds = spark.createDataFrame([("c001",), ("c002",), ("c002",)], "claim_id string")
    got = {tuple(r) for r in rs.claim_neighbours(seeds, spark.createDataFrame(edges, EDGES), ("contradicts",)).collect()}
    assert got == {(x, y) for a, b, k in edges if k == "contradicts" for x, y in ((a, b), (b, a)) if x in ("c001", "c002")}
    rows = [(f"c{i}", "k1" if i % 2 else "k2", "t", f"s{i % 3}", i / 10, float(i % 4)) for i in range(10)]
    table = spark.createDataFrame(rows, "claim_id string, entity_key string, claim_type string, shard string, confidence double, observed_at double")
    assert [r.claim_id for r in rs.claim_scan(table, entity_key="k1", least_confidence=0.3, most=2).collect()] == ["c9", "c7"]
    assert {r.claim_id for r in rs.claim_scan(table, shard="s0", claim_type="t").collect()} == {"c0", "c3", "c6", "c9"}


def test_query_claim_resolution(spark):
    claims, edges = knowledge.claims_and_edges(spark, SF)
    rows = [(r.claim_id, r.claim_type, r.observed_at, r.supersedes) for r in claims.collect()]
    found = {tuple(r) for r in registry.QUERIES["claim_resolution"](spark, SF).collect()}
    assert found == plain(rows, [tuple(r) for r in edges.collect()]) and len(found) == len(rows)


@pytest.mark.parametrize("edges", [None, 20])
def test_pairs_across_shards(spark, edges):
    rng = random.Random(6)
    pick = lambda n, k: [f"t{rng.randrange(n)}" for _ in range(rng.randint(0, k))]
    docs = [(i, f"s{i % 3}", pick(4, 2) if i % 9 else None, pick(60, 5), pick(8, 2), rng.random() < 0.4) for i in range(150)]
    held = {}
    for i, _, ds, es, _, _ in docs:
        for t in {f"d:{x}" for x in ds or ()} | {f"e:{x}" for x in es}:
            held.setdefault(t, set()).add(i)
    rows, want, seen = {d[0]: d for d in docs}, [], set()
    for t in sorted(held, key=lambda t: (len(held[t]), t)):
        for a, b in itertools.combinations(sorted(held[t]), 2) if 2 <= len(held[t]) <= 12 else ():
            if (a, b) not in seen and rows[a][1] != rows[b][1]:
                seen.add((a, b))
                votes = sum(bool(set(rows[a][c] or ()) & set(rows[b][c] or ())) for c in (2, 3, 4)) + (rows[a][5] and rows[b][5])
                if votes >= 2:
                    want.append((a, b, t, votes))
    df = spark.createDataFrame(docs, "doc_id long, shard string, domains array<string>, entities array<string>, keys array<string>, is_open boolean")
    got = [tuple(r) for r in rs.seed_across_shards(df, 12, edges).collect()]
    assert len(got) == len({x[:2] for x in got}) and sorted(got) == sorted(want if edges is None else want[: edges // 2]) and want
