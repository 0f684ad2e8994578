"""Merkle manifest against a plain recursive one, with odd rows, and against its SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import merkle
from marlstone.llm.order import numbered
from marlstone.llm.queries_manifest import OP11_SQL, op11_merkle_manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes, fanout):
    """(top, paths): of each node the pairs (what stands before it, what after it) on the way up."""
    if len(nodes) <= 1:
        return nodes[0], [[] for _ in nodes]
    runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
    top, above = tree([h(*run) for run in runs], fanout)
    return top, [[(run[:k], run[k + 1 :])] + above[j] for j, run in enumerate(runs) for k in range(len(run))]


def plain(rows, fanout=16):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((-1 if row[0] is None else row[0], leaf(row, row[1]), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:2])
    built = {s: tree([x[1] for x in groups[s]], fanout) for s in order}
    root, above = tree([built[s][0] for s in order], fanout)
    out = []
    for s, up in zip(order, above, strict=True):
        subroot, paths = built[s]
        for (_, own, row), path in zip(groups[s], paths, strict=True):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            digest, proof = leaf(row, lower(row[1])) if changed else own, ""
            for before, after in path + up:
                digest, proof = h(*before, digest, *after), proof + "".join(before + after)
            out.append((str(row[0]), own, subroot, root, h(proof), digest, str(digest == root)))
    return sorted(out)


def manifest(docs, **kw):
    return merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.tampered(F.col("text")), **kw)


def got(docs, **kw):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, str(r.verified)) for r in manifest(docs, **kw).collect())


ODD = [(1, "Ab", "en", "a", 2), (2, None, None, None, None), (3, "", "", "", 0), (None, "X", "en", "a", 1), (None, "Y", "en", "a", 1), (4, "Z" * 200_000, "en", "a", 9), (5, "É ß", "de", "ä", -3), (6, "Same", "en", "b", 4), (6, "Same", "en", "b", 4), (6, "Other", "en", "b", 5)]


def made(n, sources):
    return [(i * 7 % 1000003, f"Text {i}" * (i % 5), "en", sources(i), i) for i in range(n)]


@pytest.mark.parametrize(("rows", "fanout", "depth"), [
    (ODD, 16, 3), (ODD, 2, 1), (made(300, lambda i: "hot" if i % 3 else f"s{i % 40}"), 2, 2), (made(83, lambda i: "one"), 3, 1), (made(40, lambda i: f"s{i}"), 3, 1), (made(64, lambda i: "even"), 2, 3), (made(700, lambda i: "hot" if i % 2 else None), 16, 1)])
def test_manifest_brute_force(spark, rows, fanout, depth):
    assert got(spark.createDataFrame(rows, DOCS).repartition(3), fanout=fanout, depth=depth) == plain(rows, fanout)


def test_manifest_one_row_and_none(spark):
    one = [(3, "T", None, "s", 1)]
    assert got(spark.createDataFrame(one, DOCS)) == plain(one)
    assert got(spark.createDataFrame([], DOCS)) == []


def test_manifest_other_columns_do_not_clash(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    for c in ("idx", "key", "block", "digest", "changed", "row", "_at", "befores", "root"):
        docs = docs.withColumn(c, F.lit(1))
    assert got(docs) == plain(ODD)


def test_change_is_seen_only_where_text_changes(spark):
    rows = [(i, "ABC" if i % 2 else "abc", "en", "s", 3) for i in range(60)]
    for r in manifest(spark.createDataFrame(rows, DOCS)).collect():
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id % 2))


def test_siblings_by_index():
    level = np.frombuffer(b"".join(bytes([65 + i]) * 64 for i in range(7)), np.uint8).reshape(-1, 64)
    found, at = merkle.siblings(level, 3)
    assert [x.decode()[::64] for x in found] == ["BC", "AC", "AB", "EF", "DF", "DE", ""]
    assert at.tolist() == [0, 64, 128, 0, 64, 128, 0]


def test_numbered_hot_key(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, null, 'hot') AS g", "7 AS v", "id AS r").repartition(7)
    found = {(r.g, r.r): r.idx for r in numbered(rows, ["g"], ["v", "r"]).collect()}
    for g in (None, "hot"):
        own = sorted(r for k, r in found if k == g)
        assert [found[g, r] for r in own] == list(range(len(own)))


def test_manifest_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(OP11_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[names.index(c)] for c in names) for r in want.fetchall()))) == sorted(map(str, map(tuple, op11_merkle_manifest(spark, SF).select(*names).collect())))
