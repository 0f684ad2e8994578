"""Ranks of a shortlist that are counted, not sorted."""

import random

import duckdb
from pyspark.sql import functions as F

from marlstone import registry
from marlstone.operators import fusion


def test_counted_ranks_equal_sorted_ones(spark, monkeypatch):
    monkeypatch.setattr(fusion, "ROWS_AT_ONCE", 50)
    rng = random.Random(2)
    rows = [(q, d, rng.choice([0.5, 1.0, 1.25, 3.0])) for q in range(7) for d in rng.sample(range(400), 90)]
    tier = spark.createDataFrame(rows, "query_id long, doc_id long, score double").repartition(5)
    wanted = spark.createDataFrame(rng.sample([r[:2] for r in rows], 60) + [(3, 9999), (77, 1)], "query_id long, doc_id long")
    want = fusion.ranked(tier).join(wanted, ["query_id", "doc_id"]).select("query_id", "doc_id", F.col("rank").cast("long"))
    assert sorted(map(tuple, fusion.ranks_of(tier, wanted).select("query_id", "doc_id", "rank").collect())) == sorted(map(tuple, want.collect()))
    assert fusion.ranks_of(tier, wanted.limit(0)).count() == 0


def test_shortlist_sorts_no_tier_and_keeps_queries_without_one(spark, tmp_path):
    """Query 8 has a shard's name, which no text has, so no shortlist: its whole fused list stays."""
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "longishword1", "longishword2", "delta"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 9))), "en", "notes" if i % 3 else "wiki", 5) for i in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(6, "gamma longishword1 longishword2"), (7, "alpha longishword1"), (8, "notes"), (9, "nothing")]
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    df = registry.QUERIES["shortlist_filter"](spark, str(tmp_path))
    got = sorted(map(tuple, df.select("query_id", "doc_id", "score").collect()))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT query_id, doc_id, score FROM ({registry.ORACLE['shortlist_filter']})").fetchall())
    assert {q: sum(r[0] == q for r in got) for q in (6, 7, 8, 9)} == {6: 50, 7: 50, 8: 100, 9: 0}
    assert "Window" not in registry.QUERIES["shortlist_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
