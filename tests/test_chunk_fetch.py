"""Every text hit of a query counts in a chunk fetch, not only the first forty."""

import duckdb

from marlstone import registry


def test_all_text_hits_count(spark, tmp_path):
    docs = [(i, "alpha " + "beta " * i, "en", "notes", 5) for i in range(60)]  # the longer, the weaker as text and the more 1 / (1 + score)
    docs += [(i, "beta", "en", "notes", 5) for i in range(60, 200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "alpha"), (8, "notes")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, registry.QUERIES["chunk_fetch"](spark, str(tmp_path)).select("query_id", "doc_id", "score", "rank").collect()))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT query_id, doc_id, score, rank FROM ({registry.ORACLE['chunk_fetch']})").fetchall())
    assert [r[1] for r in got] == [55, 56, 57, 58, 59, 0, 1, 2, 3, 4]
