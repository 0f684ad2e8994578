"""The density gate at ties of its rounding and just below a floor of its gate, against its SQL."""

import duckdb

from marlstone import registry


def test_density_gate_equals_sql_at_ties_and_floors(spark, tmp_path):
    rows = [  # id, tags, characters
        (1, 12, 1536), (95, 45, 4608), (92, 85, 2048), (184, 331, 2048), (276, 103, 10240),  # seven decimals that end in 5
        (93, 1202, 1002292), (185, 2, 10), (186, 1, 3),  # .49999984: cold, though it rounds to a floor
    ]
    docs = [(i, " ".join(f"word{k:07d}" for k in range(tags - 2)), "en", "notes", chars) for i, tags, chars in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["density_gate"](spark, str(tmp_path)).select("doc_id", "density", "lifecycle").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT doc_id, density, lifecycle FROM ({registry.ORACLE['density_gate']})").fetchall())
    assert {r[0]: r[1:] for r in got}[93] == (0.5, 2)
