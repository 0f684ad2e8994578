"""Indexes in step with their documents, however these change; answers after files were replaced."""

import random
import re

from pyspark.sql import functions as F

from marlstone.operators import dealing, index, maintained
from marlstone.plans import model as m

DOCS = "doc_id long, content string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t) for i, ts in docs.items() for t in ts], DOCS)


def rows(df):
    return sorted(map(str, df.collect()))


def test_equals_a_rebuild_after_any_changes(spark, tmp_path):
    rng, words = random.Random(3), ["alpha", "beta", "gamma", "delta"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 6)))
    docs = {i: [text()] for i in range(30)} | {None: ["none at all"], 99: ["twice", "twice"]}
    folder = f"file://{tmp_path}/index"
    for step in range(6):
        df = frame(spark, docs).repartition(3)
        found, touched = maintained.sync(df, folder, index.postings, ["term"], buckets=8)
        assert rows(found) == rows(index.postings(df)), step
        assert touched == (list(range(8)) if step == 0 else sorted({r[0] for r in spark.createDataFrame([(i,) for i in changed], "doc_id long").select(maintained.bucket_of("doc_id", 8)).collect()}))
        changed = rng.sample(sorted(i for i in docs if i is not None), 3)
        docs[changed[0]] = [text() + " new"]
        del docs[changed[1]]
        docs[changed[2]] = docs[changed[2]] * 2
        docs[1000 + step] = [text()]
        changed.append(1000 + step)
    assert maintained.sync(df, folder, index.postings, buckets=8)[1] == [] and rows(found) == rows(maintained.sync(df, folder, index.postings, buckets=8)[0])
    gone, touched = maintained.sync(df.limit(0), folder, index.postings, buckets=8)
    assert gone.count() == 0 and touched
    back, _ = maintained.sync(df, folder, index.postings, buckets=8)
    assert rows(back) == rows(index.postings(df))


def test_half_written_version_is_not_seen(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    one = frame(spark, {1: ["a b"], 2: ["c"]})
    maintained.sync(one, folder, index.doc_stats)
    lost = frame(spark, {1: ["a b"], 2: ["c d e"]})

    def breaks(docs):
        return docs.select("doc_id", F.raise_error(F.lit("lost")).cast("long").alias("dl"))

    try:
        maintained.sync(lost, folder, breaks)
    except Exception:
        pass
    assert rows(maintained.sync(one, folder, index.doc_stats)[0]) == rows(index.doc_stats(one))


def test_replaced_files_give_new_answers(spark, tmp_path):
    """In place and under the same name; and after the shared folder was cleaned."""
    sf = f"file://{tmp_path}/sf"
    rows_of = lambda n, word: spark.range(n).selectExpr("id AS doc_id", f"concat('{word} ', id) AS text", "'en' AS lang", "'s' AS source", "5L AS n_chars")
    for n, word in ((100, "old"), (50, "new"), (50, "now"), (0, "no")):
        rows_of(n, word).coalesce(1).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
        assert m.lengths(spark, sf).count() == n
        assert m.postings(spark, sf).where(F.col("term") == word).count() == n
    rows_of(7, "again").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert m.lengths(spark, sf).count() == 7
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{m.shared_folder(spark)}/index")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    assert m.lengths(spark, sf).count() == 7


def test_tasks_of_a_bucket_follow_its_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintained, "TASK_BYTES", 100)
    df = spark.createDataFrame([(i % 90, f"word{i} of text number {i % 7}") for i in range(120)], "doc_id long, content string")
    found, _ = maintained.sync(df, f"file://{tmp_path}/index", index.postings, ["term"], buckets=4)
    assert rows(found) == rows(index.postings(df))
    files = list((tmp_path / "index/rows/version=1").glob("bucket=*/*.parquet"))
    assert len(files) > 4 and maintained.text_bytes(df.limit(0)) == 0


def test_texts_are_dealt_through_files(spark, tmp_path, monkeypatch):
    """Beyond the tasks that Spark deals to through files, a reader does not hold its whole part of the table."""
    monkeypatch.setattr(dealing, "FILE_TASKS", 3)
    monkeypatch.setattr(maintained, "TASK_BYTES", 100)
    df = spark.createDataFrame([(i % 90 if i else None, f"word{i} of text number {i % 7}") for i in range(120)], "doc_id long, content string")
    plan = dealing.dealt(df, 8, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(doc_id#\d+L, 8\)", plan)) == 1 and len(re.findall(r"hashpartitioning\(_deal#\d+L, 3\)", plan)) == 1
    assert "_deal" not in dealing.dealt(df, 8, "doc_id").columns and "_deal" not in dealing.dealt(df, 3, "doc_id")._jdf.queryExecution().executedPlan().toString()
    seen = []
    make = lambda docs: (seen.append(docs._jdf.queryExecution().executedPlan().toString()), index.postings(docs))[1]
    found, _ = maintained.sync(df, f"file://{tmp_path}/index", make, ["term"], buckets=4)
    assert any("hashpartitioning(_deal" in p for p in seen)
    assert rows(found) == rows(index.postings(df))
