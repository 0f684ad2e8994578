"""Indexes kept in step with their documents: only buckets with a changed document are made anew.

An index is a function of each document on its own. Documents are dealt into buckets by a hash of their
id; a bucket's rows lie in a folder of their own, by version. A table of digests tells which documents came,
changed or went, hence which buckets are touched; those are written under the next version, and a last small
file that names the version of every bucket makes them current. Until it is written, readers see the
version before; a run that broke off leaves nothing but files that no version names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.dealing import dealt
from marlstone.operators.graph import cleaned

#: Buckets of an index; a bucket is what one change makes anew. At scale, take some gigabytes of documents a bucket.
BUCKETS = 16
#: Bytes of text that a task makes rows of: a bucket has as many tasks as its share of the text asks for.
TASK_BYTES = 8_000_000


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def signature(spark: SparkSession, path: str) -> tuple:
    """What changes when files below ``path`` come, go or are replaced: their number, and sums over path, length and time of change. Reads no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def bucket_of(doc_id: str, buckets: int) -> Column:
    return F.pmod(F.hash(doc_id), F.lit(buckets))


def digests(docs: DataFrame, doc_id: str, buckets: int) -> DataFrame:
    """(doc_id, digest, n, bucket): all rows of an id are one document."""
    row = F.xxhash64(*docs.columns)
    return docs.groupBy(doc_id).agg(F.sum(row.cast("decimal(38,0)")).alias("digest"), F.count("*").alias("n")).withColumn("bucket", bucket_of(doc_id, buckets))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of the strings of ``docs``."""
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in docs.schema if f.dataType.simpleString() == "string"]
    return int(docs.agg(F.sum(sum(strings, F.lit(0).cast("long")))).first()[0] or 0)


def _current(spark: SparkSession, folder: str) -> tuple[int, dict[int, int]]:
    """The latest version and the version of each bucket; (0, {}) if there is no index yet."""
    if not exists(spark, f"{folder}/current"):
        return 0, {}
    rows = spark.read.schema("made int, bucket int, version int").parquet(f"{folder}/current")
    rows = rows.where(F.col("made") == (rows.agg(F.max("made")).first()[0] or 0)).collect()  # a row a bucket
    return (rows[0].made, {r.bucket: r.version for r in rows}) if rows else (0, {})


def _read(spark: SparkSession, folder: str, part: str, schema: str, versions: dict[int, int]) -> DataFrame:
    paths = [p for b, v in sorted(versions.items()) if exists(spark, p := f"{folder}/{part}/version={v}/bucket={b}")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def sync(docs: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame], order: list[str] | None = None, doc_id: str = "doc_id", buckets: int = BUCKETS) -> tuple[DataFrame, list[int]]:
    """(the rows of ``make(docs)``, the buckets made anew): the index in ``folder``, brought in step with ``docs``.

    ``make`` must give each document its rows, whatever other documents there are, with its ``doc_id``.
    ``order`` sorts rows within a bucket's files. A null id is a document of its own bucket. ``docs`` may
    be empty: then so is the index.
    """
    spark = docs.sparkSession
    rows = make(docs)
    kinds, marks = _ddl(rows), _ddl(docs.select(doc_id)) + ", digest decimal(38,0), n long"
    version, versions = _current(spark, folder)
    new = digests(docs, doc_id, buckets)
    if version:
        old = _read(spark, folder, "digests", marks, versions).withColumnsRenamed({doc_id: "_id", "digest": "_digest", "n": "_n"})
        same = F.col(doc_id).eqNullSafe(F.col("_id"))
        differs = ~(F.col("digest").eqNullSafe(F.col("_digest")) & F.col("n").eqNullSafe(F.col("_n")))
        both = new.join(old, same, "full_outer").where(differs)
        touched = sorted(r[0] for r in both.select(F.coalesce("bucket", bucket_of("_id", buckets))).distinct().collect())  # one a bucket at most
    else:
        touched = list(range(buckets))
    if touched:
        made = version + 1
        bucket = bucket_of(doc_id, buckets)
        some = docs.where(bucket.isin(touched)) if len(touched) < buckets else docs
        tasks = buckets * max(1, -(-text_bytes(some) // (buckets * TASK_BYTES)))
        parts = dealt(some, tasks, doc_id)  # a task is in one bucket, as buckets divide tasks, and what ``make`` groups by document needs no other deal
        out = make(parts).withColumn("bucket", bucket).sortWithinPartitions("bucket", *(order or []))
        with cleaned(spark):
            out.write.partitionBy("bucket").parquet(f"{folder}/rows/version={made}")
        new.where(F.col("bucket").isin(touched)).repartition(buckets, doc_id).write.partitionBy("bucket").parquet(f"{folder}/digests/version={made}")
        versions |= dict.fromkeys(touched, made)
        spark.createDataFrame([(made, b, v) for b, v in versions.items()], "made int, bucket int, version int").coalesce(1).write.mode("append").parquet(f"{folder}/current")
    return _read(spark, folder, "rows", kinds, versions), touched


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
