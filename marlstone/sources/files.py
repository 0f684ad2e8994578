"""File sources: directories, concept bundles, snapshots, incremental folders, cached fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Content types by extension, seconds a fetched source stays valid by volatility.
CONTENT_TYPES = {"py": "code", "js": "code", "ts": "code", "go": "code", "rs": "code", "java": "code", "md": "text", "txt": "text", "rst": "text", "json": "data", "yaml": "data", "toml": "data"}
TTL = {"stable": 7 * 86400, "medium": 12 * 3600, "hot": 15 * 60}


def directory(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md", "txt", "py"), exclude: tuple[str, ...] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """(source_id, content, content_type, mtime, size) of all files under ``root`` with one of the extensions, excluded folders left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    denied = F.lit(False)
    for x in exclude:
        denied = denied | F.contains("path", F.lit(f"/{x}/"))
    kind = F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return raw.where(~denied).select(F.col("path").alias("source_id"), F.decode("content", "UTF-8").alias("content"), F.coalesce(F.try_element_at(kind, ext), F.lit("text")).alias("content_type"), F.unix_timestamp("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"))


def frontmatter(content: Column) -> Column:
    """The block between leading --- lines as a map of its scalar ``key: value`` lines; empty for none."""
    block = F.regexp_extract(content, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([\w-]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+:\s*(.*)$", 1)), "^[\"']|[\"']$", "").alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: F.size(F.filter(pairs, lambda q: (q["key"] == p["key"]))) == 1))


def bundle(files: DataFrame, bundle_id: str) -> DataFrame:
    """Concepts of a folder of markdown files: (bundle_id, source_id, type, title, tags, links, body, degraded)."""
    meta = files.withColumn("meta", frontmatter(F.col("content")))
    body = F.regexp_replace("content", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    get = lambda k: F.try_element_at(F.col("meta"), F.lit(k))
    tags = F.filter(F.split(F.regexp_replace(F.coalesce(get("tags"), F.lit("")), r"[\[\]\"']", ""), r"\s*,\s*"), lambda t: t != "")
    links = F.array_distinct(F.regexp_extract_all(body, F.lit(r"\]\(([^)\s]+)\)"), F.lit(1)))
    return meta.select(F.lit(bundle_id).alias("bundle_id"), "source_id", get("type").alias("type"), F.coalesce(get("title"), F.regexp_extract("source_id", r"([^/]*)\.[^.]*$", 1)).alias("title"), tags.alias("tags"), links.alias("links"), body.alias("body"), get("type").isNull().alias("degraded"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines snapshot (doc_id, content, content_hash, last_accessed) whose hash matches; ``tampered`` marks the others."""
    rows = spark.read.schema("doc_id STRING, content STRING, content_hash STRING, last_accessed DOUBLE").json(path)
    return rows.withColumn("tampered", ~(F.sha2("content", 256).eqNullSafe(F.col("content_hash"))))


def write_snapshot(docs: DataFrame, path: str, cold: bool = True) -> None:
    """Documents with their hashes as JSON lines; cold ones only if asked for."""
    rows = docs if cold else docs.where("lifecycle < 2")
    rows.select("doc_id", "content", F.sha2("content", 256).alias("content_hash"), "last_accessed").write.mode("overwrite").json(path)


def sync_diff(seen: DataFrame, now: DataFrame) -> DataFrame:
    """(source_id, change): new, changed, unchanged or deleted by content hash, of (source_id, content_hash) tables."""
    j = seen.select("source_id", F.col("content_hash").alias("old")).join(now.select("source_id", F.col("content_hash").alias("new")), "source_id", "full_outer")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return j.select("source_id", change.alias("change"))


def scheme(source_id: Column) -> Column:
    """file, http, s3 or unknown."""
    s = F.lower(F.regexp_extract(source_id, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when((s == "") & (source_id.startswith("/") | source_id.rlike(r"^[A-Za-z]:[\\/]")), "file").when(s == "file", "file").when(s.isin("http", "https"), "http").when(s.isin("s3", "s3a", "s3n"), "s3").otherwise("unknown")


def cache_state(cached: DataFrame, now: float) -> DataFrame:
    """Cached fetches (source_id, volatility, cached_at) with ``valid`` by their time to live."""
    ttl = F.lit(float(TTL["medium"]))
    for k, v in TTL.items():
        ttl = F.when(F.col("volatility") == k, F.lit(float(v))).otherwise(ttl)
    return cached.withColumn("valid", F.lit(now) - F.col("cached_at") <= ttl)


def revalidate(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, state): missing without a file, stale if it changed after the document was seen, unknown without a time, else fresh."""
    j = docs.select("doc_id", "source_id", "observed_at").join(files.select("source_id", "mtime"), "source_id", "left")
    state = F.when(F.col("mtime").isNull(), "missing").when(F.col("observed_at").isNull(), "unknown").when(F.col("mtime") > F.col("observed_at"), "stale").otherwise("fresh")
    return j.select("doc_id", state.alias("state"))


def vault(docs: DataFrame, path: str, since: float | None = None) -> None:
    """Documents as text files by shard folder; with ``since`` only those created after it are added."""
    rows = docs if since is None else docs.where(F.col("created_at") > since)
    page = F.concat(F.lit("# "), "source_id", F.lit("\n\n"), F.coalesce("content", F.lit("")))
    rows.select(page.alias("value"), "shard").write.mode("overwrite" if since is None else "append").partitionBy("shard").text(path)
