"""Writes as new table states: upserts, merges, deletes, diffs, sweeps. Tables are immutable; each
operator returns the next state of a table (or a report), to be written with the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``table`` with ``rows`` put in by key; of several rows of a key the last by ``order`` wins, new over old."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def snapshot_merge(table: DataFrame, snapshot: DataFrame, strategy: str) -> DataFrame:
    """(doc_id, content, last_accessed) of a store after importing a snapshot with content hashes.

    Rows whose hash doesn't match are left out. ``skip_existing`` keeps the store's row, ``overwrite``
    the snapshot's, ``newest`` the later accessed one (the store's on ties). Adds ``outcome``.
    """
    good = snapshot.where(F.sha2(F.col("content"), 256) == F.col("content_hash")).select("doc_id", F.col("content").alias("c2"), F.col("last_accessed").alias("t2"))
    j = table.join(good, "doc_id", "full_outer")
    fresh = F.col("last_accessed").isNull()
    take = {"skip_existing": fresh, "overwrite": F.col("t2").isNotNull(), "newest": fresh | (F.col("t2") > F.col("last_accessed"))}[strategy]
    take = F.coalesce(take, F.lit(False))
    outcome = F.when(take & fresh, "added").when(take, "replaced").when(F.col("t2").isNotNull(), "skipped").otherwise("kept")
    return j.select("doc_id", F.when(take, F.col("c2")).otherwise(F.col("content")).alias("content"), F.when(take, F.col("t2")).otherwise(F.col("last_accessed")).alias("last_accessed"), outcome.alias("outcome"))


def snapshot_diff(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many keys both have, only the left has, only the right has."""
    j = left.select(key, F.lit(1).alias("l")).distinct().join(right.select(key, F.lit(1).alias("r")).distinct(), key, "full_outer")
    return j.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def merge_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (a, b, weight) with new weights in place of old ones."""
    n = new.select("a", "b", F.col("weight").alias("w2"))
    return edges.join(n, ["a", "b"], "full_outer").select("a", "b", F.coalesce("w2", "weight").alias("weight"))


def delete_cascade(gone: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that touch none of the ids ``gone(doc_id)``."""
    return edges.join(gone.select(F.col("doc_id").alias("a")), "a", "left_anti").join(gone.select(F.col("doc_id").alias("b")), "b", "left_anti").select(edges.columns)


def orphans(index: DataFrame, docs: DataFrame) -> DataFrame:
    """Index rows whose document is gone."""
    return index.join(docs.select("doc_id"), "doc_id", "left_anti")


def symbol_edges(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct edges (a, b) from a chunk that names a symbol to the chunk of the same source that defines it."""
    d, r = defs.select("source_id", "symbol", F.col("doc_id").alias("b")), refs.select("source_id", "symbol", F.col("doc_id").alias("a"))
    return r.join(d, ["source_id", "symbol"]).where("a <> b").select("a", "b").distinct()


def touched(docs: DataFrame, accesses: DataFrame, keep: int = 100) -> DataFrame:
    """Usage signals after an access log: count, last access, decay (+.1 each, 1 at most), the last ``keep`` times, lifecycle open."""
    a = accesses.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("ts"))  # cut before the shuffle, then gathered: ``keep`` rows a document at most
    latest = accesses.select("doc_id", "ts").withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= keep)
    j = docs.join(a, "doc_id", "left").join(latest.groupBy("doc_id").agg(F.sort_array(F.collect_list("ts"), False).alias("recent")), "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    return j.select("doc_id", (F.col("access_count") + n).alias("access_count"), F.col("last").alias("last_accessed"), fx.round6(F.least(F.lit(1.0), F.col("decay") + 0.1 * n)).alias("decay"), F.size(F.coalesce("recent", F.array().cast("array<double>"))).alias("recent"), F.when(n > 0, 0).otherwise(F.col("lifecycle")).alias("lifecycle"))


def store_stats(docs: DataFrame) -> DataFrame:
    """Documents by lifecycle, characters and their share."""
    g = docs.groupBy("lifecycle").agg(F.count("*").alias("documents"), F.sum(F.length("content")).alias("chars"), F.count_if(F.length("content") == 0).alias("empty"))
    total = F.sum("chars").over(Window.partitionBy(F.lit(1)))
    return g.select("lifecycle", "documents", "chars", "empty", fx.round6(F.col("chars") / total).alias("share"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """(parent, chunks, text) of chunks (parent, sequence, content) in order; a parent is one document."""
    ordered = F.array_sort(F.collect_list(F.struct("sequence", "content")))
    return chunks.groupBy("parent").agg(F.count("*").alias("chunks"), F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n").alias("text"))


def chunk_paragraphs(docs: DataFrame, most: int = 4000) -> DataFrame:
    """(doc_id, sequence, content, hard_cut): paragraphs gathered up to ``most`` characters; longer ones are cut.

    A document's pieces are folded in order inside its row, so chunking needs no shuffle.
    """
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.struct(F.substring(p, k * most + 1, F.lit(most)).alias("t"), (F.length(p) > most).alias("h")))
    paragraphs = F.filter(F.split(F.coalesce("content", F.lit("")), r"\n\s*\n|\n"), lambda p: F.trim(p) != "")
    pieces = F.flatten(F.transform(paragraphs, cut))
    empty = F.array().cast("array<struct<t:string,h:boolean>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & ~last["h"] & ~x["h"] & (F.length(last["t"]) + F.length(x["t"]) + 2 <= most)
        joined = F.struct(F.concat(last["t"], F.lit("\n\n"), x["t"]).alias("t"), F.lit(False).alias("h"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return docs.select("doc_id", F.posexplode(F.aggregate(pieces, empty, step)).alias("sequence", "c")).select("doc_id", "sequence", F.col("c.t").alias("content"), F.col("c.h").alias("hard_cut"))


def pack_budget(rows: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """Greedy packing in rank order: a document is taken if it still fits (``size``), else passed over. A fold over one query's candidates."""
    items = F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.col("size").cast("long").alias("size"))))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<doc_id:bigint,used:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + x["size"]
        one = F.array(F.struct(x["doc_id"].alias("doc_id"), used.alias("used")))
        return F.when(used <= budget, F.struct(used.alias("used"), F.concat(acc["out"], one).alias("out"))).otherwise(acc)

    folded = rows.groupBy(by).agg(items.alias("items")).select(by, F.aggregate("items", state, step, lambda a: a["out"]).alias("o"))
    return folded.select(by, F.posexplode("o").alias("i", "x")).select(by, F.col("x.doc_id").alias("doc_id"), F.col("x.used").alias("used"), (F.col("i") + 1).alias("position"))


def claims(docs: DataFrame) -> DataFrame:
    """(claim_id, doc_id, claim_type, entity_key, claim_text) found in contents: URLs, e-mail addresses, IP addresses, long numbers."""
    kinds = (("url", r"(https?://[^\s<>\"']+)"), ("email", r"([A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,})"), ("ip", r"(\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b)"), ("number", r"(\b\d{12,19}\b)"))
    found = F.array(*(F.struct(F.lit(k).alias("claim_type"), F.array_distinct(F.regexp_extract_all("content", F.lit(p), F.lit(1))).alias("keys")) for k, p in kinds))
    rows = docs.select("doc_id", F.inline(found)).select("doc_id", "claim_type", F.explode("keys").alias("entity_key"))
    text = F.concat_ws(" ", "claim_type", F.lower("entity_key"))
    return rows.select(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "claim_type", "entity_key").cast("binary")), 1, 16).alias("claim_id"), "doc_id", "claim_type", "entity_key", text.alias("claim_text"))


# What is a literal claim in a line of code, configuration, notes or results.
DEFINITION = r"^\s*(?:def|class|async\s+def)\s+([A-Za-z_]\w*)\s*[\(:]"
CONSTANT = r"^([A-Z][A-Z0-9_]{2,})\s*=\s*([^\n]+)$"
HEADER = r"^(#{1,2})\s+([^\n]+)$"
PORT = r"(?i)\bport[\s:=]+(\d{2,5})\b"
PAIR = r"^\s*([A-Za-z_][\w.-]*)\s*[:=]\s*(.+?)\s*$"
LONGEST, LONGEST_RESULT = 200, 120


def literal_claims(docs: DataFrame) -> DataFrame:
    """(claim_id, doc_id, claim_type, entity_key, claim_text, specificity, confidence) stated in so many words.

    ``docs(doc_id, content, source_kind, source_id, key_values)``. Every document's key values give
    config values. Code gives its definitions and constants, config its unindented pairs, benchmark
    the pairs whose value holds a digit, doc its headers of the first two levels and ports. Equal
    claims of a document count once; the id is a hash of what is claimed.
    """
    claim = lambda kind, key, text, specificity, confidence: F.struct(kind.alias("claim_type") if isinstance(kind, Column) else F.lit(kind).alias("claim_type"), key.alias("entity_key"), text.alias("claim_text"), F.lit(specificity).alias("specificity"), F.lit(confidence).alias("confidence"))
    part = lambda x, pattern, k: F.regexp_extract(x, pattern, k)
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    none = F.lit(None).cast("struct<claim_type:string,entity_key:string,claim_text:string,specificity:double,confidence:double>")

    def pair(x: Column, kind: str, longest: int, confidence: float, value: Column | None = None) -> Column:
        value = F.trim(part(x, PAIR, 2)) if value is None else value
        text = F.concat(part(x, PAIR, 1), F.lit(" = "), value)
        return F.when(x.rlike(PAIR) & (value != "") & (F.length(value) <= longest), claim(kind, part(x, PAIR, 1), text, 1.0, confidence)).otherwise(none)

    def of_code(x: Column) -> Column:
        name, value = part(x, CONSTANT, 1), F.trim(part(x, CONSTANT, 2))
        where = F.concat(part(x, DEFINITION, 1), F.lit(" defined in "), F.coalesce("source_id", F.col("doc_id").cast("string")))
        defined = claim("api_contract", part(x, DEFINITION, 1), where, 0.9, 0.95)
        constant = F.when(x.rlike(CONSTANT) & (F.length(value) <= LONGEST), claim("config_value", name, F.concat(name, F.lit(" = "), value), 1.0, 0.95))
        return F.when(x.rlike(DEFINITION), defined).otherwise(F.coalesce(constant, none))

    def of_config(x: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(F.trim(part(x, PAIR, 2)), r'^"+|"+$', ""), r"^'+|'+$", "")
        return F.when(~x.rlike(r"^[ \t#;]"), pair(x, "config_value", LONGEST, 0.95, value)).otherwise(none)

    def of_doc(x: Column) -> Column:
        title = F.trim(part(x, HEADER, 2))
        return F.when(x.rlike(HEADER) & (F.length(title) <= LONGEST), claim("operational_state", F.substring(title, 1, 64), F.concat(F.lit("section: "), title), 0.7, 0.8)).otherwise(none)

    kind = F.col("source_kind")
    ports = F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(PORT), F.lit(1)), lambda p: claim("path_value", F.concat(F.lit("port:"), p), F.concat(F.lit("port "), p), 1.0, 0.9))
    result = lambda x: F.when(part(x, PAIR, 2).rlike(r"\d"), pair(x, "benchmark_result", LONGEST_RESULT, 0.9)).otherwise(none)
    stated = F.when(kind == "code", F.transform(lines, of_code)).when(kind == "config", F.transform(lines, of_config)).when(kind == "doc", F.concat(F.transform(lines, of_doc), ports)).when(kind == "benchmark", F.transform(lines, result))
    known = F.transform(F.coalesce("key_values", F.array().cast("array<string>")), lambda x: pair(x, "config_value", 1 << 30, 0.95))
    every = F.filter(F.concat(known, F.coalesce(stated, F.array().cast("array<struct<claim_type:string,entity_key:string,claim_text:string,specificity:double,confidence:double>>"))), lambda c: c.isNotNull())
    rows = docs.select("doc_id", F.inline(F.array_distinct(every)))
    mark = F.concat_ws("|", F.col("doc_id").cast("string"), "claim_type", "entity_key", "claim_text")
    rows = rows.select(F.substring(F.sha1(mark.cast("binary")), 1, 16).alias("claim_id"), "doc_id", "claim_type", "entity_key", "claim_text", "specificity", "confidence")
    return rows.dropDuplicates(["claim_id"])


def entity_keys(text: Column) -> Column:
    """What a claim is about: file paths, URLs, ports, names in capitals, and the key of a pair, in that order, each once."""
    find = lambda pattern, k=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    paths = find(r"((?:[A-Za-z]:[\\/])?(?:[\w./\\-]+[\\/])+[\w./\\-]+\.[A-Za-z][A-Za-z0-9]{0,5})")
    ports = F.transform(find(PORT, 1), lambda p: F.concat(F.lit("port:"), p))
    key = F.when(text.rlike(PAIR), F.array(F.regexp_extract(text, PAIR, 1))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(paths, find(r"(?i)(\bhttps?://[\w.\-/:]+)"), ports, find(r"\b([A-Z][A-Z0-9_]{3,})\b"), key))


def claim_edges(rows: DataFrame, same: float = 0.8, different: float = 0.3, most: int = 50) -> DataFrame:
    """Edges of claims of one entity key in different documents: supersedes / duplicates from Jaccard ``same`` on, contradicts up to ``different``.

    Keys with more than ``most`` claims are noise by the operator's definition and give no edge.
    """
    ok = rows.groupBy("entity_key").count().where((F.col("count") > 1) & (F.col("count") <= most)).select("entity_key")
    r = rows.join(ok, "entity_key", "left_semi").withColumn("w", F.array_distinct(fx.tokens(F.col("claim_text"))))
    x = r.select("entity_key", F.col("claim_id").alias("a"), F.col("doc_id").alias("da"), F.col("w").alias("wa"), F.col("observed_at").alias("ta"))
    y = r.select("entity_key", F.col("claim_id").alias("b"), F.col("doc_id").alias("db"), F.col("w").alias("wb"), F.col("observed_at").alias("tb"))
    j = x.join(y, "entity_key").where("a < b AND da <> db")
    sim = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    kind = F.when(F.col("similarity") >= same, F.when(F.col("ta") != F.col("tb"), "supersedes").otherwise("duplicates")).when(F.col("similarity") <= different, "contradicts")
    return j.withColumn("similarity", fx.round6(sim)).withColumn("edge_type", kind).where("edge_type IS NOT NULL").select("a", "b", "entity_key", "edge_type", "similarity")
