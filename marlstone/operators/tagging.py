"""Tags of documents: phrases of a dictionary, identifiers, key sentences, intent.

The dictionary is a table. Up to ``MOST_PHRASES`` rows, counted first, it is sent to the workers once,
and each makes an automaton of it that finds all phrases in one pass over a text. A larger dictionary is
joined to the runs of words of the texts instead, so it may be of any size. Both find the same: a
phrase is words in a row, told apart by anything but letters and digits, whatever their case.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators.chunking import sentences
from marlstone.operators.graph import checkpointed

MOST_PHRASES = 200_000
#: Tags that a document keeps: domains, entities, key sentences (fixed values).
DOMAINS, ENTITIES, KEY_SENTENCES = 10, 15, 3
#: Label of the phrases that are domains; all others are entities.
DOMAIN = "DOMAIN"
CAMEL = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"
#: Kinds of intent in the order in which they are tried: a pattern on the text as it stands, or words in lower case (fixed values).
INTENTS = (
    ("config_knob", r'(?i)\b\w+\s*[=:]\s*(true|false|\d[\d.]*|"[^"]*")', "threshold timeout limit enabled config setting flag default".split()),
    ("data_structure", r"(?i)\bcreate\s+table\b|\bschema\b|\bcolumn\b|\bindex\b", ()),
    ("trigger_condition", None, ("when ", "if ", "trigger", "gate condition", "condition", "fires when")),
    ("process_step", None, ("step ", "pipeline", "then ", "followed by", "sequence")),
    ("mechanism", None, ("how ", "computes", "calculates", "works by", "operates")),
    ("fact", r"\b\d+\b", (" is ", " are ", " has ", "= ")),
    ("relationship", None, ("depends on", "calls ", "implements", "inherits", "extends", "wraps", "delegates to")),
)

_AUTOMATON: dict[str, ahocorasick.Automaton] = {}


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Finds each phrase, given as its place in the list, where spaces stand around it."""
    out = ahocorasick.Automaton()
    for i, x in enumerate(phrases):
        out.add_word(f" {x} ", (i, len(x) + 2))
    if phrases:
        out.make_automaton()
    return out


def _found(words: str, machine: ahocorasick.Automaton) -> dict[int, list[int]]:
    """Of each phrase in a text (words between single spaces, one space at either end): how often, and before which word first."""
    hits: dict[int, list[int]] = {}
    for end, (i, size) in machine.iter(words):
        hits.setdefault(i, [0, end - size + 1])[0] += 1
    for x in hits.values():
        x[1] = words.count(" ", 0, x[1])
    return hits


def phrase_hits(docs: DataFrame, phrases: DataFrame, keys: tuple[str, ...] = ("doc_id",), most_phrases: int = MOST_PHRASES) -> DataFrame:
    """(keys, phrase, label, n, first): which of ``phrases(phrase, label)`` each text of ``docs(keys, content)`` holds, how often, and after how many words first.

    A phrase is given in its words' form: lower case, single spaces. A phrase of several labels gives a
    row each; occurrences may overlap. Null texts and phrases without a word hold nothing.
    """
    known = checkpointed(phrases.where("phrase <> ''").distinct())
    words = fx.tokens(F.col("content"))
    if known.limit(most_phrases + 1).count() > most_phrases:
        found = _joined(docs.select(*keys, words.alias("ws")), known, keys)
    else:
        rows = sorted({r.phrase for r in known.select("phrase").collect()})
        shared, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if key not in _AUTOMATON:
                _AUTOMATON.clear()
                _AUTOMATON[key] = automaton(shared.value)
            machine, names = _AUTOMATON[key], shared.value
            for batch in batches if names else ():
                at, out = [], []
                for k, x in enumerate(batch.column("words")):
                    for i, (n, first) in _found(x.as_py(), machine).items():
                        at.append(k)
                        out.append((names[i], n, first))
                if out:
                    columns = [batch.column(c).take(pa.array(at)) for c in keys]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32()), strict=True))], names=[*keys, "phrase", "n", "first"])

        kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
        text = F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).otherwise(F.lit(""))
        found = docs.select(*keys, text.alias("words")).mapInArrow(run, f"{kinds}, phrase string, n long, first int")
    return found.join(known, "phrase").select(*keys, "phrase", "label", "n", "first")


def _joined(docs: DataFrame, known: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Hits by a join of the texts' runs of words, of each length that a phrase has, with the phrases."""
    sizes = [r[0] for r in known.select(F.size(F.split("phrase", " "))).distinct().collect()]
    out = None
    for size in sizes:
        runs = F.transform(F.sequence(F.lit(0), F.size("ws") - size), lambda i: F.struct(i.alias("first"), F.array_join(F.slice("ws", i + 1, F.lit(size)), " ").alias("phrase")))  # noqa: B023
        own = docs.where(F.size("ws") >= size).select(*keys, F.explode(runs).alias("x")).groupBy(*keys, "x.phrase").agg(F.count("*").alias("n"), F.min("x.first").alias("first"))
        out = own if out is None else out.union(own)
    return out.join(known.select("phrase").distinct(), "phrase", "left_semi").select(*keys, "phrase", "n", "first")


def intent_class(text: Column) -> Column:
    """The first kind of intent whose pattern or words are in the text; a fact needs both a number and a word."""
    lower, out = F.lower(text), None
    for name, pattern, words in INTENTS:
        by_word = F.lit(False)
        for w in words:
            by_word |= F.contains(lower, F.lit(w))
        by_pattern = F.regexp_like(text, F.lit(pattern)) if pattern else None
        holds = by_word if by_pattern is None else (by_pattern & by_word) if name == "fact" else (by_pattern | by_word)
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise("unknown")


def path_domains(path: Column) -> Column:
    """Stem of the file's name and its parts, then the folder's name and its parts: more than two characters, none that says nothing."""
    parts = F.filter(F.split(F.translate(F.lower(F.coalesce(path, F.lit(""))), "\\", "/"), "/"), lambda p: p != "")
    folder = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    stem = F.when(F.coalesce(path, F.lit("")).rlike(r"\.[^./\\]+$"), fx.filename_stem(path)).otherwise(F.lit(""))
    every = F.flatten(F.array(*(F.concat(F.array(x), F.split(x, r"[_\-]+")) for x in (stem, folder))))
    return F.array_distinct(F.filter(every, lambda t: (F.length(t) > 2) & ~t.isin(*fx.PATH_NOISE)))


def tag(docs: DataFrame, phrases: DataFrame, most_phrases: int = MOST_PHRASES) -> DataFrame:
    """``doc_id``, ``domains``, ``entities``, ``intent``, ``intent_class``, ``summary`` and ``complement`` of ``docs(doc_id, path, content)``.

    Domains: of the path, then phrases of label ``DOMAIN`` by how often they occur (ties by phrase). Entities:
    other phrases as they occur, then identifiers in camel case; each once whatever its case. A sentence
    weighs 2 for each entity in it, 1.5 for each number, 1 for each identifier, .5 for over 50 characters:
    the complement is the three that weigh most of those of 15 characters or more, the summary the first one with
    most entities, the intent the first one; short or missing ones are replaced by the start of the text.
    All texts are read whole. A null text is an empty one.
    """
    texts = docs.select("doc_id", "path", F.coalesce("content", F.lit("")).alias("content"))
    said = checkpointed(texts.select("doc_id", F.posexplode(sentences(F.col("content"))).alias("pos", "content")))
    hits = checkpointed(phrase_hits(said, phrases, ("doc_id", "pos"), most_phrases))
    is_domain = F.col("label") == DOMAIN
    used = hits.where(is_domain).groupBy("doc_id", "phrase").agg(F.sum("n").alias("n"))
    domains = used.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "phrase"))), lambda x: x["phrase"]).alias("by_use"))
    camel = said.select("doc_id", F.lit(1).alias("last"), "pos", F.posexplode(F.regexp_extract_all("content", F.lit(CAMEL), F.lit(1))).alias("first", "name"))
    named = hits.where(~is_domain).select("doc_id", F.lit(0).alias("last"), "pos", "first", F.col("phrase").alias("name")).union(camel)
    first = named.groupBy("doc_id", F.lower("name").alias("key")).agg(F.min(F.struct("last", "pos", "first", "name")).alias("x"))
    entities = first.groupBy("doc_id").agg(F.transform(F.slice(F.sort_array(F.collect_list("x")), 1, ENTITIES), lambda x: x["name"]).alias("entities"))
    held = hits.where(~is_domain).groupBy("doc_id", "pos").agg(F.sum("n").alias("held"))
    weighed = said.join(held, ["doc_id", "pos"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    numbers, names = F.regexp_count("content", F.lit(r"\d+(?:\.\d+)?")), F.regexp_count("content", F.lit(r"\b[A-Z][a-z]+[A-Z]\w*\b"))
    weight = F.col("held") * 2.0 + numbers * 1.5 + names * 1.0 + F.when(F.length("content") > 50, 0.5).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "pos"))
    key = weighed.where(F.length("content") >= 15).withColumn("weight", weight).withColumn("place", place).where(F.col("place") <= KEY_SENTENCES)
    key = key.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), " ").alias("complement"))
    tops = weighed.groupBy("doc_id").agg(F.max_by("content", F.struct("held", -F.col("pos"))).alias("top"), F.min_by("content", "pos").alias("start"))
    out = texts
    for other in (domains, entities, key, tops):
        out = out.join(other, "doc_id", "left")
    none = F.array().cast("array<string>")
    lead = F.trim(F.substring("content", 1, 100))
    intent = F.when(F.length("start") > 10, F.substring("start", 1, 200)).otherwise(lead)
    summary = F.when(F.length("top") > 10, F.substring("top", 1, 200)).otherwise(F.coalesce(F.substring("start", 1, 200), lead))
    every = F.slice(F.array_distinct(F.concat(path_domains(F.col("path")), F.coalesce("by_use", none))), 1, DOMAINS)
    out = out.select("doc_id", every.alias("domains"), F.coalesce("entities", none).alias("entities"), intent.alias("intent"), summary.alias("summary"), F.coalesce("complement", F.substring("content", 1, 500)).alias("complement"))
    return out.withColumn("intent_class", intent_class(F.col("intent")))
