"""Queries of what happens to a document when it comes in: chunks of code, symbols, sentences, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import chunking as ck
from marlstone.operators import tagging as tg
from marlstone.plans import model as m
from marlstone.registry import query

_BLANK = r"[\x20\x09-\x0D]"


def code_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document written as code: a class a line, a function a sentence, a call a word; Python, JavaScript or a language unknown."""
    d = F.col("doc_id")
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit("([a-z]{3,})"), F.lit(1))
    name = lambda s: F.coalesce(F.try_element_at(words(s), F.lit(1)), F.lit("none"))

    def written(classes, functions, call, end, close):
        body = lambda s: F.array_join(F.transform(words(s), lambda w: F.concat(F.lit("        "), w, F.lit(call))), "")
        method = lambda s: F.concat(F.lit(f"    {functions[0]}"), name(s), F.lit(functions[1]), body(s), F.lit(end))
        lines = F.filter(F.split(F.coalesce(F.col("content"), F.lit("")), "\n"), lambda x: x != "")
        return F.array_join(F.transform(lines, lambda x: F.concat(F.lit(classes[0]), F.initcap(name(x)), F.lit(classes[1]), F.array_join(F.transform(F.split(x, r"\. "), method), ""), F.lit(close))), "")

    python = written(("class ", "(Base):\n"), ("def ", "(self, x):\n"), "(x)\n", "        return x\n", "\n")
    script = written(("class ", " extends Base {\n"), ("", "(x) {\n"), "(x);\n", "    }\n", "}\n")
    other = written(("class ", "\n"), ("def ", "\n"), "\n", "", "end\n")
    suffix = F.element_at(F.array(F.lit(".py"), F.lit(".js"), F.lit(".sh")), (d % 3 + 1).cast("int"))
    content = F.when(d % 3 == 0, python).when(d % 3 == 1, script).otherwise(other)
    return m.documents(spark, sf).select("doc_id", F.concat(F.lit("/code/note_"), d.cast("string"), suffix).alias("path"), content.alias("content"))


@query("code_chunks")
def code_chunks(spark, sf) -> DataFrame:
    """A fold over each text's lines; tested against recursion and against all ways of cutting."""
    found = ck.code_chunks(code_texts(spark, sf))
    return found.withColumn("chars", F.length("content")).withColumn("digest", F.sha2("content", 256)).drop("content")


@query("code_symbol_links")
def code_symbol_links(spark, sf) -> DataFrame:
    return ck.symbol_links(ck.code_chunks(code_texts(spark, sf)))


@query(
    "sentence_groups",
    rf"""WITH {m.DOCS}, s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(content, ''), '([.!?]){_BLANK}+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x <> '') AS found FROM d),
    g AS (SELECT doc_id, found, unnest(range(0, (len(found) + 2) // 3)) AS position FROM s)
    SELECT doc_id, position::INT AS position, len(found[position * 3 + 1:position * 3 + 3])::INT AS n, array_to_string(found[position * 3 + 1:position * 3 + 3], ' ') AS text FROM g""",
)
def sentence_groups(spark, sf) -> DataFrame:
    return ck.sentence_groups(m.documents(spark, sf))


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """(phrase, label): what the documents are searched for. Domains are words of 7 letters of the benchmark texts; entities are the nations and the first three words of each benchmark sentence."""
    texts = m.table(spark, sf, "benchmark").select("text")
    words = texts.select(F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) == 7)).alias("phrase")).select("phrase", F.lit("DOMAIN").alias("label"))
    starts = texts.select(F.explode(ck.sentences(F.col("text"))).alias("s")).select(F.slice(F.filter(F.split(F.lower("s"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), 1, 3).alias("w")).where(F.size("w") == 3)
    nations = m.table(spark, sf, "nation").select(F.lower("n_name").alias("phrase"), F.lit("GPE").alias("label"))
    return words.union(starts.select(F.array_join("w", " "), F.lit("PRODUCT"))).union(nations).distinct()


PHRASES = rf"""ph AS (SELECT DISTINCT * FROM (SELECT w AS phrase, 'DOMAIN' AS label FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS w FROM benchmark) WHERE length(w) = 7
  UNION ALL SELECT array_to_string(w[1:3], ' '), 'PRODUCT' FROM (SELECT list_filter(regexp_split_to_array(lower(s), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM
    (SELECT unnest(string_split(regexp_replace(text, '([.!?]){_BLANK}+', '\1' || chr(1), 'g'), chr(1))) AS s FROM benchmark)) WHERE len(w) >= 3
  UNION ALL SELECT lower(n_name), 'GPE' FROM nation))"""
_WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM d)"


@query(
    "phrase_hits",
    f"""WITH {m.DOCS}, {PHRASES}, {_WORDS}, k AS (SELECT phrase, label, len(string_split(phrase, ' ')) AS size FROM ph), i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
    g AS (SELECT doc_id, i, unnest([1, 3]) AS size, ws FROM i), t AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM g WHERE i + size - 1 <= len(ws))
    SELECT doc_id, t.phrase, label, count(*) AS n, min(i - 1)::INT AS first FROM t JOIN k ON k.phrase = t.phrase AND k.size = t.size GROUP BY ALL""",
)
def phrase_hits(spark, sf) -> DataFrame:
    """Nation names of two words (none three) have a size of their own in the operator; the SQL looks at one and three words, see ``phrases``."""
    found = phrases(spark, sf).where("size(split(phrase, ' ')) <> 2")
    return tg.phrase_hits(m.documents(spark, sf), found)


@query("document_tags")
def document_tags(spark, sf) -> DataFrame:
    """Sentences ranked by what they hold; tested against a plain loop over each document."""
    return tg.tag(m.documents(spark, sf).withColumn("path", F.col("source_id")), phrases(spark, sf))
