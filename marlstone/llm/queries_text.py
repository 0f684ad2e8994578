"""Queries and oracle SQL of the operators on text columns: exact dedup, quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import LOWER, UPPER, exact_dedup, normalised
from .quality_rules import BOILERPLATE, ENDS, MARKED, quality_rules


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(normalised(), 256).alias("text_sha256"))
    return exact_dedup(docs, digest="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""

OP8_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS h FROM win)),
spans AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS r FROM spans GROUP BY doc_id),
lines AS (SELECT doc_id, i, a[i] AS l FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS a FROM w))),
m AS (SELECT doc_id, i, l, length(l) AS chars, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
  length(l) - length(regexp_replace(l, '[#*$%&|<>~^_=+]+', '', 'g')) AS sym,
  length(l) - length(regexp_replace(l, '[|>»•·]+', '', 'g')) AS pipes,
  length(regexp_replace(l, '\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(l, '\P{{Lu}}+', '', 'g')) AS up,
  len(regexp_extract_all(l, '{BOILERPLATE}')) AS phrases, regexp_matches(l, '{MARKED.replace(chr(39), chr(39) * 2)}') AS marked,
  len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words, regexp_split_to_array(l, '[\x20\x09-\x0D]+') AS lw FROM lines),
item AS (SELECT *, solid > 0 AND words <= 4 AND NOT contains('{ENDS.replace(chr(39), chr(39) * 2)}', right(regexp_replace(l, '[\x20\x09-\x0D]+$', ''), 1)) AS item FROM m),
menu AS (SELECT *, item AND ((lag(item, 1, false) OVER o AND lag(item, 2, false) OVER o) OR (lag(item, 1, false) OVER o AND lead(item, 1, false) OVER o)
  OR (lead(item, 1, false) OVER o AND lead(item, 2, false) OVER o)) AS menu FROM item WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, solid, sym * 20 > chars OR pipes * 40 > chars OR (up * 2 > letters AND letters >= 12) OR (letters * 2 < chars AND chars >= 12)
  OR (phrases > 0 AND phrases * 200 >= chars) OR (len(lw) >= 8 AND len(list_distinct(lw)) * 4 < len(lw)) OR (len(lw) >= 25 AND NOT marked) OR menu AS bad FROM menu WHERE solid > 0),
s AS (SELECT doc_id, sum(solid) AS solid, coalesce(sum(solid) FILTER (WHERE NOT bad), 0) AS good FROM f GROUP BY doc_id),
d AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup FROM m WHERE solid > 0 GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(good, 0) AS good FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN d USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN word_chars = 0 THEN 1.0 ELSE 1 - good::DOUBLE / word_chars END <= 0.5 AS kept FROM b
"""

QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op8_quality_rules": op8_quality_rules}
ORACLE = {"op1_exact_dedup": OP1_SQL, "op8_quality_rules": OP8_SQL}
