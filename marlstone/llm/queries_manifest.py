"""Query of the Merkle manifest, and SQL that builds and folds the same trees by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import LOWER, UPPER
from .merkle import FANOUT, FIELDS, manifest, tampered

#: Of the rows, those are verified with a changed text whose id's checksum this divides.
CHANGED_EACH = 5


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % CHANGED_EACH == 0
    return manifest(docs, changed, tampered(F.col("text"))).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _leaf(text: str) -> str:
    shown = [f"({text})" if c == "text" else f"{c}::VARCHAR" for c in FIELDS]
    return "sha256(" + " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END" for x in shown) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTEs: ``name``(grp, lv, idx, digest), all levels over ``leaves``(grp, idx, digest), and ``name``_run(grp, lv, run, ds)."""
    return f"""{name} AS (SELECT grp, 0 AS lv, idx, digest, count(*) OVER (PARTITION BY grp) AS nodes FROM {leaves}
  UNION ALL SELECT grp, lv, idx, digest, count(*) OVER (PARTITION BY grp) FROM
    (SELECT grp, lv + 1 AS lv, idx // {FANOUT} AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM {name} WHERE nodes > 1 GROUP BY grp, lv, idx // {FANOUT})),
{name}_run AS (SELECT grp, lv, idx // {FANOUT} AS run, list(digest ORDER BY idx) AS ds FROM {name} WHERE nodes > 1 GROUP BY ALL)"""


def _fold(name: str, tree: str, start: str) -> str:
    """CTEs: ``name``, the rows of ``start``(r, grp, idx, digest, proof) folded up to the top of ``tree``; ``name``_top, where they end."""
    place = f"f.idx % {FANOUT}"
    return f"""{name} AS (SELECT r, grp, 0 AS lv, idx, digest, proof FROM {start}
  UNION ALL SELECT f.r, f.grp, f.lv + 1, f.idx // {FANOUT}, sha256(array_to_string(ds[1:{place}], '') || f.digest || array_to_string(ds[{place} + 2:], '')),
    f.proof || array_to_string(ds[1:{place}], '') || array_to_string(ds[{place} + 2:], '')
    FROM {name} f JOIN {tree}_run u ON u.grp = f.grp AND u.lv = f.lv AND u.run = f.idx // {FANOUT}),
{name}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lv DESC) AS nth FROM {name}) WHERE nth = 1)"""


OP11_SQL = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS x FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END FROM bits WHERE k < 8),
tbl AS (SELECT list(x ORDER BY i) AS t FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
crc AS (SELECT doc_id, s, 0 AS k, 4294967295::BIGINT AS c FROM ids
  UNION ALL SELECT doc_id, s, k + 1, xor(c // 256, t[xor(c % 256, ascii(s[k + 1])) + 1]) FROM crc, tbl WHERE k < length(s)),
sums AS (SELECT doc_id, xor(c, 4294967295) % {CHANGED_EACH} = 0 AS changed FROM crc WHERE k = length(s)),
d AS (SELECT row_number() OVER () AS r, d.doc_id, coalesce('=' || source, '') AS grp, {_leaf('text')} AS digest,
  CASE WHEN changed THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents d LEFT JOIN sums USING (doc_id)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM d),
{_tree('low', 'leaves')},
subs AS (SELECT grp AS source, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, digest FROM low WHERE nodes = 1),
{_tree('top', 'subs')},
root AS (SELECT digest AS root FROM top WHERE nodes = 1),
start AS (SELECT r, grp, idx, coalesce(other, digest) AS digest, '' AS proof FROM leaves),
{_fold('mid', 'low', 'start')},
again AS (SELECT m.r, s.grp, s.idx, m.digest, m.proof FROM mid_top m JOIN subs s ON s.source = m.grp),
{_fold('up', 'top', 'again')}
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, root, sha256(u.proof) AS proof_sha256, u.digest AS folded_root, u.digest = root AS verified
FROM leaves l JOIN subs s ON s.source = l.grp JOIN up_top u ON u.r = l.r, root
"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE = {"op11_merkle_manifest": OP11_SQL}
