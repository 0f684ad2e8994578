"""Query of the rolling median, and SQL that joins every click to its window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .rolling_median import rolling_median


def op13_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_median(table(spark, sf_dir, "clicks"))


OP13_SQL = """
WITH c AS (SELECT click_id, ts, kind, floor(100 * value + 0.5)::BIGINT AS cents FROM clicks WHERE ts IS NOT NULL),
o AS (SELECT click_id, ts, kind, cents, coalesce('=' || kind, '') AS series FROM
  (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY ts, kind NULLS FIRST, cents NULLS FIRST) AS nth FROM c) WHERE nth = 1),
w AS (SELECT o.click_id, list(p.cents ORDER BY p.cents) AS vs FROM o JOIN o p ON p.series = o.series AND p.ts > o.ts - INTERVAL 60 MINUTE AND p.ts <= o.ts WHERE p.cents IS NOT NULL GROUP BY o.click_id),
m AS (SELECT click_id, vs, len(vs)::BIGINT AS n, CASE WHEN len(vs) >= 2 THEN vs[(len(vs) + 1) // 2] + vs[len(vs) // 2 + 1] END AS median2 FROM w),
d AS (SELECT click_id, n, median2, list_sort(list_transform(vs, lambda x: abs(2 * x - median2))) AS ds FROM m)
SELECT o.click_id, o.kind, coalesce(n, 0) AS n, median2, CASE WHEN n >= 2 THEN ds[(n + 1) // 2] + ds[n // 2 + 1] END AS mad4,
  CASE WHEN n >= 2 THEN 2 * abs(2 * cents - median2) > 3 * (ds[(n + 1) // 2] + ds[n // 2 + 1]) END AS far FROM o LEFT JOIN d ON d.click_id = o.click_id
"""

QUERIES = {"op13_rolling_median": op13_rolling_median}
ORACLE = {"op13_rolling_median": OP13_SQL}
