"""Queries over web pages: main text by wrappers, URL filters by dated lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .url_filters import filter_urls, list_entries_of, registrable
from .wrappers import main_text


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def _captures(pages: DataFrame) -> DataFrame:
    """Every page as a capture: fetched on a day of 2024 that follows from its id (the tables hold no dates)."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', int(pmod(page_id * 37, 366)))").alias("fetched"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(_captures(pages), list_entries_of(pages)).select("page_id", "url", "fetched", "blocked", "matched_entry", "matched_kind", "active_from")


OP9_SQL = f"""
WITH p AS (SELECT page_id, url, lower(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
  DATE '2024-01-01' + ((page_id * 37) % 366)::INT AS fetched FROM pages),
{list_entries_of.sql},
iv AS (SELECT kind, entry, day AS since, lead(day) OVER (PARTITION BY kind, entry ORDER BY day) AS until, action FROM
  (SELECT kind, entry, day, max(action) AS action FROM entries GROUP BY kind, entry, day)),
live AS (SELECT * FROM iv WHERE action = 'block'),
hits AS (
  SELECT page_id, 1 AS ord, 'host' AS kind, entry, since FROM p JOIN live ON kind = 'host' AND entry = host AND since <= fetched AND (until IS NULL OR fetched < until)
  UNION ALL SELECT page_id, 2, 'domain', entry, since FROM p JOIN live ON kind = 'domain' AND entry = {registrable.sql} AND since <= fetched AND (until IS NULL OR fetched < until)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS r FROM hits)
SELECT p.page_id, p.url, p.fetched, r IS NOT NULL AS blocked, entry AS matched_entry, kind AS matched_kind, since AS active_from FROM p LEFT JOIN best ON p.page_id = best.page_id AND r = 1
"""

QUERIES = {"op4_html_extraction": op4_html_extraction, "op9_url_filters": op9_url_filters}
ORACLE = {"op9_url_filters": OP9_SQL}
