"""URL filters by a temporal list join.

A list is a stream of dated entries: on a day, a host or a registrable domain is added ('block') or
taken off ('release'). Entries become validity intervals: each holds from its day to the day of the
next entry for the same name. Every capture is then held against the intervals that contain its fetch
day: an as-of join.

Intervals of one name don't overlap, so all of a name's intervals fold into one row that holds them
sorted by day, and the as-of step picks the last one that began: one equi-join by name, no range
join. Captures join by host and by domain, host first. The list side has one row a name: it is
broadcast when its size is checked to be small, else the join is a sort-merge join whose hot names
(a host may hold a third of all captures) adaptive execution splits, the list side being one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, unused, written
from .wrappers import host_of

#: Entries a list may have in its broadcast.
BROADCAST_NAMES = 50_000


#: Public suffixes of two labels (fixed values); a name registered below one has three labels.
SUFFIXES = tuple("ac.uk co.uk gov.uk org.uk com.au net.au org.au co.jp ne.jp or.jp co.nz com.br com.cn co.in co.kr co.za com.mx com.tr com.tw com.ar".split())


def _registrable(suffixes: tuple[str, ...]) -> str:
    """Pattern of the registrable domain: a public suffix of two labels, else the last label, and the label before it."""
    return r"([^.]+\.(?:" + "|".join([*(x.replace(".", r"\.") for x in suffixes), "[^.]+"]) + "))$"


def registrable(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The domain that was registered: two labels, or three where the last two are a public suffix."""
    return F.regexp_extract(host, _registrable(suffixes), 1)


registrable.sql = f"regexp_extract(host, '{_registrable(SUFFIXES)}', 1)"


def list_entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages`` (the tables hold none): (kind, entry, day, action).

    From the md5 of the name: about half of the hosts are added on some day, half of those are
    released later, and some of these added again; about half of the registrable domains are added.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct().where("host <> ''")
    digit = lambda c, k: F.conv(F.substring(F.md5(c.cast("binary")), k, 2), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    h, d = F.col("host"), F.col("domain")
    first, second, third = digit(h, 3) % 120, digit(h, 3) % 120 + 30 + digit(h, 5) % 90, digit(h, 3) % 120 + 150 + digit(h, 7) % 60
    of_hosts = hosts.where(digit(h, 1) % 2 == 0).select(
        h.alias("entry"),
        F.explode(F.array(F.struct(day(first).alias("day"), F.lit("block").alias("action")), F.when(digit(h, 9) % 2 == 0, F.struct(day(second).alias("day"), F.lit("release").alias("action"))), F.when(digit(h, 9) % 4 == 0, F.struct(day(third).alias("day"), F.lit("block").alias("action"))))).alias("e"),
    ).where("e IS NOT NULL")
    domains = hosts.select(registrable(h).alias("domain")).distinct().where("domain <> ''")
    of_domains = domains.where(digit(d, 1) % 2 == 0).select(d.alias("entry"), F.struct(day(200 + digit(d, 3) % 60).alias("day"), F.lit("block").alias("action")).alias("e"))
    return of_hosts.select(F.lit("host").alias("kind"), "entry", "e.*").union(of_domains.select(F.lit("domain").alias("kind"), "entry", "e.*"))


list_entries_of.sql = rf"""h AS (SELECT DISTINCT host FROM p WHERE host <> ''),
hd AS (SELECT host, ('0x' || md5(host)[1:2])::INT AS d1, ('0x' || md5(host)[3:4])::INT AS d3, ('0x' || md5(host)[5:6])::INT AS d5, ('0x' || md5(host)[7:8])::INT AS d7, ('0x' || md5(host)[9:10])::INT AS d9 FROM h),
dd AS (SELECT DISTINCT {registrable.sql} AS domain FROM h WHERE {registrable.sql} <> ''),
entries AS (
  SELECT 'host' AS kind, host AS entry, DATE '2024-01-01' + d3 % 120 AS day, 'block' AS action FROM hd WHERE d1 % 2 = 0
  UNION ALL SELECT 'host', host, DATE '2024-01-01' + d3 % 120 + 30 + d5 % 90, 'release' FROM hd WHERE d1 % 2 = 0 AND d9 % 2 = 0
  UNION ALL SELECT 'host', host, DATE '2024-01-01' + d3 % 120 + 150 + d7 % 60, 'block' FROM hd WHERE d1 % 2 = 0 AND d9 % 4 = 0
  UNION ALL SELECT 'domain', domain, DATE '2024-01-01' + 200 + ('0x' || md5(domain)[3:4])::INT % 60, 'block' FROM dd WHERE ('0x' || md5(domain)[1:2])::INT % 2 = 0)"""


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (kind, entry, since, until, action); ``until`` is exclusive, null while it lasts.

    Entries without a name or day are left out. Of entries of one name and day with different
    actions, 'release' counts.
    """
    once = entries.where("entry IS NOT NULL AND entry <> '' AND day IS NOT NULL AND kind IN ('host', 'domain')").groupBy("kind", "entry", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("kind", "entry").orderBy("day")
    return once.select("kind", "entry", F.col("day").alias("since"), F.lead("day").over(w).alias("until"), "action")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``captures`` with ``blocked``, ``matched_entry``, ``matched_kind``, ``active_from``.

    A capture is blocked if an interval of action 'block' of its host, or else of its registrable
    domain, contains its fetch day (first day included, last excluded). Null or odd urls, null days
    and an empty list block nothing, and a url of any length is read whole. Repeated captures are
    judged one by one; columns named like a result column are replaced, others pass through.
    """
    names = intervals(entries).where("action = 'block'").groupBy("kind", "entry").agg(F.array_sort(F.collect_list(F.struct("since", "until"))).alias("spans"))
    rest = [c for c in captures.columns if c not in ("blocked", "matched_entry", "matched_kind", "active_from")]
    host, domain, host_spans, domain_spans, by_host, by_domain, day = unused(captures, "host", "domain", "host_spans", "domain_spans", "by_host", "by_domain", "day")
    rows = captures.select(*rest, F.col(fetched).alias(day), host_of(F.col(url)).alias(host)).withColumn(domain, registrable(F.col(host), suffixes))
    side = small(written(names, "names"), BROADCAST_NAMES)
    for kind, name, spans in (("host", host, host_spans), ("domain", domain, domain_spans)):
        rows = rows.join(side.where(F.col("kind") == kind).select(F.col("entry").alias(name), F.col("spans").alias(spans)), name, "left")

    def asof(spans: Column) -> Column:
        last = F.try_element_at(F.filter(spans, lambda s: s["since"] <= F.col(day)), F.lit(-1))
        return F.when(last["until"].isNull() | (F.col(day) < last["until"]), last["since"])

    since_host, since_domain = F.col(by_host).isNotNull(), F.col(by_domain).isNotNull()
    return rows.select(*rest, host, domain, asof(F.col(host_spans)).alias(by_host), asof(F.col(domain_spans)).alias(by_domain)).select(
        *rest, (since_host | since_domain).alias("blocked"), F.when(since_host, F.col(host)).when(since_domain, F.col(domain)).alias("matched_entry"),
        F.when(since_host, "host").when(since_domain, "domain").alias("matched_kind"), F.coalesce(by_host, by_domain).alias("active_from"),
    )
