"""Exact dedup, quality rules and URL filters against plain Python, with odd rows."""

import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from marlstone.llm import quality_rules as qr
from marlstone.llm import url_filters as uf
from marlstone.llm.exact_dedup import exact_dedup, normalised

DOCS = "doc_id long, text string, kept string, source string"
ROWS = [
    (1, "Alpha beta", "x", "a"), (2, "ALPHA BETA", "x", "a"), (3, "alpha beta ", "x", "a"), (4, None, None, None), (5, "", "y", "b"),
    (6, "École", "x", "a"), (7, "école", "x", "a"), (8, "z" * 100_000, "x", "a"), (8, "z" * 100_000, "x", "a"), (9, "Z" * 100_000, "x", "a"), (None, "lone", "x", "a"),
]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup_brute_force(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    out = exact_dedup(docs.withColumn("sha", F.sha2(normalised(), 256))).collect()
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(lower(t), []).append(i)
    assert len(out) == len(ROWS)
    want = sorted((str(i), str(max((x for x in groups[lower(t)] if x is not None), default=None)), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in ROWS)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.sha) for r in out) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    assert "text" not in out[0].asDict() and out[0].source in ("a", "b", None)


def test_exact_dedup_with_digest_and_clashing_names(spark):
    docs = spark.createDataFrame(ROWS, DOCS).withColumn("sha", F.sha2(normalised(), 256))
    for c in ("bits", "bucket", "spot", "at", "full", "_full", "length", "start", "most", "many", "count", "FULL_"):
        docs = docs.withColumn(c, F.lit(7))
    one, two = exact_dedup(docs), exact_dedup(docs, digest="sha")
    assert one.columns == two.columns
    rows = sorted(map(str, one.collect()))
    assert rows == sorted(map(str, two.collect())) and len(rows) == len(ROWS)


def test_exact_dedup_prefix_alone_is_no_copy(spark):
    docs = spark.createDataFrame([(1, "p" * 500 + "a"), (2, "p" * 500 + "b"), (3, "P" * 500 + "A"), (4, "q")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs).collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_exact_dedup_empty(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts(spark):
    rep = " ".join(f"w{i % 11}" for i in range(60))
    texts = [None, "", "one two", rep, rep + "\n" + rep, "a " * 40, "x\ty\x0bz\x0cq\rw\n\n#*$ | <b>\na b\na b\n \n", "é ü # ñ " * 30, " ".join(f"u{i}" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for r in qr.quality_rules(docs).collect():
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_quality_rules_verdict(spark):
    prose = "\n".join(" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(6))
    nav = "\n".join(" | ".join(f"item{i}{j}" for j in range(12)) for i in range(8))
    rows = [(1, prose), (2, nav), (3, prose + "\nAll rights reserved."), (4, prose + "\n" + nav + nav), (5, prose.upper())]
    out = {r.doc_id: r for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.kept for k, r in out.items()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert out[1].clean_text == prose and out[3].clean_text == prose
    assert qr.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_rules_on_punctuation_menus_and_boilerplate(spark):
    prose = "\n".join(" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(6))
    menu, two = "Home\nAbout us\nProducts\nContact", "Chapter One\nThe Start"
    flat = " ".join(f"plain{j}" for j in range(40))
    wide = " ".join(f"long{j}" for j in range(80)) + ". Read more, he said."  # one phrase in some 500 characters
    rows = [(1, menu + "\n" + prose), (2, two + "\n" + prose), (3, prose + "\n" + flat), (4, prose + "\n" + wide), (5, prose + "\nRead more. Click here. Subscribe."), (6, "Home\n\nAbout\n\nMore\n" + prose)]
    out = {r.doc_id: r.clean_text for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == prose and out[3] == prose and out[5] == prose  # a menu, a line without a mark, phrases
    assert out[2] == rows[1][1] and out[4] == rows[3][1] and out[6] == rows[5][1]  # two headings, one phrase in much prose, parted lines
    lenient = qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), rules=qr.Rules(menu_words=0, unmarked_words=1000, phrase_chars=1)).collect()
    assert all(r.clean_text == rows[r.doc_id - 1][1] for r in lenient if r.doc_id != 5)


def test_quality_rules_clashing_names_and_long_text(spark):
    long = "\n".join(" ".join("lengthyword" + str(k) for k in range(j, j + 9)) + "." for j in range(0, 30_000, 9))
    docs = spark.createDataFrame([(1, long, 1, 2, 3), (1, long, 1, 2, 3)], "doc_id long, text string, _w int, words int, clean_text int")
    out = qr.quality_rules(docs).collect()
    assert [r.n_words for r in out] == [len(long.split())] * 2 and all(r._w == 1 and r.words == 2 and r.kept for r in out)


def test_url_filters_suffixes_clashes_and_long_urls(spark):
    day = dt.date(2024, 5, 5)
    entries = spark.createDataFrame([("domain", "shop.co.uk", day, "block")], "kind string, entry string, day date, action string")
    urls = ["https://www.shop.co.uk/a", "https://other.co.uk/", "http://shop.co.uk", "http://x.org/" + "y" * 100_000, None]
    captures = spark.createDataFrame([(i, u, day, 1, 2, 3, 4) for i, u in enumerate(urls)], "page_id long, url string, fetched date, host int, _h int, _host int, day int")
    out = {r.page_id: (r.blocked, r.matched_entry, r.host, r.day) for r in uf.filter_urls(captures, entries).collect()}
    assert out == {0: (True, "shop.co.uk", 1, 4), 1: (False, None, 1, 4), 2: (True, "shop.co.uk", 1, 4), 3: (False, None, 1, 4), 4: (False, None, 1, 4)}
    assert uf.filter_urls(captures, entries, suffixes=()).where("blocked").count() == 0


def test_url_filters(spark):
    d = lambda m, x: dt.date(2024, m, x)
    entries = spark.createDataFrame(
        [("host", "a.x.org", d(1, 10), "block"), ("host", "a.x.org", d(2, 1), "release"), ("host", "a.x.org", d(3, 1), "block"), ("domain", "y.net", d(1, 5), "block"), ("host", None, d(1, 1), "block"), ("host", "b.z.com", d(1, 1), "block"), ("host", "b.z.com", d(1, 1), "release"), ("host", "c.z.com", None, "block")],
        "kind string, entry string, day date, action string",
    )
    rows = [(1, "http://a.x.org/p", d(1, 9)), (2, "http://A.x.org:80/p", d(1, 10)), (3, "https://a.x.org", d(2, 1)), (4, "http://a.x.org/q?r", d(12, 1)), (5, "http://q.y.net/", d(1, 5)), (6, None, d(1, 5)), (7, "odd", d(1, 5)), (8, "http://a.x.org/", None), (9, "http://b.z.com/", d(6, 1)), (9, "http://b.z.com/", d(6, 1))]
    out = uf.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched date").withColumn("blocked", F.lit("clash")), entries).collect()
    assert len(out) == len(rows)
    assert sorted({r.page_id for r in out if r.blocked}) == [2, 4, 5]
    assert {r.page_id: (r.matched_kind, str(r.active_from)) for r in out if r.blocked} == {2: ("host", "2024-01-10"), 4: ("host", "2024-03-01"), 5: ("domain", "2024-01-05")}
    assert uf.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched date"), entries.limit(0)).where("blocked").count() == 0
