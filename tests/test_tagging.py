"""Phrases against a naive search of all of them, tags against a loop over each document."""

import random
import re

import pytest

from marlstone import registry
from marlstone.operators import tagging as tg
from marlstone.plans import ingest

SF = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "gamma", "a", "b", "new", "york", "city", "é", "x1"]
DOCS = "doc_id long, content string"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def naive(text, phrases):
    """{(phrase, label): (n, first)}: every phrase tried at every word."""
    ws, out = words(text), {}
    for phrase, label in phrases:
        p = phrase.split(" ")
        at = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        if at:
            out[phrase, label] = (len(at), at[0])
    return out


@pytest.mark.parametrize("most", [1000, 3])
def test_phrase_hits_equal_naive_search(spark, most):
    rng = random.Random(1)
    phrases = sorted({(" ".join(rng.choices(WORDS, k=rng.randint(1, 4))), rng.choice("PQ")) for _ in range(40)} | {("a a", "P"), ("absent", "P"), ("", "P")})
    texts = [None, "", "A-a.a", "New York, new york city"] + ["".join(w + rng.choice([" ", ". ", ", ", "\n", "--"]) for w in rng.choices(WORDS, k=rng.randint(1, 40))) for _ in range(60)]
    found = tg.phrase_hits(spark.createDataFrame(list(enumerate(texts)), DOCS), spark.createDataFrame(phrases * 2, "phrase string, label string"), most_phrases=most).collect()
    want = {(i, *k): v for i, t in enumerate(texts) for k, v in naive(t, [p for p in phrases if p[0]]).items()}
    assert {(r.doc_id, r.phrase, r.label): (r.n, r.first) for r in found} == want and len(found) == len(want)


def test_no_phrases(spark):
    assert tg.phrase_hits(spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([], "phrase string, label string")).count() == 0


NOISE = {"src", "lib", "data", "docs", "test", "tests", "home", "users", "tmp", "index", "main", "init"}


def plain(path, text, phrases):
    text = text or ""
    said = [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if s]
    hits = [naive(s, phrases) for s in said]
    use = {}
    for h in hits:
        for (p, label), (n, _) in h.items():
            if label == "DOMAIN":
                use[p] = use.get(p, 0) + n
    parts = [x for x in (path or "").lower().split("/") if x]
    stem = re.sub(r"\.[^.]*$", "", parts[-1]) if parts and re.search(r"\.[^./]+$", path) else ""
    folder = parts[-2] if len(parts) > 1 else ""
    own = [t for x in (stem, folder) for t in [x, *re.split(r"[_\-]+", x)] if len(t) > 2 and t not in NOISE]
    domains = list(dict.fromkeys(own + sorted(use, key=lambda p: (-use[p], p))))[:10]
    named = sorted((k, first, p) for k, h in enumerate(hits) for (p, label), (_, first) in h.items() if label != "DOMAIN")
    camel = [m for s in said for m in re.findall(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", s)]
    entities = {}
    for x in [p for _, _, p in named] + camel:
        entities.setdefault(x.lower(), x)
    held = [sum(n for (_, label), (n, _) in h.items() if label != "DOMAIN") for h in hits]
    weight = [h * 2 + 1.5 * len(re.findall(r"\d+(?:\.\d+)?", s)) + len(re.findall(r"\b[A-Z][a-z]+[A-Z]\w*\b", s)) + 0.5 * (len(s) > 50) for h, s in zip(held, said)]
    best = sorted((i for i in range(len(said)) if len(said[i]) >= 15), key=lambda i: -weight[i])[:3]
    lead = text[:100].strip()
    top = said[max(range(len(said)), key=lambda i: (held[i], -i))] if said else ""
    return (domains, list(entities.values())[:15], said[0][:200] if said and len(said[0]) > 10 else lead, top[:200] if len(top) > 10 else (said[0][:200] if said else lead), " ".join(said[i] for i in best) if best else text[:500])


def test_tags_equal_a_loop(spark):
    rng = random.Random(7)
    phrases = [("alpha", "DOMAIN"), ("beta gamma", "DOMAIN"), ("new york", "GPE"), ("york city", "GPE"), ("x1", "PRODUCT"), ("alpha", "ORG")]
    extra = ["CamelCase", "camelcase", "HttpServerThing", "12", "3.5", "longerword" * 3]
    rows = [(0, None, None), (1, "/a/src/my_file-name.py", ""), (2, "noext", "Short."), (3, "/x/y.md", "tiny. Ok.")]
    for i in range(4, 50):
        text = " ".join(" ".join(rng.choices(WORDS + extra, k=rng.randint(1, 12))) + rng.choice([".", "!", "?", ""]) for _ in range(rng.randint(1, 8)))
        rows.append((i, rng.choice(["/src/data/b_c.txt", "/pkg/claims.py", None]), text))
    found = tg.tag(spark.createDataFrame(rows, "doc_id long, path string, content string"), spark.createDataFrame(phrases, "phrase string, label string")).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, path, text in rows:
        r = by_id[i]
        assert (r.domains, r.entities, r.intent, r.summary, r.complement) == plain(path, text, phrases), (i, text)


@pytest.mark.parametrize(("text", "kind"), [
    ("retries = 3", "config_knob"), ("The Timeout matters", "config_knob"), ("CREATE  TABLE x", "data_structure"), ("Runs when asked", "trigger_condition"), ("First step of all", "process_step"), ("It computes sums", "mechanism"),
    ("There are 12 of them", "fact"), ("12 monkeys", "unknown"), ("A wraps B", "relationship"), ("", "unknown"),
])
def test_intent_class(spark, text, kind):
    from pyspark.sql import functions as F

    assert spark.range(1).select(tg.intent_class(F.lit(text)).alias("k")).first().k == kind


def test_query_document_tags(spark):
    phrases = [tuple(r) for r in ingest.phrases(spark, SF).collect()]
    docs = {r.doc_id: r for r in ingest.m.documents(spark, SF).collect()}
    found = registry.QUERIES["document_tags"](spark, SF).collect()
    assert len(found) == len(docs)
    known = {p for p, _ in phrases}
    for r in found[::9]:
        ws = words(docs[r.doc_id].content)
        held = {" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws))} & known
        d = docs[r.doc_id]
        assert (r.domains, r.entities) == plain(d.source_id, d.content, [p for p in phrases if p[0] in held])[:2]
