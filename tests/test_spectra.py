"""Spectra against numpy, ranks and trims against plain rules, and what odd rows give."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import spectra as sp

WIDTH = 3.0


def bin_of(term):
    return hashlib.md5(b"spectrum" + term.lower().encode()).digest()[0]


def wave(terms, heights):
    at = np.arange(256)
    return sum((h * np.exp(-0.5 * ((at - bin_of(t)) / WIDTH) ** 2) for t, h in zip(terms, heights)), np.zeros(256))


def keys(text):
    words = [w.strip(sp.MARKS) for w in (text or "").lower().split()]
    words = [w for w in words if len(w) > 2 and w not in sp.STOP_WORDS]
    return words[:5] + [w for w in words if len(w) > 4]


def weights(own, near):
    out = np.full(256, 0.8)
    for terms, top, reach in ((own, 1.5, 10), (near, 1.2, 7)):
        for t in terms:
            for i in range(256):
                d = i - bin_of(t)
                if abs(d) <= reach:
                    out[i] = max(out[i], 0.8 + (top - 0.8) * math.exp(-0.5 * (d / WIDTH) ** 2))
    return out


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def circular(a, b):
    if a.sum() <= 0 or b.sum() <= 0:
        return 0.0
    c = np.cumsum(a / a.sum() - b / b.sum())
    return 1 / (1 + np.abs(c - np.median(c)).sum())


QUERIES = [(1, "Where is the «granite» harbour-wall, granite?"), (2, None), (3, "the of is"), (4, "Quarry dust settles: slowly over the river banks near town (dust)")]
SYNONYMS = [("granite", "stone"), ("Dust", "powder"), ("dust", "powder"), ("quarry", None), ("missing", "none")]


def surfaces(spark):
    q = spark.createDataFrame(QUERIES, "query_id int, text string")
    return sp.query_surfaces(q, spark.createDataFrame(SYNONYMS, "term string, synonym string"))


def reference(text):
    own = keys(text)
    near = [s for t in own for k, s in (("granite", "stone"), ("dust", "powder")) if k == t]
    return wave(own + near, [1.0] * len(own) + [0.5] * len(near)), weights(own, near)


def test_surface_equals_numpy(spark):
    got = {r.query_id: r for r in surfaces(spark).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for i, text in QUERIES:
        spectrum, surface = reference(text)
        assert np.allclose(got[i].spectrum, spectrum, atol=1e-6) and np.allclose(got[i].weights, surface, atol=1e-6)
    assert max(got[2].spectrum) == 0 and set(got[3].weights) == {0.8}


def test_document_spectra(spark):
    docs = spark.createDataFrame([(1, 0.504, ["x"]), (2, 1.0, ["a b", "c", "d", "e", "f", "past the fifth"]), (3, None, None), (4, 0.0, ["x"])], "doc_id int, decay double, fragments array<string>")
    tags = spark.createDataFrame([(1, "Rust"), (1, "rust"), (1, "mill"), (1, None), (9, "nobody")], "doc_id int, tag_value string")
    got = {r.doc_id: np.array(r.spectrum) for r in sp.document_spectra(docs, tags).collect()}
    assert np.allclose(got[1], wave(["rust", "mill"], [1.0, 0.5]), atol=1e-6)
    assert np.allclose(got[2], wave(["a b", "c", "d", "e", "f"], [1.0] * 5), atol=1e-6)
    assert got[3].sum() == 0 and got[4].sum() == 0 and sorted(got) == [1, 2, 3, 4]


@pytest.mark.parametrize("metric", ["cosine", "w1"])
def test_flux_equals_numpy(spark, metric):
    tags = [["granite", "wall"], ["dust"], ["elsewhere", "stone"], []]
    docs = spark.createDataFrame([(i, 1.0, t) for i, t in enumerate(tags)], "doc_id int, decay double, fragments array<string>")
    d = sp.document_spectra(docs, spark.createDataFrame([], "doc_id int, tag_value string")).withColumnRenamed("spectrum", "b")
    rows = surfaces(spark).join(d, F.lit(True)).select("query_id", "doc_id", sp.flux(F.col("spectrum"), F.col("b"), F.col("weights"), metric).alias("f")).collect()
    texts = dict(QUERIES)
    for r in rows:
        spectrum, w = reference(texts[r.query_id])
        other = wave(tags[r.doc_id], [1.0] * 2)
        assert r.f == pytest.approx({"cosine": cosine, "w1": circular}[metric](spectrum * w, other * w), abs=3e-5)
    with pytest.raises(ValueError):
        sp.flux(F.col("a"), F.col("b"), F.col("w"), "other")


def rank(spark, tags, k, ids=None):
    docs = spark.createDataFrame([(i, 1.0, t) for i, t in enumerate(tags)], "doc_id int, decay double, fragments array<string>")
    spectra = sp.document_spectra(docs, spark.createDataFrame([], "doc_id int, tag_value string"))
    cand = spark.createDataFrame([(1, i, n + 1, "x") for n, i in enumerate(ids or range(len(tags)))], "query_id int, doc_id int, rank int, score string")
    return [(r.doc_id, r.how) for r in sp.resonance_rank(cand, surfaces(spark), spectra, k=k).orderBy("position").collect()]


def test_rank_keeps_few_pads_and_cuts(spark):
    far = next(w for w in (f"w{i}" for i in range(999)) if min(abs(bin_of(w) - bin_of(t)) for t in [*keys(QUERIES[0][1]), "stone"]) > 25)
    near = ["granite"]
    assert rank(spark, [[far], near], 2, [0, 1]) == [(0, "kept"), (1, "kept")]
    assert rank(spark, [[far], [far], [far], near], 3) == [(3, "scored"), (0, "padded"), (1, "padded")]
    assert rank(spark, [[far], near, near], 2) == [(1, "scored"), (2, "scored")]
    assert rank(spark, [[far], near, [far], near], 3) == [(1, "scored"), (3, "scored")]  # half of them score: no padding
    assert rank(spark, [near, [far]], 2, [1, 0, 7])[0] == (0, "scored")  # 7 has no spectrum


def test_trim(spark):
    spectrum, _ = reference(QUERIES[0][1])
    words = [f"line {i}" for i in range(60)]
    good = [w for w in words if round(cosine(spectrum, wave([w], [1.0])), 6) >= 0.21]
    assert 0 < len(good) < 60
    bad = [w for w in words if w not in good]
    rows = [(1, 1, words, None, "c"), (1, 2, bad[:4], "", "c"), (1, 3, [], "complement", "c"), (1, 4, None, "", "é" * 600), (1, 5, None, None, None), (2, 6, ["a", "b", "c"], None, "c")]
    pairs = spark.createDataFrame(rows, "query_id int, doc_id int, fragments array<string>, complement string, content string")
    got = {r.doc_id: (r.kept, r.text) for r in sp.interference_trim(pairs, surfaces(spark)).collect()}
    assert got == {1: (len(good), " | ".join(good)), 2: (2, " | ".join(bad[:2])), 3: (0, "complement"), 4: (0, "é" * 500), 5: (0, ""), 6: (2, "a | b")}
    assert sp.interference_trim(pairs.limit(0), surfaces(spark)).count() == 0
