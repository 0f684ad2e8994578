"""Language identification and the quality classifier: brute force, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import langid
from marlstone.llm import quality_classifier as qc

SF = "/root/testdata/sf0.001"


def brute_bits(train, text, least):
    """Code length of ``text`` under one language's counts, the recursion written out."""
    counts, order = {}, langid.ORDER
    for x in train:
        s = b" " * order + x.encode()
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def p(context, symbol):
        c = counts.get(context)
        shorter = (lambda: p(context[1:], symbol)) if context else (lambda: 1 / 256)
        if not c or len(context) > 1 and sum(c.values()) < least:
            return shorter()
        total, distinct = sum(c.values()), len(c)
        return c[symbol] / (total + distinct) if symbol in c else distinct / (total + distinct) * shorter()

    s = b" " * order + text.encode()
    return sum(-math.log2(p(s[i - order : i], s[i])) for i in range(order, len(s)))


def model_of(train, **more):
    langs, grams, counts = [], [], []
    for lang, texts in train.items():
        c = Counter()
        for x in texts:
            c.update(langid._grams(np.frombuffer(b" " * langid.ORDER + x.encode(), np.uint8)).tolist())
        langs += [lang] * len(c)
        grams += list(c)
        counts += list(c.values())
    return langid.Model(np.array(langs, object), np.array(grams), np.array(counts), **more)


def test_code_lengths_equal_recursion(monkeypatch):
    train = {"en": ["the cat sat on the mat", "where is the dog? the cat"], "de": ["der hund läuft über die straße", "das ist gut, der hund"], "zz": ["the hund"]}
    texts = ["the dog", "über den hund", "", "a", "Zürich 12!", "the cat sat", "\u65e5\u672c the"]
    for size in (1 << 18, 5):  # whole, and slices that cut texts
        monkeypatch.setattr(langid, "SLICE", size)
        for least in (1, 3):
            model = model_of(train, least=least)
            found = model.code_lengths(texts)
            for x, row in zip(texts, found, strict=True):
                for lang, bits in zip(model.langs, row, strict=True):
                    assert abs(bits - brute_bits(train[lang], x, least)) < 1e-3, (x, lang)


def test_large_models_keep_fewer_contexts():
    train = {"en": ["the cat sat on the mat " * 3], "de": ["der hund lief um das haus " * 3]}
    whole = model_of(train, least=1)
    cells = sum(len(t.keys) * 2 for t in (*whole.runs, *whole.escapes))
    less = model_of(train, least=1, cells=cells // 2)
    assert less.least > 1 and sum(len(t.keys) * 2 for t in (*less.runs, *less.escapes)) <= cells // 2
    assert [less.langs[k] for k in less.code_lengths(["the cat", "der hund"]).argmin(1)] == ["en", "de"]


def test_equal_code_lengths_go_to_the_first_language(spark):
    model = model_of({"b": ["same text"], "a": ["same text"]})
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (2, "x" * 300_000)], "doc_id long, text string")
    out = langid.predict(docs, model).collect()
    assert {r.lang_pred for r in out} == {"a"} and all(abs(r.score - 0.5) < 1e-6 for r in out) and len(out) == 3


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 20 and sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out)
    assert all(r.held_out and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in out)
    assert len({round(r.score, 3) for r in out}) > 5  # a lead a byte, not a certainty that grows with the text
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "the " * 50_000), (4, "the " * 50_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_is_not_an_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    plain = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    hidden = {r.doc_id: r.lang_pred for r in langid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")), model).collect()}
    assert plain == hidden


def test_classifier_separates_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = qc.fit(docs, labels.where("doc_id % 2 = 0"))
    out = qc.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in out)
    assert len(out) > 100 and right >= 0.97 * len(out)
    assert len(model.exchanged) == qc.ROUNDS and model.exchanged[-1][0] > 0


def test_exchange_equals_brute_force(spark):
    """Rounds over Spark's search and over all rows held in one array give the same views."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows, marks = docs.collect(), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 0").collect()}
    xt = np.stack([qc.text_vector(r.text) for r in rows])
    xm = qc.one_hot(np.array([qc.metadata_places(r.source, r.lang, r.n_chars) for r in rows]))
    y = np.array([marks.get(r.doc_id, -1) for r in rows])
    least = math.log(qc.SURE / (1 - qc.SURE))

    def search(view, model, most):
        margin = np.where(y < 0, model.margin((xt, xm)[view]), 0)
        good, bad = [k for k in np.argsort(-margin, kind="stable") if margin[k] >= least][:most], [k for k in np.argsort(margin, kind="stable") if margin[k] <= -least][:most]
        return xt[good + bad], xm[good + bad], np.r_[np.ones(len(good), int), np.zeros(len(bad), int)]

    hashes = np.array([r.h for r in docs.select(F.xxhash64(F.coalesce("text", F.lit("")), "source", "lang", "n_chars").alias("h")).collect()])
    known = sorted(np.flatnonzero(y >= 0).tolist(), key=lambda k: (hashes[k], xt[k].tobytes()))
    fold = (hashes[known].view(np.uint64) >> np.uint64(17)) % np.uint64(qc.FOLDS)
    want = qc.co_train(xt[known], xm[known], y[known], fold, search, most=40)
    got = qc.fit(docs, labels.where("doc_id % 2 = 0"), exchange=40)
    assert got.exchanged == want.exchanged and got.exchanged[0][0] > 0
    assert np.allclose(got.text.weights, want.text.weights, atol=1e-3) and np.allclose(got.metadata.weights, want.metadata.weights, atol=1e-2)


def test_views_teach_each_other():
    """Two independent views of one label, few labels: what is handed on lowers both views' errors."""
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 2, 4000)
    view = lambda: np.where(rng.random((4000, 12)) < np.where(truth, 0.72, 0.28)[:, None], 1.0, 0.0)
    a, b = view(), view()
    few, rest = np.arange(40), np.arange(40, 4000)

    def search(v, model, most):
        margin = model.margin((a, b)[v][rest])
        at = np.r_[np.argsort(-margin)[:most], np.argsort(margin)[:most]]
        return a[rest][at], b[rest][at], (margin[at] > 0).astype(int)

    errors = []
    for rounds in (0, 4):
        m = qc.co_train(a[few], b[few], truth[few], few % 4, search, rounds=rounds, most=150)
        errors.append([((x.margin(y[rest]) > 0) != truth[rest]).mean() for x, y in ((m.text, a), (m.metadata, b))])
    assert errors[1][0] < errors[0][0] and errors[1][1] < errors[0][1] and all(x > 0 for r in m.exchanged for x in r)


def test_classifier_fit_is_reproducible_and_bounded(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one, two = (qc.fit(d, labels, labelled=30) for d in (docs, docs.repartition(7)))
    assert np.array_equal(one.text.weights, two.text.weights) and one.mix == two.mix and one.exchanged == two.exchanged


def test_classifier_clashing_names_ties_and_long_text(spark):
    long = "good clean words here. " * 60_000
    rows = [(i, ("good clean words here. " * 5) if i % 2 else ("## $$ | " * 9), "en", "s", 100) for i in range(40)] + [(50, long, "en", "s", len(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    for c in ("key", "mark", "margins", "_m", "_y", "t", "m", "y", "at"):
        docs = docs.withColumn(c, F.lit("own"))
    out = qc.score(docs, qc.fit(docs, labels)).collect()
    assert len({r.quality_score for r in out if r.doc_id % 2 and r.doc_id < 40}) == 1 and all(r.kept == (r.doc_id % 2 == 1) for r in out if r.doc_id < 40)
    assert all(r.margins == "own" and r.key == "own" for r in out) and next(r for r in out if r.doc_id == 50).quality_score is not None


def test_classifier_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(i, ("good clean words here. " * 5) if i % 2 else ("## $$ | " * 9), "en", "s", 100, "clash") for i in range(40)] + [(100, None, None, None, None, None), (101, "", "en", "s", 0, None), (1, "good clean words here. " * 5, "en", "s", 100, None)]
    docs = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)] + [(None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    out = qc.score(docs, qc.fit(docs, labels)).collect()
    assert len(out) == len(rows) and all(r.kept == (r.doc_id % 2 == 1) for r in out if r.doc_id < 40)
    assert all(r.quality_score is not None for r in out)
    none = qc.score(docs, qc.fit(docs, labels.limit(0))).collect()
    assert all(r.kept and r.quality_score is None for r in none)
    assert qc.score(docs.limit(0), qc.fit(docs, labels)).count() == 0
    assert qc.fit(docs.limit(0), labels) is None


def test_search_hands_on_the_surest_alone(spark, monkeypatch):
    """However many rows are sure, the features of no more than the surest are written."""
    sizes, real = {}, qc.written

    def counted(df, name):
        out = real(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(qc, "written", counted)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.concat("text", F.lit(" x"))))
    model = qc.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), exchange=5)
    assert model.exchanged[-1][0] > 0
    assert set(sizes["margins"]) == {docs.count() - 399} and max(sizes["surest"]) <= 2 * 15 + 20  # copies of the last one may be beyond
