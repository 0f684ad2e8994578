"""The n-gram join against brute force, and the pipeline stage by stage."""

import random

import corpus_pipeline as cp
import pytest

from marlstone.llm import ngram_join as nj

SF = "/root/testdata/sf0.001"


def word_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        if i is not None and i not in sets:
            sets[i] = word_shingles(t)
    ids, links, root = sorted(sets), dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {i: (max(g), links[i], len(g)) for g in groups.values() for i in g}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = words(60), words(150)
    rows = [(i, " ".join(words(rng.randrange(1, 120)))) for i in range(60)]
    rows += [(1000 + i, " ".join(words(40) + passage + words(20))) for i in range(150)]  # a passage many share
    for i in range(150):  # near copies of one text, more or less near
        near = list(base)
        for _ in range(rng.randrange(0, 9)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        rows.append((2000 + i, " ".join(near)))
    rows += [(3000 + i, "Same text of six words here") for i in range(80)]  # copies
    rows += [(4000, None), (4001, ""), (4002, "two words"), (4003, "TWO  words"), (4004, " ".join(words(20_000))), (5000, "Same text of six words here"), (5000, "Same text of six words here"), (None, "Same text of six words here")]
    return rows


def test_join_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(nj, "BLOCK", 20)  # several blocks to a component
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links, r.class_size) for r in nj.ngram_join(docs).collect()}
    assert got == brute(rows)


def test_more_runs_until_the_sample_is_found(spark, monkeypatch):
    """With hardly any paths a run, one run finds too little; repeated runs reach the target."""
    rows = [(i, " ".join(t.split()[:60])) for i, t in corpus(2) if i is not None and 2000 <= i < 2060]  # sets small enough for pools to hold them whole
    monkeypatch.setattr(nj, "RUNS", 1)
    monkeypatch.setattr(nj, "MOST_RUNS", 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = nj.written(nj.sketch(docs, "text", "doc_id", 0.8).dropDuplicates(["n", "f1", "f2"]).select("id", "n", "pool"), "sets")
    kept = {i for i, in sets.select("id").collect()}
    own = {i: word_shingles(t) for i, t in rows if i in kept}
    near = lambda a, b: len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])
    want = {(a, b) for a in own for b in own if a != b and near(a, b)}
    assert {(r.a, r.b) for r in nj.sample_pairs(sets).collect()} == want
    comp = {r.id: r.comp for r in nj.loose_components(sets, target=1.0).collect()}
    assert all(comp[a] == comp[b] for a, b in want)


def test_join_string_ids_and_ids_with_several_texts(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [("a", base), ("b", base.upper()), ("c", "other words stand here and not there"), ("c", base), ("c", base), (None, base), ("d", None)]
    got = sorted((r.doc_id, r.class_id, r.n_links, r.class_size) for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("a", "c", 2, 3), ("b", "c", 2, 3), ("c", "c", 0, 1), ("c", "c", 2, 3), ("d", "d", 0, 1)]


def test_join_empty_and_all_unlike(spark):
    assert nj.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f"), (2, "g h i j k l")]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, 1, 0), (2, 2, 0)]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs
    for name, f in cp.STAGES:
        docs = cp.written(f(spark, docs, SF), "stage")
        out[name] = docs
    return out


def test_stage_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "quality rules", "exact dedup", "n-gram Jaccard join", "best-fit packing"]
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].columns == stages["input"].columns


def test_classifier_and_rules_stages(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["quality classifier"].collect()}
    assert all((i in kept) == (q == 1) for i, q in labels.items())
    clean = {r.doc_id: r.text for r in stages["quality rules"].collect()}
    assert set(clean) <= kept and all(len(t.split()) >= 1 for t in clean.values())


def test_dedup_stages_equal_brute_force(stages):
    before = [(r.doc_id, r.text) for r in stages["quality rules"].collect()]
    keep = {}
    for i, t in before:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        keep[low] = max(keep.get(low, -1), i)
    exact = [(r.doc_id, r.text) for r in stages["exact dedup"].collect()]
    assert {i for i, _ in exact} == set(keep.values())
    near = {r.doc_id for r in stages["n-gram Jaccard join"].collect()}
    assert near == {i for i, (c, _, _) in brute(exact).items() if i == c}


def test_packing_stage(stages):
    docs = {r.doc_id for r in stages["n-gram Jaccard join"].collect()}
    rows = stages["best-fit packing"].collect()
    assert {r.doc_id for r in rows} == docs
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 2


def test_run_gives_the_stages_result(spark, stages):
    assert sorted((r.doc_id, r.piece, r.length) for r in cp.run(spark, SF).collect()) == sorted((r.doc_id, r.piece, r.length) for r in stages["best-fit packing"].collect())


def test_every_stage_on_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns named like inner ones."""
    rng = random.Random(4)
    sentence = lambda n: " ".join(rng.choice(["stone", "river", "walks", "under", "seven", "lamps", "quiet", "green"]) + str(rng.randrange(60)) for _ in range(n)) + "."
    long, plain = "\n".join(sentence(40) for _ in range(400)), sentence(60)
    rows = [(1, plain, "en", "a", 10), (1, plain, "en", "a", 10), (2, plain.upper(), None, None, None), (None, plain, "en", "a", 3), (3, None, "en", "a", 0), (3, None, "en", "a", 0), (4, "", "en", None, 0)]
    rows += [(5, long, "en", "a", 9), (6, long + " more", "en", "a", 9), (None, sentence(50), None, "b", None), (7, sentence(45), "en", "b", 4), (7, sentence(45), "en", "b", 4), (8, " ", "en", "b", 1)]
    odd = {"mark": "m", "kept": False, "row": 1, "_id": 2, "_gone": 3, "norm": "n", "n_words": 5, "clean_text": "c", "length": 1, "class_id": 9, "rep": 0, "set": 0, "stays": True, "_m": 0, "_y": 0, "_w": 0, "count": 1, "full": 0}
    docs = spark.createDataFrame([(*r, *odd.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'int'}" for k, v in odd.items()))
    spark.createDataFrame([(1, 1, 0), (7, 0, 0), (5, 1, None), (None, 0, 0), (2, None, 1), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {name: sorted(map(str, f(spark, docs, str(tmp_path)).collect())) for name, f in cp.STAGES[:-1]}
    for name, f in cp.STAGES[:-1]:
        assert f(spark, docs, str(tmp_path)).columns == docs.columns
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
    ids = lambda name: sorted(x.split("doc_id=")[1].split(",")[0] for x in found[name])
    # equal texts: 1, 1, 2 and null share one; 3, 3 and 4 are empty; the two texts of 7 differ
    assert ids("exact dedup") == sorted(["2", "4", "5", "6", "None", "7", "7", "8"])
    # near copies: 1 and 2 share all shingles, 5 and 6 nearly all; null ids and texts without words stay
    assert ids("n-gram Jaccard join") == sorted(["2", "None", "None", "3", "3", "4", "6", "7", "7", "8"])
    assert not {"3", "4", "8"} & set(ids("quality rules")) and "5" in ids("quality rules")
    assert len(cp.pack(spark, docs, "").select("doc_id", "piece").where("piece = 0").collect()) == len(rows)
    assert cp.pack(spark, docs.limit(0), "").count() == 0
