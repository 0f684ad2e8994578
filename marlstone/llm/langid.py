"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts is counted on a sample of labelled rows
(``rows_per_language``, a documented bound of the fit alone). Its depth varies: a context of two bytes
or more is a node only where the language's sample holds it ``LEAST`` times, ``ORDER`` bytes at most.
The statistics are then frozen: a symbol seen after its longest known context costs
-log2(count / (total + distinct)); an unseen one pays the escape, distinct / (total + distinct), and
is looked up in the next shorter context, down to a uniform order. The code length of a whole text is
the exact sum of its bytes' costs, and the language of the shortest code is predicted.

The trees are kept sparse: for each order the runs of context and symbol that occur, with a cost in
each language, escapes worked in. A byte is looked up by its longest run; where that is in no tree,
the context's escapes are added and the next shorter run is looked up. What is broadcast holds at most
``MODEL_CELLS`` costs: beyond it ``LEAST`` is doubled until they fit. No shuffle: each text is scored on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokenise import blocks

#: Rows of each language that the fit looks at, at most about.
ROWS_PER_LANGUAGE = 1500
#: Bytes of the longest context, and how often a context of two or more must occur.
ORDER, LEAST = 4, 4
#: Costs (four bytes each) of a model at most.
MODEL_CELLS = 32_000_000
#: Positions scored at a time.
SLICE = 1 << 18
#: Bytes of text over whose mean code a language's lead is measured in a score.
UNIT = 1
_START = b" " * ORDER


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def gram_counts(sample: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each run of ``ORDER`` bytes and the next one occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            at = 0
            for texts in blocks(batch, 1, 2_000_000):
                by: dict[str, list[bytes]] = {}
                for k, x in zip(langs[at : at + len(texts)], texts, strict=True):
                    by.setdefault(k, []).append(_START + x.encode("utf-8", "replace"))
                at += len(texts)
                for k, parts in by.items():
                    grams, n = np.unique(np.concatenate([_grams(np.frombuffer(p, np.uint8).astype(np.int64)) for p in parts]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(grams), pa.string()), pa.array(grams), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    found = sample.select(lang, text).mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _grams(x: np.ndarray) -> np.ndarray:
    """Each byte after the first ``ORDER`` with those before it, as a number; the last byte is the lowest."""
    out = x[: len(x) - ORDER].astype(np.int64)
    for k in range(1, ORDER + 1):
        out = (out << 8) | x[k : len(x) - ORDER + k]
    return out


class _Table:
    """Sorted numbers with a row of costs each, found by hash; those that lose their slot are searched for."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        self.keys, self.costs = keys, costs
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 1))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        at = self._slot(keys)
        self.slots[at] = np.arange(len(keys), dtype=np.int32)
        self.lost = np.flatnonzero(self.slots[at] != np.arange(len(keys)))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each number, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = self.slots[self._slot(wanted)].astype(np.int64)
        miss = np.flatnonzero(self.keys[at] != wanted)
        at[miss] = -1
        if len(self.lost) and len(miss):
            lost = self.keys[self.lost]
            k = np.minimum(np.searchsorted(lost, wanted[miss]), len(lost) - 1)
            hit = lost[k] == wanted[miss]
            at[miss[hit]] = self.lost[k[hit]]
        return at


class Model:
    """Frozen costs in each language: of runs of a context and a symbol, and of escapes from contexts."""

    def __init__(self, langs: np.ndarray, grams: np.ndarray, counts: np.ndarray, least: int = LEAST, cells: int = MODEL_CELLS):
        self.langs = sorted(set(langs.tolist()))
        if not self.langs:
            return
        number = {x: k for k, x in enumerate(self.langs)}
        who = np.array([number[x] for x in langs.tolist()], np.int64)
        while not self._build(who, grams, counts.astype(np.float64), least, cells):
            least *= 2
        self.least = least

    def _build(self, who: np.ndarray, grams: np.ndarray, counts: np.ndarray, least: int, cells: int) -> bool:
        size = len(self.langs)
        self.runs: list[_Table] = []
        self.escapes: list[_Table] = []
        held = 0
        for order in range(ORDER + 1):
            mask = (1 << 8 * (order + 1)) - 1
            keys, row = np.unique((grams & mask) * size + who, return_inverse=True)
            n = np.bincount(row, counts)
            key, lang = keys // size, keys % size
            context = key >> 8
            nodes, at = np.unique(context * size + lang, return_inverse=True)
            total, distinct = np.bincount(at, n), np.bincount(at).astype(float)
            known = (total >= least) | (order < 2)
            keep = known[at]
            runs, contexts = np.unique(key[keep]), np.unique(nodes[known] // size)
            held += (len(runs) + len(contexts)) * size
            if held > cells and least < counts.sum():
                return False
            escape = np.zeros((len(contexts), size))
            escape[np.searchsorted(contexts, nodes[known] // size), nodes[known] % size] = -np.log2(distinct[known] / (total + distinct)[known])
            if order:
                below = self.runs[-1]
                shorter = below.costs[below.find(runs & (mask >> 8))]
            else:
                shorter = np.full((len(runs), size), 8.0)
            costs = shorter + escape[np.searchsorted(contexts, runs >> 8)]
            costs[np.searchsorted(runs, key[keep]), lang[keep]] = -np.log2(n[keep] / (total + distinct)[at][keep])
            self.runs.append(_Table(runs, costs.astype(np.float32)))
            self.escapes.append(_Table(contexts, escape.astype(np.float32)))
        return True

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run in each language."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        todo = np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            own = grams[todo] & ((1 << 8 * (order + 1)) - 1)
            at = self.runs[order].find(own)
            hit = at >= 0
            if hit.all():
                out[todo] += self.runs[order].costs[at]
                return out
            out[todo[hit]] += self.runs[order].costs[at[hit]]
            todo, own = todo[~hit], own[~hit]
            at = self.escapes[order].find(own >> 8)
            node = at >= 0
            out[todo[node]] += self.escapes[order].costs[at[node]]
        out[todo] += 8  # the uniform order
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text in each language."""
        parts = [_START + x.encode("utf-8", "replace") for x in texts]
        ends = np.cumsum([len(x) for x in parts])
        x = np.frombuffer(b"".join(parts), np.uint8)
        out = np.zeros((len(texts), len(self.langs)))
        starts = np.r_[0, ends[:-1]]
        for low in range(ORDER, len(x), SLICE):
            high = min(low + SLICE, len(x))
            bits = self.costs(_grams(x[low - ORDER : high]))
            first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high - 1, side="right")
            for k in range(first, last + 1):  # the start symbols of a text cost nothing
                a, b = max(starts[k] + ORDER, low) - low, min(ends[k], high) - low
                if b > a:
                    out[k] += bits[a:b].sum(0, dtype=np.float64)
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """The model of the labelled rows that aren't held out, from about ``rows_per_language`` of each language.

    Rows are drawn by a hash of the id, each language with its own share, and read whole.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(doc_id), F.lit(False)))
    shares = [(r[0], min(1.0, rows_per_language / r.n)) for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()]
    shares = spark.createDataFrame(shares or [("", 0.0)], "_lang string, _share double")
    drawn = F.pmod(F.xxhash64(F.col(doc_id), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(shares), F.col(lang) == F.col("_lang")).where(drawn < F.col("_share"))
    found = gram_counts(sample.select(F.col(text).alias("text"), F.col(lang).alias("lang"))).toArrow()
    return Model(np.array(found["lang"].to_pylist(), object), found["gram"].to_numpy(), found["n"].to_numpy())


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", bits: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row, with ``bits`` the code lengths by language.

    ``und`` with score 0 where the text is null or has no letter (and where nothing was learned).
    The score is the share of the best language among 2^-(bits of ``UNIT`` mean bytes) of all: how far
    it leads a byte, whatever the length. Equal code lengths: the first language in alphabetical
    order. Repeated rows get equal results; other columns are dropped, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            pred, score, lengths = [], [], []
            for texts in blocks(batch, 2, 2_000_000):
                if not model.langs:
                    pred += ["und"] * len(texts)
                    score += [0.0] * len(texts)
                    lengths += [{}] * len(texts)
                    continue
                found = model.code_lengths(texts)
                best = found.argmin(1)
                pred += [model.langs[k] for k in best]
                size = np.array([max(1, len(x.encode("utf-8", "replace"))) for x in texts])
                score += (1 / np.exp2(UNIT * (found.min(1, keepdims=True) - found) / size[:, None]).sum(1)).tolist()
                if bits:
                    lengths += [list(zip(model.langs, x, strict=True)) for x in found.tolist()]
            und = [not x for x in batch.column(3).to_pylist()]
            columns = [pa.array(["und" if u else p for u, p in zip(und, pred, strict=True)], pa.string()), pa.array([0.0 if u else s for u, s in zip(und, score, strict=True)], pa.float64())]
            if bits:
                columns.append(pa.array(lengths, pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[doc_id, "held_out", "lang_pred", "score", *(["bits"] * bits)])

    id_type = docs.schema[doc_id].dataType.simpleString()
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(doc_id), F.coalesce(held_out(doc_id), F.lit(False)).alias("_held"), F.coalesce(F.col(text), F.lit("")).alias("_text"), letter.alias("_letter"))
    return rows.mapInArrow(run, f"`{doc_id}` {id_type}, held_out boolean, lang_pred string, score double" + ", bits map<string,double>" * bits)
