"""Quality scores by co-training a text view and a metadata view.

Each view has a logistic regression. One sees the text alone: hashed words and byte trigrams, shares
of kinds of characters, repeated words and lines. The other sees only the page's metadata: source,
language, both together, and bands of the recorded length. Both start from the labelled rows. In each
round each view looks through *all* unlabelled documents for those of which it is surest, as many of
either class as keep the classes' proportion, and hands them to the other view with its labels, which
learns from them from then on. How sure a view may be is told by its margins on labelled rows that it
was not trained on (by turns, a fold at a time), so a view that knows nothing is sure of nothing and hands on nothing; ``exchanged``
says what each handed on in each round.

At the end the views are calibrated, and combined, by a regression on such margins; a view that
speaks against the labels there gets no say.

The fit is on at most ``LABELLED`` labelled rows and ``EXCHANGE`` handed-on rows a view and class,
both drawn by a stated order and both parameters. Features are taken on executors; the search for
sure rows covers every document, and so does scoring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, unused, written

LABELLED, EXCHANGE, ROUNDS = 8_000, 2_000, 3
#: A view is sure of a row from this probability on.
SURE = 0.97
#: Folds of the labelled rows for calibration.
FOLDS = 4
#: Buckets of hashed words, trigrams, sources, languages, pairs of both; bands of the length.
WORDS, GRAMS = 128, 128
SOURCES, LANGS, PAIRS, BANDS = 64, 16, 64, 24
METADATA = SOURCES + LANGS + PAIRS + BANDS
_CACHE = 100_000

# Kinds of bytes (fixed values): the first that holds a byte; any other is "sign".
_KINDS = [("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("line", "\n"), ("space", " \t\r\x0b\x0c"), ("pipe", "|"), ("shout", "!?"), ("symbol", "#*$%&<>~^_=+@"), ("stop", ".,;:")]
_ENDS = frozenset(".!?\"»”:;")


def _kind_table() -> np.ndarray:
    table = np.full(256, len(_KINDS), np.int64)
    table[128:] = len(_KINDS) + 1
    for k, (_, chars) in enumerate(_KINDS):
        table[np.frombuffer(chars.encode(), np.uint8)] = k
    return table


_KIND = _kind_table()
COUNTS = len(_KINDS) + 2 + 6
TEXT = COUNTS + WORDS + GRAMS


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = value = xxhash.xxh32_intdigest(word) % WORDS
        return value


_BUCKETS = _Buckets()


def text_vector(text: str | None) -> np.ndarray:
    """Features of the whole text, each finite for any text; null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(TEXT, np.float32)
    size = max(1, len(raw))
    out[: len(_KINDS) + 2] = np.bincount(_KIND[raw], minlength=len(_KINDS) + 2) / size
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(lines))
    ended = sum([x.rstrip()[-1:] in _ENDS for x in lines if x.rstrip()])
    solid = out[0] + out[1] + out[len(_KINDS) + 1]
    out[len(_KINDS) + 2 : COUNTS] = np.log1p(len(words)), sum(map(eq, words, words[1:])) / n, min(len(set(words)) / n**0.8, 4.0), 1 - len(set(lines)) / m, ended / m, out[1] / max(float(solid), 1e-6)
    if words:
        out[COUNTS : COUNTS + WORDS] = np.sqrt(np.bincount(np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words)), minlength=WORDS) / n)
    if len(raw) > 2:
        x = raw.astype(np.uint32)
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        out[COUNTS + WORDS :] = np.sqrt(np.bincount(((h * np.uint32(0x27D4EB2F)) >> np.uint32(25)).astype(np.int64), minlength=GRAMS) / len(h))
    return out


def metadata_places(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """The four metadata features that are 1; null counts as empty or zero."""
    source, lang = source or "", lang or ""
    of = lambda x, n: xxhash.xxh32_intdigest(x) % n
    band = min(BANDS - 1, max(0, int(n_chars or 0)).bit_length())
    return [of(source, SOURCES), SOURCES + of(lang, LANGS), SOURCES + LANGS + of(f"{source}\0{lang}", PAIRS), SOURCES + LANGS + PAIRS + band]


def _metadata(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """``metadata_places`` of columns, a row each."""
    known: dict[tuple, list[int]] = {}
    out = []
    for key in zip(*(x.to_pylist() for x in (source, lang, n_chars)), strict=True):
        if key not in known:
            known[key] = metadata_places(*key)
        out.append(known[key])
    return np.array(out, np.int16).reshape(-1, 4)


def one_hot(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), METADATA), np.float32)
    out[np.arange(len(places))[:, None], places] = 1
    return out


@dataclass
class Logistic:
    """A logistic regression; ``mean`` and ``scale`` standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.weights[:-1] + self.weights[-1]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> Logistic:
    """Ridge logistic regression by Newton steps."""
    x = x.astype(np.float64)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([np.clip((x - mean) / scale, -20, 20), np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return Logistic(mean, scale, w)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class CoTrained:
    """Both views and the combination of their margins: probability = sigmoid(a * text + b * metadata + c)."""

    text: Logistic
    metadata: Logistic
    mix: tuple[float, float, float]
    #: For each round what the text view and the metadata view handed on.
    exchanged: tuple[tuple[int, int], ...]


#: (view, its regression, most rows) -> text features, metadata features and labels of the rows it is surest of.
Search = Callable[[int, Logistic, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def left_out(x: np.ndarray, y: np.ndarray, fold: np.ndarray, more: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Margin of each labelled row by a view trained on the other folds and on what was handed on."""
    out = np.zeros(len(y))
    for k in np.unique(fold):
        own = fold == k
        rest = np.flatnonzero(~own)
        if not 0 < y[rest].sum() < len(rest):
            rest = np.arange(len(y))  # too few labels to leave any out
        out[own] = fit_logistic(np.vstack([x[rest], more[0]]), np.r_[y[rest], more[1]].astype(float)).margin(x[own])
    return out


def calibrated(view: Logistic, margins: np.ndarray, y: np.ndarray) -> Logistic | None:
    """The view with margins that are log odds, by those of rows it wasn't trained on; None if they tell nothing there."""
    on = fit_logistic(margins[:, None], y.astype(float))
    slope = on.weights[0] / on.scale[0]
    if slope <= 0:
        return None
    weights = view.weights * slope
    weights[-1] += on.weights[1] - slope * on.mean[0]
    return Logistic(view.mean, view.scale, weights)


def proportionate(sure: np.ndarray, good: np.ndarray, odds: float, most: int) -> np.ndarray:
    """Places of the surest rows, at most ``most`` a class, ``good`` ones ``odds`` times as many as others; none if a class is missing."""
    order = np.argsort(-sure, kind="stable")
    yes, no = order[good[order]][:most], order[~good[order]][:most]
    if not len(yes) or not len(no):
        return order[:0]
    return np.r_[yes[: max(1, int(len(no) * odds))], no[: max(1, int(len(yes) / odds))]]


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, fold: np.ndarray, search: Search, rounds: int = ROUNDS, most: int = EXCHANGE) -> CoTrained | None:
    """Both views from labelled features (xt, xm, y) in folds. None without both classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    odds = y.mean() / (1 - y.mean())
    labelled = (xt, xm)
    given: list[tuple[np.ndarray, np.ndarray]] = [(xt[:0], y[:0]), (xm[:0], y[:0])]
    exchanged = []
    for k in range(rounds + 1):
        views = [fit_logistic(np.vstack([x, own]), np.r_[y, label].astype(float)) for x, (own, label) in zip(labelled, given, strict=True)]
        margins = [left_out(x, y, fold, more) for x, more in zip(labelled, given, strict=True)]
        if k == rounds:
            break
        handed: list[tuple[np.ndarray, np.ndarray] | None] = [None, None]
        sent = [0, 0]
        for v in (0, 1):
            on = calibrated(views[v], margins[v], y)
            if on is None:
                continue
            t, m, label = search(v, on, most * (k + 1))
            sure = np.abs(on.margin((t, m)[v])) if len(label) else np.zeros(0)
            at = proportionate(sure, label == 1, odds, most * (k + 1))
            handed[1 - v], sent[v] = ((m, t)[v][at], label[at]), len(at)
        given = [new or (x[:0], y[:0]) for new, x in zip(handed, labelled, strict=True)]
        exchanged.append((sent[0], sent[1]))
    both, use = np.stack(margins, 1), [0, 1]
    while use:
        last = fit_logistic(both[:, use], y.astype(float))
        weights = last.weights[:-1] / last.scale
        if (weights >= 0).all() or len(use) == 1:
            break
        use.remove(use[int(weights.argmin())])
    mix = [0.0, 0.0]
    for v, w in zip(use, weights, strict=True):
        mix[v] = float(w)
    return CoTrained(views[0], views[1], (*mix, float(last.weights[-1] - (weights * last.mean).sum())), tuple(exchanged))


def features(docs: DataFrame, text: str, mark: str) -> DataFrame:
    """(text features, metadata places, label, order) of every document; ``mark`` is the label or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [text_vector(x.as_py()).tobytes() for x in batch.column(0)]
            places = [x.tobytes() for x in _metadata(*batch.columns[1:4])]
            yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), pa.array(places, pa.binary()), batch.column(4), batch.column(5)], names=["t", "m", "y", "at"])
        release()

    rows = docs.select(text, F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col(mark).cast("int"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), "source", "lang", "n_chars"))
    return rows.mapInArrow(run, "t binary, m binary, y int, at long")


def _arrays(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = np.frombuffer(b"".join(found["t"].to_pylist()), np.float32).reshape(-1, TEXT)
    m = np.frombuffer(b"".join(found["m"].to_pylist()), np.int16).reshape(-1, 4)
    return t, one_hot(m)


#: Rows whose margins are taken at a time, and how far a margin may lie off by rounding between two passes.
BLOCK, SLACK = 1024, 1e-9


def _view_margin(model: Logistic, view: int, column: pa.Array) -> np.ndarray:
    """Margins by a view of its features as ``features`` gives them."""
    out = np.empty(len(column))
    for low in range(0, len(column), BLOCK):
        raw = b"".join(column.slice(low, BLOCK).to_pylist())
        x = one_hot(np.frombuffer(raw, np.int16).reshape(-1, 4)) if view else np.frombuffer(raw, np.float32).reshape(-1, TEXT)
        out[low : low + BLOCK] = model.margin(x)
    return out


def searcher(held: DataFrame, sure: float = SURE) -> Search:
    """The search over all unlabelled rows of ``held``, a features table: margins of all first, then the features of the surest alone."""
    least = float(np.log(sure / (1 - sure)))
    open_ = held.where("y IS NULL")

    def search(view: int, model: Logistic, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_view_margin(model, view, batch.column(0))), batch.column(1)], names=["margin", "at"])
            release()

        every = written(open_.select("tm"[view], "at").mapInArrow(margins, "margin double, at long"), "margins")
        from_ = {}
        for sign in (1, -1):
            best = every.where((F.abs("margin") >= least) & (F.col("margin") * sign > 0)).orderBy(F.col("margin") * -sign, "at").limit(most).select("margin").toArrow()
            from_[sign] = max(least, sign * best["margin"][-1].as_py() - SLACK) if best.num_rows and best.num_rows == most else least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margin = _view_margin(model, view, batch.column(view))
                keep = np.flatnonzero(((margin > 0) & (margin >= from_[1])) | ((margin < 0) & (-margin >= from_[-1])))
                if len(keep):
                    order = pa.array(keep)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(order) for c in range(3)), pa.array(margin[keep])], names=["t", "m", "at", "margin"])
            release()

        rows = written(open_.select("t", "m", "at").mapInArrow(run, "t binary, m binary, at long, margin double"), "surest")
        parts = [rows.where(f"{sign} * margin > 0").orderBy(F.col("margin") * -sign, "at", "t", "m").limit(most).toArrow() for sign in (1, -1)]
        both = [_arrays(x) if x.num_rows else (np.zeros((0, TEXT), np.float32), np.zeros((0, METADATA), np.float32)) for x in parts]
        return np.vstack([x[0] for x in both]), np.vstack([x[1] for x in both]), np.r_[np.ones(len(both[0][0]), int), np.zeros(len(both[1][0]), int)]

    return search


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", labelled: int = LABELLED, exchange: int = EXCHANGE) -> CoTrained | None:
    """The co-trained views. Labels with a null or other than 0 and 1 are left out; of repeated labels the largest counts.

    Beyond ``labelled`` labels those of the smallest hashes of the id count. Null without labels of
    both classes. Repeated rows count as rows. Names of other columns don't matter.
    """
    key, mark = unused(docs, "key", "mark")
    marks = labels.where(F.col("quality").isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(key)).agg(F.max("quality").alias(mark))
    marks = marks.orderBy(F.xxhash64(key, F.lit("quality")), key).limit(labelled)  # the documented bound of the fit
    rows = docs.join(F.broadcast(marks), F.col(doc_id) == F.col(key), "left")
    held = written(features(rows, text, mark), "features")
    known = held.where("y IS NOT NULL").orderBy("at", "t", "m", "y").toArrow()
    if not known.num_rows:
        return None
    xt, xm = _arrays(known)
    fold = (known["at"].to_numpy().view(np.uint64) >> np.uint64(17)) % np.uint64(FOLDS)
    return co_train(xt, xm, known["y"].to_numpy().astype(int), fold, searcher(held), most=exchange)


def _margins(model: CoTrained, text: Column, source: Column, lang: Column, n_chars: Column) -> Column:
    """Both views' margins of a row."""
    kind = pa.struct([("t", pa.float64()), ("m", pa.float64())])

    @F.arrow_udf("t double, m double")
    def margins(text: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> pa.Array:
        t = np.empty(len(text))
        for low in range(0, len(text), 1024):
            part = text.slice(low, 1024)
            t[low : low + len(part)] = model.text.margin(np.stack([text_vector(x.as_py()) for x in part]))
        m = model.metadata.margin(one_hot(_metadata(source, lang, n_chars))) if len(text) else t
        return pa.StructArray.from_arrays([pa.array(t), pa.array(m)], fields=list(kind))

    return margins(text, source.cast("string"), lang.cast("string"), n_chars.cast("long"))


def score(docs: DataFrame, model: CoTrained | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``p_text``, ``p_metadata``, ``quality_score`` and ``kept`` (score at least ``threshold``).

    Without a model (no labels of both classes) every score is null and every row is kept. Null text
    and metadata count as empty, texts of any length are read whole. Repeated rows and ties get equal
    scores; columns named like a result column are replaced, others pass through.
    """
    rest = [c for c in docs.columns if c not in ("p_text", "p_metadata", "quality_score", "kept")]
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select(*rest, nothing.alias("p_text"), nothing.alias("p_metadata"), nothing.alias("quality_score"), F.lit(True).alias("kept"))
    sigmoid = lambda m: 1 / (1 + F.exp(-F.greatest(F.least(m, F.lit(40.0)), F.lit(-40.0))))
    both = unused(docs, "margins")[0]
    a, b, c = model.mix
    found = docs.select(*rest, _margins(model, F.col(text), F.col("source"), F.col("lang"), F.col("n_chars")).alias(both))
    t, m = F.col(both)["t"], F.col(both)["m"]
    return found.select(*rest, sigmoid(t).alias("p_text"), sigmoid(m).alias("p_metadata"), sigmoid(a * t + b * m + c).alias("quality_score")).withColumn("kept", F.col("quality_score") >= threshold)
