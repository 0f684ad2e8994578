"""Ranking and trimming by spectra: a query's surface of weights, flux through it, and interference with fragments.

Spectra are arrays of 256 entries of six decimals. Peaks are summed a bin before they are gathered, so an array
of peaks never exceeds the bins, however many tags a document has. All of it are column expressions and joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx
from marlstone.operators import evidence as e
from marlstone.operators import tiers

SIZE = 256
#: Words that carry no signal in a spectrum (fixed values).
STOP_WORDS = tuple(
    """the a an is are was were be been being have has had do does did will would shall should may might must can could
    about above after again all also and any because before between both but by came come each for from get got her here
    him his how into its just like make many more most much not now only other our out over said she some than that the
    their them then there these they this those through too under use very want was way what when where which who why
    with you your""".split()
)
#: Marks cut from both ends of a word (fixed values).
MARKS = ".,;:!?'\"()[]{}<>/@#$%^&*+=~`|\\—–-"


def terms(text: Column) -> Column:
    """A query's first five keywords, then all longer than four characters; a word counts as often as it stands in each."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(MARKS)))
    keys = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.concat(F.slice(keys, 1, 5), F.filter(keys, lambda w: F.length(w) > 4))


def _gathered(peaks: DataFrame, by: str, amplitude: Column, width: float) -> DataFrame:
    """(by, spectrum, own, near): peaks (by, bin, own, height) summed a bin, then gathered; ``own`` and ``near`` are bins."""
    bins = peaks.groupBy(by, "bin").agg(F.sum(amplitude).alias("height"), F.bool_or("own").alias("own"), F.bool_or(~F.col("own")).alias("near"))
    all_ = F.array_sort(F.collect_list(F.struct("bin", "height", "own", "near")))
    lit = bins.groupBy(by).agg(all_.alias("p"))
    of = lambda flag: F.transform(F.filter("p", lambda x: x[flag]), lambda x: x["bin"])
    return lit.select(by, e.spectrum(F.col("p.bin"), F.col("p.height"), width, SIZE).alias("spectrum"), of("own").alias("own"), of("near").alias("near"))


def surface(own: Column, near: Column, width: float = 3.0, own_top: float = 1.5, near_top: float = 1.2, base: float = 0.8) -> Column:
    """Weights of the bins: ``base``, raised to ``own_top`` at bins of terms and ``near_top`` at bins of synonyms.

    A rise falls off as a normal curve and ends three widths (synonyms: two) and a bin away. Rises meet by their maximum.
    """

    def rise(bins: Column, top: float, reach: int, i: Column) -> Column:
        close = F.filter(bins, lambda b: F.abs(i - b) <= reach)
        return F.array_max(F.transform(close, lambda b: base + (top - base) * F.exp(-0.5 * F.pow((i - b) / width, F.lit(2.0)))))

    both = lambda i: F.greatest(F.lit(base), rise(own, own_top, int(width * 3) + 1, i), rise(near, near_top, int(width * 2) + 1, i))
    return F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: fx.round6(both(i)))


def query_surfaces(queries: DataFrame, synonyms: DataFrame, width: float = 3.0) -> DataFrame:
    """(query_id, spectrum, weights) of (query_id, text), with (term, synonym): a synonym is half as high as its term.

    A query without terms (null or empty text too) has a spectrum of zeros and the base weight everywhere.
    """
    t = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term"))
    pairs = synonyms.select(F.lower("term").alias("term"), "synonym").where("term IS NOT NULL AND synonym IS NOT NULL").distinct()
    near = t.join(pairs, "term").select("query_id", e.bin_of(F.col("synonym")).alias("bin"), F.lit(False).alias("own"))
    peaks = t.select("query_id", e.bin_of(F.col("term")).alias("bin"), F.lit(True).alias("own")).unionByName(near)
    lit = _gathered(peaks, "query_id", F.when(F.col("own"), 1.0).otherwise(0.5), width)
    none = F.array().cast("array<int>")
    whole = queries.select("query_id").join(lit, "query_id", "left")
    flat = F.array_repeat(F.lit(0.0), SIZE)
    return whole.select("query_id", F.coalesce("spectrum", flat).alias("spectrum"), surface(F.coalesce("own", none), F.coalesce("near", none), width).alias("weights"))


def document_spectra(docs: DataFrame, tags: DataFrame, width: float = 3.0) -> DataFrame:
    """(doc_id, spectrum) of (doc_id, decay, fragments): peaks of its tags (doc_id, tag_value), damped by decay at two decimals.

    Without tags its first five fragments take their place; without those (or decay) all is zero.
    """
    d = docs.select("doc_id", F.bround(F.coalesce(F.col("decay").cast("double"), F.lit(0.0)), 2).alias("decay"), F.transform(F.slice(F.coalesce("fragments", F.array().cast("array<string>")), 1, 5), e.bin_of).alias("first"))
    peaks = tags.where("tag_value IS NOT NULL").select("doc_id", e.bin_of(F.col("tag_value")).alias("bin"))
    bins = peaks.groupBy("doc_id", "bin").agg(F.count("*").cast("double").alias("height"))
    lit = bins.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("bin", "height"))).alias("p"))
    both = d.join(lit, "doc_id", "left")
    at, high = F.coalesce("p.bin", "first"), F.coalesce("p.height", F.transform("first", lambda _: F.lit(1.0)))
    return both.select("doc_id", e.spectrum(at, F.transform(high, lambda h: h * F.col("decay")), width, SIZE).alias("spectrum"))


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def flux(a: Column, b: Column, weights: Column, metric: str = "cosine") -> Column:
    """Likeness of two spectra seen through ``weights``: cosine, or 1 / (1 + W1) on the circle; 0 where one is empty."""
    if metric not in ("cosine", "w1"):
        raise ValueError(f"no metric {metric}")
    x, y = times(a, weights), times(b, weights)
    if metric == "cosine":
        return fx.round6(tiers.cosine(x, y))
    return F.when((total(x) > 0) & (total(y) > 0), e.circular_w1(x, y)).otherwise(F.lit(0.0))


def resonance_rank(candidates: DataFrame, queries: DataFrame, spectra: DataFrame, k: int = 5, metric: str = "cosine", floor: float = 0.05, padding: float = 0.1) -> DataFrame:
    """(query_id, doc_id, score, how, position): the best ``k`` candidates (query_id, doc_id, rank) of each query by flux.

    ``queries`` are ``query_surfaces``. Up to ``k`` candidates all stay as they are (``how``: kept). Else those above
    ``floor`` count (scored); if they are fewer than half, the others fill up to ``k`` in order of rank with the score
    ``padding`` (padded). Ties go to scored ones, then by rank. A candidate without a spectrum scores 0.
    """
    q = tiers.terms_side(queries.select("query_id", F.col("spectrum").alias("_q"), "weights"), 5_000)
    met = candidates.select("query_id", "doc_id", "rank").join(spectra.select("doc_id", "spectrum"), "doc_id", "left").join(q, "query_id")
    score = F.when(F.col("spectrum").isNull(), 0.0).otherwise(flux(F.col("_q"), F.col("spectrum"), F.col("weights"), metric))
    met = met.select("query_id", "doc_id", "rank", score.alias("score")).withColumn("_hit", F.col("score") > floor)
    w = Window.partitionBy("query_id")
    met = met.withColumns({"_n": F.count("*").over(w), "_hits": F.count_if("_hit").over(w), "_place": F.row_number().over(Window.partitionBy("query_id", "_hit").orderBy("rank", "doc_id"))})
    few, pads = F.col("_n") <= k, ~F.col("_hit") & (F.col("_hits") < F.col("_n") * 0.5) & (F.col("_place") <= k - F.col("_hits"))
    how = F.when(few, "kept").when(F.col("_hit"), "scored").when(pads, "padded")
    met = met.withColumn("how", how).where("how IS NOT NULL").withColumn("score", F.when(F.col("how") == "padded", padding).otherwise(F.col("score")))
    order = [F.when(F.col("how") == "kept", 0.0).otherwise(-F.col("score")), F.col("how") == "padded", F.col("rank"), F.col("doc_id")]
    return met.withColumn("position", F.row_number().over(w.orderBy(*order))).where(F.col("position") <= k).select("query_id", "doc_id", "score", "how", "position")


def resonances(spectrum: Column, width: float = 3.0) -> Column:
    """Cosine of a spectrum with a single peak at each bin: what any fragment scores, by the bin it falls in."""
    kernel = F.array(*(F.lit(round(math.exp(-0.5 * (d / width) ** 2), 6)) for d in range(SIZE)))
    bins = F.sequence(F.lit(0), F.lit(SIZE - 1))
    peak = lambda c: F.transform(bins, lambda i: F.get(kernel, F.abs(i - c)))
    return F.transform(bins, lambda c: fx.round6(tiers.cosine(spectrum, peak(c))))


def interference_trim(pairs: DataFrame, queries: DataFrame, aggressiveness: float = 0.3, least: int = 2, width: float = 3.0) -> DataFrame:
    """(query_id, doc_id, kept, text): a document's fragments that resonate with the query, joined by `` | ``.

    ``pairs`` hold (query_id, doc_id, fragments, complement, content). A fragment stays if it scores .7 of
    ``aggressiveness`` or more. If none does, the first ``least`` stay. Without fragments the text is the complement
    or, where that is empty, the first 500 characters of the content (``kept`` is 0; null content is an empty text).
    """
    near = tiers.terms_side(queries.select("query_id", resonances(F.col("spectrum"), width).alias("_near")), 5_000)
    p = pairs.select("query_id", "doc_id", F.coalesce("fragments", F.array().cast("array<string>")).alias("f"), F.nullif("complement", F.lit("")).alias("complement"), F.col("content")).join(near, "query_id")
    stay = F.filter("f", lambda x: F.get(F.col("_near"), e.bin_of(x)) >= round(aggressiveness * 0.7, 6))
    kept = p.withColumn("_stay", stay).withColumn("_stay", F.when(F.size("_stay") > 0, F.col("_stay")).otherwise(F.slice("f", 1, least)))
    rest = F.coalesce("complement", F.substring("content", 1, 500), F.lit(""))
    return kept.select("query_id", "doc_id", F.size("_stay").cast("long").alias("kept"), F.when(F.size("_stay") > 0, F.concat_ws(" | ", "_stay")).otherwise(rest).alias("text"))
