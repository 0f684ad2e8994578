"""Exact medians and median deviations over sliding time windows, all windows bisected together.

A task holds a stretch of a series with the clicks before it that its windows reach, as prefix counts:
the sorted values are halved again and again, and each halving keeps, for every place in time, how
many values before it fell in the lower half. One bisection moves all windows' medians down those
halvings together; a second one bisects the radii around each median that hold half of its window,
each round counting by the same prefix counts.

Where two windows' lengths of a series hold too many rows for a task, clicks and the starts of their
windows are put in one order by series and time, dealt by ranges, so that a window is a range of places,
and places are cut into blocks of rows. A task holds a block and the one before.

A window of more rows than that is not gathered either. Its inner blocks are pieces of sorted
value lists over 1, 2, 4, ... blocks, of which summaries of runs tell between which values the median
and the radius can lie; only runs that reach there are read, all others count as one weighted value.
So no task holds more than some blocks, however dense a series is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .order import numbered

#: Length of a window, in microseconds.
MINUTES_60 = 60 * 60 * 1_000_000
#: Rows of a window's length and of the one before that a task gets whole, and window's lengths of a task at most.
MOST_ROWS, MOST_HOURS = 1 << 19, 8
#: Places in a block at least and at most; in between, four times the longest window.
LEAST_BLOCK, MOST_BLOCK = 1 << 13, 1 << 17
#: Runs in a block's sorted values.
RUNS = 8
_FAR_OFF = 1 << 62


class PrefixCounts:
    """Values in order of place; counts and order statistics of any range of places, for many ranges at once.

    ``weights`` are how often each value counts (once where None).
    """

    def __init__(self, values: np.ndarray, weights: np.ndarray | None = None):
        self.distinct, rank = np.unique(values, return_inverse=True)
        self.bits = max(1, int(len(self.distinct) - 1).bit_length()) if len(values) else 0
        self.zeros, self.sums = [], [self._running(weights)]
        for bit in range(self.bits - 1, -1, -1):
            upper = (rank >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~upper))).astype(np.int32))
            order = np.concatenate((np.flatnonzero(~upper), np.flatnonzero(upper)))
            rank = rank[order]
            weights = None if weights is None else weights[order]
            self.sums.append(self._running(weights))

    @staticmethod
    def _running(weights: np.ndarray | None) -> np.ndarray | None:
        return None if weights is None else np.concatenate(([0], np.cumsum(weights)))

    def _held(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = self.sums[level]
        return b - a if sums is None else sums[b] - sums[a]

    def total(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._held(0, a, b)

    def nth(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n``-th smallest value (from 1) of each range."""
        rank = np.zeros(len(a), np.int64)
        for level, zeros in enumerate(self.zeros):
            za, zb = zeros[a], zeros[b]
            lower = self._held(level + 1, za, zb)
            right = n > lower
            n = np.where(right, n - lower, n)
            a, b = np.where(right, zeros[-1] + a - za, za), np.where(right, zeros[-1] + b - zb, zb)
            rank = rank << 1 | right
        return self.distinct[rank]

    def below(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range are less than ``bound``."""
        rank = np.searchsorted(self.distinct, bound)
        whole = rank >= 1 << self.bits
        out = np.where(whole, self.total(a, b), 0)
        rank = np.where(whole, 0, rank)
        for level, zeros in enumerate(self.zeros):
            za, zb = zeros[a], zeros[b]
            right = (rank >> (self.bits - 1 - level) & 1).astype(bool)
            out += np.where(right, self._held(level + 1, za, zb), 0)
            a, b = np.where(right, zeros[-1] + a - za, za), np.where(right, zeros[-1] + b - zb, zb)
        return out


def medians(found: PrefixCounts, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, median2, mad4) of the ranges; the latter two mean nothing where n < 2."""
    n = found.total(a, b)
    median, mad = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    some = np.flatnonzero(n >= 2)
    if len(some):
        a, b, size = a[some], b[some], n[some]
        low, high = (size + 1) // 2, size // 2 + 1
        middle = found.nth(a, b, low) + found.nth(a, b, high)
        median[some], mad[some] = middle, _deviations(found, a, b, size, middle, low, high)
    return n, median, mad


def _deviations(found: PrefixCounts, a, b, size, middle, low, high) -> np.ndarray:
    """The sum of the ``low``-th and ``high``-th smallest of |2 * value - middle| in each range."""

    def within(at, radius):
        first, last = -((radius - middle[at]) // 2), (middle[at] + radius) // 2  # ceiling and floor
        under, upto = found.below(a[at], b[at], first), found.below(a[at], b[at], last + 1)
        return under, upto

    skipped = (size - low) // 2  # the values from there on are enough: their farthest end bounds the radius
    left, right = found.nth(a, b, skipped + 1), found.nth(a, b, skipped + low)
    lower, upper = np.zeros(len(a), np.int64), np.maximum(middle - 2 * left, 2 * right - middle)
    open_ = np.flatnonzero(lower < upper)
    while len(open_):
        tried = (lower[open_] + upper[open_]) // 2
        under, upto = within(open_, tried)
        enough = upto - under >= low[open_]
        upper[open_] = np.where(enough, tried, upper[open_])
        lower[open_] = np.where(enough, lower[open_], tried + 1)
        open_ = open_[lower[open_] < upper[open_]]
    second = upper.copy()
    at = np.flatnonzero(high > low)
    if len(at):
        under, upto = within(at, upper[at])
        at, under, upto = (x[upto - under < high[at]] for x in (at, under, upto))
    if len(at):  # the next deviation is that of the next value on either side
        after = 2 * found.nth(a[at], b[at], np.minimum(upto + 1, size[at])) - middle[at]
        before = middle[at] - 2 * found.nth(a[at], b[at], np.maximum(under, 1))
        second[at] = np.minimum(np.where(upto < size[at], after, _FAR_OFF), np.where(under > 0, before, _FAR_OFF))
    return upper + second


RESULT = "series string, ts long, n long, median2 long, mad4 long"


def _rows(series: str, ts: pa.ChunkedArray, n: np.ndarray, median: np.ndarray, mad: np.ndarray) -> pa.Table:
    few = n < 2
    return pa.table({"series": pa.array([series] * len(n), pa.string()), "ts": ts, "n": pa.array(n, pa.int64()), "median2": pa.array(median, pa.int64(), mask=few), "mad4": pa.array(mad, pa.int64(), mask=few)})


def _ints(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[c].to_numpy().astype(np.int64) for c in names]


def _near(points: DataFrame, windows: DataFrame, block: int, longest: int) -> DataFrame:
    """Windows that end in a block and start no earlier than in the one before."""

    def run(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        place, cents = _ints(held, "place", "cents")
        order = np.argsort(place)
        place, (a, b) = place[order], _ints(asked, "a", "b")
        found = PrefixCounts(cents[order])
        return _rows(key[0].as_py(), asked["ts"], *medians(found, np.searchsorted(place, a), np.searchsorted(place, b)))

    own = F.floor(F.col("place") / F.lit(block)).cast("long")
    reached = F.col("place") % block >= block - min(longest, block)
    held = points.select("series", "place", "cents", F.explode(F.when(reached, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"))
    return held.groupBy("series", "block").cogroup(windows.select("series", "ts", "a", "b", F.col("eb").alias("block")).groupBy("series", "block")).applyInArrow(run, RESULT)


def pieces(low: int, high: int) -> Iterator[tuple[int, int]]:
    """(level, node) that together cover the blocks from ``low`` up to ``high``: node ``i`` of level ``k`` is 2**k blocks from i * 2**k."""
    while low < high:
        level = min((low & -low).bit_length() - 1 if low else 62, (high - low).bit_length() - 1)
        yield level, low >> level
        low += 1 << level


def bracket(low: np.ndarray, high: np.ndarray, size: np.ndarray, apart: int) -> list[tuple[int, int]]:
    """Between which values the medians, and the values at the radius on either side, of windows can lie.

    A window is the values of all runs (least ``low``, greatest ``high``, ``size`` of them) and at most
    ``apart`` others.
    """
    lows, highs = np.argsort(low, kind="stable"), np.argsort(high, kind="stable")
    starts, ends = low[lows], high[highs]
    started, ended = np.concatenate(([0], np.cumsum(size[lows]))), np.concatenate(([0], np.cumsum(size[highs])))
    least, most = (int(size.sum()) - apart) // 2, (int(size.sum()) + apart) // 2 + 1

    def at_most(x):  # how many values are x or less, if runs count once they start, or once they have ended
        return started[np.searchsorted(starts, x, "right")]

    def surely(x):
        return ended[np.searchsorted(ends, x, "right")]

    first = int(starts[np.searchsorted(started[1:], least)]) if least > 0 else -_FAR_OFF
    last = int(ends[np.searchsorted(ended[1:], most)]) if most <= ended[-1] else _FAR_OFF
    if least <= 0 or most > ended[-1]:
        return [(-_FAR_OFF, _FAR_OFF)]

    def radius(enough) -> int:
        lower, upper = 0, 2 * int(max(ends[-1] - first, last - starts[0])) + 2
        while lower < upper:
            tried = (lower + upper) // 2
            lower, upper = (lower, tried) if enough(tried) else (tried + 1, upper)
        return lower

    near = radius(lambda r: at_most(last + r // 2) - surely(first - r // 2 - 1) >= least)
    wide = radius(lambda r: surely((2 * first + r) // 2) - at_most(-((r - 2 * last) // 2) - 1) >= most)
    return [(first - wide // 2 - 2, last - near // 2 + 2), (first - 1, last + 1), (first + near // 2 - 2, last + wide // 2 + 2)]


def _far(points: DataFrame, windows: DataFrame, block: int) -> DataFrame:
    """Windows of more blocks: those with one first and one last block are a group, which shares all blocks between."""
    group, piece, run_size = ["series", "sb", "eb"], ["series", "level", "node"], max(1, block // RUNS)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, x, y, *p) for s, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in pieces(x + 1, y)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] + [pa.int64()] * 4, strict=True)], names=[*group, "level", "node"])

    groups = written(windows.select(*group).distinct(), "groups")
    covers = written(groups.mapInArrow(cover, "series string, sb long, eb long, level long, node long"), "covers")
    levels = [r.level for r in covers.select("level").distinct().collect()]  # a logarithm of the blocks in a window
    own = F.floor(F.col("place") / F.lit(block)).cast("long")
    members = points.withColumn("block", own).select("series", "place", "cents", "block", F.explode(F.array(*(F.lit(x).cast("long") for x in levels))).alias("level"))
    members = members.select("series", "level", F.floor(F.col("block") / F.pow(F.lit(2.0), F.col("level"))).cast("long").alias("node"), "cents", "place")
    members = numbered(members.join(covers.select(*piece).distinct(), piece, "left_semi"), piece, ["cents", "place"], "rank")
    members = written(members.select(*piece, F.floor(F.col("rank") / F.lit(run_size)).cast("long").alias("run"), "cents"), "members")
    runs = members.groupBy(*piece, "run").agg(F.min("cents").alias("low"), F.max("cents").alias("high"), F.count("*").alias("size"))

    def choose(key: tuple, held: pa.Table) -> pa.Table:
        low, high, size = _ints(held, "low", "high", "size")
        read = np.zeros(len(low), bool)
        for x, y in bracket(low, high, size, 2 * block):
            read |= (low <= y) & (high >= x)
        read &= low < high  # runs of one value need no reading
        same = {c: pa.array([k.as_py()] * len(low), t) for c, k, t in zip(group, key, (pa.string(), pa.int64(), pa.int64()), strict=True)}
        return pa.table({**same, **{c: held[c] for c in ("level", "node", "run")}, "cents": pa.array(low, mask=read), "weight": pa.array(size, mask=read)})

    chosen = written(covers.join(runs, piece).groupBy(*group).applyInArrow(choose, "series string, sb long, eb long, level long, node long, run long, cents long, weight long"), "chosen")
    read = chosen.where("weight IS NULL").select(*group, "level", "node", "run").join(members, [*piece, "run"]).groupBy(*group, "cents").agg(F.count("*").alias("weight"))
    inner = read.union(chosen.where("weight IS NOT NULL").groupBy(*group, "cents").agg(F.sum("weight"))).select(*group, F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"), "cents", "weight")
    ends = groups.select(*group, F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("sb").alias("block")), F.struct(F.lit(2).alias("part"), F.col("eb").alias("block")))).alias("x")).select(*group, "x.*")
    outer = ends.join(points.withColumn("block", own), ["series", "block"]).select(*group, "part", "place", "cents", F.lit(1).cast("long").alias("weight"))

    def run(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        part, place, cents, weight = _ints(held, "part", "place", "cents", "weight")
        order = np.lexsort((place, part))
        part, place = part[order], place[order]
        found, (a, b) = PrefixCounts(cents[order], weight[order]), _ints(asked, "a", "b")
        last = int(np.searchsorted(part, 2))
        return _rows(key[0].as_py(), asked["ts"], *medians(found, np.searchsorted(place[: int(np.searchsorted(part, 1))], a), last + np.searchsorted(place[last:], b)))

    return outer.union(inner).groupBy(*group).cogroup(windows.select(*group, "ts", "a", "b").groupBy(*group)).applyInArrow(run, RESULT)


def _micros(clicks: DataFrame) -> Column:
    """``ts`` in microseconds since 1970; a time without a zone is counted as it stands, whatever the session's zone."""
    if clicks.schema["ts"].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros("ts")
    since = "(ts - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    units = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000}
    return F.expr(" + ".join(f"CAST(CAST(extract({unit} FROM {since}) AS DECIMAL(18, 6)) * {size}L AS BIGINT)" for unit, size in units.items()))


def rolling_median(clicks: DataFrame, window: int = MINUTES_60, most_rows: int = MOST_ROWS, least_block: int = LEAST_BLOCK, most_block: int = MOST_BLOCK) -> DataFrame:
    """``click_id``, ``kind``, ``n``, ``median2``, ``mad4`` and ``far`` of every click that has a time.

    Clicks of one kind (null is a kind) are a series. Cents are floor(100 * value + 0.5); a null, NaN or
    infinite value has none. A window holds the cents of its series' clicks later than ``window``
    microseconds before the click and no later than the click, all those of its own time included.
    ``n`` counts them; ``median2`` is the doubled median, ``mad4`` the doubled median of |2 * cents - median2|;
    ``far`` is 2 * |2 * c - median2| > 3 * mad4 of the click's own cents. Below two cents the three are null.

    An id of several rows counts once, with the earliest of its rows (by time, kind, value); a null id
    is one id. Clicks of one time share a window. An empty table gives an empty result. Other columns
    are dropped, so that their names can't clash.
    """
    value = F.col("value").cast("double")
    cents = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(F.floor(value * 100 + 0.5))
    ts = _micros(clicks)
    rows = clicks.where("ts IS NOT NULL").select("click_id", F.struct(ts.alias("ts"), F.col("kind").cast("string").alias("kind"), cents.alias("cents")).alias("row"))
    once = rows.groupBy("click_id").agg(F.min("row").alias("row")).select(F.coalesce(F.concat(F.lit("="), "row.kind"), F.lit("")).alias("series"), "click_id", "row.ts", "row.cents")
    once = written(once.withColumn("hour", F.floor(F.col("ts") / F.lit(window)).cast("long")), "once")
    hours = written(once.groupBy("series", "hour").agg(F.count("*").alias("rows")), "hours")
    before = hours.select("series", (F.col("hour") + 1).alias("hour"), F.col("rows").alias("more"))
    both = hours.join(before, ["series", "hour"], "full_outer").select("series", "hour", (F.coalesce("rows", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("held"))
    dense = written(both.where(F.col("held") > most_rows).select("series", "hour"), "dense")
    most = both.where(F.col("held") <= most_rows).agg(F.max("held")).first()[0] or 1
    width = max(1, min(MOST_HOURS, most_rows // (4 * most)))
    if not dense.limit(1).count():
        found = _within_hours(once.withColumn("asked", F.lit(True)), window, width)
    else:
        same, ahead = dense.select("series", "hour", F.lit(True).alias("own")), dense.select("series", (F.col("hour") - 1).alias("hour"), F.lit(True).alias("next"))
        told = written(once.join(small(same), ["series", "hour"], "left").join(small(ahead), ["series", "hour"], "left"), "told")
        calm = told.where("own IS NULL OR next IS NULL").withColumn("asked", F.col("own").isNull())
        crowded = told.where("own OR next").withColumn("asked", F.col("own").isNotNull())
        found = _within_hours(calm, window, width).union(_by_place(crowded, window, least_block, most_block))
    kind = F.when(F.col("series") != "", F.substring("series", 2, 1 << 30)).alias("kind")
    far = 2 * F.abs(2 * F.col("cents") - F.col("median2")) > 3 * F.col("mad4")
    return found.select("click_id", kind, "n", "median2", "mad4", far.alias("far"))


def _within_hours(rows: DataFrame, window: int, width: int) -> DataFrame:
    """Clicks whose windows hold few enough rows: a task gets ``width`` windows' length of a series and the clicks of one before."""
    id_type = rows.schema["click_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        (ts,), cents = _ints(group, "ts"), group["cents"].combine_chunks()
        asked = group["asked"].to_numpy(zero_copy_only=False)
        held = ~cents.is_null().to_numpy(zero_copy_only=False)
        times, values = ts[held], cents.fill_null(0).to_numpy()[held]
        order = np.argsort(times, kind="stable")
        times = times[order]
        ends, back = np.unique(ts[asked], return_inverse=True)
        n, median, mad = (x[back] for x in medians(PrefixCounts(values[order]), np.searchsorted(times, ends - window, "right"), np.searchsorted(times, ends, "right")))
        few, own = n < 2, group.filter(pa.array(asked))
        return pa.table({"series": own["series"], "click_id": own["click_id"], "cents": own["cents"], "n": pa.array(n, pa.int64()), "median2": pa.array(median, pa.int64(), mask=few), "mad4": pa.array(mad, pa.int64(), mask=few)})

    stretch = F.floor(F.col("hour") / F.lit(width)).cast("long")
    last = F.pmod(F.col("hour"), F.lit(width)) == width - 1  # the windows of the next stretch reach into these
    own = F.struct(stretch.alias("stretch"), F.col("asked"))
    dealt = rows.select("series", "click_id", "ts", "cents", F.explode(F.when(last, F.array(own, F.struct((stretch + 1).alias("stretch"), F.lit(False).alias("asked")))).otherwise(F.array(own))).alias("x"))
    return dealt.select("series", "click_id", "ts", "cents", "x.*").groupBy("series", "stretch").applyInArrow(run, f"series string, click_id {id_type}, cents long, n long, median2 long, mad4 long")


def _by_place(rows: DataFrame, window: int, least_block: int, most_block: int) -> DataFrame:
    """Clicks of any density, by places and blocks of them."""
    # a click, and behind all clicks of its time the start of the windows that begin there
    click = F.struct(F.col("ts").alias("time"), F.lit(0).cast("byte").alias("role"), "click_id", "cents")
    start = F.struct((F.col("ts") - window).alias("time"), F.lit(1).cast("byte").alias("role"), F.lit(None).cast(rows.schema["click_id"].dataType).alias("click_id"), F.lit(None).cast("long").alias("cents"))
    both = rows.select("series", "ts", "asked", F.explode(F.when(F.col("asked"), F.array(click, start)).otherwise(F.array(click))).alias("x")).select("series", "ts", "asked", "x.*")
    placed = written(numbered(both, ["series"], ["time", "role", "click_id"], "place"), "placed")
    own = F.when(F.col("role") == 0, F.col("place"))
    windows = placed.where("asked").groupBy("series", "ts").agg(F.max(F.when(F.col("role") == 1, F.col("place"))).alias("a"), (F.max(own) + 1).alias("b"))
    windows = written(windows, "windows")
    longest = windows.agg(F.max(F.col("b") - F.col("a"))).first()[0] or 0
    block = least_block
    while block < most_block and block < 4 * longest:
        block *= 2
    windows = windows.select("*", F.floor(F.col("a") / F.lit(block)).cast("long").alias("sb"), F.floor((F.col("b") - 1) / F.lit(block)).cast("long").alias("eb"))
    points = placed.where("role = 0 AND cents IS NOT NULL").select("series", "place", "cents")
    found, far = _near(points, windows.where("eb - sb <= 1"), block, longest), windows.where("eb - sb > 1")
    if longest > block and far.limit(1).count():  # windows that reach over a whole block
        found = found.union(_far(points, far, block))
    return placed.where("asked AND role = 0").join(written(found, "found"), ["series", "ts"]).select("series", "click_id", "cents", "n", "median2", "mad4")
