"""Best-fit packing of documents into sequences by a configuration linear program.

1. Executors tokenise whole texts and cut those beyond the capacity; only lengths and checksums stay.
2. The histogram of lengths (at most ``capacity`` rows, however many documents) goes to the driver.
3. There the configuration LP (fewest sequences whose fillings cover the histogram) is solved by
   multiplicative weights until every length is covered: prices of lengths fall as they are covered,
   and a knapsack dynamic program over the capacity finds the fillings of the highest price. Steps
   shrink with what is left, so that all lengths are used up together. Each program gives many
   fillings, and its prices give a lower bound by duality.
4. The solution is rounded along its fillings in order, so that alike fillings keep their number. Those
   that the counts allow are taken whole; of the others only the longest pieces, and what is left over
   goes into their rooms best fit, longest first. The plan of the fewest sequences counts. Plain best
   fit is tried too, so the result never needs more sequences than it.
5. The plan says for every length which ordinals go to which sequence and offset. Pieces that fill a
   sequence need no ordinal. The others get theirs within (length, salt) groups of about ``GROUP_ROWS``
   rows, as many groups as it takes, so a frequent length is no hot key.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, small, written
from .tokenise import LibraryIds, Pieces, blocks, encode_block

CAPACITY = 2048
#: Least fillings taken from a knapsack program; the share of what is left that one filling covers at most, and
#: the least such share; the rate of the weights.
FILLINGS, STEP, LEAST_STEP, RATE = 256, 0.03, 1e-4, 0.5
#: Pieces of one length in a group that numbers them.
GROUP_ROWS = 500


# --- the plan: driver side, over the histogram ------------------------------------------------


def _fillings(lengths: np.ndarray, prices: np.ndarray, capacity: int, most: int) -> tuple[list[Counter], float]:
    """Up to ``most`` fillings of high price, by an unbounded knapsack over the capacity, and the highest price of any."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        k = int(fits[room])
        value = best[room - lengths[:k]] + prices[:k]
        j = int(value.argmax())
        if value[j] > best[room - 1]:
            best[room], last[room] = value[j], j
        else:
            best[room] = best[room - 1]
    value = prices + best[capacity - lengths]
    out, seen = [], set()
    for first in np.argsort(-value, kind="stable")[:most].tolist():
        parts, room = [int(lengths[first])], capacity - int(lengths[first])
        while room > 0:
            if last[room] < 0:
                room -= 1
                continue
            parts.append(int(lengths[last[room]]))
            room -= parts[-1]
        if (key := tuple(sorted(parts))) not in seen:
            seen.add(key)
            out.append(Counter(parts))
    return out, float(best[capacity])


def solve_lp(counts: dict[int, int], capacity: int = CAPACITY, rate: float = RATE, step: float = STEP) -> tuple[dict[tuple[int, ...], float], float]:
    """({filling: number}, bound): fillings that cover the histogram fractionally, none beyond its counts.

    ``left`` is the open share of each length's count. A length's weight is exp(``rate`` * (its share /
    the mean share)), its price the weight times the length. A filling covers at most ``step`` of the
    mean share, so the rounds needed grow with the logarithm of the precision, and no length is used up
    long before the others. ``bound`` is the best dual bound met: no packing, fractional or not, has
    fewer sequences.
    """
    lengths = np.array(sorted(counts))
    if not len(lengths):
        return {}, 0.0
    total = np.array([counts[int(x)] for x in lengths], float)
    volume = total * lengths
    place = {int(x): i for i, x in enumerate(lengths)}
    left, out, bound = np.ones(len(lengths)), Counter(), float(volume.sum() / capacity)
    while (open_ := left > 0).any():
        mean = float((left * volume).sum() / volume[open_].sum())
        prices = np.where(open_, lengths * np.exp(np.clip(rate * (left / mean - 1), -3, 3)), 0)
        found, most = _fillings(lengths[open_], prices[open_], capacity, max(FILLINGS, len(lengths) // 3))
        bound = max(bound, float((total * prices).sum() / most))
        share = max(step * mean, LEAST_STEP)
        for filling in found:
            number = min(min(left[place[x]], share) * total[place[x]] / n for x, n in filling.items())
            if number > 0:
                for x, n in filling.items():
                    left[place[x]] -= number * n / total[place[x]]
                out[tuple(sorted(filling.elements(), reverse=True))] += number
        left[left < 1e-9] = 0
    return dict(out), bound


def best_fit(counts: dict[int, int], capacity: int = CAPACITY, begun: Iterable[tuple[int, tuple[int, ...]]] = ()) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first, over a histogram: (number, lengths) groups of equal sequences, those ``begun`` among them."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def add(room: int, number: int, parts: tuple[int, ...]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((number, parts))

    for number, parts in begun:
        add(capacity - sum(parts), number, parts)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    add(capacity - each * length, left // each, (length,) * each)
                    left %= each
                else:
                    add(capacity - left * length, 1, (length,) * left)
                    left = 0
                continue
            room = rooms[at]
            number, parts = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            used = min(number, left)
            add(room - length, used, (*parts, length))
            if number > used:
                add(room, number - used, parts)
            left -= used
    return [(n, parts) for room in rooms for n, parts in groups[room]]


def _rounded(solved: dict[tuple[int, ...], float], counts: dict[int, int], kept: int, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """The solution in whole numbers. Of a filling that the counts don't allow the ``kept`` longest pieces stay together.

    Numbers are rounded by a running sum over the fillings in order of their pieces, so every run of
    alike fillings keeps its number to within one. The fullest fillings then come first.
    """
    drawn, due = [], 0.5
    for parts, number in sorted(solved.items()):
        due += number
        if n := int(due):
            due -= n
            drawn.append((n, parts))
    left, begun = dict(counts), []
    for n, parts in sorted(drawn, key=lambda x: (-sum(x[1]), x[1])):
        need = Counter(parts)
        whole = min(n, *(left[x] // k for x, k in need.items()))
        if whole:
            begun.append((whole, parts))
            for x, k in need.items():
                left[x] -= whole * k
        for _ in range(n - whole):
            have = []
            for x in parts:
                if left[x] and len(have) < kept:
                    left[x] -= 1
                    have.append(x)
            if not have:  # none of its pieces is left, nor will be
                break
            begun.append((1, tuple(have)))
    return best_fit({x: n for x, n in left.items() if n}, capacity, begun)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(number, lengths) groups that hold every length exactly as often as the histogram has it.

    The program's rounded solution counts where plain best fit does not need fewer sequences.
    """
    left = {x: n for x, n in counts.items() if n and x != capacity}
    whole = [(counts[capacity], (capacity,))] if counts.get(capacity) else []
    solved, _ = solve_lp(left, capacity)
    plans = [*(_rounded(solved, left, kept, capacity) for kept in (1, 2, capacity)), best_fit(left, capacity)]
    return whole + min(plans, key=lambda p: sum(n for n, _ in p))


def slots(groups: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each length the ranges of its ordinals: first ordinal, first sequence, offset; sorted by key."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for number, parts in groups:
        offset = 0
        for x in parts:
            rows.append(((x << 40) | used[x], used[x], sequence, offset))
            used[x] += number
            offset += x
        sequence += number
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": a[:, 0].copy(), "first": a[:, 1].copy(), "sequence": a[:, 2].copy(), "offset": a[:, 3].copy()}


# --- executors --------------------------------------------------------------------------------

_ENCODERS: dict[str, tuple] = {}


def _encoder(vocabulary: str) -> tuple[Pieces, Callable[[str], bytes]]:
    """The worker's dictionary of pieces, and a function for whole texts."""
    if vocabulary not in _ENCODERS:
        ids = LibraryIds(vocabulary)
        release()  # what reading the vocabulary took
        _ENCODERS[vocabulary] = (Pieces(lambda pieces: ids.many([" " + x for x in pieces])), lambda text: ids.many([text])[0] if text else b"")
    return _ENCODERS[vocabulary]


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut into pieces.

    A document of more than ``capacity`` tokens is cut so that its first piece is the shorter one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what earlier stages left in this worker
        pieces, whole = _encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, out = 0, [[], [], [], [], []]
            for texts in blocks(batch, 1):
                for packed in encode_block(texts, pieces, whole):
                    packed += end
                    n = len(packed) // 4
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
                        for column, value in zip(out, (row, k, a, b - a, zlib.crc32(packed[4 * a : 4 * b])), strict=True):
                            column.append(value)
                    row += 1
            took = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=[doc_id, "piece", "start", "length", "ids_crc32"])
        release()

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``.

    A null text counts as empty: it is packed as its end id alone. Repeated rows are packed once
    each, as rows of their own; a null id is packed like any other. A text of any length is cut into
    full pieces and one shorter first piece. Ties (equal lengths) go by id and piece. An empty table
    gives an empty result; other columns are dropped, whatever their names. Full pieces are sequences
    of their own, with negative numbers.
    """
    pieces = written(pieces_of(docs, vocabulary, capacity, end_id, text, doc_id).withColumnRenamed(doc_id, "doc"), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    short = {x: n for x, n in counts.items() if x != capacity}
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(short, capacity)))
    groups = docs.sparkSession.createDataFrame([(x, -(-n // GROUP_ROWS)) for x, n in short.items()] or [(0, 1)], "length long, groups long")
    salted = written(pieces.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.col("groups"))).drop("groups"), "salted")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    offsets = small(written(sizes.select("length", "salt", before.alias("before")), "offsets"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc", "piece", "ids_crc32")) - 1
    numbered = salted.withColumn("at", inside).join(offsets, ["length", "salt"]).select("doc", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("at"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = table.value
        for batch in batches:
            length, at = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            k = np.searchsorted(to["key"], (length << 40) | at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(to["sequence"][k] + at - to["first"][k]), pa.array(to["offset"][k])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    placed = numbered.mapInArrow(place, f"doc {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).select("doc", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(full).withColumnRenamed("doc", doc_id)
