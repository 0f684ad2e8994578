"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles. Those with equal sets are one class from the start and are
represented by one of them, so copies are never joined. Then:

1. Each set keeps a consistent sample of its shingles, its *pool* (about ``POOL / threshold``; small
   sets keep all). A shingle's hash decides, so similar sets sample alike, and pools estimate Jaccard.
2. Paths of length one: a set chooses a shingle with probability ``RUNS / (threshold * size)``, the
   ``RUNS`` repetitions of the chosen-path step at once. Small sets choose all their shingles.
   A set goes by the ``RAREST`` half of its paths alone. Similar sets share most shingles, rank them
   alike, and so meet in the rare ones; sets that share a common passage and no more don't meet at all.
3. A bucket (a path and its sets) of at most ``LEAF`` sets is compared all against all, on pools. In
   a larger one every set is held against ``PIVOTS`` pivots and is joined to all that are loosely
   near (``LOOSE``): by a link to one of them, and links between pivots, once a batch. Sets at least ``NEAR`` to one leave the bucket: whatever they are similar to is,
   by the triangle inequality, loosely near that pivot as well and gets its own link there. The rest
   choose again, extending the path, and so split recursively. After ``DEPTH`` levels what is left is
   compared in square blocks, each a task of its own: the exact way for what paths can't split.
4. The links so found are loose (well below the threshold). Of a block only those are kept that join
   what the block's halves don't join by themselves, so their number is about that of the sets. Their
   connected components should hold every pair at the threshold. How many do is measured: a bounded
   sample of sets is held against all sets, and the chosen-path runs are repeated with other hashes
   until ``RECALL`` of the sample's pairs lie in one component.
5. In each component all pairs of whole sets are compared exactly, a task for each block of sets and
   the rest streaming past it. A task returns one row of counts for each of its sets, and links that
   join what isn't joined yet; never pairs.

No bucket or component is capped; large ones only cost more tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, release, small, written

SHINGLE, THRESHOLD = 5, 0.8
RUNS, POOL, LEAF, DEPTH, PIVOTS = 18, 72, 64, 5, 8
#: Share of a sample's pairs that the runs must find, sets in the sample, and runs at most (then an error).
RECALL, SAMPLE, MOST_RUNS = 0.97, 256, 8
#: Share of a set's first paths, the rarest ones, that it goes by.
RAREST = 0.5
#: Children of a set in a bucket that splits, on average, times the threshold.
BRANCH = 1.0
#: Pool estimates that link, and that let a set leave a bucket.
LOOSE, NEAR = 0.35, 0.6
#: Large buckets whose pivots (of about 6 KB) may be broadcast.
BROADCAST_PIVOTS = 2_500
#: Sets in a block of the exact comparison, and shingles in one (blocks of long texts hold fewer sets).
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Words a worker keeps the hashes of.
_WORD_CACHE = 100_000
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M[5]
    x = (x ^ (x >> np.uint64(29))) * _M[6]
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= _WORD_CACHE:
            self.clear()
        self[word] = value
        return value


_WORDS = _Words()


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``size`` lower-case words (between white space).

    A text of fewer words is one shingle of all of them; one without a word has none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(31))) * _M[i % 5] + w[i : i + n]
    return np.unique(_mix(h))


def _unit(h: np.ndarray) -> np.ndarray:
    """Hash -> a number from 0 to 1, of bits that paths don't use otherwise."""
    return (_mix(h ^ _M[7]) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def pool_of(h: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The pool of a set."""
    return h[_unit(h) < POOL / (threshold * max(1, len(h)))]


def first_paths(pool: np.ndarray, n: int, run: int, threshold: float = THRESHOLD) -> np.ndarray:
    """The pool's shingles that are paths of length one in a run; other runs choose by other hashes."""
    reach = min(1.0, POOL / (threshold * max(1, n)))  # the share of the set that is in the pool
    u = _unit(pool) / reach if run == 0 else _unit(pool ^ _mix(np.full(1, run, np.uint64))[0])
    return pool[u * reach < RUNS / (threshold * max(1, n))]


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    if not len(h):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(_mix(h).sum().astype(np.int64)), int(_mix(h ^ _M[0]).sum().astype(np.int64))


def sketch(docs: DataFrame, text: str, doc_id: str, threshold: float) -> DataFrame:
    """``id, n, f1, f2, pool``: size and fingerprint of the set, and its pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, pools = [], [], [], []
            for x in batch.column(1):
                h = shingles(x.as_py() or "")
                a, b = _fingerprint(h)
                n.append(len(h))
                f1.append(a)
                f2.append(b)
                pools.append(pool_of(h, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _binary(pools)], names=["id", "n", "f1", "f2", "pool"])
        _WORDS.clear()
        release()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n long, f1 long, f2 long, pool binary")


# --- pools ------------------------------------------------------------------------------------


def estimate(p: np.ndarray, n: int, q: np.ndarray, m: int, threshold: float = THRESHOLD) -> float:
    """Jaccard of two sets by their pools: exact if both pools are whole sets."""
    cut = POOL / (threshold * max(n, m))
    if cut < 1:
        p, q = p[_unit(p) < cut], q[_unit(q) < cut]
    both = len(np.intersect1d(p, q, assume_unique=True))
    total = len(p) + len(q) - both
    return both / total if total else 0.0


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``a`` shares with each of ``b``, by products of 0/1 blocks of columns."""
    la, lb = [len(x) for x in a], [len(x) for x in b]
    out = np.zeros((len(a), len(b)), np.float32)
    va, vb = np.concatenate(a), np.concatenate(b)
    if a is b:  # an element of one set alone matches nothing but itself
        values, counts = np.unique(va, return_counts=True)
        common = values[counts > 1]
    else:
        common = np.intersect1d(va, vb)
    if not len(common):
        return out
    ra, rb = np.repeat(np.arange(len(a)), la), np.repeat(np.arange(len(b)), lb)

    def placed(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, v)
        at[at == len(common)] = 0
        hit = common[at] == v
        at, r = at[hit], r[hit]
        order = np.argsort(at, kind="stable")
        return at[order], r[order]

    (ca, ra), (cb, rb) = placed(va, ra), placed(vb, rb)
    width = 4096
    for low in range(0, len(common), width):
        ja, jb = slice(*np.searchsorted(ca, (low, low + width))), slice(*np.searchsorted(cb, (low, low + width)))
        w = min(width, len(common) - low)
        x, y = np.zeros((len(a), w), np.float32), np.zeros((len(b), w), np.float32)
        x[ra[ja], ca[ja] - low] = 1
        y[rb[jb], cb[jb] - low] = 1
        out += x @ y.T
    return out


def _tree(hit: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Component of each place of a symmetric matrix, and the pairs of a spanning forest."""
    label, pairs = np.full(len(hit), -1), []
    for start in range(len(hit)):
        if label[start] >= 0:
            continue
        label[start], todo = start, [start]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(hit[i] & (label < 0)).tolist()
            label[new] = start
            pairs += [(i, j) for j in new]
            todo += new
    return label, pairs


def _bridges(lx: np.ndarray, ly: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``hit`` that join components of the rows with components of the columns, no more than it takes."""
    i, j = np.nonzero(hit)
    first = np.unique(lx[i] * len(ly) + ly[j], return_index=True)[1]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
        x, y = find(int(lx[a])), find(-1 - int(ly[b]))
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _loose(left: tuple, right: tuple) -> np.ndarray:
    """Which pools of one block (ids, sizes, pools) estimate at least LOOSE with which of another.

    A pool of a smaller set reaches further than that of a larger one, so its length counts as far as
    the larger set's cut is expected to leave it.
    """
    shared = _overlaps(left[2], right[2])
    big = np.maximum(left[1][:, None], right[1][None, :])
    la = np.array([len(x) for x in left[2]])[:, None] * np.minimum(1, left[1][:, None] / big)
    lb = np.array([len(x) for x in right[2]])[None, :] * np.minimum(1, right[1][None, :] / big)
    return shared * (1 + LOOSE) >= LOOSE * (la + lb)


def _joins(x: tuple, y: tuple | None, near) -> list[tuple[int, int]]:
    """Links of a block, or those between two blocks that join what neither block joins by itself."""
    label, pairs = _tree(near(x, x))
    if y is None:
        return [(int(x[0][i]), int(x[0][j])) for i, j in pairs]
    return [(int(x[0][i]), int(y[0][j])) for i, j in _bridges(label, _tree(near(y, y))[0], near(x, y))]


# --- blocks -----------------------------------------------------------------------------------


def _blocked(rows: DataFrame, key: str, blocks: Column, both: bool) -> DataFrame:
    """Rows of each key dealt into ``blocks`` blocks, each row sent to the tasks that need it.

    A task is a pair of blocks (x <= y), or with ``both`` one block x that all others pass by.
    """
    rows = rows.withColumn("_blocks", blocks.cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id", F.lit("block")), F.col("_blocks")).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    if both:
        return rows.withColumn("x", F.col("_with")).withColumn("y", F.when(F.col("_own") == F.col("_with"), -1).otherwise(F.col("_own"))).drop("_with", "_blocks")
    return rows.withColumn("x", F.least("_own", "_with")).withColumn("y", F.greatest("_own", "_with")).drop("_with", "_blocks")


def _runs(rows: DataFrame, keys: list[str], each, schema: str) -> DataFrame:
    """``each(table)`` on the rows of every key, a block of bounded size; yields tuples of ``schema``.

    One shuffle and a sort bring a key's rows together; a task walks its runs without a Python call
    a group for the rest of the batch.
    """
    kinds = pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in schema.split(", ")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, out = None, []

        def end() -> None:
            if held:
                out.extend(each(pa.Table.from_batches(held).combine_chunks()))
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in keys], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                key = tuple(k[a].tolist())
                if key != last:
                    end()
                    last = key
                held.append(batch.slice(a, b - a))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                out.clear()
        end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
            out.clear()
        release()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(walk, schema)


def _streams(rows: DataFrame, keys: list[str], part: str, each, schema: str) -> DataFrame:
    """As ``_runs``, but ``each`` gets the parts of a key one after another, so a task holds two parts at most."""
    kinds = pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in schema.split(", ")])
    columns = [*keys, part]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                key = tuple(k[a].tolist())
                if key != last and held:
                    yield last[:-1], pa.Table.from_batches(held).combine_chunks()
                    held.clear()
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield last[:-1], pa.Table.from_batches(held).combine_chunks()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
        for _, parts in groupby(cut(batches), key=lambda x: x[0]):
            for row in each(t for _, t in parts):
                out.append(row)
                if len(out) >= 10_000:
                    yield batch()
                    out.clear()
        if out:
            yield batch()
            out.clear()
        release()

    return rows.repartition(*keys).sortWithinPartitions(*keys, part, "id").mapInArrow(walk, schema)


def _columns(found: pa.Table, columns: tuple[str, ...]) -> tuple:
    """Columns of a block in order of its ids, one row an id; binary ones as lists of hashes."""
    ids = found["id"].to_numpy()
    if len(ids) > 1 and not (ids[1:] != ids[:-1]).all():
        found = found.take(pa.array(np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])))
    return tuple([np.frombuffer(x.as_py(), np.uint64) for x in found[c]] if pa.types.is_binary(found[c].type) else found[c].to_numpy() for c in columns)


def _sides(found: pa.Table, columns: tuple[str, ...]) -> list[tuple]:
    """Columns of one or two blocks of a tile."""
    own = found["_own"].to_numpy()
    return [_columns(found.filter(pa.array(own == block)), columns) for block in np.unique(own)]


def _leaf_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Loose links (a, b) inside the buckets of ``rows(path, count, id, n, pool)``."""

    def each(found: pa.Table) -> list[tuple[int, int]]:
        if found.num_rows < 2:
            return []
        sides = _sides(found, ("id", "n", "pool"))
        if len(sides) == 1 and len(sides[0][0]) <= 3:
            ids, sizes, pools = sides[0]
            pairs = [(i, j) for i in range(len(ids)) for j in range(i)]
            return [(int(ids[i]), int(ids[j])) for i, j in pairs if estimate(pools[i], int(sizes[i]), pools[j], int(sizes[j]), threshold) >= LOOSE]
        if len(sides) == 1 and found["x"][0] != found["y"][0]:
            return []  # the other block is empty; a block's own pairs are compared in its own tile
        return _joins(sides[0], sides[1] if len(sides) > 1 else None, _loose)

    return _runs(_blocked(rows, "path", F.ceil(F.col("count") / BLOCK), False), ["path", "x", "y"], each, "a long, b long")


def _flat(arrays: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of pools, and the row of each."""
    sets = [np.frombuffer(x.as_py(), np.uint64) if x.is_valid else np.empty(0, np.uint64) for x in arrays]
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])


def estimates(p: pa.Array, n: np.ndarray, q: pa.Array, m: np.ndarray, threshold: float) -> np.ndarray:
    """``estimate`` of whole columns, row by row; a null pool gives 0."""
    cut = POOL / (threshold * np.maximum(1, np.maximum(n, m)))

    def reached(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, row = _flat(column)
        keep = _unit(h) < cut[row]
        h, row = h[keep], row[keep]
        return _mix(h ^ (row.astype(np.uint64) * _M[1])), np.bincount(row, minlength=len(n))

    (a, la), (b, lb) = reached(p), reached(q)
    h, row = _flat(p)
    keep = _unit(h) < cut[row]
    both = np.bincount(row[keep][np.isin(a, b)], minlength=len(n))
    return both / np.maximum(1, la + lb - both)


def _split(rows: DataFrame, level: int, threshold: float, run: int) -> DataFrame:
    """Large buckets ``(path, id, n, pool, pivots)`` -> ``(kind, path, id)``: links to pivots (path = pivot) and longer paths."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, ids, sizes, pools = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            stay, first, links = np.ones(len(ids), bool), np.full(len(ids), -1), []
            for k in range(PIVOTS):
                slot = batch.column(4 + 3 * k)
                there, pivot = slot.is_valid().to_numpy(zero_copy_only=False), slot.fill_null(-1).to_numpy()
                near = estimates(pools, sizes, batch.column(6 + 3 * k), batch.column(5 + 3 * k).fill_null(0).to_numpy(), threshold)
                own = there & (pivot == ids)
                hit = (near >= LOOSE) & there & ~own
                stay &= ~(near >= NEAR) & ~own
                # one link a set; further pivots near the same sets are linked to that pivot, once a batch
                new, more = hit & (first < 0), hit & (first >= 0)
                links += [np.stack([pivot[new], ids[new]], 1), np.unique(np.stack([pivot[more], first[more]], 1), axis=0)]
                first[new] = pivot[new]
            links = np.concatenate(links)
            h, row = _flat(pools)
            count = np.maximum(1, np.bincount(row, minlength=len(ids)))
            seed = _mix(path.astype(np.uint64) * _M[3] + np.uint64((level + 64 * run) * int(_M[4]) & (1 << 64) - 1))
            u = _mix(h ^ seed[row])
            pick = stay[row] & ((u >> np.uint64(11)).astype(np.float64) * 2.0**-53 < (BRANCH / (threshold * count))[row])
            longer = _mix(u[pick] + seed[row[pick]]).astype(np.int64)
            kind = pa.array(["link"] * len(links) + ["path"] * len(longer), pa.string())
            yield pa.RecordBatch.from_arrays([kind, pa.array(np.concatenate([links[:, 0], longer])), pa.array(np.concatenate([links[:, 1], ids[row[pick]]]))], names=["kind", "path", "id"])
        release()

    slots = [F.get("pivots", k)[c].alias(f"{c}{k}") for k in range(PIVOTS) for c in ("pivot", "m", "q")]
    return rows.select("path", "id", "n", "pool", *slots).mapInArrow(go, "kind string, path long, id long")


def _paths(sets: DataFrame, run: int, threshold: float) -> DataFrame:
    """(path, id): of each set's paths of length one those of the fewest sets, ``RAREST`` of all it chose, if others have them."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [first_paths(np.frombuffer(x.as_py(), np.uint64), n, run, threshold) for n, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            each = np.array([len(x) for x in found], np.int64)
            at = np.repeat(np.arange(len(found)), each)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).astype(np.int64)), batch.column(0).take(pa.array(at)), pa.array(each[at])], names=["path", "id", "chosen"])
        release()

    rows = written(sets.select("id", "n", "pool").mapInArrow(go, "path long, id long, chosen long"), "paths")
    shared = rows.join(rows.groupBy("path").agg(F.count("*").alias("count")).where("count > 1").hint("merge"), "path")
    own = Window.partitionBy("id")
    ranked = shared.withColumn("place", F.row_number().over(own.orderBy("count", "path"))).withColumn("alone", F.col("chosen") - F.count("*").over(own))
    return written(ranked.where(F.col("alone") + F.col("place") <= F.ceil(RAREST * F.col("chosen"))).select("path", "id"), "rarest")


def candidates(sets: DataFrame, threshold: float = THRESHOLD, run: int = 0) -> DataFrame:
    """Loose links (a, b) between the rows of ``sets(id, n, pool)``, ids unique, by one run."""
    pools = sets.select("id", "n", "pool")
    rows = _paths(sets, run, threshold)
    links, leaves = [], []
    for level in range(1, DEPTH + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("count")).where("count > 1")
        held = written(rows.join(sizes.hint("merge"), "path"), f"level{level}")
        last = level == DEPTH
        leaves.append(held if last else held.where(F.col("count") <= LEAF))
        large = held.where(F.col("count") > LEAF)
        if last or not large.limit(1).count():
            break
        # up to PIVOTS sets a large bucket, the smallest id of each share of its sets: aggregated, never gathered
        wanted = written(large.groupBy("path", F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(PIVOTS)).alias("share")).agg(F.min("id").alias("pivot")).select("path", "pivot"), "pivots")
        few = wanted.count() <= PIVOTS * BROADCAST_PIVOTS
        found = pools.select(F.col("id").alias("pivot"), F.col("n").alias("m"), F.col("pool").alias("q")).join(F.broadcast(wanted) if few else wanted, "pivot")
        found = found.groupBy("path").agg(F.collect_list(F.struct("pivot", "m", "q")).alias("pivots"))
        near = large.select("path", "id").join(pools, "id").join(F.broadcast(found) if few else found.hint("merge"), "path")
        split = written(_split(near, level, threshold, run), f"split{level}")
        links.append(split.where("kind = 'link'").select(F.col("id").alias("a"), F.col("path").alias("b")).distinct())
        rows = split.where("kind = 'path'").select("path", "id").distinct()
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.union(x)
    links.append(_leaf_links(leaf.select("path", "count", "id").join(pools, "id"), threshold))
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return out


def sample_pairs(sets: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """(a, b): pairs of a sampled set a and any set b whose pools estimate the threshold, by brute force.

    The sample, ``most`` sets by a hash of the id, is the bound of what every task gets; all sets pass by it.
    """
    spark = sets.sparkSession
    some = sets.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(most).select("id", "n", "pool").toArrow()
    ids, sizes = some["id"].to_numpy(), some["n"].to_numpy()
    pools = [np.frombuffer(x.as_py(), np.uint64) for x in some["pool"]]
    shared = spark.sparkContext.broadcast((ids, sizes, pools))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, pools = shared.value
        flat = np.concatenate([np.empty(0, np.uint64), *pools])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(pools)), [len(x) for x in pools])[order]
        for batch in batches:
            h, row = _flat(batch.column(2))
            low, high = np.searchsorted(flat, h), np.searchsorted(flat, h, side="right")
            hits = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(hits)[:-1]], hits) + np.arange(hits.sum())
            pair, count = np.unique(np.repeat(row, hits) * len(pools) + owner[at], return_counts=True) if hits.sum() else (np.empty(0, np.int64), np.empty(0, np.int64))
            a, b = [], []
            n, own, sets_ = batch.column(1).to_numpy(), batch.column(0).to_numpy(), batch.column(2)
            for p, c in zip(pair.tolist(), count.tolist(), strict=True):
                j, k = divmod(p, len(pools))
                # a pool shares at most as much as it reaches: far pairs need no estimate
                if own[j] != ids[k] and 4 * c >= min(len(pools[k]), 8) and estimate(pools[k], int(sizes[k]), np.frombuffer(sets_[j].as_py(), np.uint64), int(n[j]), threshold) >= threshold:
                    a.append(int(ids[k]))
                    b.append(int(own[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        release()

    return sets.select("id", "n", "pool").mapInArrow(go, "a long, b long")


def loose_components(sets: DataFrame, threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
    """(id, comp) of the loose links, from as many runs as it takes to find ``target`` of the sample's pairs."""
    pairs = written(sample_pairs(sets, threshold), "sampled")
    total, links = pairs.count(), None
    for run in range(MOST_RUNS):
        more = written(candidates(sets, threshold, run), f"links{run}")
        links = more if links is None else links.union(more)
        comps = written(components(links), "loose")
        if not total:
            return comps
        a, b = comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        found = pairs.join(a, "a").join(b, "b").where("ca = cb").count()
        if found >= target * total:
            return comps
    raise RuntimeError(f"{MOST_RUNS} runs found {found} of {total} sampled pairs; the target is {target}")


def _exact(rows: DataFrame, threshold: float) -> DataFrame:
    """Counts and links of the components of ``rows(comp, count, total, id, copies, shingles)``.

    Returns (kind, a, b, c): ``sum`` a = id, b = linked sets, c = documents in them, one row a linked
    set; ``link`` a-b, which together join what the pairs at the threshold join.
    """

    def near(x: tuple, y: tuple) -> np.ndarray:
        shared = _overlaps(x[2], y[2])
        union = np.array([len(v) for v in x[2]])[:, None] + np.array([len(v) for v in y[2]])[None, :] - shared
        return shared >= threshold * union - 1e-6

    def each(parts: Iterator[pa.Table]) -> Iterator[tuple]:
        held = None
        for found in parts:  # the block itself comes first (y = -1), then the others in order
            at = _columns(found, ("id", "copies", "shingles"))
            if held is None:
                if found["y"][0].as_py() >= 0:
                    return  # no set of its own
                held, own = at, found["x"][0].as_py()
                hit = near(held, held)
                np.fill_diagonal(hit, False)
                sets, docs = hit.sum(1), (hit * held[1]).sum(1)
                label, pairs = _tree(hit)
                yield from (("link", int(held[0][i]), int(held[0][j]), 0) for i, j in pairs)
                continue
            hit = near(held, at)
            sets, docs = sets + hit.sum(1), docs + (hit * at[1]).sum(1)
            if found["y"][0].as_py() > own and hit.any():
                bridges = _bridges(label, _tree(near(at, at))[0], hit)
                yield from (("link", int(held[0][i]), int(at[0][j]), 0) for i, j in bridges)
        if held is not None:
            yield from (("sum", int(i), int(n), int(c)) for i, n, c in zip(held[0], sets, docs, strict=True) if n)

    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES))
    return _streams(_blocked(rows, "comp", blocks, True), ["comp", "x"], "y", each, "kind string, a long, b long, c long")


def _with_shingles(docs: DataFrame, members: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of ``members(id, rep, n, f1, f2, ...)`` with the whole shingle set of their document."""
    extra = [f for f in members.schema if f.name not in ("rep", "n", "f1", "f2")]
    rows = docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("text")).join(small(members), "rep")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py() or "") for x in batch.column(0)]
            marks = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            own = pa.array([(len(h), *_fingerprint(h)) == m for h, m in zip(sets, marks, strict=True)], pa.bool_())  # another row of the id may hold another text
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], _binary(sets)], names=[*(f.name for f in extra), "shingles"]).filter(own)
        _WORDS.clear()
        release()

    return rows.select("text", "n", "f1", "f2", *(f.name for f in extra)).mapInArrow(run, f"{kinds}, shingles binary")


def ngram_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: ``doc_id, class_id, n_links, n_text_links, class_size``.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at
    least ``threshold``. ``n_links`` counts the other documents a document is linked to (rows of one
    text count once an id), ``n_text_links`` those sets of shingles other than its own. ``class_id``
    is the largest id of its connected component, ``class_size`` the documents in it. Ids may be of
    any type that has an order. A null text counts as empty; texts without a word have no shingles
    and are linked to nothing. Repeated rows of an id give one row for each of its different sets;
    rows with a null id are left out. An empty table gives an empty result; other columns are dropped.
    """
    docs = docs.where(F.col(doc_id).isNotNull())
    rows = written(sketch(docs, text, doc_id, threshold), "sketch")
    once = rows.select("id", "n", "f1", "f2").distinct()
    groups = once.where("n > 0").groupBy("n", "f1", "f2").agg(F.max("id").alias("rep"), F.count("*").alias("copies"))
    groups = written(groups.withColumn("set", F.monotonically_increasing_id()), "groups")
    sets = rows.join(groups.withColumnRenamed("rep", "id"), ["id", "n", "f1", "f2"]).select(F.col("set").alias("id"), "n", "pool").dropDuplicates(["id"])
    comps = loose_components(written(sets, "sets"), threshold).withColumnRenamed("id", "set")
    totals = written(comps.join(groups, "set"), "found").select("comp", "n")
    counts = totals.groupBy("comp").agg(F.count("*").alias("count"), F.sum("n").alias("total"))
    members = comps.join(counts.hint("merge"), "comp").join(groups, "set").select(F.col("set").alias("id"), "comp", "count", "total", "copies", "rep", "n", "f1", "f2")
    found = written(_exact(_with_shingles(docs, written(members, "members"), text, doc_id), threshold), "exact")
    classes = components(found.where("kind = 'link'").select("a", "b")).withColumnRenamed("id", "set")
    sums = found.where("kind = 'sum'").select(F.col("a").alias("set"), F.col("b").alias("texts"), F.col("c").alias("linked"))
    reps = groups.join(classes, "set", "left").join(sums, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    sizes = reps.groupBy("comp").agg(F.sum("copies").alias("class_size"), F.max("rep").alias("class_id"))
    counted = (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    reps = written(reps.join(sizes.hint("merge"), "comp").select("n", "f1", "f2", "class_id", counted, F.coalesce("texts", F.lit(0)).alias("n_text_links"), "class_size"), "classes")
    out = once.where("n > 0").join(reps.hint("merge"), ["n", "f1", "f2"]).select("id", "class_id", "n_links", "n_text_links", "class_size")
    zero = F.lit(0).cast("long")
    lone = once.where("n = 0").select("id", F.col("id").alias("class_id"), zero.alias("n_links"), zero.alias("n_text_links"), F.lit(1).cast("long").alias("class_size"))
    return out.union(lone).withColumnRenamed("id", doc_id)
