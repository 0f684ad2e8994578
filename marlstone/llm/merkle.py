"""Merkle manifest of a dataset: a tree for each source, a tree over the sources, and a proof for every row.

A leaf is the digest of a row's fields, made by Spark's own functions in one scan. Leaves get their
places by ranges of (source, id), so a hot source is spread. The tree is built in aligned blocks of
``fanout ** BLOCK_LEVELS`` leaves: a task holds a block's digests as one contiguous matrix of 64 hex
bytes a row, reshapes it by the fanout and hashes its rows, level by level, down to one digest a
block. These are the nodes of the next tier, until each source has one; the sources' digests go
through the same tiers. Proofs come down again: each block gets the siblings above it as one row,
and finds those inside it by index arithmetic on its matrices. No task holds more than a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .exact_dedup import LOWER, UPPER
from .order import numbered

FANOUT = 16
#: Levels of the tree in a block: 4096 leaves at a fanout of 16.
BLOCK_LEVELS = 3
#: Hex digits of a digest.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value as text."""
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def tampered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """The digests as rows of 64 bytes."""
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, WIDTH)


def parents(level: np.ndarray, fanout: int) -> np.ndarray:
    """The level above: each run of ``fanout`` digests hashed, the last run with as many as there are."""
    whole = len(level) // fanout * fanout
    runs = list(level[:whole].reshape(-1, fanout * WIDTH))
    if whole < len(level):
        runs.append(level[whole:].reshape(-1))
    return np.frombuffer("".join(hashlib.sha256(run).hexdigest() for run in runs).encode(), np.uint8).reshape(-1, WIDTH)


def levels(leaves: np.ndarray, fanout: int, least: int) -> list[np.ndarray]:
    """All levels from the leaves to one digest, at least ``least`` above the leaves."""
    out = [leaves]
    while len(out[-1]) > 1 or len(out) <= least:
        out.append(parents(out[-1], fanout))
    return out


def siblings(level: np.ndarray, fanout: int) -> tuple[list[bytes], np.ndarray]:
    """Of each node the digests of the others in its run, left to right, and how many bytes of them stand before it."""
    node = np.arange(len(level))
    start = node // fanout * fanout
    place, others = node - start, np.minimum(fanout, len(level) - start) - 1
    at = np.arange(fanout - 1)
    index = np.minimum(start[:, None] + at + (at >= place[:, None]), len(level) - 1)
    rows = level[index].reshape(len(level), -1)
    return [row[: k * WIDTH].tobytes() for row, k in zip(rows, others.tolist(), strict=True)], place * WIDTH


def _least(block: int, rows: int, fanout: int, depth: int) -> int:
    """Levels that a block has in any case. Only a group's first block can be all of it, and then ends at one digest."""
    return 0 if block == 0 and rows < fanout**depth else depth


def _sorted(group: pa.Table) -> pa.Table:
    return group.sort_by("idx")


def _reduced(tier: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The tier above ``tier(key, idx, digest)``: one row a block."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        name, block = (x.as_py() for x in key)
        top = levels(matrix(_sorted(group)["digest"]), fanout, _least(block, len(group), fanout, depth))[-1]
        return pa.table({"key": [name], "idx": pa.array([block], pa.int64()), "digest": [top.tobytes().decode()]})

    blocks = tier.withColumn("block", F.floor(F.col("idx") / F.lit(fanout**depth)).cast("long"))
    return blocks.groupBy("key", "block").applyInArrow(run, "key string, idx long, digest string")


def _tiers(tier: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """``tier`` and those above it, the last with one row a key."""
    out = [tier]
    while (out[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        out.append(written(_reduced(out[-1], fanout, depth), "tier"))
    return out


PATH = "befores array<string>, afters array<string>, subroot string, root string"


def _steps(group: pa.Table, block: int, above: pa.Table, fanout: int, depth: int) -> list[tuple[int, list[bytes], np.ndarray]]:
    """The levels on the way from the rows of a block to the root: (rows to a node, siblings, bytes before), the shared ones above with one node."""
    found = levels(matrix(group["digest"]), fanout, _least(block, len(group), fanout, depth))
    out = [(fanout**k, *siblings(x, fanout)) for k, x in enumerate(found[:-1])]
    for before, after in zip(above["befores"][0].as_py(), above["afters"][0].as_py(), strict=True):
        out.append((1 << 62, [(before + after).encode()], np.array([len(before)])))
    return out


def _descended(tier: DataFrame, paths: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``paths(key, idx, befores, afters, subroot, root)`` of the blocks carried down to the nodes of ``tier(key, idx, digest)``."""

    def run(key: tuple, group: pa.Table, above: pa.Table) -> pa.Table:
        group, block = _sorted(group), key[1].as_py()
        steps, n = _steps(group, block, above, fanout, depth), len(group)
        befores, afters = [], []
        for i in range(n):
            cut = [(found[i // width].decode(), int(at[i // width])) for width, found, at in steps]
            befores.append([x[:at] for x, at in cut])
            afters.append([x[at:] for x, at in cut])
        same = {c: pa.array(above[c].to_pylist() * n, pa.string()) for c in ("subroot", "root")}
        some = pa.list_(pa.string())
        return pa.table({"key": group["key"], "idx": group["idx"], "digest": group["digest"], "befores": pa.array(befores, some), "afters": pa.array(afters, some), **same})

    return _with_paths(tier, paths, fanout, depth).applyInArrow(run, f"key string, idx long, digest string, {PATH}")


def _with_paths(tier: DataFrame, paths: DataFrame, fanout: int, depth: int):
    blocks = tier.withColumn("block", F.floor(F.col("idx") / F.lit(fanout**depth)).cast("long"))
    above = paths.select("key", F.col("idx").alias("block"), "befores", "afters", "subroot", "root")
    return blocks.groupBy("key", "block").cogroup(above.groupBy("key", "block"))


def _proven(leaves: DataFrame, paths: DataFrame, id_type: str, fanout: int, depth: int) -> DataFrame:
    """The rows of the result from ``leaves(key, idx, doc_id, digest, changed)`` and the paths of their blocks."""

    def run(key: tuple, group: pa.Table, above: pa.Table) -> pa.Table:
        group = _sorted(group)
        steps = _steps(group, key[1].as_py(), above, fanout, depth)
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        proofs, folded = [], []
        for i, (own, changed) in enumerate(zip(group["digest"].to_pylist(), group["changed"].to_pylist(), strict=True)):
            proof, digest = hashlib.sha256(), (changed or own).encode()
            for width, found, at in steps:
                others, cut = found[i // width], int(at[i // width])
                proof.update(others)
                digest = hashlib.sha256(others[:cut] + digest + others[cut:]).hexdigest().encode()
            proofs.append(proof.hexdigest())
            folded.append(digest.decode())
        n = len(group)
        return pa.table({"doc_id": group["doc_id"], "leaf": group["digest"], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    return _with_paths(leaves, paths, fanout, depth).applyInArrow(run, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, changed: Column | None = None, changed_text: Column | None = None, fanout: int = FANOUT, depth: int = BLOCK_LEVELS) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot`` of its source, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of each row.

    ``leaf`` digests doc_id, source, lang, n_chars and text. In a source leaves ascend by doc_id (null
    first, equal ids by leaf); every ``fanout`` consecutive nodes become the digest of their hex text, the
    last run of what is left, until one remains. Subroots in order of source (null first, by UTF-8 bytes)
    become the root alike. ``proof_sha256`` digests all siblings from the leaf to the root. Where
    ``changed`` holds, the row is verified with ``changed_text`` in place of its text: ``folded_root`` is
    folded from that leaf and the original siblings, and ``verified`` tells whether it is the root.

    Null fields are marked apart from empty ones, in any column. Repeated rows are leaves of their own.
    An empty table gives an empty result. Other columns are dropped, so that their names can't clash.
    """
    own = [F.col(c) for c in FIELDS]
    other = leaf(*own[:-1], changed_text) if changed_text is not None else F.lit(None).cast("string")
    mark = F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(False)
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null first
    slim = docs.select(source.alias("key"), "doc_id", leaf(*own).alias("digest"), F.when(mark, other).alias("changed"), F.monotonically_increasing_id().alias("row"))
    leaves = written(numbered(written(slim, "leaves"), ["key"], ["doc_id", "digest", "row"]).drop("row"), "leaves")
    lower = _tiers(leaves.select("key", "idx", "digest"), fanout, depth)
    subroots = written(numbered(lower[-1].select(F.lit("").alias("key"), F.col("key").alias("source_key"), "digest"), ["key"], ["source_key"]), "subroots")
    upper = _tiers(subroots.select("key", "idx", "digest"), fanout, depth)
    none = F.array().cast("array<string>")
    paths = upper[-1].select("key", "idx", none.alias("befores"), none.alias("afters"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for tier in upper[-2::-1]:
        paths = written(_descended(tier, paths, fanout, depth), "paths").drop("digest")
    paths = subroots.select("source_key", "idx", "digest").join(paths, "idx").select(F.col("source_key").alias("key"), F.lit(0).cast("long").alias("idx"), "befores", "afters", F.col("digest").alias("subroot"), "root")
    for tier in lower[-2:0:-1]:
        paths = written(_descended(tier, paths, fanout, depth), "paths").drop("digest")
    return _proven(leaves, paths, docs.schema["doc_id"].dataType.simpleString(), fanout, depth)
