"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

One scan of the documents writes a slim table: the other columns, the text's length and a hash of
its first ``prefix`` characters. From that table lengths are counted; prefix hashes are counted only
among rows whose length occurs again; and only rows whose length and prefix hash both occur again
are survivors. Full hashes are taken of survivors alone, in a second scan: a bit set of the surviving
keys, sized by their count, tells them, and a false hit of it costs one more hash and changes nothing.
Where the caller has a full hash of every row already (``digest``), it is written with the slim
table, and the text is read once.

Groups are joined back by full hash. Counts are aggregated before their shuffle. A group that holds
a third of all rows is a join whose large side adaptive execution splits (the other side has one row
for each group), and rows that can have no copy carry a key of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, unused, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the set for each surviving key, and the fewest and most bits in all (the most are 64 MB).
BITS_EACH, FEWEST_BITS, MOST_BITS = 16, 1 << 18, 1 << 29
_ROW_BITS = 4096 * 8


def _text(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def normalised(text: str | Column = "text") -> Column:
    """Null as empty, A-Z lower-cased, nothing else changed."""
    return F.translate(_text(text), UPPER, LOWER)


def length_and_prefix(text: str | Column, prefix: int) -> list[Column]:
    """Length and prefix hash of the normalised text; lower-casing A-Z moves neither a length nor a prefix."""
    return [F.octet_length(_text(text)), F.xxhash64(normalised(F.substring(_text(text), 1, prefix)))]


def surviving(keys: DataFrame, length: str, start: str) -> DataFrame:
    """The (length, prefix hash) pairs that occur more than once, prefixes looked at for repeated lengths only."""
    lengths = written(keys.groupBy(length).count().where("count > 1").select(length), "lengths")
    return written(keys.join(small(lengths), length, "left_semi").groupBy(length, start).count().where("count > 1").select(length, start), "pairs")


def _bit_set(keys: DataFrame, bits: int) -> DataFrame:
    """(bucket, bits): a bit for each of ``keys(spot)``; at most ``bits`` / 32768 rows."""
    return keys.groupBy((F.col("spot") / _ROW_BITS).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("spot", F.lit(_ROW_BITS))).alias("bits"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix: int = 256, digest: str | None = None) -> DataFrame:
    """All columns of ``docs`` but ``text``, with ``keep_id``, ``group_size`` and ``kept``.

    Of equal texts the largest id stays. Null texts equal empty ones. Repeated rows of one id count
    as rows of the group and share its decision; a null id loses against any other and stays only
    in a group that has no other. An empty table gives an empty result. Further columns pass
    through; those named like a result column are replaced, and names used inside never clash.
    ``digest`` names a column that holds a full hash of the normalised text, if there is one.
    """
    rest = [c for c in docs.columns if c not in (text, "keep_id", "group_size", "kept")]
    length, start, full, most, many = unused(docs, "length", "start", "full", "most", "many")
    keys = [c.alias(n) for c, n in zip(length_and_prefix(text, prefix), (length, start), strict=True)]
    if digest:
        slim = written(docs.select(*rest, *keys), "slim")
        found = slim.withColumn(full, F.col(digest))
        again = slim.join(small(surviving(slim, length, start)), [length, start], "left_semi").select(F.col(digest).alias(full), doc_id)
    else:
        pairs = surviving(written(docs.select(*keys), "keys"), length, start)
        bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_EACH * pairs.count()).bit_length()))
        spot = F.pmod(F.xxhash64(length, start), F.lit(bits))
        marks = _bit_set(pairs.select(spot.alias("spot")), bits)
        bucket, mask, at = unused(docs, "bucket", "bits", "at")
        rows = docs.select(*rest, _text(text).alias(full), *keys).withColumn(at, spot)
        rows = rows.join(F.broadcast(marks.select(F.col("bucket").alias(bucket), F.col("bits").alias(mask))), (F.col(at) / _ROW_BITS).cast("int") == F.col(bucket), "left")
        byte = F.conv(F.hex(F.substring(mask, (F.pmod(F.col(at), F.lit(_ROW_BITS)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.col(mask).isNotNull() & (byte.bitwiseAND(F.expr(f"shiftleft(1, int(`{at}` % 8))")) != 0)
        found = written(rows.select(*rest, F.when(hit, F.sha2(normalised(full), 256)).alias(full)), "hashed")
        again = found.where(F.col(full).isNotNull()).select(full, doc_id)
    groups = again.groupBy(full).agg(F.max(doc_id).alias(most), F.count("*").alias(many)).where(F.col(many) > 1)
    # rows that were never hashed have no copy; a key of their own keeps them from meeting in one task
    key = F.coalesce(F.col(full), F.concat(F.lit("!"), F.xxhash64(doc_id).cast("string")))
    out = found.withColumn(full, key).join(groups.hint("merge"), full, "left")
    keep = F.when(F.col(many).isNull(), F.col(doc_id)).otherwise(F.col(most))
    return out.select(*rest, keep.alias("keep_id"), F.coalesce(many, F.lit(1)).cast("long").alias("group_size"), F.col(doc_id).eqNullSafe(keep).alias("kept"))
