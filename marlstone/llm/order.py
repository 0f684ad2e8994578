"""Places of rows in an order, without a window that gathers a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: ``monotonically_increasing_id`` holds the task's number above these bits and the row's below.
_ROW_BITS = 33


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """``rows`` with ``name``: the place (from 0) of each row among those of its ``group``, in ascending ``order``, nulls first.

    Rows are dealt by ranges of group and order, so a group of any size is spread over tasks, and are
    written with their task's and row's number. What is joined back is one row for each task and group
    in it. Rows that are equal in all of ``order`` get the places between them in any order; give a last
    column that tells them apart where one key may hold a large share of the rows. Names starting with
    ``_at`` must be free.
    """
    dealt = written(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()), "dealt")
    task = F.shiftright("_at", _ROW_BITS)
    own = dealt.groupBy(task.alias("_at_task"), *group).agg(F.min("_at").alias("_at_first"), F.count("*").alias("_at_rows"))
    before = Window.partitionBy(*group).orderBy("_at_task").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks dealt
    shift = F.coalesce(F.sum("_at_rows").over(before), F.lit(0)) - F.col("_at_first")
    starts = written(own.select("_at_task", *(F.col(g).alias(f"_at_{i}") for i, g in enumerate(group)), shift.alias("_at_shift")), "starts")
    same = task == F.col("_at_task")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_at_{i}"))
    return dealt.join(small(starts), same).select(*rows.columns, (F.col("_at") + F.col("_at_shift")).alias(name))
