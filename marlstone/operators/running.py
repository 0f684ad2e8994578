"""Running sums over one order of all rows, without a window that gathers them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.graph import checkpointed


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with a running sum (that of its own row included) for each of ``sums``, in ``order``; ties get them in any order.

    Rows are dealt by ranges of the order and written with their range's number. Sums of whole ranges,
    one row a task, give each range its start; inside a range a window goes on from there.
    """
    dealt = checkpointed(rows.select("*", *(c.alias(f"_{k}") for k, c in sums.items())).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = dealt.groupBy("_part").agg(*(F.sum(f"_{k}").alias(f"_of_{k}") for k in sums))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks dealt
    starts = own.select("_part", *(F.coalesce(F.sum(f"_of_{k}").over(upto), F.lit(0)).alias(f"_from_{k}") for k in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.select("*", *(F.sum(f"_{k}").over(inside).alias(f"_in_{k}") for k in sums)).join(F.broadcast(starts), "_part")
    return found.select(*rows.columns, *((F.col(f"_from_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums))
