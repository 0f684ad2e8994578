"""Rows dealt by a key into tasks, however many, by tasks that hold few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks up to which Spark deals rows through files, one a task. Beyond, whoever deals holds all its rows in memory.
FILE_TASKS = 200


def dealt(rows: DataFrame, tasks: int, key: str) -> DataFrame:
    """``rows`` in ``tasks`` tasks by a hash of ``key``.

    Beyond ``FILE_TASKS`` tasks rows are dealt twice: into that many through files, then from there. Else a reader
    would hold its whole part of a table, which may be one row group of gigabytes; so it is one in ``FILE_TASKS`` of all rows.
    """
    if tasks > FILE_TASKS:
        rows = rows.withColumn("_deal", F.xxhash64(key)).repartition(FILE_TASKS, "_deal").drop("_deal")  # by a column of its own, else Spark takes both deals for one
    return rows.repartition(tasks, key)
