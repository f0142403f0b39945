"""A stable number for every row, so that results of separate runs over one table can be paired."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.sources import sinks

#: Bits of Spark's row numbers that count within a task.
_WITHIN = 33


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """``df`` and ``name``, a bigint from 0 to the number of rows less one, each once.

    Rows are written once with their task and place in it, so all later scans, whatever their partitions, agree
    on the numbers. Tasks' counts are summed in order to offsets: a row per task of the write, the only thing that
    passes the driver. No row moves.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    place = sinks.unused(df, "place")
    rows = sinks.kept(df.withColumn(place, F.monotonically_increasing_id()), "ordinal")
    task = F.shiftright(place, _WITHIN).cast("int")
    counts = sorted(rows.groupBy(task.alias("task")).count().collect())
    starts = accumulate((r["count"] for r in counts), initial=0)
    offsets = df.sparkSession.createDataFrame([(r["task"], s) for r, s in zip(counts, starts, strict=False)], "__task int, __start bigint")
    at = F.col("__start") + F.col(place) - F.shiftleft(task.cast("bigint"), _WITHIN)
    return rows.join(F.broadcast(offsets), task == F.col("__task")).select(*[F.col(f"`{c}`") for c in df.columns], at.alias(name))
