"""Row numbers of an ordering without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.sources.shared import written


def ranked(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with its row number (from 1) in the given total order.

    The sorted table is written once with each row's task and place in it; a window over
    one row a task gives the tasks' offsets. No task holds more than its range of the order.
    """
    place = df.orderBy(*order).withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    place = written(place, "ranked")
    sizes = place.groupBy("_task").agg(F.count("*").alias("_n"))
    before = sizes.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    out = place.join(F.broadcast(before), "_task")  # a row a task
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_at") + 1).alias(rank))
