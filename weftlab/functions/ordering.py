"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlab.session import materialise, release


def numbered(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """df with `out`, the place of each row from 0 in the order; rows that tie in it are placed in any order.

    Rows are dealt by range and sorted within the tasks; the sizes of the ranges, one row per task, give the offsets.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = materialise(df, "unordered")  # else finding the ranges would compute it once more
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "ordered").withColumn("__part", F.shiftright("__at", 33))
    release(df)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + local).drop("__at", "__part", "__start")
