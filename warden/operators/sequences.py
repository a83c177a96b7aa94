"""Running values over long per-key histories.

A plain window would put a whole key in one task.  Here each key is cut into
time buckets: one aggregated row per bucket carries the value forward, and a
window inside (key, bucket) does the rest, so a hot key spreads over as many
tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bucket_of(t: Column, width: int) -> Column:
    """Number of the ``width``-microsecond bucket a microsecond time lies in."""
    return ((t - F.pmod(t, F.lit(width))) / F.lit(width)).cast("bigint")


def running_max(
    rows: DataFrame, keys: list[str], time: str, ties: list[str], value: str, out: str, width: int
) -> DataFrame:
    """Largest non-NULL ``value`` up to and including each row, per key.

    ``time`` is in microseconds, ``width`` the bucket length.  Rows without a
    value are probes that only receive.
    """
    bucketed = rows.withColumn("__bucket", bucket_of(F.col(time), width))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        bucketed.filter(F.col("__bucket").isNotNull())
        .groupBy(*keys, "__bucket")
        .agg(F.max(value).alias("__top"))
        .withColumn("__carry", F.max("__top").over(before))
        .drop("__top")
    )
    inside = (
        Window.partitionBy(*keys, "__bucket")
        .orderBy(time, *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = bucketed.join(carried, [*keys, "__bucket"], "left")
    return joined.withColumn(out, F.greatest("__carry", F.max(value).over(inside))).drop("__bucket", "__carry")
