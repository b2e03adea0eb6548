"""Running counts over long ordered sequences without one task per sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sum(df: DataFrame, seq: str, position: str, value: Column, out: str,
                block: int = 65536) -> DataFrame:
    """Inclusive running sum of ``value`` by ``position`` within ``seq``.

    Two levels: totals per block of positions, summed up over blocks, then the running sum inside
    each block. A sequence with billions of positions spreads over as many tasks as it has blocks.
    """
    tagged = df.withColumn("_block", F.floor(F.col(position) / block)).withColumn("_v", value)
    totals = tagged.groupBy(seq, "_block").agg(F.sum("_v").alias("_t"))
    before = totals.withColumn("_base", F.sum("_t").over(
        Window.partitionBy(seq).orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_t")).drop("_t")
    inside = Window.partitionBy(seq, "_block").orderBy(position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = tagged.withColumn("_run", F.sum("_v").over(inside))
    return (local.join(before, [seq, "_block"])
            .withColumn(out, F.col("_run") + F.col("_base"))
            .select(*df.columns, out))
