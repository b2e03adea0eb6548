"""Exact group quantiles by refined histograms, and box-plot summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .joins import join_per_group, null_safe_join

#: Bins of a histogram, and rows of an interval that are counted by value at once.
BINS, FEW = 1024, 10_000


def _bin(value: Column, lo: Column, hi: Column) -> Column:
    """Bin of a value in [lo, hi], rising with the value; the least value is in the first bin and
    the greatest in the last. Halves, so that no difference overflows."""
    share = F.nanvl(F.try_divide(value / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0))
    inner = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)).cast("int")
    return F.when(value == lo, 0).when(value == hi, BINS - 1).otherwise(inner)


def _inside(rows: DataFrame, spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows that lie in one of their group's intervals, with its ``lo`` and ``hi``."""
    per_group = written(spans.groupBy(*by).agg(
        F.collect_list(F.struct("lo", "hi")).alias("_spans")), "spans")
    hit = F.filter("_spans", lambda s: F.col("_v").between(s["lo"], s["hi"]))
    return (join_per_group(rows, per_group, by, F.col("_v"))
            .select(*by, "_v", F.explode(hit).alias("s")).select(*by, "_v", "s.lo", "s.hi"))


def _with_ranks(counts: DataFrame, spans: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """``counts`` (by..., lo, ``order``, n) of intervals with ``base``, the rows of the group below,
    and the wanted ``ranks`` among their own; those without are left out."""
    below = Window.partitionBy(*by, "lo").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = null_safe_join(counts, spans.select(*by, "lo", F.col("base").alias("_base"),
                                                 F.col("ranks").alias("_ranks")), [*by, "lo"])
    placed = placed.withColumn("base", F.col("_base") + F.coalesce(F.sum("n").over(below),
                                                                   F.lit(0)))
    ranks = F.filter("_ranks", lambda r: (r >= F.col("base"))
                     & (r < F.col("base") + F.col("n")))
    return placed.withColumn("ranks", ranks).where(F.size("ranks") > 0).drop("_base", "_ranks")


def group_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                    names: Sequence[str]) -> DataFrame:
    """Exact quantiles per group, linear interpolation between order statistics.

    Every round counts the rows of each interval that holds a wanted rank in BINS bins, and goes
    on with the bins that hold one, cut down to their own least and greatest value, until these are
    equal or a bin holds few rows. Rows are counted before any exchange and never gathered by
    group; the driver sees whether intervals are left. NULL and NaN values are ignored; NULL group
    keys form a group.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = written(rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "sizes")
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("bigint") for x in at
                                       for f in (F.floor, F.ceil)]))
    spans = sizes.select(*by, "lo", "hi", F.lit(0).cast("bigint").alias("base"), "n",
                         ranks.alias("ranks"))
    same = F.col("lo") == F.col("hi")
    ready = spans.where(same | (F.col("n") <= FEW))
    spans = spans.where(~same & (F.col("n") > FEW))
    while not spans.isEmpty():
        bins = _inside(rows, spans, by).groupBy(
            *by, "lo", _bin(F.col("_v"), F.col("lo"), F.col("hi")).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        spans = written(_with_ranks(bins, spans, by, "bin").select(
            *by, F.col("least").alias("lo"), F.col("most").alias("hi"), "base", "n", "ranks"),
            "spans")
        ready = ready.unionByName(spans.where(same | (F.col("n") <= FEW)))
        spans = spans.where(~same & (F.col("n") > FEW))
    few = ready.where(~same)
    counted = _inside(rows, few, by).groupBy(*by, "lo", "_v").agg(F.count(F.lit(1)).alias("n"))
    found = (ready.where(same).select(*by, "ranks", F.col("lo").alias("x"))
             .unionByName(_with_ranks(counted, few, by, "_v")
                          .select(*by, "ranks", F.col("_v").alias("x"))))
    values = found.withColumn("rank", F.explode("ranks")).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    out = null_safe_join(sizes.select(*by, "n"), values, by)
    cols = []
    for x, name in zip(at, names):
        lo, hi = (F.col("at")[f(x).cast("bigint")] for f in (F.floor, F.ceil))
        # equal ends first: the difference of two infinities is no number
        cols.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (x - F.floor(x))).alias(name))
    return out.select(*by, *cols)


def group_median(df: DataFrame, value: str, by: Sequence[str], name: str = "median") -> DataFrame:
    return group_quantiles(df, value, by, [0.5], [name])


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR of the box) and outlier count per group."""
    by = list(by)
    q = written(group_quantiles(df, value, by, [0.25, 0.5, 0.75], ["q1", "median", "q3"]), "box")
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = (F.col("_v") >= lo) & (F.col("_v") <= hi)
    return join_per_group(rows, q, by, F.col("_v")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"),
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.max("_v").alias("max"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
