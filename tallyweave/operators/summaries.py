"""Descriptive tables: cells, shares, null patterns, densities."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..session import written
from .joins import join_per_group, null_safe_join
from .quantiles import group_quantiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cell_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Row count, mean and sample standard deviation per cell (NULL deviation for one row)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                               F.stddev_samp(value).alias("sd"))


def small_cells(df: DataFrame, by: Sequence[str], minimum: int = 20) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < minimum)
    return out.orderBy(F.desc("n"), *[F.asc_nulls_last(c) for c in by])


def group_shares(df: DataFrame, group: Sequence[str], category: str) -> DataFrame:
    """Share of each category within its group."""
    cells = df.groupBy(*group, category).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(*group).agg(F.sum("n").alias("_total"))
    return null_safe_join(cells, totals, group).select(
        *group, category, "n", (F.col("n") / F.col("_total")).alias("share"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of NULLs, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns]))
        .alias("r")).select("r.*")


def null_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per combination of NULL flags, most frequent first."""
    flags = [F.col(c).isNull().alias(f"na_{c}") for c in columns]
    out = df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), *[f"na_{c}" for c in columns])


def rows_with_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cond = F.lit(False)
    for c in columns or df.columns:
        cond = cond | F.col(c).isNull()
    return df.where(cond)


def common_sample(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows complete in all ``columns``: the shared estimation sample of several models."""
    return df.dropna(subset=list(columns))


def common_sample_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_total"),
                  F.count_if(complete).alias("n_complete")).select(
        "n_total", "n_complete", (F.col("n_total") - F.col("n_complete")).alias("n_omitted"),
        F.try_divide(100.0 * (F.col("n_total") - F.col("n_complete")), F.col("n_total"))
        .alias("pct_omitted"))


def density(df: DataFrame, value: str, by: str, n: int = 512) -> DataFrame:
    """Gaussian kernel density per group on ``n`` points over the common value range.

    Bandwidth 0.9 * min(sd, IQR / 1.34) * size^(-1/5). Values are spread linearly over ``n`` bins
    before any kernel is evaluated, so the cost past one aggregate hangs on groups and bins only.
    Groups with fewer than two values are dropped.
    """
    x = F.col(value).cast("double")
    data = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, x.alias("x"))
    stats = data.groupBy(by).agg(F.count(F.lit(1)).alias("size"), F.stddev_samp("x").alias("sd"),
                                 F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    stats = written(stats, "stats")
    ends = stats.agg(F.min("x_min").alias("x_from"), F.max("x_max").alias("x_to"))  # one row
    q = group_quantiles(data, "x", [by], [0.25, 0.75], ["q1", "q3"])
    spread = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / 1.34)
    spread = (F.when(spread > 0, spread).when(F.col("sd") > 0, F.col("sd"))
              .when(F.col("x_min") != 0, F.abs("x_min")).otherwise(F.lit(1.0)))
    stats = (stats.where(F.col("size") > 1).join(q, by)
             .withColumn("bw", 0.9 * spread * F.pow(F.col("size").cast("double"), F.lit(-0.2)))
             .join(F.broadcast(ends))
             .withColumn("grid_from", F.col("x_from") - 4 * F.col("bw"))
             .withColumn("step", (F.col("x_to") - F.col("x_from") + 8 * F.col("bw")) / (n - 1)))
    stats = written(stats, "bandwidths")
    pos = (F.col("x") - F.col("grid_from")) / F.col("step")
    binned = (join_per_group(data, stats, [by], F.col("x"))
              .withColumn("bin", F.floor(pos).cast("int"))
              .withColumn("right", pos - F.floor(pos))
              .groupBy(by, "bin").agg(F.count(F.lit(1)).alias("cnt"),
                                      F.sum("right").alias("right")))
    bins = binned.join(stats.select(by, "size", "bw", "x_from", "x_to", "grid_from", "step"), by)
    schema = StructType([df.schema[by], StructField("point", IntegerType()),
                         StructField("x", DoubleType()), StructField("density", DoubleType())])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        # At most n + 1 bins of one group.
        r = pdf.iloc[0]
        weight = np.zeros(n + 1)
        np.add.at(weight, pdf["bin"].to_numpy(), (pdf["cnt"] - pdf["right"]).to_numpy())
        np.add.at(weight, pdf["bin"].to_numpy() + 1, pdf["right"].to_numpy())
        weight = weight[:n] / r["size"]
        k = np.arange(n) * r["step"] / r["bw"]
        kernel = np.exp(-0.5 * k * k) / (r["bw"] * np.sqrt(2 * np.pi))
        on_grid = np.convolve(weight, np.concatenate([kernel[:0:-1], kernel]))[n - 1:2 * n - 1]
        at = np.linspace(r["x_from"], r["x_to"], n)
        y = np.interp(at, r["grid_from"] + np.arange(n) * r["step"], on_grid)
        return pd.DataFrame({by: r[by], "point": np.arange(n, dtype=np.int32), "x": at,
                             "density": y})

    return bins.groupBy(by).applyInPandas(smooth, schema)
