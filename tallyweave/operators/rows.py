"""Row selection: first per key, arg-max, samples, top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

_SLICES = 4096


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must be a total order within a key.

    An aggregate, not a window: copies of a hot key are already reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Arg-max row per key (no ties)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    best = df.groupBy(*keys).agg(F.max_by(row, order).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def scramble(key: Column, seed: int) -> Column:
    """Repeatable pseudo-random rank in [0, 2^32) of a whole-number key.

    Plain multiply-and-modulo, so that any SQL engine gives the same order. Text keys go through
    ``xxhash64`` first.
    """
    # Odd multipliers near 2^32 / golden ratio, applied in two rounds.
    mod = F.lit(2 ** 32)
    start = F.pmod(F.pmod(key, F.lit(2 ** 31)) + F.lit(seed), F.lit(2 ** 31))
    once = F.pmod(start * F.lit(2654435761), mod)
    return F.pmod(F.floor(once / 65536) * F.lit(40503) + once * F.lit(31), mod)


def bottom_n(df: DataFrame, rank: Column, n: int, tie: Sequence[Column] = ()) -> DataFrame:
    """The ``n`` rows with the smallest ``rank`` (in [0, 2^32)), exactly.

    A histogram of the rank's leading bits finds the slice in which the n-th row lies; only the
    rows up to that slice are sorted, so one task never sees more than about n rows.
    """
    ranked = df.withColumn("_rank", rank).withColumn(
        "_slice", F.floor(F.col("_rank") / (2 ** 32 // _SLICES)).cast("int"))
    hist = ranked.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    # At most 4096 rows from here on.
    upto = hist.withColumn("_before", F.sum("_n").over(
        Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        - F.col("_n"))
    cut = upto.where(F.col("_before") < n).agg(F.max("_slice").alias("_cut"))
    near = ranked.where(F.col("_slice") <= cut.scalar())
    return near.orderBy("_rank", *tie).limit(n).select(*df.columns)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Fixed-size repeatable row sample; ``key`` (whole number or text) tells rows apart."""
    k = F.col(key)
    if isinstance(df.schema[key].dataType, StringType):
        k = F.xxhash64(k)
    return bottom_n(df, scramble(k, seed), n, [F.col(key)])


def sample_entities(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` pseudo-randomly chosen entities (whole-number ``key``)."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    chosen = bottom_n(ids, scramble(F.col(key), seed), n, [F.col(key)])
    return df.join(chosen, key, "left_semi")


def count_sorted(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Counts per key, most frequent first, ties by key."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = out.orderBy(F.desc("n"), *[F.asc_nulls_last(k) for k in keys])
    return out.limit(limit) if limit else out
