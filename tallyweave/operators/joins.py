"""Joins by key names in which NULL keys meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

#: Bits and probes per key of a membership filter, and its greatest size in 64-bit words (4 MB).
KEY_BITS, PROBES, MOST_WORDS = 16, 4, 1 << 19
#: Places over which the rows of one group are dealt in a join with values of the group.
SALTS = 16


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` with NULL equal to NULL; the keys come from the left side once."""
    renamed = right.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                           *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return left.join(renamed, cond, how).drop(*[f"_key{i}" for i in range(len(keys))])


def join_per_group(rows: DataFrame, groups: DataFrame, by: Sequence[str], spread: Column,
                   how: str = "inner") -> DataFrame:
    """Columns of ``groups`` (one row per group, a written table) for every row of ``rows``.

    A small ``groups`` is broadcast by its known size, and rows stay where they are. Otherwise each
    group's row is sent to SALTS places and the rows of a group go to these places by the hash of
    ``spread``, so that a group with most rows is shared out. NULL keys are a group.
    """
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = null_safe_join(rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS))
                                         .cast("int")), salted, [*by, "_salt"], how)
    return out.drop("_salt")


def keep_members(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` is, or may be, one of ``keys`` (a written table with that column).

    For use before a join that would send all rows to other places: rows that cannot match are left
    out where they lie. The filter is a bit set of a size set by the count of keys, built by an
    aggregate and broadcast as one row. No match is lost; a filter past its greatest size only
    lets more rows through.
    """
    words = 1
    while words * 64 < min(KEY_BITS * keys.count(), MOST_WORDS * 64):
        words *= 2

    def places(column: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(column, F.lit(i)), F.lit(words * 64)) for i in range(PROBES)]

    at = F.explode(F.array(*places(F.col(key))))
    bits = (keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")))
    whole = bits.agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(words - 1)),
                    lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
        .alias("_bits"))
    found = F.lit(True)
    for place in places(F.col(key)):
        word = F.get(F.col("_bits"), F.floor(place / 64).cast("int"))
        found = found & (F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1)
    one = F.broadcast(written(whole, "members"))
    return rows.join(one).where(F.col(key).isNotNull() & found).drop("_bits")
