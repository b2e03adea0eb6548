"""Weighted rendezvous hashing of record keys over shards, with gapless slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.session import written


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard whose exponential variate for ``key`` is smallest; rate = weight.

    The variate of a (key, shard) pair depends on nothing else, so another shard takes over
    exactly the keys for which its own variate is the smallest.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    draws = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        unit = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)
        draws.append(F.struct((-F.log(unit) / F.lit(float(weight))).alias("draw"),
                              F.lit(shard).alias("shard")))
    best = F.least(*draws) if len(draws) > 1 else draws[0]
    return best["shard"]


def shard_records(df: DataFrame, key_col: str, text_col: str,
                  weights: Sequence[float]) -> DataFrame:
    """One row per record: key, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16, ``text_crc32`` the CRC-32 of those
    bytes (null: that of no bytes), ``grown_shard`` the shard if one more of the last weight
    were there. Slots count from 0 without gaps in each shard, in order of source part, key,
    checksum and size.

    Cases: a null key is a key like any other; repeated rows get a slot each; an empty table gives
    an empty result; further columns are not looked at. Equal keys always share a shard, as the
    law demands; numbering is per (shard, source part), so a key with very many rows is still
    numbered by many tasks.
    """
    key = F.col(f"`{key_col}`")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # the part is written with its rows: a lost executor cannot change the numbering
    placed = written(df.select(
        key.alias(key_col),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, weights[-1]]).alias("grown_shard"),
        F.spark_partition_id().alias("_part")), "sharding")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
              .select("shard", "_part",
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("shard", "_part").orderBy(key_col, "text_crc32", "size")
    numbered = placed.withColumn("_rank", F.row_number().over(inside) - 1)
    return (numbered.join(starts, ["shard", "_part"])
            .select(key_col, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("_start") + F.col("_rank")).cast("long").alias("slot"),
                    "grown_shard"))
