"""Importance resampling towards a target: hashed word features, and ranks by a radix sort."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyweave.llm.common import (LETTERS_LOWER, WordBatch, arrays_batch, arrow_map, documents,
                                   word_batches)
from tallyweave.session import written

BUCKETS = 10_000
#: Bits of a key digit, and the least and most rows of a block that one task puts in place.
DIGIT_BITS, LEAST_BLOCK, MOST_BLOCK = 11, 4096, 1 << 20
#: Words up to this length are hashed together, longer ones one by one.
_LONG = 48


def _crc_table() -> np.ndarray:
    """CRC-32 of every byte value (reflected polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def word_checksums(words: WordBatch) -> np.ndarray:
    """CRC-32 of the bytes of every word: one array step per byte position."""
    lengths = words.ends - words.starts
    out = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(lengths, _LONG + 1), kind="stable")
    length = lengths[order]
    first = int(np.searchsorted(-length, -_LONG, side="left"))  # words beyond _LONG come first
    order, length = order[first:], length[first:]
    at = words.starts[order]
    state = out[order]
    for k in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -k, side="left"))  # words longer than k
        state[:n] = _CRC[(state[:n] ^ words.data[at[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[order] = state
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _LONG):
        out[i] = zlib.crc32(words.data[words.starts[i]:words.ends[i]].tobytes())
    return out


def bucket_counts(df: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """Words of all texts per bucket. Every task sums its own; ``buckets`` rows are collected."""
    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n = np.zeros(buckets, np.int64)
            for _, words in word_batches(batch.column(0), LETTERS_LOWER):
                n += np.bincount(word_checksums(words) % buckets, minlength=buckets)
            at = np.flatnonzero(n)
            yield arrays_batch(bucket=at, n=n[at])
        return work
    rows = (arrow_map(df.select(F.col(f"`{text_col}`").alias("text")), "bucket long, n long", make)
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


@dataclass(frozen=True)
class Gains:
    """Whole-number gain of each bucket: 1000 ln of how much likelier it is in the target."""

    values: np.ndarray

    @classmethod
    def between(cls, source: np.ndarray, target: np.ndarray) -> Gains:
        n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
        return cls(np.array([
            math.floor(1000 * math.log(float((int(t) + 1) * (s_all + n))
                                       / float((int(s) + 1) * (t_all + n))))
            for s, t in zip(source, target)], np.int64))


def noise(seed: int, doc_id: int | None) -> int:
    """Whole-number Gumbel variate of a document: a hash of seed and id drives it."""
    name = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(df: DataFrame, id_col: str, text_col: str, gains: Gains, seed: int) -> DataFrame:
    """(id, n_features, weight, score) of every row: array sums over the words' buckets."""
    shared = df.sparkSession.sparkContext.broadcast(gains.values)

    def make():
        values = shared.value

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column(0)
            for first, words in word_batches(batch.column(1), LETTERS_LOWER):
                sums = np.zeros(len(words.starts) + 1, np.int64)
                np.cumsum(values[word_checksums(words) % len(values)], out=sums[1:])
                weight = np.diff(sums[words.bounds])
                part = ids.slice(first, len(weight))
                luck = np.array([noise(seed, i) for i in part.to_pylist()], np.int64)
                yield arrays_batch(id=part, n_features=np.diff(words.bounds), weight=weight,
                                   score=weight + luck)
        return work
    return arrow_map(documents(df, id_col, text_col),
                     "id long, n_features long, weight long, score long", make)


@dataclass(frozen=True)
class KeyPart:
    """One column of a composite key, last decisive part first; values count from ``low``."""

    column: str
    descending: bool
    low: int
    bits: int

    def value(self):
        c = F.col(self.column)
        if self.descending:
            return F.lit(self.low) - c
        return c - F.lit(self.low)


def _key_parts(df: DataFrame, order: list[tuple[str, bool]]) -> list[KeyPart]:
    """Parts from the least decisive on, as wide as the spread of their values."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c, _ in order
                    for n, f in (("min", F.min), ("max", F.max))]).first()
    parts = []
    for column, descending in reversed(order):
        low, high = ends[f"min_{column}"], ends[f"max_{column}"]
        if low is not None and high > low:
            if high - low >= 1 << 63:
                raise ValueError(f"{column}: values spread over more than 63 bits")
            parts.append(KeyPart(column, descending, high if descending else low,
                                 (high - low).bit_length()))
    return parts


def _digits(parts: list[KeyPart]) -> list[tuple[KeyPart, int, int]]:
    """(part, shift, bits) of every digit, least significant first."""
    out = []
    for part in parts:
        passes = -(-part.bits // DIGIT_BITS)
        width = -(-part.bits // passes)
        out += [(part, at, min(width, part.bits - at)) for at in range(0, part.bits, width)]
    return out


def _place(block: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """Counting sort of one block: each row's place in the whole table after this pass."""
    block = block.sort_values("pos", kind="stable")
    digit = block["digit"].to_numpy(np.uint16)
    order = np.argsort(digit, kind="stable")
    n = np.bincount(digit)
    inside = np.empty(len(digit), np.int64)
    inside[order] = np.arange(len(digit)) - np.repeat(np.cumsum(n) - n, n)
    first = np.zeros(len(n), np.int64)
    first[starts["digit"].to_numpy()] = starts["start"].to_numpy()
    return block.assign(pos=first[digit] + inside).drop(columns=["digit", "block"])


def radix_ranked(df: DataFrame, order: list[tuple[str, bool]], name: str = "radix") -> DataFrame:
    """``df`` with ``pos``: 0, 1, 2, ... in the order of the long columns ``(column, descending)``.

    Least significant digit first: every pass counts the digits of each block of consecutive
    rows, adds the counts up to the first place of each (digit, block), and moves every row there;
    rows of one digit keep their order. A task holds one block, and no key, however frequent,
    brings more rows together. Each pass is written to the shared folder, so a lost executor
    repeats only its own share of one pass. Rows equal in all columns take any order among
    themselves. ``df`` should be cheap to read twice and must not hold nulls in these columns.
    """
    spark = df.sparkSession
    columns = df.columns
    parts = _key_parts(df, order)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the first order: rows as they lie in the parts; the parts' sizes give the places
    rows = written(df.withColumn("_part", F.spark_partition_id())
                   .withColumn("_in_part", F.monotonically_increasing_id()), name)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"),
                                      F.min("_in_part").alias("_least"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_least", F.coalesce(F.sum("n").over(before), F.lit(0))
                          .alias("_start"))  # one row per part of the input
    now = rows.join(starts, "_part").select(
        *columns, (F.col("_start") + F.col("_in_part") - F.col("_least")).alias("pos"))
    size = min(max(-(-total // tasks), LEAST_BLOCK), MOST_BLOCK)
    for part, shift, bits in _digits(parts):
        digit = F.shiftright(part.value(), shift).bitwiseAND((1 << bits) - 1).cast("int")
        keyed = now.withColumn("digit", digit).withColumn(
            "block", F.floor(F.col("pos") / size).cast("long"))
        counts = written(keyed.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n")),
                         f"{name}-counts")
        of_digit = dict(counts.groupBy("digit").agg(F.sum("n")).collect())  # 2^bits rows at most
        first, at = {}, 0
        for d in sorted(of_digit):
            first[d], at = at, at + of_digit[d]
        digit_start = spark.createDataFrame(list(first.items()) or [(0, 0)],
                                            "digit int, digit_start long")
        earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(
            Window.unboundedPreceding, -1)
        places = (counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
                  .join(F.broadcast(digit_start), "digit")
                  .select("block", "digit", (F.col("before") + F.col("digit_start"))
                          .alias("start")))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema)
        now = written(keyed.groupBy("block").cogroup(places.groupBy("block"))
                      .applyInPandas(_place, schema), name)
    return now


def resample(df: DataFrame, id_col: str, text_col: str, target: DataFrame, target_text: str,
             seed: int, percent: int, least_words: int, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null: not drawn).

    A document's features are its words (A-Z lower-cased; letters, digits and all beyond ASCII),
    each in the bucket of its CRC-32. A bucket's gain says how much likelier it is in ``target``,
    the weight is the sum over all words, and the score adds a Gumbel variate of seed and id. Of
    the documents with at least ``least_words`` words, ``percent`` per cent are drawn, highest
    scores first, ties to the smaller id; their ranks come from :func:`radix_ranked`. Counts cover
    all of ``df`` and ``target``; only one number per bucket reaches the driver.

    Cases: null and empty texts have no words and weight 0; a very long text counts whole; a null
    id takes the variate of an empty name and comes after all others of its score; repeated rows
    are drawn each; an empty table gives an empty result, an empty target equal shares; further
    columns are not read.
    """
    gains = Gains.between(bucket_counts(df, text_col, buckets),
                          bucket_counts(target, target_text, buckets))
    scored = written(weighed(df, id_col, text_col, gains, seed), "scored")
    enough = F.col("n_features") >= least_words
    drawn_from = scored.where(enough).withColumn("no_id", F.col("id").isNull().cast("long")) \
        .withColumn("key", F.coalesce("id", F.lit(0)))
    ranked = radix_ranked(drawn_from, [("score", True), ("no_id", False), ("key", False),
                                       ("n_features", False)])
    take = drawn_from.count() * percent // 100
    rank = F.when(F.col("pos") < take, F.col("pos") + 1).cast("long").alias("rank")
    return (ranked.select("id", "n_features", "weight", "score", rank)
            .unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))))
