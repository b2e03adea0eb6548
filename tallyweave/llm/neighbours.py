"""Nearest neighbours by inner product from a hash-prefix forest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyweave.session import written

#: Trees, bits of a hash string, vectors per block, queries per block, and rows and queries of the
#: sample that sets how many entries are gathered (CHOICES: per vector of the block).
TREES, BITS, BLOCK_ROWS, QUERY_ROWS = 24, 32, 4096, 4096
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 256
CHOICES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0)
_LEVELS = range(BITS, -1, -1)


def hash_strings(vectors: np.ndarray, norm2: float, query: bool) -> np.ndarray:
    """(rows, TREES) strings of sign bits, first bit highest.

    Index vectors get one more coordinate that makes all norms equal, queries a zero there; the
    angle then orders like the inner product.
    """
    extra = np.zeros(len(vectors)) if query else np.sqrt(
        np.maximum(norm2 - (vectors ** 2).sum(axis=1), 0))
    planes = np.random.default_rng(11).standard_normal((vectors.shape[1] + 1, TREES * BITS))
    sides = (vectors @ planes[:-1] + extra[:, None] * planes[-1] > 0).reshape(-1, TREES, BITS)
    return (sides.astype(np.uint64) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(axis=2)


class Forest:
    """Sorted arrays of hash strings, one per tree, over one block of vectors."""

    def __init__(self, vectors: np.ndarray, norm2: float):
        codes = hash_strings(vectors, norm2, False)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, 0)

    def ranges(self, queries: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, TREES) first and last + 1 of the entries that share ``level`` bits."""
        if level == 0:
            shape = queries.shape
            return np.zeros(shape, np.int64), np.full(shape, len(self.codes))
        shift = np.uint64(BITS - level)
        low = queries >> shift << shift
        lo, hi = np.empty(queries.shape, np.int64), np.empty(queries.shape, np.int64)
        for t in range(TREES):
            lo[:, t] = np.searchsorted(self.codes[:, t], low[:, t])
            hi[:, t] = np.searchsorted(self.codes[:, t], low[:, t] + (np.uint64(1) << shift))
        return lo, hi

    def candidates(self, queries: np.ndarray, gather: float, least: int) -> np.ndarray:
        """Mask (queries, vectors): in all trees at once, ascend from the longest matching prefix
        until ``gather`` entries per vector of the block, and one tree's ``least``, are reached."""
        n = len(self.codes)
        mask = np.zeros((len(queries), n), bool)
        open_ = np.arange(len(queries))
        for level in _LEVELS:
            lo, hi = self.ranges(queries[open_], level)
            size = hi - lo
            done = (size.sum(axis=1) >= gather * n) & (size.max(axis=1) >= min(least, n))
            if level == 0:
                done[:] = True
            for q, a, b in zip(open_[done], lo[done], hi[done]):
                row = mask[q]
                for t in range(TREES):
                    row[self.order[a[t]:b[t], t]] = True
            open_ = open_[~done]
            if not len(open_):
                break
        return mask


def calibrate(vectors: np.ndarray, queries: np.ndarray, norm2: float, k: int,
              recall: float) -> float:
    """Smallest of CHOICES with which a forest over the sample finds ``recall`` of the nearest.
    A query's own vector is none of them."""
    if len(vectors) <= k + 1 or not len(queries):
        return CHOICES[-1]
    forest, codes = Forest(vectors, norm2), hash_strings(queries, norm2, True)
    score = queries @ vectors.T
    own = (queries ** 2).sum(axis=1)[:, None]
    for q, row in enumerate(np.isclose(score, own, rtol=1e-12)):
        for i in np.flatnonzero(row):
            if np.array_equal(vectors[i], queries[q]):
                score[q, i] = -np.inf
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    for gather in CHOICES:
        mask = forest.candidates(codes, gather, k)
        if np.take_along_axis(mask, best, 1).mean() >= recall:
            return gather
    return CHOICES[-1]


def _search(norm2: float, gather: float, k: int):
    """Function for one block of the index and one of the queries: up to k entries per query."""
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())),
                            ("score", pa.float64())])
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        vectors, wanted = _matrix(index["vec"]), _matrix(queries["vec"])
        ids, reps = index["ids"].combine_chunks(), index["rep"].to_numpy()
        names = queries["id"].to_numpy()
        found = ([], [], [])
        forest, codes = Forest(vectors, norm2), hash_strings(wanted, norm2, True)
        for at in range(0, len(names), 256):
            mask = forest.candidates(codes[at:at + 256], gather, k)
            for q, own in enumerate(mask):
                near = np.flatnonzero(own)
                score = vectors[near] @ wanted[at + q]  # of the candidates alone
                if len(near) > k:
                    best = score >= np.partition(score, len(score) - k)[-k]
                    near, score = near[best], score[best]
                order = np.lexsort((reps[near], -score))[:k]
                found[0].append(np.full(len(order), names[at + q]))
                found[1].append(near[order])
                found[2].append(score[order])
        names, near, score = map(np.concatenate, found)
        return pa.table([pa.array(names), ids.take(pa.array(near)).cast(pa.list_(pa.int64())),
                         pa.array(score)], schema=schema)
    return search


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy().astype(float).reshape(len(values), -1)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): ids with a vector that is finite and not zero; of several, the least."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    return (df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec"))
            .where(F.col("id").isNotNull() & F.col("vec").isNotNull())
            .where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)
                            & (F.abs(x) < F.lit(float("inf")))))
            .where(F.exists("vec", lambda x: x != 0))
            .groupBy("id").agg(F.min("vec").alias("vec")))


def nearest(df: DataFrame, id_col: str, vec_col: str, is_query, k: int = 20,
            recall: float = 0.96) -> DataFrame:
    """The ``k`` rows found nearest to each query: query_id, rank, id, score (inner product).

    ``is_query`` makes the condition on the id column that marks queries; candidates are all rows
    but the query's own. Equal vectors are one entry with its k + 1 least ids, which is all that a
    query can need of them. The index is cut into blocks of about BLOCK_ROWS vectors with a forest
    each; blocks of queries meet every block of the index. How far to ascend is set on a sample of
    at most SAMPLE_ROWS vectors and SAMPLE_QUERIES queries, with as many neighbours as fall into
    it, such that ``recall`` of them are among the candidates. Scores are exact, in double
    precision; ties go to the smaller id.

    Cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
    vectors of other lengths are no candidates; of several rows with one id the least vector
    counts; with fewer candidates all are returned; an empty table gives an empty result; further
    columns are not looked at.
    """
    spark = df.sparkSession
    known = written(usable(df, id_col, vec_col), "vectors")
    some = Window.partitionBy("vec").orderBy("id")
    entries = written(known.withColumn("n", F.row_number().over(some)).where(f"n <= {k + 1}")
                      .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")),
                      "entries")
    total = entries.count()
    queries = known.where(is_query(F.col("id")))
    asked = queries.count()
    norm2 = entries.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    size = F.size("vec").alias("dim")
    gather = CHOICES[-1]
    if total and asked:
        gather = _sampled(entries.select("vec"), queries.select("vec"), float(norm2), k, recall,
                          total)
    blocks, query_blocks = max(1, -(-total // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    left = entries.select(
        size, "vec", "ids", F.col("ids")[0].alias("rep"),
        F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"))
    right = queries.select(
        size, "vec", "id", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    found = (left.groupBy("dim", "block", "part").cogroup(right.groupBy("dim", "block", "part"))
             .applyInArrow(_search(float(norm2 or 0), gather, k + 1),  # its own vector may be one
                           "query_id long, ids array<long>, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.select("query_id", F.explode("ids").alias("id"), "score")
            .where("id <> query_id").withColumn("rank", F.row_number().over(best))
            .where(f"rank <= {k}").select("query_id", "rank", "id", "score"))


def _sampled(entries: DataFrame, queries: DataFrame, norm2: float, k: int, recall: float,
             total: int) -> float:
    """:func:`calibrate` on the vectors with the least hashes, of the commonest length."""
    def take(df, n):
        return df.orderBy(F.xxhash64("vec")).limit(n).toArrow()["vec"].to_pylist()
    rows, asked = take(entries, SAMPLE_ROWS), take(queries, SAMPLE_QUERIES)
    lengths = [len(r) for r in rows]
    dim = max(set(lengths), key=lengths.count)
    vectors = np.array([r for r in rows if len(r) == dim])
    wanted = np.array([r for r in asked if len(r) == dim]).reshape(-1, dim)
    near = max(1, min(k, round(k * len(rows) / total)))
    return calibrate(vectors, wanted, norm2, near, recall)
