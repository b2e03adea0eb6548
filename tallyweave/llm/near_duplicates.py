"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import (SPACED_LOWER, HashFilter, WordBatch, arrays_batch, arrow_map,
                                   documents, gram_hashes, mixed, signed, word_batches)
from tallyweave.llm.components import components
from tallyweave.session import written

#: Least hashes in a signature (16 bits of each), and the chance that a pair just at the similarity
#: threshold may be farther apart than the join's distance.
SYMBOLS, MISS = 48, 1e-5
_MULT = mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mixed(np.arange(1001, SYMBOLS + 1001, dtype=np.uint64))


def distance_bound(percent: int) -> int:
    """Signature distance that pairs of this similarity exceed with a chance below MISS: 19 for
    0.85 and 23 for 0.8. It is odd, so that (distance + 1) / 2 chunks use it fully."""
    differ = 1 - percent / 100
    chance, bound = 1.0, -1
    while chance >= MISS or bound % 2 == 0:
        bound += 1
        chance -= comb(SYMBOLS, bound) * differ ** bound * (1 - differ) ** (SYMBOLS - bound)
    if bound > 2 * SYMBOLS // 3:
        raise ValueError(f"similarity of {percent} percent is too low for {SYMBOLS} symbols")
    return bound


def shingle_sets(words: WordBatch, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    b, grams = words.bounds, gram_hashes(words.hashes, size)
    out = []
    for i in range(len(b) - 1):
        n = int(b[i + 1] - b[i])
        if n >= size:
            out.append(np.unique(grams[b[i]:b[i + 1] - size + 1]))
        else:
            out.append(gram_hashes(words.hashes[b[i]:b[i + 1]], n) if n
                       else np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of the least value of each hash function over the set."""
    out = np.empty(SYMBOLS, np.uint16)
    for i in range(SYMBOLS):
        h = (shingles * _MULT[i]) + _ADD[i]
        h ^= h >> np.uint64(29)
        out[i] = mixed((h * np.uint64(0xBF58476D1CE4E5B9)).min(keepdims=True))[0] & np.uint64(0xFFFF)
    return out.tobytes()


def _fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(table: DataFrame, size: int) -> DataFrame:
    """(id, n, set_hash, sig): set size, 128-bit hash of the set, signature (null if empty); then
    whatever longs ``table`` has behind id and text."""
    more = table.columns[2:]

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row, words in word_batches(batch.column(1), SPACED_LOWER):
                sets = shingle_sets(words, size)
                yield arrays_batch(
                    id=batch.column(0).slice(row, len(sets)),
                    n=pa.array([len(s) for s in sets], pa.int64()),
                    set_hash=pa.array([_fingerprint(s) for s in sets], pa.binary()),
                    sig=pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    **{c: batch.column(i).slice(row, len(sets)) for i, c in enumerate(more, 2)})
        return work
    return arrow_map(table, "id long, n long, set_hash binary, sig binary"
                     + "".join(f", {c} long" for c in more), make)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def chunk_keys(sig: np.ndarray, distance: int) -> np.ndarray:
    """(rows, SYMBOLS) keys: each chunk with each one of its symbols left out.

    Signatures that differ in ``distance`` symbols or fewer have, of (distance + 1) / 2 chunks,
    one that differs in a single symbol at most (pigeonhole); there they share a key.
    """
    keys = np.empty(sig.shape, np.uint64)
    column = 0
    for c, part in enumerate(np.array_split(np.arange(SYMBOLS), (distance + 1) // 2)):
        for hole in part:
            h = np.full(len(sig), (c << 8 | int(hole - part[0])) + 1, np.uint64)
            for j in part:
                if j != hole:
                    h = mixed(h + sig[:, j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            keys[:, column] = h
            column += 1
    return keys


def _key_rows(classes: DataFrame, distance: int, only: HashFilter | None) -> DataFrame:
    """(key, node) for every class, or only where the key is in the filter."""
    shared = classes.sparkSession.sparkContext.broadcast(only) if only else None

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                keys = chunk_keys(_matrix(part.column(1)), distance).ravel()
                nodes = np.repeat(part.column(0).to_numpy(), SYMBOLS)
                if shared:
                    keep = shared.value.test(keys)
                    keys, nodes = keys[keep], nodes[keep]
                yield arrays_batch(key=signed(keys), node=nodes)
        return work
    return arrow_map(classes.select("node", "sig"), "key long, node long", make)


def _sets(nodes: DataFrame, classes: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the classes in ``nodes`` (node), read from the documents again."""
    own = written(classes.join(nodes, "node", "left_semi")
                  .select("node", "set_hash", F.xxhash64("rep").alias("h")), "wanted-sets")
    wanted = table.sparkSession.sparkContext.broadcast(HashFilter.build(own, "h"))

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            part = batch.filter(pa.array(wanted.value.test(ids)))
            for row, words in word_batches(part.column(1), SPACED_LOWER):
                sets = shingle_sets(words, size)
                yield arrays_batch(
                    h=part.column(2).slice(row, len(sets)),
                    set_hash=pa.array([_fingerprint(s) for s in sets], pa.binary()),
                    shingles=pa.array([s.tobytes() for s in sets], pa.binary()))
        return work
    found = arrow_map(table.select("id", "text", F.xxhash64("id").alias("h")),
                      "h long, set_hash binary, shingles binary", make)
    return written(found.join(own, ["h", "set_hash"]).dropDuplicates(["h", "set_hash"])
                   .select("node", "shingles"), "sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, table: DataFrame, size: int,
               percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures are near enough and whose whole sets are similar."""
    own = classes.select("node", "sig", "n")
    near = (pairs.join(own.select(F.col("node").alias("a"), F.col("sig").alias("sa"),
                                  F.col("n").alias("na")), "a")
            .join(own.select(F.col("node").alias("b"), F.col("sig").alias("sb"),
                             F.col("n").alias("nb")), "b")
            .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
            .select("a", "b", "sa", "sb"))
    bound = distance_bound(percent)

    def distance():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            differ = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(axis=1)
            yield batch.filter(pa.array(differ <= bound)).select([0, 1])
        return work
    near = written(arrow_map(near, "a long, b long", distance), "near-pairs")
    nodes = written(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    sets = _sets(nodes, classes, table, size)
    both = (near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
            .select("a", "b", "x", "y"))

    def similar():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])
        return work
    return arrow_map(both, "a long, b long", similar)


def _judged(table: DataFrame, size: int, percent: int,
            with_null: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`signatures`, and (set_hash, component, leads) for every set of words:
    the least id of the set's component, and whether the component's first set is this one.

    An id may stand at several sets, so sets are linked under numbers of their own (``node``),
    which follow the order of least id (null last) and set hash; ids come back at the end. Rows
    with a null id are left out unless ``with_null``.
    """
    rows = written(signatures(table, size), "signatures")
    counted = rows.where("n > 0" if with_null else "n > 0 and id is not null")
    classes = written(counted.groupBy("set_hash")
                      .agg(F.min("id").alias("rep"), F.first("sig").alias("sig"),
                           F.first("n").alias("n"))
                      .orderBy(F.asc_nulls_last("rep"), "set_hash")
                      .withColumn("node", F.monotonically_increasing_id()), "classes")
    shared = written(_key_rows(classes, distance_bound(percent), None).groupBy("key")
                     .agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                     .where("lo < hi").select("key", "lo"), "shared-keys")
    members = written(_key_rows(classes, distance_bound(percent), HashFilter.build(shared, "key"))
                      .join(shared, "key"), "key-members")
    star = members.where("lo < node").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    links = written(_confirmed(star.distinct(), classes, table, size, percent), "links")
    labels = components(links)
    rest = _across(members, labels, classes, table, size, percent)
    more = written(_confirmed(rest, classes, table, size, percent), "links")
    if more.limit(1).count():
        labels = components(links.union(more))
    first = labels.join(classes.select(F.col("node").alias("label"), F.col("rep").alias("least")),
                        "label")
    reach = (classes.select("set_hash", "rep", "node").join(first, "node", "left")
             .select("set_hash", F.when(F.col("label").isNull(), F.col("rep"))
                     .otherwise(F.col("least")).alias("component"),
                     F.coalesce(F.col("label") == F.col("node"), F.lit(True)).alias("leads")))
    return rows, reach


def near_duplicates(df: DataFrame, id_col: str, text_col: str, size: int = 3,
                    percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Words are runs of characters other than blank, tab, LF, VT, FF and CR after lower-casing A-Z;
    a document's set holds its distinct runs of ``size`` words (all words, if fewer). Documents
    are linked if intersection * 100 >= union * ``percent``; ``component_id`` is the least id
    reachable, and the document with that id is kept.

    Documents with one set are one class. Classes meet under the keys of :func:`chunk_keys`. First
    every class is compared with the least class of each key it shares; that joins most of a
    group. Then the classes under keys where several components are left are compared across
    components (:func:`_across`). So no link between components is missed among signatures within
    :func:`distance_bound`, and links inside one component are not written out. Every link is
    confirmed on whole sets.

    Cases: texts that are null or without words are linked with nothing; a row with a null id has
    a null component and is kept; rows with equal ids and different texts are judged each, and of
    such rows in one component those with the component's first set are kept; an empty table gives
    an empty result; further columns are not looked at.
    """
    rows, reach = _judged(documents(df, id_col, text_col), size, percent, False)
    out = rows.join(reach, "set_hash", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("id").isNull() | (F.col("n") == 0)
                       | ((F.col("id") == component) & F.col("leads"))).alias("kept"))


def one_of_each(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """The rows of ``df`` without near duplicates: one row per component of
    :func:`near_duplicates`, and of rows without words one per id and text.

    Null ids count as the latest, and rows with one are linked like any other. Of the rows with
    the component's first set, the one with the least id stays, then by a hash of the text, then
    by a hash of all columns; rows equal in all columns are one.
    """
    keys = {"h": F.xxhash64(F.col(f"`{text_col}`")),
            "r": F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in df.columns])}
    table = df.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                      F.col(f"`{text_col}`").alias("text"),
                      *[v.alias(k) for k, v in keys.items()])
    rows, reach = _judged(table, size, percent, True)
    place = F.struct(F.col("id").isNull().alias("late"), "id", "h", "r").alias("place")
    least = (rows.where("n > 0").join(reach.where("leads").select("set_hash"), "set_hash",
                                      "left_semi")
             .select("set_hash", place).groupBy("set_hash").agg(F.min("place").alias("place")))
    wordless = (rows.where("n = 0").select("id", "h", place).groupBy("id", "h")
                .agg(F.min("place").alias("place")))
    chosen = written(least.select("place.*").union(wordless.select("place.*"))
                     .select("h", "r", "late", F.coalesce("id", F.lit(0)).alias("i")).distinct(),
                     "chosen-rows")
    own = F.col(f"`{id_col}`").cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    keyed = df.select(row, keys["h"].alias("h"), keys["r"].alias("r"),
                      own.isNull().alias("late"), F.coalesce(own, F.lit(0)).alias("i"))
    on = ["h", "r", "late", "i"]
    return (keyed.join(chosen, on, "left_semi").groupBy(*on).agg(F.first("row").alias("row"))
            .select("row.*"))


def _across(members: DataFrame, labels: DataFrame, classes: DataFrame, table: DataFrame,
            size: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components that may be similar, among the classes that
    share a key with another component.

    Comparing all of them would square a group of texts that have a passage in common. Of two
    similar sets, though, the rarest shingles already agree: with shingles in one order, rarest
    first, the first one in common stands so early in both that the rest can still hold the
    overlap. Only pairs with a common shingle at such places are made.
    """
    own = (members.join(labels, "node", "left")
           .select("key", "node", F.coalesce("label", "node").alias("comp")))
    mixed_keys = (own.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
                  .where("x < y").select("key"))
    rest = written(own.join(mixed_keys, "key", "left_semi").select("node", "comp").distinct(),
                   "unjoined")
    sets = _sets(rest.select("node"), classes, table, size)

    def shingles():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, 500):
                own = [np.frombuffer(b, np.int64) for b in batch.column(1)[at:at + 500].to_pylist()]
                sizes = [len(x) for x in own]
                yield arrays_batch(node=np.repeat(batch.column(0)[at:at + 500].to_numpy(), sizes),
                                   n=np.repeat(np.array(sizes, np.int64), sizes),
                                   shingle=np.concatenate(own))
        return work
    all_shingles = arrow_map(sets, "node long, n long, shingle long", shingles)
    common = (all_shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    lists = (all_shingles.join(common, "shingle").groupBy("node", "n")
             .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("list"))
             .join(rest, "node"))
    # shingles that no other set has come first
    early = written(lists.select("node", "comp", "n", F.size("list").alias("m"),
                                 F.posexplode("list").alias("pos", "entry"))
                    .select("node", "comp", "n", F.col("entry.shingle").alias("shingle"),
                            (F.col("n") - F.col("m") + F.col("pos")).alias("place"))
                    .where(F.lit(100) * (F.col("n") - F.col("place")) >= percent * F.col("n")),
                    "early-shingles")
    x, y = early.alias("x"), early.alias("y")
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    return (x.join(y, F.col("x.shingle") == F.col("y.shingle"))
            .where((F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
                   & (left * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
