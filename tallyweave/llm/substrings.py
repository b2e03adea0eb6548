"""Removal of word runs that repeat across documents, by seed and extend."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import (SPACED, HashFilter, WordBatch, arrays_batch, arrow_map, covered,
                                   documents, gram_hashes, signed, window_minima, word_batches)
from tallyweave.session import written

#: Length threshold in words, and words per anchor gram.
WINDOW, GRAM = 13, 5
SCHEMA = ("id long, n_words long, n_removed long, kept_text string, "
          "repeats array<struct<start: int, end: int>>")


def _anchors(words: WordBatch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, winnowed gram of each window, which windows lie in one text)."""
    grams = gram_hashes(words.hashes, GRAM)
    return grams, window_minima(grams, window - GRAM + 1), words.inside(window)


def shared_anchors(table: DataFrame, window: int) -> DataFrame:
    """Hashes of winnowed grams that occur under at least two ids. Counting keeps the least and
    greatest id per hash, so a very common gram is one row per task before the shuffle."""
    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, words in word_batches(batch.column(1), SPACED):
                grams, sel, inside = _anchors(words, window)
                at = np.unique(sel[inside])
                yield arrays_batch(hash=signed(grams[at]), id=ids[row + words.text_of[at]])
        return work
    found = arrow_map(table, "hash long, id long", make)
    return (found.groupBy("hash").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
            .where("lo < hi").select("hash"))


def extended_windows(table: DataFrame, anchors: HashFilter, window: int) -> DataFrame:
    """Every window around a shared anchor: hash, id, place (checksum of the text and position).

    A window belongs to the anchor that winnowing chose in it, so all windows that contain the
    anchor, to its left and right, are extended to once.
    """
    shared = table.sparkSession.sparkContext.broadcast(anchors)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, words in word_batches(batch.column(1), SPACED):
                grams, sel, inside = _anchors(words, window)
                at = np.unique(sel[inside])
                hot = np.zeros(len(grams), bool)
                hot[at] = shared.value.test(grams[at])
                starts = np.flatnonzero(inside & hot[sel])
                text = words.text_of[starts]
                check = np.zeros(len(words.bounds) - 1, np.int64)
                for i in np.unique(text):
                    check[i] = _checksum(words, i)
                yield arrays_batch(
                    hash=signed(gram_hashes(words.hashes, window)[starts]), id=ids[row + text],
                    place=(check[text] << 32) + starts - words.bounds[text])
        return work
    return arrow_map(table, "hash long, id long, place long", make)


def _checksum(words: WordBatch, i: int) -> int:
    """31 bits that tell texts under one id apart."""
    return zlib.crc32(words.data[words.edges[i]:words.edges[i + 1]]) >> 1


def _kept_text(words: WordBatch, keep: np.ndarray) -> pa.Array:
    """Kept words of each text, joined by one blank."""
    mark = np.zeros(len(words.data) + 1, np.int8)
    mark[words.starts[keep]] += 1
    mark[words.ends[keep]] -= 1
    mask = np.cumsum(mark[:-1], dtype=np.int8) > 0
    data = words.data.copy()
    kept = np.flatnonzero(keep)
    more = kept[:-1][words.text_of[kept[:-1]] == words.text_of[kept[1:]]]
    data[words.ends[more]] = 32  # the separator after a word that is not its text's last
    mask[words.ends[more]] = True
    edges = np.concatenate([[0], np.cumsum(mask)])[words.edges].astype(np.int32)
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.tobytes()),
                                       pa.py_buffer(data[mask].tobytes()))


def _cleaned(words: WordBatch, ids: pa.Array, places: list, window: int) -> pa.RecordBatch:
    sizes = np.diff(words.bounds)
    removed = np.zeros(len(words.hashes), bool)
    for i, own in enumerate(places):
        if own is not None and len(own):
            own = np.asarray(own, np.int64)
            own = own[own >> 32 == _checksum(words, i)] & 0xFFFFFFFF
            removed[words.bounds[i]:words.bounds[i + 1]] = covered(own, window, int(sizes[i]))
    spans = [[] for _ in sizes]
    if removed.any():
        for i in np.unique(words.text_of[removed]):
            mask = removed[words.bounds[i]:words.bounds[i + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
            spans[i] = [{"start": a, "end": b} for a, b in zip(edges[::2].tolist(),
                                                              edges[1::2].tolist())]
    counts = np.bincount(words.text_of[removed], minlength=len(sizes))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
         _kept_text(words, ~removed), pa.array(spans, kind)],
        ["id", "n_words", "n_removed", "kept_text", "repeats"])


def remove_repeats(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text, repeats (maximal word spans).

    Words are runs of characters other than blank, tab, LF, VT, FF and CR. A word is removed if a
    run of ``window`` words around it also is in a document with a smaller id, judged on the
    input; ``kept_text`` joins the rest by one blank.

    Seeds are winnowed grams of five words: each window holds one that depends on its words alone.
    Grams under several ids are the shared anchors; around these, matches are extended to all
    windows, and the least id of each window decides, so groups of copies are never paired.
    Adjacent and overlapping windows merge into the maximal repeats. Window hashes have 64 bits.
    Which anchors and which ids take part travels in filters of bounded size that lose nothing.

    Cases: null and empty texts have no words; a null id is never smaller and keeps all words;
    rows with equal ids are never each other's source, repeated rows are cleaned alike; a text of
    fewer words than a window stays whole; an empty table gives an empty result; further columns
    are not looked at.
    """
    table = documents(df, id_col, text_col)
    known = table.where("id is not null")
    anchors = HashFilter.build(written(shared_anchors(known, window), "shared-anchors"), "hash")
    windows = extended_windows(known, anchors, window)  # read twice: cheaper than a stored copy
    first = (windows.groupBy("hash").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
             .where("lo < hi").select("hash", "lo"))
    hits = windows.join(first, "hash").where("id > lo").select("id", "place")
    by_text = written(hits.groupBy("id").agg(F.collect_list("place").alias("places")), "repeats")
    ids = HashFilter.build(by_text.select(F.xxhash64("id").alias("h")), "h")
    touched = df.sparkSession.sparkContext.broadcast(ids)

    def untouched_worker():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            part = batch.filter(pa.array(~_test(touched.value, batch.column(2))))
            for row, words in word_batches(part.column(1), SPACED):
                n = len(words.bounds) - 1
                yield _cleaned(words, part.column(0).slice(row, n), [None] * n, window)
        return work

    def select_worker():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield batch.filter(pa.array(_test(touched.value, batch.column(2)))).select([0, 1])
        return work

    def clean_worker():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row, words in word_batches(batch.column(1), SPACED):
                n = len(words.bounds) - 1
                places = [p.values.to_numpy() if p.is_valid else None
                          for p in batch.column(2).slice(row, n)]
                yield _cleaned(words, batch.column(0).slice(row, n), places, window)
        return work

    hashed = table.withColumn("h", F.xxhash64("id"))
    some = arrow_map(hashed, "id long, text string", select_worker).join(by_text, "id", "left")
    return (arrow_map(hashed, SCHEMA, untouched_worker)
            .unionByName(arrow_map(some.select("id", "text", "places"), SCHEMA, clean_worker)))


def _test(ids: HashFilter, column: pa.Array) -> np.ndarray:
    return ids.test(column.to_numpy(zero_copy_only=False).view(np.uint64))
