"""Benchmark decontamination by winnowed word fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import (LETTERS_LOWER, WordBatch, arrays_batch, arrow_map,
                                   covered, documents, gram_hashes, signed, window_minima,
                                   word_batches)
from tallyweave.session import written

#: Words per window, words per fingerprint gram, grams per winnowing window. Every run of WINDOW
#: words holds GRAMS whole grams, so winnowing keeps at least one of them.
WINDOW, GRAM = 13, 5
GRAMS = WINDOW - GRAM + 1
#: Benchmark windows that one pass over the documents looks for; more take further passes.
BLOCK_WINDOWS = 200_000
_ITEM_SCHEMA = "length int, hash long, anchor long, item string, words binary"
SCHEMA = "id long, n_words long, n_hit long, items array<string>, contaminated boolean"


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per item and distinct window: length, hash, anchor (fingerprint), item, words.

    ``words`` are the window's word hashes, for the exact extension of a hit. Items with fewer
    words than a window are one window of their own length without a fingerprint; a null item id
    counts as the empty string.
    """
    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            names = np.array([i or "" for i in batch.column(0).to_pylist()], object)
            for row, words in word_batches(batch.column(1), LETTERS_LOWER):
                h, b = words.hashes, words.bounds
                grams, sel = gram_hashes(h, GRAM), window_minima(gram_hashes(h, GRAM), GRAMS)
                whole = gram_hashes(h, WINDOW)
                at = np.flatnonzero(words.inside(WINDOW))
                parts = [(WINDOW, s, whole[s], grams[sel[s]]) for s in at]
                for i, n in enumerate(np.diff(b)):
                    if 0 < n < WINDOW:
                        parts.append((int(n), b[i], gram_hashes(h[b[i]:b[i + 1]], int(n))[0],
                                      np.uint64(0)))
                if parts:
                    yield arrays_batch(
                        length=pa.array([p[0] for p in parts], pa.int32()),
                        hash=signed(np.array([p[2] for p in parts], np.uint64)),
                        anchor=signed(np.array([p[3] for p in parts], np.uint64)),
                        item=pa.array([names[row + words.text_of[p[1]]] for p in parts],
                                      pa.string()),
                        words=pa.array([h[p[1]:p[1] + p[0]].tobytes() for p in parts],
                                       pa.binary()))
        return work
    table = items.select(F.col(f"`{id_col}`").cast("string").alias("item"),
                         F.col(f"`{text_col}`").alias("text"))
    return arrow_map(table, _ITEM_SCHEMA, make).distinct()


class Lookup:
    """Benchmark windows of one block as sorted arrays."""

    def __init__(self, table: pa.Table):
        self.by_length = {}
        self.anchors = np.empty(0, np.uint64)
        lengths = table["length"].to_numpy()
        for n in np.unique(lengths):
            part = table.filter(pa.array(lengths == n))
            h = part["hash"].to_numpy().view(np.uint64)
            order = np.argsort(h, kind="stable")
            keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
            words = part["words"].take(pa.array(order[first])).to_pylist()
            matrix = np.frombuffer(b"".join(words), np.uint64).reshape(len(keys), n)
            self.by_length[int(n)] = (keys, matrix, first, count,
                                      np.array(part["item"].to_pylist(), object)[order])
            if n == WINDOW:
                self.anchors = np.unique(part["anchor"].to_numpy().view(np.uint64))

    def hits(self, words: WordBatch) -> Iterator[tuple[int, np.ndarray, tuple]]:
        """(length, starting words, (entries, table)) of the windows that occur in the texts."""
        h = words.hashes
        for n, table in self.by_length.items():
            inside = words.inside(n)
            if n == WINDOW:
                grams = gram_hashes(h, GRAM)
                sel = window_minima(grams, GRAMS)
                if not len(sel):
                    continue
                marked = np.zeros(len(grams), bool)
                used = np.unique(sel[inside])
                marked[used] = _isin(grams[used], self.anchors)[0]
                starts = np.flatnonzero(inside & marked[sel])
                # a hit fingerprint is extended: its whole windows are looked up and compared
                if not len(starts):
                    continue
                keys = gram_hashes(h, n)[starts]
            else:
                starts = np.flatnonzero(inside)
                keys = gram_hashes(h, n)[starts]
            found, entry = _isin(keys, table[0])
            starts, entry = starts[found], entry[found]
            for i in range(n):
                same = h[starts + i] == table[1][entry, i]
                starts, entry = starts[same], entry[same]
            if len(starts):
                yield n, starts, (entry, table)


def _isin(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the keys in the sorted table, their places)."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def judge(words: WordBatch, lookup: Lookup, before: list[tuple] | None) -> list[tuple]:
    """(spans, items) per text: hit words as sorted (start, end) pairs, ids of occurring items."""
    n = len(words.bounds) - 1
    spans = [list(b[0]) for b in before] if before else [[] for _ in range(n)]
    items = [set(b[1]) for b in before] if before else [set() for _ in range(n)]
    for length, starts, (entry, table) in lookup.hits(words):
        text_of = words.text_of[starts]
        for i in np.unique(text_of):
            own = text_of == i
            at = starts[own] - words.bounds[i]
            size = int(words.bounds[i + 1] - words.bounds[i])
            spans[i] += _runs(covered(at, length, size))
            for e in np.unique(entry[own]):
                items[i].update(table[4][table[2][e]:table[2][e] + table[3][e]])
    return list(zip(spans, items))


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _hit_words(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _verdict(spans: list[tuple[int, int]], n: int, share: int) -> tuple[int, bool]:
    hit = _hit_words(spans)
    return hit, hit > 0 and share * hit >= n


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _search(table: DataFrame, items: DataFrame, item_id_col: str, item_text_col: str,
            block_windows: int, schema: str, finish) -> DataFrame:
    """Look all blocks of the benchmark up in ``table`` (id, text, ...), then
    ``finish(rows, word counts, [(spans, items)])`` makes the batches of ``schema``.

    Between two blocks the state is written, so that a pass is never run again.
    """
    found = written(benchmark_windows(items, item_id_col, item_text_col), "benchmark-windows")
    n = max(1, -(-found.count() // block_windows))
    base = len(table.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    state = f"{fields}, spans array<struct<a: int, b: int>>, items array<string>"

    def worker(lookup, last):
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row, words in word_batches(batch.column(1), LETTERS_LOWER):
                part = batch.slice(row, len(words.bounds) - 1)
                before = None
                if batch.num_columns > base:
                    before = [([(s["a"], s["b"]) for s in spans], names) for spans, names in zip(
                        part.column(base).to_pylist(), part.column(base + 1).to_pylist())]
                got = judge(words, lookup.value, before)
                own = [part.column(i) for i in range(base)]
                if last:
                    yield finish(own, np.diff(words.bounds), got)
                else:
                    yield pa.RecordBatch.from_arrays([
                        *own,
                        pa.array([[{"a": a, "b": b} for a, b in s] for s, _ in got], _SPANS),
                        pa.array([sorted(i) for _, i in got], pa.list_(pa.string()))],
                        [*part.schema.names[:base], "spans", "items"])
        return work

    for i in range(n):
        block = found.where(F.pmod(F.xxhash64("hash", "item"), F.lit(n)) == i).toArrow()
        lookup = table.sparkSession.sparkContext.broadcast(Lookup(block))
        last = i == n - 1
        table = arrow_map(table, schema if last else state,
                          lambda lookup=lookup, last=last: worker(lookup, last))
        if not last:
            table = written(table, "decontamination")
    return table


def contamination(df: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id_col: str,
                  item_text_col: str, share: int = 20,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids), contaminated.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A word is hit
    inside any run of 13 words that also is in an item (of all words, for shorter items); a
    document with a hit in at least 1 of ``share`` words is contaminated. Fingerprints are the
    least gram hash of each winnowing window; documents' and benchmark's fingerprints are joined
    by look-up, and each match is extended to its windows and compared word by word.

    The benchmark is broadcast in blocks of ``block_windows`` windows, one pass over the documents
    each; documents are not shuffled, and neither side has a limit.

    Cases: null and empty texts have no words and are clean; repeated rows are judged each; an
    empty benchmark hits nothing; an empty table gives an empty result; further columns are not
    looked at; null item ids are listed as the empty string.
    """
    def finish(own, words, got):
        verdicts = [_verdict(s, n, share) for (s, _), n in zip(got, words.tolist())]
        return pa.RecordBatch.from_arrays([
            own[0], pa.array(words, pa.int64()),
            pa.array([hit for hit, _ in verdicts], pa.int64()),
            pa.array([sorted(i) for _, i in got], pa.list_(pa.string())),
            pa.array([bad for _, bad in verdicts], pa.bool_())],
            ["id", "n_words", "n_hit", "items", "contaminated"])

    return _search(documents(df, id_col, text_col), items, item_id_col, item_text_col,
                   block_windows, SCHEMA, finish)


def decontaminate(df: DataFrame, text_col: str, items: DataFrame, item_id_col: str,
                  item_text_col: str, share: int = 20,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Rows of ``df``, all columns as they are, without the contaminated ones
    (see :func:`contamination`)."""
    def finish(own, words, got):
        keep = pa.array([not _verdict(s, n, share)[1] for (s, _), n in zip(got, words.tolist())],
                        pa.bool_())
        return pa.RecordBatch.from_arrays([own[2].filter(keep)], ["row"])

    table = df.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").alias("text"),
                      F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kept = _search(table, items, item_id_col, item_text_col, block_windows,
                   f"row {table.schema['row'].dataType.simpleString()}", finish)
    return kept.select("row.*")
