"""Words of whole batches as arrays, and table helpers that the operators here share.

Text work is done on Arrow batches: the UTF-8 bytes of many documents are split into words and
hashed with a few array operations, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise: spread every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(_BLOCK + 1, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers


def byte_rule(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that belong to words, what each byte is read as)."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    read = np.arange(256, dtype=np.uint8)
    if lower:
        read[65:91] += 32
    return inside, read


#: Words end at blank, tab, line feed, VT, FF and carriage return only.
SPACED = byte_rule(b"\x20\x09\x0a\x0b\x0c\x0d", False)
SPACED_LOWER = byte_rule(b"\x20\x09\x0a\x0b\x0c\x0d", True)
#: Words are a-z, 0-9 and everything beyond ASCII, after lower-casing A-Z.
LETTERS_LOWER = byte_rule(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61),
                                 *range(0x7B, 0x80)]), True)


class WordBatch:
    """Words of some consecutive texts.

    ``data``: bytes as read; ``starts``, ``ends``: byte range of each word; ``bounds``: index of
    each text's first word, and the number of words; ``hashes``: 64 bits per word.
    """

    def __init__(self, data: np.ndarray, edges: np.ndarray, rule: tuple[np.ndarray, np.ndarray]):
        inside = rule[0][data]
        self.data, self.edges = rule[1][data], edges
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = edges[:-1][edges[:-1] < len(data)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = edges[1:][edges[1:] > 0] - 1
        last[cuts] = inside[cuts]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, edges)
        self.hashes = self._hash()
        self.text_of = np.repeat(np.arange(len(edges) - 1), np.diff(self.bounds))

    def _hash(self) -> np.ndarray:
        up, down = _power_tables()
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(out):
            base = self.starts[a]
            b = int(np.searchsorted(self.ends, base + _BLOCK, side="right"))
            if b == a:  # one word longer than a block
                b = a + 1
                out[a] = xxhash.xxh3_64_intdigest(self.data[base:self.ends[a]].tobytes())
            else:
                part = self.data[base:self.ends[b - 1]]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_BYTE[part] * up[:len(part)], out=sums[1:])
                s, e = self.starts[a:b] - base, self.ends[a:b] - base
                out[a:b] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _STEP)
            a = b
        return out

    def inside(self, n: int) -> np.ndarray:
        """For each word: do it and the next n - 1 words belong to one text?"""
        count = max(0, len(self.text_of) - n + 1)
        return self.text_of[:count] == self.text_of[n - 1:n - 1 + count]


def word_batches(column: pa.Array, rule: tuple[np.ndarray, np.ndarray],
                 limit: int = 2 << 20) -> Iterator[tuple[int, WordBatch]]:
    """(first row, words) for runs of rows of about ``limit`` bytes; null texts have no words."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1]
    edges = edges.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + limit, side="right")) - 1)
        yield a, WordBatch(data[edges[a]:edges[b]], edges[a:b + 1] - edges[a], rule)
        a = b


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words (none if there are fewer)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(((2 * n + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1 | 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out *= base
        out += words[i:i + count]
    return mixed(out)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values: index of its smallest value, the first of equals."""
    count = len(h) - width + 1
    if count <= 0:
        return np.empty(0, np.int64)
    value, at = h, np.arange(len(h))
    have = 1
    while have < width:
        step = min(have, width - have)
        later = value[step:] < value[:len(value) - step]
        at = np.where(later, at[step:], at[:len(at) - step])
        value = np.where(later, value[step:], value[:len(value) - step])
        have += step
    return at[:count]


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Mask of the positions below ``n`` inside any span ``start .. start + length - 1``."""
    edges = np.bincount(starts, minlength=n + 1)[:n + 1] - np.bincount(
        np.minimum(starts + lengths, n), minlength=n + 1)[:n + 1]
    return np.cumsum(edges[:n]) > 0


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return np.ascontiguousarray(h).view(np.int64)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """``make()``, remembered by a Python worker for later tasks with the same ``key`` only: one
    value at a time, dropped as soon as the worker turns to other work (:func:`arrow_map`)."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    """Free what the worker remembers."""
    _kept.clear()


def arrow_map(df: DataFrame, schema: str,
              make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """``mapInArrow`` with a fresh worker per task: ``make()`` gives the function for batches."""
    def run(batches):
        drop_kept()
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
    return df.mapInArrow(run, schema)


def arrays_batch(**columns) -> pa.RecordBatch:
    """Record batch of numpy or Arrow arrays."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()],
        list(columns))


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that count, under fixed names; whatever else ``df`` has stays out."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                     F.col(f"`{text_col}`").alias("text"))


class HashFilter:
    """A Bloom filter of bounded size over 64-bit hashes, built by an aggregate and broadcast.

    It never misses a hash it was built from, so what it lets through is complete. Beyond
    ``max_bits`` / 32 hashes it only lets more through than needed; results do not change.
    """

    _PROBES, _SEGMENT = 8, 32768

    def __init__(self, bits: int, segments: dict[int, bytes]):
        self.bits = bits
        data = np.zeros(bits // 8, np.uint8)
        size = self._SEGMENT // 8
        for number, part in segments.items():
            data[number * size:(number + 1) * size] = np.frombuffer(part, np.uint8)
        self.data = data

    @classmethod
    def build(cls, df: DataFrame, hash_col: str, max_bits: int = 1 << 28) -> HashFilter:
        """``df`` must be cheap to read twice (a written table). At most ``max_bits`` / 8 bytes
        reach the driver, whatever the size of ``df``."""
        bits = cls._SEGMENT
        count = df.count()
        while bits < min(32 * count, max_bits):
            bits *= 2
        h = F.col(hash_col)
        low = h.bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
        at = [(low + F.lit(i) * high).bitwiseAND(F.lit(bits - 1)) for i in range(cls._PROBES)]
        rows = (df.select(F.explode(F.array(*at)).alias("at"))
                .groupBy(F.shiftright("at", 15).alias("segment"))
                .agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("part"))
                .collect())
        return cls(bits, {r["segment"]: bytes(r["part"]) for r in rows})

    def test(self, h: np.ndarray) -> np.ndarray:
        """Mask of the hashes that may be in the filter."""
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        found = np.arange(len(h))
        for i in range(self._PROBES):  # most misses end after the first probes
            at = ((low[found] + np.uint64(i) * high[found]) & np.uint64(self.bits - 1)).astype(
                np.int64)
            found = found[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(h), bool)
        out[found] = True
        return out
