"""Jaro distance as an Arrow-batched function."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# The function travels with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


_WIDTH = 64  # characters of a name that one machine word has a bit for
_LOW = np.array([(1 << k) - 1 for k in range(_WIDTH + 1)], np.uint64)  # the lowest k bits
#: For every place in the right string: the places within each reach of it.
_WINDOW = np.array([[(1 << min(j + r + 1, _WIDTH)) - (1 << max(j - r, 0))
                     for r in range(_WIDTH // 2)] for j in range(_WIDTH)], np.uint64)
_ONE = np.uint64(1)


def _code_points(strings: list[str], width: int) -> np.ndarray:
    """Rows of code points, padded with zeros."""
    out = np.zeros((len(strings), width), dtype=np.uint32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    out[np.arange(width) < lens[:, None]] = flat
    return out


def jaro_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro similarity of aligned lists: one numpy step per character position.

    Each character of ``right`` takes the first free equal character of ``left`` inside the
    window ``max(len) // 2 - 1``; half of the matched characters that stand in another order
    count as transpositions (rounded down).
    """
    n = len(left)
    sim = np.zeros(n)
    la = np.fromiter(map(len, left), dtype=np.int64, count=n)
    lb = np.fromiter(map(len, right), dtype=np.int64, count=n)
    sim[(la == 0) & (lb == 0)] = 1.0
    todo = np.flatnonzero((la > 0) & (lb > 0))
    # Rows of similar length go together, so that padding stays small.
    longer = np.maximum(la[todo], lb[todo])
    todo = todo[np.argsort(longer, kind="stable")]
    short = int((longer <= _WIDTH).sum())
    for some, block in ((todo[:short], _jaro_words), (todo[short:], _jaro_block)):
        for part in np.array_split(some, max(1, -(-len(some) // 2048))):
            if len(part):
                sim[part] = block([left[i] for i in part], [right[i] for i in part],
                                  la[part], lb[part])
    return sim


def _jaro_block(left, right, la, lb):
    a = _code_points(left, int(la.max()))
    b = _code_points(right, int(lb.max()))
    n, wa, wb = len(la), a.shape[1], b.shape[1]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free = np.arange(wa) < la[:, None]
    taken_b = np.zeros((n, wb), dtype=bool)
    pos = np.arange(wa)
    rows = np.arange(n)
    for j in range(wb):
        ok = free & (a == b[:, j, None]) & (np.abs(pos - j) <= reach[:, None])
        ok &= (j < lb)[:, None]
        hit = ok.any(axis=1)
        first = ok.argmax(axis=1)
        free[rows[hit], first[hit]] = False
        taken_b[:, j] = hit
    taken_a = ~free & (pos < la[:, None])
    m = taken_b.sum(axis=1)
    # Matched characters in reading order, packed to the left.
    order_a = np.argsort(~taken_a, axis=1, kind="stable")
    order_b = np.argsort(~taken_b, axis=1, kind="stable")
    k = int(m.max()) if n else 0
    seq_a = np.take_along_axis(a, order_a[:, :k], axis=1)
    seq_b = np.take_along_axis(b, order_b[:, :k], axis=1)
    moved = ((seq_a != seq_b) & (np.arange(k) < m[:, None])).sum(axis=1) // 2
    md = np.maximum(m, 1).astype(float)
    s = (m / la + m / lb + (md - moved) / md) / 3.0
    return np.where(m == 0, 0.0, s)


def _jaro_words(left, right, la, lb):
    """:func:`_jaro_block` for strings of at most _WIDTH characters: one bit per character."""
    a, b = _code_points(left, _WIDTH), _code_points(right, int(lb.max()))
    seen = np.zeros(int(b.max()) + 1, bool)
    seen[b] = True
    kinds = np.flatnonzero(seen)
    codes = (np.cumsum(seen) - 1)[np.ascontiguousarray(b.T)]
    codes[np.arange(b.shape[1])[:, None] >= lb] = len(kinds)  # equals nothing
    # where every character stands in every left string
    places = np.zeros((len(kinds) + 1, len(la)), np.uint64)
    for k, kind in enumerate(kinds):
        places[k] = np.packbits((a == kind).ravel(), bitorder="little").view("<u8")
    reach, rows = np.maximum(np.maximum(la, lb) // 2 - 1, 0), np.arange(len(la))
    free = _LOW[la]
    equal, hits = [], []
    for j, code in enumerate(codes):
        same = places[code, rows]
        fits = same & free & _WINDOW[j][reach]
        first = fits & (~fits + _ONE)
        free ^= first
        equal.append(same)
        hits.append(first != 0)
    taken = _LOW[la] & ~free
    m = np.bitwise_count(taken).astype(np.int64)
    moved = np.zeros(len(la), np.int64)
    for same, hit in zip(equal, hits):  # the next matched character of both, in reading order
        first = taken & (~taken + _ONE) & (hit * ~np.uint64(0))
        moved += hit & (same & first == 0)
        taken ^= first
    moved //= 2
    md = np.maximum(m, 1).astype(float)
    s = (m / la + m / lb + (md - moved) / md) / 3.0
    return np.where(m == 0, 0.0, s)


def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    null = np.array(a.is_null()) | np.array(b.is_null())
    left = [x or "" for x in a.to_pylist()]
    right = [x or "" for x in b.to_pylist()]
    return pa.array(1.0 - jaro_batch(left, right), mask=null, type=pa.float64())


def jaro_distance(a: Column, b: Column) -> Column:
    """1 - Jaro similarity; NULL when either side is NULL."""
    udf = F.arrow_udf(_distance, DoubleType())
    return udf(a, b)
