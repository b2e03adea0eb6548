"""Removal of near-repeated lines by a deletion-neighbourhood join."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import HashFilter, arrow_map, mixed, signed, texts_of
from tallyweave.session import written

#: Shorter lines never count as repeated.
MIN_CHARS = 20
_BLANKS = re.compile(r"[ \t\r\f\v]+")
_BASE = 0xD6E8FEB86659FD93
_ORDER = "struct<late: boolean, id: bigint, line: int, check: bigint>"


def plain_line(line: str) -> str:
    """Without blanks at the ends, and with one blank for a run of blanks and tabs."""
    line = line.strip(" \t\r\f\v")
    if "  " in line or "\t" in line or "\r" in line or "\f" in line or "\v" in line:
        line = _BLANKS.sub(" ", line)
    return line


def half_keys(line: str) -> list[int]:
    """Keys of the line's first and last half, for partners of its length, one more, one less.

    Lines within one edit share the first or the last h characters, h being half of the shorter
    one's length; a key also holds h and the side.
    """
    n = len(line)
    out = []
    for h in _halves(n):
        out.append(xxhash.xxh3_64_intdigest(line[:h], 2 * h))
        out.append(xxhash.xxh3_64_intdigest(line[n - h:], 2 * h + 1))
    return out


def _halves(n: int) -> tuple[int, ...]:
    return (n // 2, (n - 1) // 2) if n % 2 == 0 else (n // 2,)


def open_part(n: int, shared: list[bool]) -> tuple[int, int]:
    """First and last position at which a line may differ from its partners, by which of its
    :func:`half_keys` are shared: behind a shared first half, or before a shared last half.

    If several positions give the same variant, one of them lies there.
    """
    first, last = n, -1
    for i, h in enumerate(_halves(n)):
        if shared[2 * i]:
            first, last = min(first, h), n - 1
        if shared[2 * i + 1]:
            first, last = 0, max(last, n - 1 - h)
    return first, last


_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, int]:
    inverse = pow(_BASE, -1, 1 << 64)
    if not _tables or len(_tables[0]) < n:
        table = np.full(max(n, 4096), _BASE, np.uint64)
        table[0] = 1
        _tables[:] = [np.cumprod(table, dtype=np.uint64)]
    return _tables[0][:n], inverse


def deletion_variants(line: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, deleted position) of the line itself, at -1, and of it without each character."""
    codes = mixed(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
                  + np.uint64(1))
    n = len(codes)
    up, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * up, out=sums[1:])
    without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(inverse)
    size = np.full(n + 1, n - 1, np.uint64)
    size[0] = n
    hashes = mixed(np.concatenate([sums[-1:], without]) + size * np.uint64(0x9E3779B97F4A7C15))
    return hashes, np.arange(-1, n, dtype=np.int32)


def _line_rows(table: DataFrame, min_chars: int, only: HashFilter | None) -> DataFrame:
    """One row per line that counts: h1, h2 (128-bit hash), ord (its place in the corpus), and
    the half keys, or, for lines with a half key in ``only``, the line and its open part."""
    shared = table.sparkSession.sparkContext.broadcast(only) if only else None
    last = "keys array<bigint>" if only is None else "part struct<text: string, a: int, b: int>"

    def candidates(rows: list[tuple]) -> list[tuple]:
        found = shared.value.test(np.array([k for r in rows for k in r[2]], np.uint64)).tolist()
        out, at = [], 0
        for line, order, keys in rows:
            own = found[at:at + len(keys)]
            at += len(keys)
            if any(own):
                out.append((line, order, open_part(len(line), own)))
        return out

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 200):
                rows = []
                for key, text in zip(ids[at:at + 200], texts_of(batch.column(1).slice(at, 200))):
                    check = None
                    for number, line in enumerate(text.split("\n")):
                        line = plain_line(line)
                        if len(line) < min_chars:
                            continue
                        if check is None:
                            check = zlib.crc32(text.encode())
                        rows.append((line, (key is None, 0 if key is None else key, number, check),
                                     half_keys(line)))
                if shared and rows:
                    rows = candidates(rows)
                if rows:
                    lines, order, extra = zip(*rows)
                    digests = [xxhash.xxh3_128_intdigest(line) for line in lines]
                    h1, h2 = [d >> 64 for d in digests], [d & (1 << 64) - 1 for d in digests]
                    late, key, number, check = zip(*order)
                    if only is None:
                        flat = pa.array(signed(np.array([k for e in extra for k in e], np.uint64)))
                        edges = np.cumsum([0, *map(len, extra)]).astype(np.int32)
                        column = pa.ListArray.from_arrays(pa.array(edges), flat)
                    else:
                        first, end = zip(*extra)
                        column = pa.StructArray.from_arrays(
                            [pa.array(lines, pa.string()), pa.array(first, pa.int32()),
                             pa.array(end, pa.int32())], ["text", "a", "b"])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(signed(np.array(h1, np.uint64))),
                        pa.array(signed(np.array(h2, np.uint64))),
                        pa.StructArray.from_arrays(
                            [pa.array(late, pa.bool_()), pa.array(key, pa.int64()),
                             pa.array(number, pa.int32()), pa.array(check, pa.int64())],
                            ["late", "id", "line", "check"]), column],
                        ["h1", "h2", "ord", last.split()[0]])
        return work
    return arrow_map(table.select("id", "text"), f"h1 bigint, h2 bigint, ord {_ORDER}, {last}", make)


def _variants(lines: DataFrame, only: HashFilter | None) -> DataFrame:
    """(variant, hole, line, ord): every line as it is and without each character of its open
    part, or only the variants in the filter; ``line`` is a hash of the line."""
    shared = lines.sparkSession.sparkContext.broadcast(only) if only else None

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            parts = batch.column(2).to_pylist()
            for at in range(0, len(parts), 100):
                hashes, holes, rows = [], [], []
                for i, part in enumerate(parts[at:at + 100], at):
                    h, p = deletion_variants(part["text"])
                    keep = np.r_[0, part["a"] + 1:part["b"] + 2]
                    if shared:
                        keep = keep[shared.value.test(h[keep])]
                    hashes.append(h[keep])
                    holes.append(p[keep])
                    rows.append(np.full(len(keep), i))
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(hashes))), pa.array(np.concatenate(holes)),
                     batch.column(0).take(rows), batch.column(1).take(rows)],
                    ["variant", "hole", "line", "ord"])
        return work
    return arrow_map(lines.select("h1", "ord", "part"),
                     f"variant bigint, hole int, line bigint, ord {_ORDER}", make)


def near_repeats(lines: DataFrame) -> DataFrame:
    """``ord`` of every distinct line (h1, ord, part) that is within one edit of an earlier one.

    Variants of one line alone drop out first. The rest is joined without pairing all lines of a
    group. Lines that agree without the character at one position are all within one edit of each
    other, so the earliest suffices; a whole line and the lines of which it is a variant are
    compared through their earliest too. The edit distance of each deciding pair is verified on
    the lines.
    """
    several = (_variants(lines, None).groupBy("variant")
               .agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
               .where("lo < hi").select("variant"))
    shared = HashFilter.build(written(several, "shared-variants"), "variant")
    variants = written(_variants(lines, shared).drop("line"), "variants")
    holes, whole = variants.where("hole >= 0"), variants.where("hole < 0")
    same = (holes.groupBy("variant", "hole")
            .agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
            .where("first < last").select("variant", "hole", "first"))
    pairs = holes.join(same, ["variant", "hole"]).where("ord > first").select("ord", "first")
    least = whole.groupBy("variant").agg(F.min("ord").alias("entire"))
    pairs = pairs.union(holes.join(least, "variant").where("ord > entire")
                        .select("ord", "entire"))
    cut = holes.groupBy("variant").agg(F.min("ord").alias("short"))
    pairs = pairs.union(whole.join(cut, "variant").where("ord > short").select("ord", "short"))
    pairs = pairs.distinct()
    left = lines.select("ord", F.col("part.text").alias("a"))
    right = lines.select(F.col("ord").alias("first"), F.col("part.text").alias("b"))
    return (pairs.join(left, "ord").join(right, "first")
            .where(F.levenshtein("a", "b", 1) >= 0).select("ord").distinct())


def _decisions(table: DataFrame, min_chars: int) -> DataFrame:
    """(late, id, check, kept): numbers of the counting lines that each text keeps."""
    first = written(_line_rows(table, min_chars, None).groupBy("h1", "h2")
                    .agg(F.min("ord").alias("ord"), F.first("keys").alias("keys")), "lines")
    halves = (first.select("h1", F.explode("keys").alias("key")).groupBy("key")
              .agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi"))
    shared = HashFilter.build(written(halves.select("key"), "half-keys"), "key")
    lines = written(_line_rows(table, min_chars, shared).groupBy("h1", "h2")
                    .agg(F.min("ord").alias("ord"), F.first("part").alias("part")), "lines")
    kept = first.select("ord").join(written(near_repeats(lines), "near-lines"), "ord", "left_anti")
    return (kept.groupBy("ord.late", "ord.id", "ord.check")
            .agg(F.collect_list("ord.line").alias("kept")))


def dedup_lines(df: DataFrame, id_col: str, text_col: str,
                min_chars: int = MIN_CHARS) -> DataFrame:
    """Columns id, text, n_lines, n_removed, and ``row``, the struct of all of ``df``'s columns.

    Lines end at LF. A line of at least ``min_chars`` characters, blanks at its ends aside, is
    removed if an earlier line of the corpus equals it or is within one insertion, deletion or
    substitution of it, runs of blanks and tabs counting as one blank. Earlier means a smaller id,
    then a smaller line number; every line is judged on the input. Shorter lines stay.

    Exact repeats are aggregated first. Single deletions of a line are emitted as hashed keys and
    joined (:func:`near_repeats`), but only for lines that share their first or last half with
    another line, without which no edit leads to one, and only outside that half. Shared halves
    and variants travel in filters of bounded size that lose none.

    Cases: a null text stays null and an empty one empty, with no and one line; null ids count as
    the latest; repeated rows with equal ids and texts are one document and keep the same lines;
    of equal ids with different texts, the smaller checksum is earlier; an empty table gives an
    empty result; further columns are carried along in ``row`` only.
    """
    table = df.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                      F.col(f"`{text_col}`").alias("text"),
                      F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kept = written(_decisions(table, min_chars), "kept-lines")
    keyed = table.select("*", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("c"),
                         F.coalesce("id", F.lit(0)).alias("i"), F.col("id").isNull().alias("l"))
    joined = keyed.join(kept.select(F.col("id").alias("i"), F.col("check").alias("c"),
                                    F.col("late").alias("l"), "kept"), ["i", "c", "l"], "left")

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, lines, removed = [], [], []
            for text, numbers in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                split = [] if text is None else text.split("\n")
                numbers = set(numbers or ())
                keep = [line for i, line in enumerate(split)
                        if i in numbers or len(plain_line(line)) < min_chars]
                texts.append(None if text is None else "\n".join(keep))
                lines.append(len(split))
                removed.append(len(split) - len(keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()),
                 pa.array(removed, pa.int64()), batch.column(2)],
                ["id", "text", "n_lines", "n_removed", "row"])
        return work
    kind = table.schema["row"].dataType.simpleString()
    return arrow_map(joined.select("id", "text", "row", "kept"),
                     f"id long, text string, n_lines long, n_removed long, row {kind}", make)
