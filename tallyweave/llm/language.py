"""Language identification by compression with one dictionary per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import arrow_map, documents, texts_of

#: Bounds of what is learnt: documents per language, characters of each, dictionary bytes, and the
#: documents and bytes of all languages together, which many languages share. Of a longer document,
#: characters come from PIECES places spread over all of it.
#: LEVEL and BLOCK: compression level, characters encoded at once.
DOCS_PER_LANGUAGE, CHARS_PER_DOC, DICTIONARY_BYTES = 400, 1500, 200_000
ALL_DOCS, ALL_BYTES = 80_000, 40_000_000
#: Languages whose limits are broadcast (some 50 bytes each).
MAP_ROWS = 100_000
PIECES = 5
PIECE_CHARS = (CHARS_PER_DOC - PIECES + 1) // PIECES
LEVEL, BLOCK = 6, 8000
SCHEMA = "id long, lang_pred string, score double, confident boolean"
_OTHER = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    """Lower-case words of letters between single blanks; empty if there is no letter."""
    words = _OTHER.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


def spread_pieces(text, key):
    """Column: a text up to CHARS_PER_DOC, or one piece of each PIECES-th part of a longer one, at
    a place set by the hash of its key, with a blank between pieces."""
    part = F.floor(F.length(text) / PIECES).cast("int")
    pieces = []
    for i in range(PIECES):
        free = part - F.lit(PIECE_CHARS) + 1
        at = F.pmod(F.xxhash64(key, F.lit(i)), F.greatest(free, F.lit(1)).cast("long"))
        pieces.append(F.substring(text, (part * i + at).cast("int") + 1, F.lit(PIECE_CHARS)))
    return F.when(F.length(text) <= CHARS_PER_DOC, text).otherwise(F.concat_ws(" ", *pieces))


def sample_texts(df: DataFrame, text_col: str, lang_col: str, key_col: str) -> dict[str, list[str]]:
    """Texts of a bounded number of documents of every language, those with the least key hashes;
    of longer ones, pieces from all over the text (:func:`spread_pieces`).

    One pass: each language's share of all hash values is set from its count, a third above the
    need, and the rest is cut on the driver. However many languages there are, all are learnt;
    beyond ALL_DOCS / DOCS_PER_LANGUAGE of them each has fewer documents.
    """
    known = df.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"),
                      F.xxhash64(F.col(f"`{key_col}`")).alias("h")).where(
        "lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()
    if not languages:
        return {}
    each = documents_each(languages)
    # the least hashes of a language, a third more than needed; rare languages have all of theirs
    share = F.least(F.lit(1.0), F.lit(1.3 * each) / F.col("n"))
    limits = counts.select("lang", (F.lit(-2.0 ** 63) + share * F.lit(2.0 ** 64)).alias("limit"))
    if languages <= MAP_ROWS:  # else rows meet their language's limit in a plain join
        limits = F.broadcast(limits)
    # rows with one key share a hash: a first aggregate keeps one text per key and language
    rows = (known.join(limits, "lang").where(F.col("h").cast("double") <= F.col("limit"))
            .groupBy("lang", "h").agg(F.min(spread_pieces(F.col("text"), F.col("h"))).alias("text"))
            .orderBy("h", "lang").limit(2 * each * languages).collect())
    out: dict[str, list[str]] = {}
    for r in rows:
        own = out.setdefault(r["lang"], [])
        if len(own) < each:
            own.append(r["text"])
    return dict(sorted(out.items()))


def documents_each(languages: int) -> int:
    """Documents that each of so many languages is learnt from."""
    return max(20, min(DOCS_PER_LANGUAGE, ALL_DOCS // languages))


def fill_evenly(texts: list[str], budget: int) -> bytes:
    """Content of at most ``budget`` bytes from all texts in turn: a piece of each, then the next
    piece of each. Where a text's turns begin goes round its pieces from text to text, so that
    openings have no precedence."""
    cut = []
    for i, text in enumerate(texts):
        own = [letters_only(text[at:at + PIECE_CHARS + 1]).encode()
               for at in range(0, len(text), PIECE_CHARS + 1)]
        first = i % max(1, len(own))
        cut.append([p for p in own[first:] + own[:first] if p])
    content, size = [], 0
    for turn in range(max(map(len, cut), default=0)):
        for own in cut:
            if turn < len(own) and size + len(own[turn]) <= budget:
                content.append(own[turn])
                size += len(own[turn])
    return b"".join(content)


class Dictionaries:
    """Raw-content dictionaries per language and the bytes a text needs with each."""

    def __init__(self, texts: dict[str, list[str]], level: int = LEVEL):
        self.languages, self.level = sorted(texts), level
        budget = min(DICTIONARY_BYTES, ALL_BYTES // max(1, len(texts)))
        self.contents = []
        for lang in self.languages:
            self.contents.append(fill_evenly(texts[lang], budget) or b" ")

    def compressors(self) -> list:
        out = []
        for content in self.contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d,
                                                write_content_size=False, write_checksum=False,
                                                write_dict_id=False))
        return out


def encoded_sizes(compressors: list, text: str) -> np.ndarray:
    """Bytes of the whole text with each dictionary, block by block."""
    sizes = np.zeros(len(compressors), np.int64)
    for at in range(0, len(text), BLOCK):
        data = text[at:at + BLOCK].encode()
        sizes += [len(c.compress(data)) for c in compressors]
    return sizes


class Identifier:
    """Decides for one text after another."""

    def __init__(self, dictionaries: Dictionaries, margin: float):
        self.of, self.margin = dictionaries, margin
        self.compressors = dictionaries.compressors()

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        plain = letters_only(text or "")
        if not plain or not self.compressors:
            return "und", 0.0, False
        sizes = encoded_sizes(self.compressors, plain)
        best = np.flatnonzero(sizes == sizes.min())
        if len(best) > 1:  # equal sizes: the dictionary that knows most of the words
            words = {f" {w} ".encode() for w in plain.split()}
            known = [sum(w in self.of.contents[i] for w in words) for i in best]
            best = best[int(np.argmax(known)):]
        first = int(best[0])
        if len(sizes) == 1:
            return self.of.languages[0], 1.0, True
        # share of its bytes that the next language needs more
        gain = 1 - sizes[first] / np.partition(sizes, 1)[1]
        return self.of.languages[first], float(min(1.0, gain / (gain + self.margin))), bool(
            gain >= self.margin)


def identify(df: DataFrame, id_col: str, text_col: str, dictionaries: Dictionaries,
             margin: float = 0.02) -> DataFrame:
    """One row per document: id, lang_pred, score, confident.

    A text is read as lower-case words of letters and encoded whole, in blocks, with each
    language's raw-content dictionary; the smallest size decides, and among equal sizes the
    dictionary that holds most of the words, then the first name. With gain g, the share by which
    the next language is larger, the score is g / (g + margin); ``confident`` is false, that is,
    the guess is rejected, where g is below ``margin``. Dictionaries are of bounded size.

    Cases: null texts and texts without a letter are ``und`` with score 0, and so is everything if
    no language was learnt; very long texts are encoded block by block; repeated rows are judged
    alike; an empty table gives an empty result; further columns are not looked at.
    """
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        judge = Identifier(shared.value, margin)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lang, score, sure = zip(*map(judge, texts_of(part.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang), pa.array(score), pa.array(sure)],
                    ["id", "lang_pred", "score", "confident"])
        return work
    return arrow_map(documents(df, id_col, text_col), SCHEMA, make)
