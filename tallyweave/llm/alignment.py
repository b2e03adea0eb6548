"""Alignment of two tokenizers: groups of tokens with equal bytes, and how often ids go together."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import arrays_batch, documents, kept
from tallyweave.session import written

#: Fixed value: how byte-level tokenizers split a text before they merge.
_SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Links above which a group is counted by ids instead of by occurrences.
_WIDE = 1 << 16
#: Id pairs of documents that form a chunk, and characters that are aligned at once.
CHUNK_LINKS, _CHARS = 1 << 20, 1 << 20
#: Rows of three kinds: documents; distinct pairs of a chunk; a document's places among these.
ALIGNED = ("row long, id long, n_a long, n_b long, n_groups long, n_links long, "
           "groups_sha256 string, chunk long, place long, code long, n_docs long, "
           "places binary, links binary")


class Side:
    """One tokenizer: bytes and byte lengths of its tokens, and texts of its ids."""

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = token_bytes
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError


#: Characters of which all engines agree what is a letter, a number and white space.
_PLAIN = re.compile("[\x00-\u024f\u2010-\u2027]*").fullmatch


class ByteLevel(Side):
    """A byte-level tokenizer file; it reads a blank and the text, special tokens as plain text.

    Where the ids follow the order of the file's merges, texts of plain characters are merged by
    a second engine with the file's vocabulary, which gives the same ids in less time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        letters = sorted(pre_tokenizers.ByteLevel.alphabet())
        plain = [c for c in letters if ord(c) < 256]  # printable bytes stand for themselves
        free = iter(sorted(set(range(256)) - set(map(ord, plain))))
        value = {c: ord(c) for c in plain}
        value.update((c, next(free)) for c in letters if ord(c) >= 256)
        vocabulary = self._tokenizer.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in value for c in token)
            tokens[i] = bytes(map(value.__getitem__, token)) if known else token.encode()
        super().__init__(tokens)
        self._merge = self._second_engine(path)

    def _second_engine(self, path: str) -> Callable[[str], list[int]] | None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps, special = told["model"]["merges"], {t["id"] for t in told["added_tokens"]}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        split = told["pre_tokenizer"] or {}
        if told["normalizer"] or {**plain, **split, "trim_offsets": True} != {
                **plain, "trim_offsets": True}:
            return None
        ids = told["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in steps]
        if [ids.get("".join(m)) for m in pairs] != list(range(256, 256 + len(pairs))):
            return None
        from tiktoken import Encoding
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in special}
        return Encoding("of-file", pat_str=_SPLIT, mergeable_ranks=ranks,
                        special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts]
        if self._merge is None:
            return self._all(texts)
        out = [self._merge(t) if _PLAIN(t) else None for t in texts]
        others = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(others, self._all([texts[i] for i in others])):
            out[i] = ids
        return out

    def _all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(Side):
    """A sentence-piece model that puts a blank before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self._model = SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i)
                          else piece.replace("▁", " ").encode())
        super().__init__(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def side(path: str) -> Side:
    """The tokenizer of a file: ``.model`` is a sentence-piece model, else a tokenizer file."""
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def _tokens(ids: list[list[int]], lengths: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """Ids of all tokens of a batch, and a frame (start, end, doc, token), sorted by start.

    The texts lie one behind the other, so that starts rise over the whole batch.
    """
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
    ends = np.cumsum(lengths[flat])
    return flat, pd.DataFrame({"start": ends - lengths[flat], "end": ends,
                               "doc": np.repeat(np.arange(len(ids)), counts),
                               "token": np.arange(len(flat))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens of the two sides that share a byte, in order of place.

    Every token start finds the other side's covering token; two tokens overlap exactly if one
    of them starts inside the other, so both directions together give every overlap.
    """
    of_a = pd.merge_asof(a[["start", "doc", "token"]], b[["start", "doc", "token"]], on="start",
                         by="doc", suffixes=("_a", "_b"))
    of_b = pd.merge_asof(b[["start", "doc", "token"]], a[["start", "doc", "token"]], on="start",
                         by="doc", suffixes=("_b", "_a"))
    keys = np.sort(np.concatenate([x["token_a"].to_numpy() * (len(b) + 1) + x["token_b"].to_numpy()
                                   for x in (of_a, of_b)]))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys // (len(b) + 1), keys % (len(b) + 1)


class Groups:
    """Tokens of a batch cut where both sides end: ``of_a``, ``of_b`` are the tokens' groups,
    ``docs`` the document of each group, ``n_a``, ``n_b`` its tokens."""

    def __init__(self, a: pd.DataFrame, b: pd.DataFrame):
        i, j = overlaps(a, b)
        closes = a["end"].to_numpy()[i] == b["end"].to_numpy()[j]
        group = np.cumsum(closes) - closes
        self.of_a, self.of_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        self.of_a[i], self.of_b[j] = group, group
        count = int(closes.sum())
        self.n_a = np.bincount(self.of_a, minlength=count)
        self.n_b = np.bincount(self.of_b, minlength=count)
        self.first_a = np.cumsum(self.n_a) - self.n_a
        self.first_b = np.cumsum(self.n_b) - self.n_b
        self.docs = a["doc"].to_numpy()[self.first_a]

    def pairs(self, a: np.ndarray, b: np.ndarray, width: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, id pair ``a * width + b``, linked occurrences), one row per document and
        pair, sorted. Wide groups are counted by distinct ids."""
        wide = self.n_a * self.n_b > _WIDE
        docs, codes, n = [], [], []
        for g in np.flatnonzero(wide):
            x, nx = np.unique(a[self.first_a[g]:self.first_a[g] + self.n_a[g]], return_counts=True)
            y, ny = np.unique(b[self.first_b[g]:self.first_b[g] + self.n_b[g]], return_counts=True)
            codes.append((x[:, None] * width + y).ravel())
            n.append((nx[:, None] * ny).ravel())
            docs.append(np.full(len(codes[-1]), self.docs[g]))
        tokens = np.flatnonzero(~wide[self.of_a])
        group = self.of_a[tokens]
        times = self.n_b[group]
        at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        codes.append(np.repeat(a[tokens], times) * width
                     + b[at + np.repeat(self.first_b[group], times)])
        docs.append(np.repeat(self.docs[group], times))
        n.append(np.ones(len(at), np.int64))
        doc, code, n = map(np.concatenate, (docs, codes, n))
        order = np.lexsort((code, doc))
        doc, code, n = doc[order], code[order], n[order]
        new = np.ones(len(doc), bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        return doc[first], code[first], np.add.reduceat(n, first) if len(first) else n


def _whole(ids: list[int], tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


class _Pair:
    """Both tokenizers and the texts of their ids with the mark that may follow them."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = side(path_a), side(path_b)
        size = len(self.a.bytes)
        # an A id is followed by "," or, at the end of its group, "|"; a B id by "," or ";"
        self.marked = [f"{i}{m}" for m in ",|" for i in range(size)]
        self.marked += [f"{i}{m}" for m in ",;" for i in range(len(self.b.bytes))]
        self.width = len(self.b.bytes)

    def align(self, texts: list[str]) -> tuple:
        """(n_a, n_b, n_groups, n_links, checksum of the groups) per text, and its id pairs."""
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        for i, text in enumerate(texts):
            whole = (" " + text).encode()
            if not text or _whole(ids_a[i], self.a.bytes) != whole \
                    or _whole(ids_b[i], self.b.bytes) != whole:
                ids_a[i], ids_b[i] = [], []
        a, of_a = _tokens(ids_a, self.a.lengths)
        b, of_b = _tokens(ids_b, self.b.lengths)
        n = len(texts)
        if not len(a):
            zero, none = np.zeros(n, np.int64), np.empty(0, np.int64)
            return zero, zero, zero, zero, [""] * n, (none, none, none)
        g = Groups(of_a, of_b)
        doc, code, links = g.pairs(a, b, self.width)
        last_a = np.append(g.of_a[1:] != g.of_a[:-1], True)
        last_b = np.append(g.of_b[1:] != g.of_b[:-1], True)
        marked = np.empty(len(a) + len(b), np.int64)
        marked[np.arange(len(a)) + g.first_b[g.of_a]] = a + len(self.a.bytes) * last_a
        marked[np.arange(len(b)) + (g.first_a + g.n_a)[g.of_b]] = (
            b + 2 * len(self.a.bytes) + len(self.b.bytes) * last_b)
        n_a, n_b = (np.bincount(x["doc"], minlength=n) for x in (of_a, of_b))
        edges = np.append(0, np.cumsum(n_a + n_b))
        sums = []
        for i in range(n):
            text = "".join(map(self.marked.__getitem__, marked[edges[i]:edges[i + 1]].tolist()))
            sums.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
        n_links = np.bincount(g.docs, g.n_a * g.n_b, n).astype(np.int64)
        return n_a, n_b, np.bincount(g.docs, minlength=n), n_links, sums, (doc, code, links)


def tokenizer_pair(path_a: str, path_b: str) -> _Pair:
    """Both tokenizers, loaded once for the tasks that a Python worker runs in a row."""
    return kept(("aligned", path_a, path_b), lambda: _Pair(path_a, path_b))


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHARS characters."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > _CHARS:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def _small(links: np.ndarray) -> bytes:
    """Counts as unsigned numbers of 1, 4 or 8 bytes, whichever suffices."""
    most = int(links.max())
    return links.astype("u1" if most < 256 else "<u4" if most < 1 << 32 else "<u8").tobytes()


class _Chunk:
    """Documents whose id pairs share one list: each distinct pair is sent and looked up once."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, codes: np.ndarray, links: np.ndarray) -> None:
        self.parts.append((rows, codes, links))
        self.size += len(codes)

    def close(self) -> Iterator[pa.RecordBatch]:
        """The distinct pairs with their number of documents, and each document's places in them."""
        if self.size:
            rows, codes, links = map(np.concatenate, zip(*self.parts))
            distinct, place, docs = np.unique(codes, return_inverse=True, return_counts=True)
            for x in range(0, len(distinct), 100_000):
                n = len(distinct[x:x + 100_000])
                yield _rows(n, chunk=np.full(n, self.number), place=np.arange(x, x + n),
                            code=distinct[x:x + n], n_docs=docs[x:x + n])
            edges = np.append(np.flatnonzero(np.append(True, rows[1:] != rows[:-1])), len(rows))
            for x in range(0, len(edges) - 1, 1000):
                cut = list(zip(edges[:-1], edges[1:]))[x:x + 1000]
                yield _rows(len(cut), chunk=np.full(len(cut), self.number),
                            row=rows[edges[x:x + len(cut)]],
                            places=pa.array([place[i:j].astype("<u4").tobytes() for i, j in cut]),
                            links=pa.array([_small(links[i:j]) for i, j in cut]))
        self.parts, self.size = [], 0
        self.number += 1


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = [f.split() for f in ALIGNED.split(", ")]


def _rows(n: int, **columns) -> pa.RecordBatch:
    """``n`` rows of ALIGNED; columns not given are null."""
    return arrays_batch(**{name: columns.get(name, pa.nulls(n, _KINDS[kind]))
                           for name, kind in _FIELDS})


def _rate(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of the documents of a chunk from the counts of its pairs."""
    count, best = (np.zeros(len(pairs), np.int64) for _ in range(2))
    at = pairs["place"].to_numpy()
    count[at], best[at] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    sums, tops = [], []
    for places, links in zip(docs["places"], docs["links"]):
        at = np.frombuffer(places, "<u4")
        n = np.frombuffer(links, f"<u{len(links) // len(at)}").astype(np.int64)
        sums.append(int(n @ count[at]))
        tops.append(int(n @ best[at]))
    return pd.DataFrame({"row": docs["row"], "n_best": tops, "count_sum": sums})


def align(df: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Each text is encoded without special tokens by both tokenizers (see :func:`side`); their
    strings inside a text are plain text. Byte offsets at which tokens of both sides end cut the
    tokens into groups, and all pairs of an A and a B token of a group are linked. The count of a
    pair of ids is the number of documents that hold it linked; ``n_best`` counts the links whose
    count is the highest of their A id (ties included), ``count_sum`` adds up the counts of all
    links, ``groups_sha256`` is the checksum of the groups as ``a1,a2|b1;a3|b2,b3``.

    Texts are read once. Documents are gathered into chunks of a bounded number of pairs; a
    chunk's distinct pairs are summed up in the corpus and joined with the sums, and documents
    take them by place. The highest counts have one row per A id and are broadcast.

    Cases: null and empty texts, and texts whose bytes a tokenizer does not give back, have no
    tokens: all numbers are 0 and the checksum is empty. A very long text is aligned whole, by
    one task. Repeated rows count as documents of their own; an empty table gives an empty
    result; further columns are not read. The files must be at the same paths on all machines.
    """
    width = len(side(path_b).bytes)

    def run(batches):
        both = tokenizer_pair(path_a, path_b)
        base = row = TaskContext.get().partitionId() << 33
        chunk = _Chunk(base)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for x, y in _runs(texts):
                    n_a, n_b, n_groups, n_links, sums, (doc, code, links) = both.align(texts[x:y])
                    rows = row + np.arange(y - x)
                    row += y - x
                    yield _rows(y - x, row=rows, id=part.column(0).slice(x, y - x), n_a=n_a,
                                n_b=n_b, n_groups=n_groups, n_links=n_links,
                                groups_sha256=pa.array(sums, pa.string()))
                    chunk.add(rows[doc], code, links)
                    if chunk.size >= CHUNK_LINKS:
                        yield from chunk.close()
        yield from chunk.close()
    found = written(documents(df, id_col, text_col).mapInArrow(run, ALIGNED), "aligned")
    pairs = found.where("code is not null").select("chunk", "place", "code", "n_docs")
    counts = written(pairs.groupBy("code").agg(F.sum("n_docs").alias("count")), "pair-counts")
    of_a = F.expr(f"code div {width}").alias("a")
    highest = counts.groupBy(of_a).agg(F.max("count").alias("most"))
    rated = (counts.withColumn("a", of_a).join(F.broadcast(highest), "a")
             .select("code", "count", (F.col("count") == F.col("most")).cast("long").alias("best")))
    rated = pairs.join(rated, "code").select(F.col("chunk").alias("of_chunk"), "place", "count",
                                             "best")
    places = found.where("places is not null").select("chunk", "row", "places", "links")
    sums = (places.groupBy("chunk").cogroup(rated.groupBy("of_chunk"))
            .applyInPandas(_rate, "row long, n_best long, count_sum long"))
    zero = F.lit(0).cast("long")
    return found.where("n_a is not null").join(sums, "row", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
