"""Packing documents into token windows by multiway differencing."""

from __future__ import annotations

import base64
import heapq
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyweave.llm.common import documents, kept, texts_of

#: Windows in the largest set of documents that is balanced at once.
CELL_WINDOWS = 256
#: Words whose ids a worker remembers (about 200 bytes each).
_KEPT_WORDS = 1_500_000
_LETTERS_AND_MARKS = re.compile(
    r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?|%&*$#\"()\[\]-]*)").fullmatch
SCHEMA = ("id long, start long, length long, token_ids binary, doc_tokens long, "
          "sequence_id long, offset long")


# How the tokenizers read a text whose ids are those of its words (WordEncoder).
_WORD_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"}]}
_WORD_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {
        "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def reads_words(path: str) -> bool:
    """Is the file a tokenizer whose normaliser, splitter and model are those WordEncoder is for?"""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = told["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                           "fuse_unk", "byte_fallback", "ignore_merges"))
    return (told["normalizer"] == _WORD_NORMALIZER and told["pre_tokenizer"] == _WORD_SPLIT
            and model["type"] == "BPE" and plain
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]
                        for t in told["added_tokens"]))


class TextEncoder:
    """Token ids of whole texts by any tokenizer file, text by text: ``.json`` for tokenizers,
    ``.model`` for sentencepiece, ``.tiktoken`` ranks with the pattern ``split``."""

    def __init__(self, path: str, split: str | None = None):
        self._encode: Callable[[list[str]], list]
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor
            pieces = SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: pieces.encode(texts, num_threads=1)
        elif path.endswith(".tiktoken"):
            if split is None:
                raise ValueError("a file of ranks needs the pattern that splits texts")
            from tiktoken import Encoding
            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank)
                         for token, rank in map(bytes.split, f)}
            ranked = Encoding("of-file", pat_str=split, mergeable_ranks=ranks, special_tokens={})
            self._encode = lambda texts: [ranked.encode_ordinary(t) for t in texts]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            whole = Tokenizer.from_file(path)
            self._encode = lambda texts: [e.ids for e in whole.encode_batch_fast(
                texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self._encode(texts)]


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    For byte-level tokenizers that lower-case, drop white space, never merge across it, and split
    marks off letters: a text's ids are those of its blank-separated words, and each word is
    encoded once. Plain letters need no normalisation beyond lower case and go to the merges
    directly; everything else takes the tokenizer's whole path.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._model = self._tokenizer.model
        self._ids: dict[str, bytes] = {"": b""}
        bytes_as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters = {ord(c): bytes_as_letters.pre_tokenize_str(c)[0][0]
                         for c in map(chr, range(0xE0, 0x100)) if c.isalpha()}
        self._letters[0xDF] = bytes_as_letters.pre_tokenize_str("\u00df")[0][0]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        words, known = set().union(*split), self._ids
        new = [w for w in words if w not in known]
        if len(known) + len(new) > _KEPT_WORDS:
            known = self._ids = {"": b""}
            new = list(words)
        self._learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def _learn(self, new: list[str]) -> None:
        known = self._ids
        whole, parts = set(), []  # "Word," has the ids of "word" and of ","
        for word in new:
            if m := _LETTERS_AND_MARKS(word):
                letters, marks = m[1].lower(), m[2]
                if letters not in known:  # the normal form already: only the merges are left
                    known[letters] = np.array(
                        [t.id for t in self._model.tokenize(letters.translate(self._letters))],
                        "<u4").tobytes()
                if marks not in known:
                    whole.add(marks)
                if word not in known:
                    parts.append((word, letters, marks))
            else:
                whole.add(word)
        whole = list(whole)
        for at in range(0, len(whole), 20_000):
            part = whole[at:at + 20_000]
            for word, got in zip(part, self._tokenizer.encode_batch_fast(
                    part, add_special_tokens=False)):
                known[word] = np.array(got.ids, "<u4").tobytes()
        for word, letters, marks in parts:
            known[word] = known[letters] + known[marks]


def encoder(tokenizer_path: str, split: str | None = None) -> WordEncoder | TextEncoder:
    """One encoder for the packing tasks that a Python worker runs in a row: by words where the
    file allows it, else by whole texts."""
    return kept(("encoder", tokenizer_path, split), lambda: (
        WordEncoder(tokenizer_path) if reads_words(tokenizer_path)
        else TextEncoder(tokenizer_path, split)))


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``lengths`` dealt into ``windows`` near-equal sets.

    A partial partition holds one sum per window. The two with the widest spread are merged,
    largest sum with smallest, until one is left.
    """
    left: list[np.ndarray] = [np.zeros(len(lengths) + 1, np.int64)]
    right: list[np.ndarray] = [np.zeros(len(lengths) + 1, np.int64)]
    made = len(lengths) + 1  # node 0 is the empty set, node i + 1 the item i
    heap = []
    for i, length in enumerate(lengths):
        sums, nodes = np.zeros(windows, np.int64), np.zeros(windows, np.int64)
        sums[-1], nodes[-1] = length, i + 1
        heap.append((-length if windows > 1 else 0, i, sums, nodes))
    heapq.heapify(heap)
    order = len(lengths)
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        sums, other = a + b[::-1], b_nodes[::-1]
        both = (a_nodes > 0) & (other > 0)
        nodes = np.where(a_nodes > 0, a_nodes, other)
        n = int(both.sum())
        left.append(a_nodes[both])
        right.append(other[both])
        nodes[both] = np.arange(made, made + n)
        made += n
        at = np.argsort(sums, kind="stable")
        sums, nodes = sums[at], nodes[at]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), order, sums, nodes))
        order += 1
    if not heap:
        return [[] for _ in range(windows)]
    lefts, rights = np.concatenate(left), np.concatenate(right)
    out = []
    for root in heap[0][3]:
        items, todo = [], [int(root)] if root else []
        while todo:
            node = todo.pop()
            if node <= len(lengths):
                items.append(node - 1)
            else:
                todo += [int(rights[node]), int(lefts[node])]
        out.append(items)
    return out


class _Packer:
    """Takes one task's documents and gives filled windows."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next_id = capacity, first
        self.items: list[tuple] = []  # (doc, start, length); doc = (id, bytes, tokens)
        self.total = 0
        self.rows: list[tuple] = []

    def add(self, doc: tuple) -> None:
        full = doc[2] // self.capacity
        for i in range(full):
            self.window([(doc, i * self.capacity, self.capacity)])
        if rest := doc[2] - full * self.capacity:
            self.items.append((doc, full * self.capacity, rest))
            self.total += rest

    def window(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, length in pieces:
            self.rows.append((doc[0], start, length, doc[1][4 * start:4 * (start + length)],
                              doc[2], self.next_id, at))
            at += length
        self.next_id += 1

    @staticmethod
    def take(pool: list[tuple], tokens: int) -> list[tuple]:
        """The last ``tokens`` tokens of the pool, with one cut at most; they leave the pool."""
        got = []
        while tokens:
            doc, start, length = pool.pop()
            if length > tokens:
                pool.append((doc, start, length - tokens))
                start, length = start + length - tokens, tokens
            got.append((doc, start, length))
            tokens -= length
        return got

    def balance(self, last: bool) -> None:
        """Deal the gathered pieces out; what exceeds full windows waits for the next set.

        After the last set it opens further windows, whose lengths are powers of two (these are
        not padded).
        """
        count = self.total // self.capacity
        spare: list[tuple] = []
        if count:
            low = []
            for window in difference([x[2] for x in self.items], count):
                pieces = [self.items[i] for i in window]
                size = sum(x[2] for x in pieces)
                if size > self.capacity:
                    spare += self.take(pieces, size - self.capacity)
                    size = self.capacity
                if size == self.capacity:
                    self.window(pieces)
                else:
                    low.append((pieces, self.capacity - size))
            for pieces, room in low:  # surplus and room differ by total - count * capacity >= 0
                self.window(pieces + self.take(spare, room))
        else:
            spare = self.items
        self.items, self.total = spare, sum(x[2] for x in spare)
        if last and self.total:
            pool = self.items[::-1]
            for power in range(self.capacity.bit_length() - 1, -1, -1):
                if self.total & 1 << power:
                    self.window(self.take(pool, 1 << power))
            self.items, self.total = [], 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      [f.split()[0] for f in SCHEMA.split(", ")])


def pack(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int,
         capacity: int = 4096, cell_windows: int = CELL_WINDOWS,
         split: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, token_ids, doc_tokens, sequence_id, offset.

    A document's ids are its tokens and ``end_id``. Whole windows are cut off long documents; the
    rests of about ``cell_windows`` windows are dealt into near-equal windows by multiway
    differencing, single surplus tokens are cut off and fill the gaps, and what exceeds the
    windows' capacity opens new ones. Every sequence has ``capacity`` tokens or, at the end of a
    task's input, a power of two. ``token_ids`` are little-endian unsigned 32-bit numbers.

    There is no shuffle: each task packs its own input and holds one set of documents, whatever
    the input's size. The tokenizer file must be at the same path on all machines; it may be of any
    kind that :class:`TextEncoder` reads (``split``: its pattern, for a file of ranks). Only files
    that :func:`reads_words` knows to allow it are encoded word by word, with the same ids.

    Cases: null and empty texts are the end id alone; a very long text becomes many windows;
    repeated rows are packed each; an empty table gives no piece; further columns are not read.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        packer = _Packer(capacity, TaskContext.get().partitionId() << 36)
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 500):
                texts = texts_of(column.slice(at, 500))
                for key, tokens in zip(ids[at:at + 500],
                                       encoder(tokenizer_path, split).encode(texts)):
                    packer.add((key, tokens + end, len(tokens) // 4 + 1))
                    if packer.total >= cell_windows * capacity:
                        packer.balance(False)
                    if len(packer.rows) >= 1000:
                        yield _batch(packer.rows)
                        packer.rows = []
        packer.balance(True)
        if packer.rows:
            yield _batch(packer.rows)

    return documents(df, id_col, text_col).mapInArrow(run, SCHEMA)
