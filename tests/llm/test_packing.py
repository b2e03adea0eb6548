import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyweave.llm import common
from tallyweave.llm.packing import TextEncoder, WordEncoder, difference, pack, reads_words
from tallyweave.llm.queries import END_ID, TOKENIZER, packing

PATH = public_tokenizers.path(TOKENIZER)
ODD = ["", " \n\t ", "a\x1cb c\x85d e\xa0f", "Don't STOṔ café Café, (x) É!! ÿ|a´ ́x",
       "<|endoftext|>x <|startoftext|>", "x" * 5000, "12 345,6!? 中文　\U0001f600",
       "İstanbul ΣΣ ẞ", "a\r\nb c​d"]


PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [END_ID]


def test_words_encode_like_whole_texts(tiny):
    texts = ODD + [t for _, t in tiny]
    for text, got in zip(texts, WordEncoder(PATH).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == PLAIN.encode(
            text, add_special_tokens=False).ids


def check(rows, texts, capacity):
    """Every id of every row in exactly one piece, sequences without gaps and hardly padded."""
    by_seq = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    assert by_doc.keys() == texts.keys()
    for key, text in texts.items():
        want, at = ids(text), 0
        for p in sorted(by_doc[key], key=lambda p: p.start):
            part = np.array(want[p.start:p.start + p.length], "<u4").tobytes()
            assert p.start == at and p.doc_tokens == len(want) and p.crc == zlib.crc32(part)
            at += p.length
        assert at == len(want)


def test_query_holds_every_token_once(spark, tiny):
    rows = packing(spark, "/root/testdata/sf0.001").withColumnRenamed("ids_crc32", "crc").collect()
    check(rows, dict(tiny), 4096)


@pytest.mark.parametrize("cell", [1, 3, 50])
def test_small_windows(spark, docs_of, cell):
    from pyspark.sql import functions as F
    texts = dict(enumerate([*ODD, None, "word " * 300, *["same text"] * 40]))
    df = pack(docs_of(texts.items()).repartition(2), "doc_id", "text", PATH, END_ID, 64, cell)
    check(df.withColumnsRenamed({"id": "doc_id"}).withColumn("crc", F.crc32("token_ids")).collect(),
          texts, 64)


FILES = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken",
         "piece_bpe_32k.model", TOKENIZER)


def plain_ids(name):
    """Ids of one text by the library the file is for."""
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        whole = Tokenizer.from_file(path)
        return lambda t: whole.encode(t, add_special_tokens=False).ids
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor
        return SentencePieceProcessor(model_file=path).encode
    import base64

    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


@pytest.mark.parametrize("name", FILES)
def test_every_tokenizer_file(spark, docs_of, tiny, name):
    path, of = public_tokenizers.path(name), plain_ids(name)
    assert reads_words(path) == (name == TOKENIZER)
    texts = dict(enumerate([*ODD, None, *(t for _, t in tiny[:40])]))
    rows = pack(docs_of(texts.items()).repartition(3), "doc_id", "text", path, END_ID, 256, 4,
                split=public_tokenizers.PATTERN).collect()
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.id, r.start)):
        assert r.start == len(found[r.id])
        found[r.id] += np.frombuffer(r.token_ids, "<u4").tolist()
    assert found == {k: [*of(t or ""), END_ID] for k, t in texts.items()}


def test_ranks_need_a_pattern():
    with pytest.raises(ValueError, match="pattern"):
        TextEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_repeated_rows_and_empty_table(spark, docs_of):
    df = docs_of([(1, "one two"), (1, "one two"), (None, None)])
    rows = pack(df, "doc_id", "text", PATH, END_ID, 4).collect()
    assert sum(r.length for r in rows) == 7
    assert pack(df.limit(0), "doc_id", "text", PATH, END_ID).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "text", PATH, END_ID, 100)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 4096, 600).tolist()
    windows = difference(lengths, 100)
    assert sorted(i for w in windows for i in w) == list(range(600))
    sums = [sum(lengths[i] for i in w) for w in windows]
    assert max(sums) - min(sums) < 200
    assert difference([], 2) == [[], []] and difference([5], 1) == [[0]]


def test_worker_keeps_one_value_until_other_work():
    first = common.kept("encoder", object)
    assert common.kept("encoder", object) is first
    other = common.kept("other", object)
    assert other is not first and common.kept("other", object) is other
    common.drop_kept()
    assert common.kept("other", object) is not other
    common.drop_kept()
