import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tallyweave.llm import alignment, queries
from tallyweave.llm.alignment import ByteLevel, Groups, align, overlaps

PATH_A, PATH_B = (public_tokenizers.path(n) for n in (queries.ALIGNED_A, queries.ALIGNED_B))
ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "a  b\t\n c"), (6, "<|endoftext|> <s></s><unk>"),
       (7, "naïve ▁ mark"), (8, "\U0001f600\U0001f469‍\U0001f52c 漢字かな"), (9, "x" * 3000),
       (10, "=" * 500 + " " + "9" * 77), (4, "a"), (11, "tab\u0000nul"), (None, "no id"),
       (12, "word " * 4000), (13, "ﬁne Å"), (14, " leading and trailing ")]


def plain_rows(docs):
    """The contract, token by token."""
    ranks = {int(b): base64.b64decode(a) for a, b in map(
        bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    first = Tokenizer.from_file(PATH_A)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=PATH_B)
    pieces = []
    for i in range(second.get_piece_size()):
        p = second.id_to_piece(i)
        pieces.append(bytes([int(p[3:5], 16)]) if second.is_byte(i)
                      else p.replace("▁", " ").encode())
    cut, counts = [], Counter()
    for _, text in docs:
        text = text or ""
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(ranks[i] for i in a) != whole or b"".join(pieces[i] for i in b) != whole:
            a, b = [], []
        ends_a = np.cumsum([len(ranks[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(pieces[i]) for i in b]).tolist()
        groups, p, q = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[p:x], b[q:y]))
            p, q = x, y
        cut.append((len(a), len(b), groups))
        counts.update({(x, y) for g, h in groups for x in g for y in h})
    most = defaultdict(int)
    for (x, _), c in counts.items():
        most[x] = max(most[x], c)
    out = []
    for (key, _), (n_a, n_b, groups) in zip(docs, cut):
        links = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((key, n_a, n_b, len(groups), len(links),
                    sum(counts[k] == most[k[0]] for k in links), sum(counts[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return Counter(out)


def test_against_brute_force(docs_of, tiny):
    docs = ODD + tiny[:60]
    got = align(docs_of(docs), "doc_id", "text", PATH_A, PATH_B)
    assert Counter(map(tuple, got.select(
        "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        "groups_sha256").collect())) == plain_rows(docs)


def test_chunks_do_not_change_counts(spark, docs_of, tiny):
    docs = tiny[:60]
    one = align(docs_of(docs), "doc_id", "text", PATH_A, PATH_B).collect()
    # every task has chunks of its own
    many = align(docs_of(docs).repartition(8), "doc_id", "text", PATH_A, PATH_B).collect()
    assert sorted(one) == sorted(many)


def test_empty_table(docs_of):
    assert align(docs_of([]), "doc_id", "text", PATH_A, PATH_B).count() == 0


def test_token_bytes():
    ranks = {int(b): base64.b64decode(a) for a, b in map(
        bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    mine = ByteLevel(PATH_A).bytes
    assert all(mine[i] == token for i, token in ranks.items())


def test_both_engines_give_the_same_ids(tiny):
    mine = ByteLevel(PATH_A)
    assert mine._merge is not None
    rng = np.random.default_rng(1)
    plain = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x2010, 0x2028)]
    texts = [t for _, t in tiny] + [t or "" for _, t in ODD]
    texts += ["".join(rng.choice(plain, 300)) for _ in range(300)]
    texts += ["".join(rng.choice([*" \n\t\u00a0\u0085ab'st1.", "ll", "\r\n"], 200))
              for _ in range(300)]
    assert mine.encode(texts) == mine._all([" " + t for t in texts])


def frame(lengths, docs):
    ends = np.cumsum(lengths)
    return pd.DataFrame({"start": ends - lengths, "end": ends, "doc": docs,
                         "token": np.arange(len(ends))})


@pytest.mark.parametrize("seed", range(5))
def test_overlaps_and_wide_groups(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    sides = []
    for _ in range(2):
        lengths, docs = [], []
        for doc in range(4):
            left = 40
            while left:
                n = min(left, int(rng.integers(1, 7)))
                lengths.append(n)
                docs.append(doc)
                left -= n
        sides.append((frame(np.array(lengths), np.array(docs)), rng.integers(0, 4, len(lengths))))
    (a, ids_a), (b, ids_b) = sides
    i, j = overlaps(a, b)
    want = [(x, y) for x in range(len(a)) for y in range(len(b))
            if a.start[x] < b.end[y] and b.start[y] < a.end[x]]
    assert list(zip(i, j)) == want
    g = Groups(a, b)
    narrow = [x.tolist() for x in g.pairs(ids_a, ids_b, 10)]
    monkeypatch.setattr(alignment, "_WIDE", 3)
    assert [x.tolist() for x in g.pairs(ids_a, ids_b, 10)] == narrow
    plain = Counter((a.doc[x], ids_a[x] * 10 + ids_b[y]) for x in range(len(a))
                    for y in range(len(b)) if g.of_a[x] == g.of_b[y])
    assert dict(zip(zip(*narrow[:2]), narrow[2])) == dict(plain)


def test_registered_query(spark):
    out = queries.alignment(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                           "groups_sha256"]
    assert out.where("n_links < n_groups or n_best > n_links or count_sum < n_links").count() == 0
