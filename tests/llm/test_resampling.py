import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.llm import resampling
from tallyweave.llm.common import LETTERS_LOWER, word_batches
from tallyweave.llm.resampling import radix_ranked, resample, word_checksums


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_rows(docs, target, percent, least, buckets=10_000):
    def bucket(w):
        return zlib.crc32(w.encode()) % buckets
    words = [words_of(t) for _, t in docs]
    s = Counter(bucket(w) for ws in words for w in ws)
    t = Counter(bucket(w) for _, x in target for w in words_of(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for (key, _), ws in zip(docs, words):
        weight = sum(math.floor(1000 * math.log(
            float((t[b] + 1) * (s_all + buckets)) / float((s[b] + 1) * (t_all + buckets))))
            for b in map(bucket, ws))
        name = "2024:" + ("" if key is None else str(key))
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        rows.append((key, len(ws), weight,
                     weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least),
                    key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    take = percent * len(enough) // 100
    out = [(*r, i + 1 if i < take else None) for i, r in enumerate(enough)]
    return Counter(out + [(*r, None) for r in rows if r[1] < least])


def test_checksums():
    texts = ["", None, "Some Wörter 漢字 mixed123", "y" * 47 + " " + "z" * 48 + " " + "q" * 49,
             "long " + "é" * 5000, "a " * 300]
    for _, words in word_batches(pa.array(texts), LETTERS_LOWER):
        want = [zlib.crc32(w.encode()) for t in texts for w in words_of(t)]
        assert word_checksums(words).tolist() == want


@pytest.mark.parametrize("tasks", [1, 7])
def test_radix_ranks(spark, monkeypatch, tasks):
    monkeypatch.setattr(resampling, "LEAST_BLOCK", 16)
    rng = random.Random(tasks)
    rows = [(rng.choice([rng.randrange(-10 ** 6, 10 ** 6), 5, 5, 5]), rng.randrange(40), i % 3)
            for i in range(900)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(tasks)
    got = radix_ranked(df, [("a", True), ("b", False), ("c", True)]).collect()
    assert sorted(r.pos for r in got) == list(range(900))
    assert [(r.a, r.b, r.c) for r in sorted(got, key=lambda r: r.pos)] == sorted(
        rows, key=lambda r: (-r[0], r[1], -r[2]))


def test_radix_extremes(spark):
    wide = [(2 ** 62,), (-1,), (0,), (2 ** 62,), (7,)]
    got = radix_ranked(spark.createDataFrame(wide, "a long"), [("a", False)]).collect()
    assert [r.a for r in sorted(got, key=lambda r: r.pos)] == sorted(x for x, in wide)
    same = radix_ranked(spark.createDataFrame([(3,)] * 20, "a long"), [("a", True)]).collect()
    assert sorted(r.pos for r in same) == list(range(20))
    assert radix_ranked(spark.createDataFrame([], "a long"), [("a", True)]).count() == 0


def test_against_brute_force(spark, docs_of, tiny, monkeypatch):
    monkeypatch.setattr(resampling, "LEAST_BLOCK", 32)
    docs = [*tiny, (None, "no id " * 20), (1, None), (2, ""), (3, "... !!"), tiny[0], tiny[1],
            (tiny[2][0], tiny[2][1] + " more words"), (10 ** 9, "very long " * 50_000)]
    target = [(i, t) for i, t in tiny if i % 9 == 0]
    got = resample(docs_of(docs), "doc_id", "text", docs_of(target), "text", 2024, 30, 20)
    assert Counter(map(tuple, got.select("id", "n_features", "weight", "score", "rank").collect())
                   ) == plain_rows(docs, target, 30, 20)


def test_empty_tables(docs_of, tiny):
    none = docs_of([])
    assert resample(none, "doc_id", "text", none, "text", 1, 10, 1).count() == 0
    got = resample(docs_of(tiny[:30]), "doc_id", "text", none, "text", 2024, 50, 1)
    assert Counter(map(tuple, got.select("id", "n_features", "weight", "score", "rank").collect())
                   ) == plain_rows(tiny[:30], [], 50, 1)


def test_table_of_checksums():
    assert np.array_equal(resampling._CRC[[0, 1, 255]], [0, 0x77073096, 0x2D02EF8D])
