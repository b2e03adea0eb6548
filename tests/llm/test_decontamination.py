import hashlib
import re

import pyarrow.parquet as pq
import pytest

from tallyweave.llm.decontamination import contamination, decontaminate
from tallyweave.llm.queries import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    """(n_words, n_hit, items) of one document."""
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(13, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for s in range(len(own) - n + 1):
            if tuple(own[s:s + n]) in windows:
                hit.update(range(s, s + n))
                names.add("" if name is None else str(name))
    return len(own), len(hit), sorted(names)


def test_query_against_brute_force(spark, tiny):
    sf = "/root/testdata/sf0.001"
    b = pq.read_table(f"{sf}/benchmark.parquet")
    items = list(zip(b["item_id"].to_pylist(), b["text"].to_pylist()))
    rows = {r.doc_id: r for r in decontamination(spark, sf).collect()}
    assert len(rows) == len(tiny)
    for key, text in tiny:
        n, hit, names = brute(text, items)
        assert rows[key][1:] == (n, hit, len(names),
                                 hashlib.sha256(",".join(names).encode()).hexdigest(),
                                 hit > 0 and 20 * hit >= n)
    assert sum(r.contaminated for r in rows.values()) > 0


PASSAGE = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, PASSAGE), (2, "Short item, HERE"), (None, "w1 w2 w3"), (3, None), (4, "..."),
         (5, PASSAGE), (10, " ".join(f"w{i}" for i in range(3, 18))), (1, PASSAGE)]
TEXTS = [(1, f"a b {PASSAGE} c"), (2, "short ITEM here"), (3, None), (4, ""), (5, "w1 w2 w3 w4"),
         (6, "x " * 400 + PASSAGE), (7, PASSAGE + " " + PASSAGE), (7, PASSAGE), (None, PASSAGE),
         (8, " ".join(f"w{i}" for i in range(12))), (9, "w0 w1 x w2"), (10, "É w1 w2\xa0w3 w2")]


@pytest.mark.parametrize("block", [200_000, 5, 1])
def test_cases_and_blocks(spark, docs_of, block):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, id int")
    rows = contamination(docs_of(TEXTS), "doc_id", "text", items, "item_id", "text",
                         block_windows=block).collect()
    want = []
    for key, text in TEXTS:
        n, hit, names = brute(text, ITEMS)
        want.append((key, n, hit, names, hit > 0 and 20 * hit >= n))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    df = docs_of(TEXTS)
    kept = decontaminate(df, "text", items, "item_id", "text", block_windows=block)
    assert kept.schema == df.schema or kept.columns == df.columns
    clean = [w[0] for w in want if not w[4]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([], "item_id long, text string")
    rows = contamination(docs_of(TEXTS), "doc_id", "text", items, "item_id", "text").collect()
    assert len(rows) == len(TEXTS) and not any(r.contaminated or r["items"] for r in rows)
    assert contamination(docs_of(TEXTS).limit(0), "doc_id", "text", items, "item_id",
                         "text").count() == 0
