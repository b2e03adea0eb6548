import random
import re

import numpy as np
import pytest

from tallyweave.llm import near_duplicates as nd
from tallyweave.llm.components import components
from tallyweave.llm.queries import minhash_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def brute(rows, size=3, percent=85):
    """Sorted (id, n_shingles, component, kept) over rows with distinct ids."""
    sets = {k: shingles(t, size) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    by_shingle = {}
    for k, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    for k, s in sets.items():
        near = {o for x in s for o in by_shingle[x] if o < k}
        for o in near:
            both = len(s & sets[o])
            if 100 * both >= percent * (len(s) + len(sets[o]) - both):
                a, b = sorted((find(k), find(o)))
                root[b] = a
    return sorted((k, len(s), find(k), find(k) == k) for k, s in sets.items())


def test_query_against_brute_force(spark):
    import pyarrow.parquet as pq
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    got = sorted(map(tuple, minhash_dedup(spark, "/root/testdata/sf0.01").collect()))
    want = brute(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())))
    assert got == want and sum(not r[3] for r in want) > 50


def chains(seed):
    """Groups whose members drift away from each other word by word, and copies."""
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([30, 60, 150]))]
        for _ in range(25):
            if rng.random() < 0.5:
                base = list(base)
            copy = base if rng.random() < 0.5 else list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(500)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize("seed, size, percent", [(1, 3, 85), (2, 5, 80)])
def test_drifting_groups(spark, docs_of, seed, size, percent):
    rows = chains(seed) + [(900, None), (901, " \n"), (902, "One  two"), (903, "one TWO"),
                           (904, "one"), (905, ""), (906, "x y z " * 3000), (907, "x y z " * 2000)]
    got = nd.near_duplicates(docs_of(rows).repartition(3), "doc_id", "text", size, percent)
    assert sorted(map(tuple, got.collect())) == brute(rows, size, percent)


def test_odd_rows(spark, docs_of):
    text = "a b c d e f g h"
    rows = [(3, text), (3, text), (2, text.upper()), (None, text), (7, None), (7, "other words here")]
    got = nd.near_duplicates(docs_of(rows), "doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (3, 6, 2, False), (3, 6, 2, False), (2, 6, 2, True), (None, 6, None, True), (7, 0, 7, True),
        (7, 1, 7, True)]))
    assert nd.near_duplicates(docs_of(rows).limit(0), "doc_id", "text").count() == 0


def test_near_signatures_share_a_key():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, (200, nd.SYMBOLS), dtype=np.uint16)
    other = sig.copy()
    assert (nd.distance_bound(85), nd.distance_bound(80)) == (19, 23)
    for row in other:
        at = rng.permutation(nd.SYMBOLS)[:19]
        row[at] ^= 1
    a, b = nd.chunk_keys(sig, 19), nd.chunk_keys(other, 19)
    assert all(np.intersect1d(x, y).size for x, y in zip(a, b))
    assert len(np.unique(a)) == a.size


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 99)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 99: 99, 100: 99}
    assert components(links.limit(0)).count() == 0


def test_one_id_on_two_texts(spark, docs_of):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    alone = " ".join(f"v{i}" for i in range(40))
    rows = [(5, alone), (5, near), (3, " ".join(base)), (8, alone + " end"), (9, near + " x"),
            (9, near), (None, near)]
    got = nd.near_duplicates(docs_of(rows).repartition(3), "doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (None, 58, None, True), (5, 38, 5, True), (5, 58, 3, False), (3, 58, 3, True), (8, 39, 5, False),
        (9, 59, 3, False), (9, 58, 3, False)]))
    own = nd.near_duplicates(docs_of([(1, " ".join(base)), (1, near)]), "doc_id", "text").collect()
    assert [r.component_id for r in own] == [1, 1] and sum(r.kept for r in own) == 1
