import hashlib
import random
import re

import pytest

from tallyweave.llm.queries import substring_dedup
from tallyweave.llm.substrings import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    """{row: (n_words, n_removed, kept)} by whole word windows."""
    first = {}
    split = [WORD.findall(t or "") for _, t in rows]
    for (key, _), w in zip(rows, split):
        if key is not None:
            for i in range(len(w) - n + 1):
                g = tuple(w[i:i + n])
                first[g] = min(key, first.get(g, key))
    out = []
    for (key, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - n + 1):
            if key is not None and first[tuple(w[i:i + n])] < key:
                gone.update(range(i, i + n))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_query_against_brute_force(spark, tiny):
    got = substring_dedup(spark, "/root/testdata/sf0.001").collect()
    want = [(k, n, r, hashlib.sha256(t.encode()).hexdigest()) for k, n, r, t in brute(tiny)]
    assert sorted(tuple(r[:4]) for r in got) == sorted(want)
    assert sum(r[2] for r in want) > 100


@pytest.mark.parametrize("window", [13, 7, 5])
def test_random_texts(spark, docs_of, window):
    rng = random.Random(window)
    passages = [" ".join(f"p{rng.randrange(40)}" for _ in range(rng.randrange(3, 40)))
                for _ in range(6)]
    rows = [(i, " ".join(rng.choice([*passages, "é\xa0 b\tc\n", f"x{rng.randrange(9)}"])
                         for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    rows += [(3, rows[4][1]), (None, rows[5][1]), (None, None), (61, None), (62, ""), (5, "one"),
             (63, rows[9][1]), (63, rows[9][1]), (64, "a\x00b \x1c " * 20), (65, "a\x00b \x1c " * 20),
             (66, " ".join(passages) * 200)]
    df = docs_of(rows).repartition(3)
    got = remove_repeats(df, "doc_id", "text", window).collect()
    assert sorted(map(str, (tuple(r[:4]) for r in got))) == sorted(map(str, brute(rows, window)))
    for r in got:
        assert sum(s.end - s.start for s in r.repeats) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.repeats, r.repeats[1:]))


def test_empty_table(spark, docs_of):
    assert remove_repeats(docs_of([(1, "a")]).limit(0), "doc_id", "text").count() == 0
