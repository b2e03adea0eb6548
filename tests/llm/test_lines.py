import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from tallyweave.llm import lines as ln
from tallyweave.llm.queries import line_dedup


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows, min_chars=20):
    """[(id, text, n_lines, n_removed)] by comparing with all earlier lines."""
    def plain(line):
        return re.sub(r"[ \t\r\f\v]+", " ", line.strip(" \t\r\f\v"))
    place = {}
    for key, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if len(plain(line)) >= min_chars:
                at = (key is None, key or 0, i, zlib.crc32(text.encode()))
                place[plain(line)] = min(at, place.get(plain(line), at))
    by_length = {}
    for line in place:
        by_length.setdefault(len(line), []).append(line)
    gone = {a for a in place for n in (len(a) - 1, len(a), len(a) + 1)
            for b in by_length.get(n, ()) if place[b] < place[a] and within_one(a, b)}
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, None, 0, 0))
            continue
        split = text.split("\n")
        keep = [x for i, x in enumerate(split) if len(plain(x)) < min_chars or (
            plain(x) not in gone
            and place[plain(x)] == (key is None, key or 0, i, zlib.crc32(text.encode())))]
        out.append((key, "\n".join(keep), len(split), len(split) - len(keep)))
    return out


def test_query_against_brute_force(spark, tiny):
    got = line_dedup(spark, "/root/testdata/sf0.001").collect()
    want = brute(tiny)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == sorted(want)
    assert sum(w[3] for w in want) > 20


def edited(rng, line):
    at, c = rng.randrange(len(line)), rng.choice("abé ")
    return rng.choice([line[:at] + c + line[at:], line[:at] + line[at + 1:],
                       line[:at] + c + line[at + 1:], line])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_edits(spark, docs_of, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(15, 60))) for _ in range(8)]
    pool += ["aaaaaaaaaaaaaaaaaaaaaaaab", "ab" * 12]
    rows = []
    for i in range(40):
        picked = []
        for _ in range(rng.randrange(0, 7)):
            line = rng.choice(pool)
            for _ in range(rng.randrange(0, 3)):
                line = edited(rng, line)
            picked.append(line)
        rows.append((rng.choice([i, i, None]), "\n".join(picked)))
    rows += [(50, None), (51, ""), (52, pool[0]), (52, pool[0]), (3, "\n\n  x \n"),
             (60, "long line " * 5000 + "\n" + "long line " * 5000 + "x")]
    got = ln.dedup_lines(docs_of(rows).repartition(3), "doc_id", "text").collect()
    assert sorted(map(str, ((r.id, r.text, r.n_lines, r.n_removed) for r in got))) == sorted(
        map(str, brute(rows)))
    assert all(r.row.doc_id == r.id and r.row.id == 7 for r in got)


def test_variants():
    for line in ("abcdé" * 5, "x"):
        hashes, holes = ln.deletion_variants(line)
        assert holes.tolist() == list(range(-1, len(line)))
        for h, p in zip(hashes, holes):
            plain = line if p < 0 else line[:p] + line[p + 1:]
            assert not plain or h == ln.deletion_variants(plain)[0][0]


def test_empty_table(spark, docs_of):
    assert ln.dedup_lines(docs_of([(1, "a")]).limit(0), "doc_id", "text").count() == 0


def test_real_lines(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    got = line_dedup(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == sorted(brute(rows))
