import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyweave.llm.neighbours import BITS, TREES, Forest, hash_strings, nearest
from tallyweave.llm.queries import nearest_neighbours


def brute(rows, k):
    """{query: [(id, score)]} over (id, vector) rows with distinct ids."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            score = x @ np.array(v, float)
            order = np.lexsort((ids, -score))
            out[i] = [(int(ids[j]), float(score[j])) for j in order if ids[j] != i][:k]
    return out


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert all(a.score > b.score or a.score == b.score and a[2] < b[2]
                   for a, b in zip(mine, mine[1:]))
        hits += len({r[2] for r in mine} & {i for i, _ in best})
        total += len(best)
    return hits / total


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist()))
    got = nearest_neighbours(spark, f"/root/testdata/{sf}").collect()
    vectors = dict(rows)
    for r in got[:200]:
        want = np.dot(np.array(vectors[r.query_id], float), np.array(vectors[r.vec_id], float))
        assert abs(r.score - want) < 1e-12
    assert recall(got, brute(rows, 20)) >= 0.9


def test_copies_norms_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.2, 3)).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(200)]  # copies; some of them are queries
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] * 4), (2060, [float("nan")] * 8),
           (2080, [float("inf")] * 8), (2100, []), (None, [1.0] * 8), (2120, [1.0, 2.0]),
           (1, rows[1][1])]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows + odd],
                               "vec_id long, embedding array<float>, ids string, rank int")
    exact = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    got = nearest(df, "vec_id", "embedding", lambda c: c % 20 == 0, 5).collect()
    assert recall(got, brute(exact, 5)) >= 0.9
    assert {r.query_id for r in got} == {i for i, _ in rows if i % 20 == 0}
    ties = [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1000]
    better = [i for i, _ in brute(exact, 5)[1000]]
    assert ties == better or recall([r for r in got if r.query_id == 1000],
                                    {1000: brute(exact, 5)[1000]}) >= 0.6


def test_small_and_empty(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [-1.0, 0.0])],
                               "vec_id long, embedding array<float>")
    got = nearest(df, "vec_id", "embedding", lambda c: c % 20 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 1, 0.5), (20, 2, 2, -1.0)]
    assert nearest(df.limit(0), "vec_id", "embedding", lambda c: c % 20 == 0).count() == 0


def test_forest_against_plain_prefixes():
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((300, 6)), rng.standard_normal((20, 6))
    norm2 = float((x ** 2).sum(axis=1).max())
    a, b = hash_strings(x, norm2, False), hash_strings(q, norm2, True)
    mask = Forest(x, norm2).candidates(b, 0.5, 3)
    for i in range(20):
        for level in range(BITS, -1, -1):
            same = (a >> np.uint64(BITS - level)) == (b[i] >> np.uint64(BITS - level))
            if same.sum() >= 150 and same.sum(axis=0).max() >= 3:
                break
        assert (same.any(axis=1) == mask[i]).all()
    assert a.shape == (300, TREES)
