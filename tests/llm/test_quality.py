import zlib

import numpy as np
import pyarrow.parquet as pq

from tallyweave.llm.quality import VoteModel, fit_votes, keep_quality, quality_scores
from tallyweave.llm.queries import quality_classifier

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in quality_classifier(spark, SF).collect()}
    assert len(rows) == 1000
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    t = pq.read_table(f"{SF}/labels.parquet")
    held = [(q, rows[i].score) for i, q in zip(t["doc_id"].to_pylist(), t["quality"].to_pylist())
            if rows[i].held_out]
    y, s = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    assert auc(y, s) > 0.95
    assert (s[y == 1] >= 0.3).mean() > 0.98


def test_votes_against_brute_force():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(4096, 30, replace=False)), rng.integers(1, 9, 30).astype(float))
            for _ in range(80)]
    labels = rng.integers(0, 2, 80).tolist()
    model = VoteModel.fit(rows, labels)
    got = model.score(rows[:10])
    for (terms, counts), have in zip(rows[:10], got):
        v = np.zeros(4096)
        v[terms] = np.log1p(counts) * model.weights[terms]
        v = v @ model.projection
        near = model.vectors @ (v / np.linalg.norm(v))
        top = np.argsort(-near)[:30]
        w = np.maximum(near[top], 0) ** 8 + 1e-9
        assert abs(have - (w * model.labels[top]).sum() / w.sum()) < 1e-4


def test_odd_rows(spark, docs_of):
    rows = [(i, "good plain words here " * 3 if i % 2 else "BAD!! ### $$$ ### !!") for i in range(40)]
    odd = [(100, None), (101, ""), (102, "x" * 100_000), (None, "good plain words"), (1, "a\n b")]
    df = docs_of(rows + odd).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (None, 1), (3, None)],
                                   "id long, label int")
    model = fit_votes(df, "doc_id", "text", labels)
    got = {r.id: r for r in quality_scores(df, "doc_id", "text", model).collect()}
    assert got[7].score > 0.9 and got[8].score < 0.1 and len(got) == 44
    assert abs(got[100].score - model.base) < 1e-6 and got[101].score == got[100].score
    kept = keep_quality(df, "text", model)
    assert kept.columns == df.columns and {8, 10} & {r.doc_id for r in kept.collect()} == set()
    none = fit_votes(df, "doc_id", "text", labels.limit(0))
    assert {r.score for r in quality_scores(df, "doc_id", "text", none).collect()} == {0.5}
    assert quality_scores(df.limit(0), "doc_id", "text", model).count() == 0


def terms(text):
    import pyarrow as pa
    from tallyweave.llm.quality import _terms_of
    return next(_terms_of(pa.array([text])))[1][0]


def test_words_of_one_shape_are_told_apart():
    good = ["photosynthesis turns light into sugar", "leaves turn light into sugar slowly",
            "sugar and light make leaves grow"] * 6
    bad = ["qwrtphxzvbnmkl tgrns lzght zntx sxgxr", "lxxvxs txrn lzght zntx sxgxr slxwlx",
           "sxgxr xnd lzght mxkx lxxvxs grxw"] * 6
    model = VoteModel.fit([terms(t) for t in good + bad], [1] * len(good) + [0] * len(bad))
    a, b = terms("photosynthesis turns light into sugar"), terms("qwrtphxzvbnmkl turns lzght zntx sxgxr")
    assert set(a[0]) != set(b[0])
    high, low = model.score([a, b])
    assert high > 0.8 and low < 0.4


def test_equal_similarities_share_the_last_vote():
    same = (np.array([1, 2]), np.array([1.0, 1.0]))
    other = (np.array([3, 900]), np.array([1.0, 1.0]))
    labels = [1, 0] * 30 + [0] * 10
    model = VoteModel.fit([same] * 60 + [other] * 10, labels)
    shuffled = VoteModel.fit([same] * 60 + [other] * 10, [0, 1] * 30 + [0] * 10)
    assert abs(model.score([same])[0] - 0.5) < 1e-6  # 60 equal ones: half of them are 1
    assert abs(model.score([same])[0] - shuffled.score([same])[0]) < 1e-6
