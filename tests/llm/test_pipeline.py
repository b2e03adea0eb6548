"""Each stage on its own input, against the brute-force versions of its operator's tests."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
import test_decontamination
import test_lines
import test_near_duplicates
import test_packing
from tallyweave.llm import queries
from tallyweave.llm.quality import quality_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """{stage: (input rows, output rows)} as (doc_id, text) pairs, and the packed pieces."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, {}
    for number, (name, stage) in enumerate(cp.STAGES):
        before = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        path = str(tmp_path_factory.mktemp("stages") / str(number))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if number < len(cp.STAGES) - 1:
            assert docs.columns == columns
            rows = docs.collect()
            assert all(r.n_chars == len(r.text) for r in rows)
            out[name] = before, sorted((r.doc_id, r.text) for r in rows)
        else:
            out[name] = before, docs.collect()
    return out


def test_order_of_stages():
    assert [f.__name__ for _, f in cp.STAGES] == ["quality", "lines", "near_copies", "benchmark",
                                                  "packing"]


def test_quality_keeps_what_scores_enough(spark, stages):
    before, after = stages["quality classifier"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.id for r in quality_scores(docs, "doc_id", "text", model).collect()
            if r.score >= 0.3}
    assert after == [r for r in before if r[0] in good] and 0 < len(after) < len(before)


def test_lines_are_those_of_the_brute_force(stages):
    before, after = stages["line dedup"]
    want = [(k, t) for k, t, _, gone in test_lines.brute(before) if not gone or t.strip()]
    assert after == sorted(want) and after != before


def test_one_document_of_each_group_stays(stages):
    before, after = stages["MinHash near-dedup"]
    kept = {k for k, _, _, keep in test_near_duplicates.brute(before, 5, 80) if keep}
    assert after == [r for r in before if r[0] in kept]


def test_contaminated_documents_go(stages):
    before, after = stages["benchmark decontamination"]
    t = pq.read_table(f"{SF}/benchmark.parquet")
    items = list(zip(t["item_id"].to_pylist(), t["text"].to_pylist()))
    want = []
    for key, text in before:
        n, hit, _ = test_decontamination.brute(text, items)
        if not (hit > 0 and 20 * hit >= n):
            want.append((key, text))
    assert after == want and len(after) < len(before)


def test_packing_holds_every_token(spark, stages):
    from pyspark.sql import functions as F
    before, pieces = stages["packing"]
    df = spark.createDataFrame(pieces).withColumn("crc", F.crc32("token_ids"))
    test_packing.check(df.collect(), dict(before), 4096)


def test_run_gives_the_last_stage(spark, stages):
    got = cp.run(spark, SF)
    assert sum(r.length for r in got.select("length").collect()) == sum(
        p.length for p in stages["packing"][1])


def test_odd_documents(spark):
    """Nulls, empty texts and ties pass through all stages but where a decision is due."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words", "en", "s", 10),
            (3, "one line of some length here\nagain", "en", "s", 34),
            (4, "one line of some length here", "en", "s", 28)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in cp.STAGES[1:4]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()
    cleaned = {r.doc_id: r.text for r in cp.lines(spark, docs, SF).collect()}
    assert cleaned == {1: None, 2: "", None: "some words", 3: rows[3][1]}
    assert cp.near_copies(spark, docs, SF).count() == 5


def test_one_row_of_each_group(spark):
    """Repeated rows, copies without an id, and one id on two texts, one of them a near copy."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = [f"w{i}" for i in range(80)]
    text, near = " ".join(base), " ".join([*base[:-1], "other"])
    alone, late = " ".join(f"v{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(3, text), (3, text), (5, alone), (5, text), (5, near), (None, near), (None, late),
            (None, late), (None, late + " end"), (7, None), (7, None), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows] + [
        (3, text, "de", "s", 1)], schema).repartition(3)
    got = [(r.doc_id, r.text) for r in cp.near_copies(spark, docs, SF).collect()]
    ends = [t for k, t in got if t and t.startswith(late)]
    assert len(ends) == 1 and sorted(map(str, got)) == sorted(map(str, [
        (3, text), (5, alone), (None, ends[0]), (7, None), (None, "")]))
    twice = [(r.doc_id, r.text) for r in cp.near_copies(spark, docs.union(docs), SF).collect()]
    assert sorted(map(str, twice)) == sorted(map(str, got))


def odd_documents(spark):
    """The smallest documents with columns whose names clash, and nulls, copies and empty texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = [(r.doc_id, r.text, 1, "x", None, 2.0, "y") for r in docs.collect()]
    odd = [(None, None), (None, ""), (known[0][0], known[0][1]), (10 ** 9, None), (10 ** 9 + 1, ""),
           (10 ** 9 + 2, " \n "), (10 ** 9 + 3, "word " * 30_000)]
    rows = known + [(k, t, 1, "x", None, 2.0, "y") for k, t in odd]
    return spark.createDataFrame(rows, "doc_id long, text string, id int, label string, "
                                       "hash long, score double, row string").repartition(3)


def test_odd_documents_in_the_first_and_last_stage(spark):
    docs = odd_documents(spark)
    kept = cp.quality(spark, docs, SF)
    assert kept.schema == docs.schema
    rows = kept.collect()
    model = queries.quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for text in (None, "", " \n "):  # judged alike, by the share of good documents
        assert sum(r.text == text for r in rows) == (model.base >= 0.3) * sum(
            r.text == text for r in docs.collect())
    first = docs.where("doc_id = 0").collect()
    assert [r for r in rows if r.doc_id == 0] in ([], first)
    assert cp.quality(spark, docs.limit(0), SF).count() == 0
    pieces = cp.packing(spark, docs, SF)
    ends = pieces.where("doc_id is null").collect()
    assert [p.length for p in ends] == [1, 1] and all(p.doc_tokens == 1 for p in ends)
    tokens = pieces.groupBy("doc_id").sum("length").where("doc_id = 1000000003").first()[1]
    assert tokens == 30_001
    assert cp.packing(spark, docs.limit(0), SF).count() == 0


def test_run_over_odd_and_over_no_documents(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = odd_documents(spark).withColumn("n_chars", F.length("text").cast("long"))
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    got = cp.run(spark, str(tmp_path))
    whole = got.groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert {r.doc_id for r in whole} <= {r.doc_id for r in docs.collect()}
    assert all(r[2] % r.doc_tokens == 0 for r in whole)
    docs.limit(0).write.mode("overwrite").parquet(path)
    assert cp.run(spark, str(tmp_path)).count() == 0
