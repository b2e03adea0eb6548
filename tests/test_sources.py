import datetime
import gzip
import random
import re

import pytest
from pyspark.sql import Window, functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType)

from tallyweave.operators.quality import schema_problems
from tallyweave.plans.storage_queries import write_dirty_orders
from tallyweave.session import written
from tallyweave.sources import datasets, schemas
from tallyweave.sources.delimited import (file_facts, logical_records, parse_records,
                                          quote_events, read_lines, repair_lines, typed_projection)

BODY = r'''transaction.id,memo,amount,cycle
1,"ends in backslash\",5,2016
2,"multi
line, memo",6.5,2016
3,\N,7,2016
4,,8,2016
5,"say ""hi""",9,2016
6,short
7,text,abc,2016
8,"never closed\
9,"fine",3,2016
10,é,4,2016
11,tail,1,2016\
'''
SCHEMA = StructType([
    StructField("transaction_id", StringType(), True, {"source_name": "transaction.id"}),
    StructField("memo", StringType(), True, {"source_name": "memo"}),
    StructField("amount", DoubleType(), True, {"source_name": "amount"})])


def gz(path, text, encoding="utf-8"):
    path.write_bytes(gzip.compress(text.encode(encoding)))


def test_repair_and_types(spark, tmp_path):
    gz(tmp_path / "c_2016.csv.gz", BODY)
    gz(tmp_path / "d_2016.csv.gz", BODY, "latin-1")
    header = ["transaction.id", "memo", "amount", "cycle"]
    raw = read_lines(spark, str(tmp_path / "*.gz"))
    facts = file_facts(raw, header)
    assert {r["n_headers"] for r in facts.collect()} == {1}
    lines = repair_lines(raw, facts)
    assert {r["transcoded"] for r in lines.where("file like '%c_2016%'").collect()} == {False}
    recs = parse_records(logical_records(lines, 4), header)
    rows = typed_projection(recs, SCHEMA, ("file", "open_quote", "cycle"))
    for name in ("c_2016", "d_2016"):
        got = {r["transaction_id"]: r for r in rows.where(f"file like '%{name}%'").collect()}
        memo = {k: r["memo"] for k, r in got.items()}
        assert memo == {"1": "ends in backslash\\", "2": "multi\nline, memo", "3": None, "4": "",
                        "5": 'say "hi"', "6": "short", "7": "text", "8": "never closed",
                        "9": "fine", "10": "é", "11": "tail"}
        assert {k: r["amount"] for k, r in got.items()} == {
            "1": 5.0, "2": 6.5, "3": 7.0, "4": 8.0, "5": 9.0, "6": None, "7": None, "8": None,
            "9": 3.0, "10": 4.0, "11": 1.0}
        assert [k for k, r in got.items() if r["open_quote"]] == ["8"]


def test_long_multi_line_record_over_chunks(spark):
    values = ["a,b"] + [x for i in range(50) for x in (f'{i},"x', "", "mid dle", f'y{i}"')]
    df = spark.createDataFrame([("f", i // 7, i, v) for i, v in enumerate(values)],
                               "file string, chunk int, seq bigint, value string")
    recs = logical_records(df.repartition(5), 2)
    rows = parse_records(recs, ["a", "b"]).collect()
    assert len(rows) == 50
    assert all(r["b"] == f"x\n\nmid dle\ny{r['a']}" and r["n_lines"] == 4 for r in rows)


def plain_records(values, n_columns):
    """Line by line: the automaton of the docstrings with a look at the next event."""
    def kind(v):
        bare = v.replace('""', "")
        first = bare.find('"')
        if first < 0:
            return None
        opens = bare[:first] == "" or bare[:first].endswith(",")
        closes = bare[first + 1:first + 2] in ("", ",")
        if v.count('"') % 2:
            return "O" if opens and not closes else "K" if closes and not opens else "S"
        fields = len(re.sub(r'"[^"]*("|$)', "", v).split(","))
        return "C" if not closes and fields == n_columns else None
    kinds = [kind(v) for v in values]
    out, state, i = [], 0, 0
    while i < len(values):
        k = kinds[i]
        state = {"O": 1, "K": 0, "C": 0, "S": 1 - state, None: state}[k]
        end = next((j for j in range(i + 1, len(values)) if kinds[j]), None)
        if state and k in ("O", "S") and end is not None and kinds[end] in ("K", "S"):
            out.append("\n".join(values[i:end + 1]))
            state, i = (0 if kinds[end] == "K" else 1 - state), end
        else:
            out.append(values[i])
        i += 1
    return out


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_quote_states_over_chunks(spark, chunk):
    rng = random.Random(chunk)
    pieces = ['1,"a",x', '2,"b', 'c",x', "plain", "", '3,"say ""hi""",x', '4,"", ', "5,6,7", '"',
              '",x', 'x"y', '7,"open', '8,""lone"",9', 'd"",""e', '"""', '9,"p","q']
    values = [rng.choice(pieces) for _ in range(600)]
    df = spark.createDataFrame([("f" if i % 2 else "g", i // 2 // chunk, i, v)
                                for i, v in enumerate(values)],
                               "file string, chunk int, seq bigint, value string")
    # line numbers of a file's chunk are consecutive
    order = Window.partitionBy("file").orderBy("seq")
    df = written(df.withColumn("seq", F.row_number().over(order)).repartition(4), "lines")
    rows = logical_records(df, 3).orderBy("file", "seq").collect()
    for name, mine in (("f", values[1::2]), ("g", values[::2])):
        assert [r["record"] for r in rows if r["file"] == name] == plain_records(mine, 3)


def test_text_that_looks_like_a_record(spark, tmp_path):
    gz(tmp_path / "a_2016.csv.gz", HEAD + '1,"one\n2,two,5,2016\nthree",5,2016\n4,four,5,2016\n'
       '5,"never closed,5,2016\n6,six,5,2016\n7,"seven",5,2016\n')
    ingest(spark, tmp_path)
    rows = datasets.read_by_cycle(spark, str(tmp_path / "out"), STORED).collect()
    assert {r["transaction_id"]: r["memo"] for r in rows} == {
        "1": "one\n2,two,5,2016\nthree", "4": "four", "6": "six", "7": "seven"}


def test_lines_are_not_shuffled(spark, tmp_path):
    lines = written(spark.createDataFrame([("f", 0, i, f'{i},"a",b') for i in range(100)],
                                          "file string, chunk int, seq bigint, value string"),
                    "lines")
    plan = logical_records(lines, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_ingest_skips_what_is_done(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    good = "transaction.id,memo,amount,cycle\n1,a,5,2016\n2,b,6,x\n3,c,7,2016,extra\n"
    gz(src / "c_2016.csv.gz", good)
    args = (str(src / "*.gz"), str(tmp_path / "out"), str(tmp_path / "ledger"), SCHEMA)
    ledger = datasets.ingest_contributions(spark, *args)
    r = ledger.first()
    assert (r["cycle"], r["n_written"], r["n_torn"], r["n_bad"], r["status"]) == (
        2016, 1, 1, 1, "converted")
    gz(src / "c_2018.csv.gz", "transaction.id,memo,amount,cycle\n1,a,5,2018\n")
    assert datasets.ingest_contributions(spark, *args).count() == 2
    stored = StructType([*SCHEMA.fields, StructField("cycle", LongType())])
    back = datasets.read_by_cycle(spark, str(tmp_path / "out"), stored)
    assert sorted(r["cycle"] for r in back.collect()) == [2016, 2018]
    assert dict(back.dtypes)["cycle"] == "bigint"
    plan = back.where("cycle = 2018").select("amount")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cycle" in plan and "ReadSchema: struct<amount" in plan
    assert datasets.table_is_complete(spark, str(tmp_path / "out"), stored)
    assert not datasets.table_is_complete(spark, str(tmp_path / "nothing"), stored)


STORED = StructType([*SCHEMA.fields, StructField("cycle", LongType())])


def ingest(spark, tmp_path, **more):
    args = (str(tmp_path / "*.gz"), str(tmp_path / "out"), str(tmp_path / "ledger"), SCHEMA)
    ledger = datasets.ingest_contributions(spark, *args, **more)
    return {r["file"].rsplit("/", 1)[1]: r["status"] for r in ledger.collect()}


def stored(spark, tmp_path):
    return sorted((r["transaction_id"], r["cycle"]) for r in datasets.read_by_cycle(
        spark, str(tmp_path / "out"), STORED).collect())


HEAD = "transaction.id,memo,amount,cycle\n"


def test_a_failed_file_does_not_hold_up_others(spark, tmp_path):
    gz(tmp_path / "a_2016.csv.gz", HEAD + "1,a,5,2018\n")
    gz(tmp_path / "b_2016.csv.gz", "transaction.id,amount,cycle\n2,5,2016\n")
    gz(tmp_path / "c_2016.csv.gz", HEAD + "3,a,5,2016\n")
    assert ingest(spark, tmp_path) == {"a_2016.csv.gz": "failed", "b_2016.csv.gz": "failed",
                                       "c_2016.csv.gz": "converted"}
    assert stored(spark, tmp_path) == [("3", 2016)]


def test_files_have_their_own_headers(spark, tmp_path):
    gz(tmp_path / "a_2016.csv.gz", HEAD + "1,a,5,2016\n")
    gz(tmp_path / "b_2016.csv.gz", "memo,transaction.id,amount,cycle,more\na,2,5,2016,x\n")
    assert set(ingest(spark, tmp_path).values()) == {"converted"}
    assert stored(spark, tmp_path) == [("1", 2016), ("2", 2016)]


def test_late_and_changed_files(spark, tmp_path):
    import shutil
    gz(tmp_path / "a_2016.csv.gz", HEAD + "1,a,5,2016\n2,b,5,2016\n")
    ingest(spark, tmp_path)
    gz(tmp_path / "b_2016.csv.gz", HEAD + "3,a,5,2016\n")
    ingest(spark, tmp_path)
    assert stored(spark, tmp_path) == [("1", 2016), ("2", 2016), ("3", 2016)]
    gz(tmp_path / "a_2016.csv.gz", HEAD + "1,a,5,2016\n4,changed row,5,2016\n")
    ingest(spark, tmp_path)
    assert stored(spark, tmp_path) == [("1", 2016), ("3", 2016), ("4", 2016)]
    shutil.rmtree(tmp_path / "out")  # lost output is built again
    ingest(spark, tmp_path)
    assert stored(spark, tmp_path) == [("1", 2016), ("3", 2016), ("4", 2016)]


def test_missing_column_is_refused(spark, tmp_path):
    gz(tmp_path / "c_2016.csv.gz", "transaction.id,amount,cycle\n1,5,2016\n")
    with pytest.raises(ValueError, match="memo"):
        datasets.read_contributions(spark, str(tmp_path / "*.gz"), SCHEMA)


def test_full_schemas(spark, tmp_path):
    assert len(schemas.CONTRIBUTIONS) == 44 and len(schemas.CONTRIBUTORS) == 43
    assert set(schemas.PANEL_INPUT) <= set(schemas.STORED_CONTRIBUTIONS.names)
    names = [f.metadata["source_name"] for f in schemas.CONTRIBUTORS]
    row = {n: "" for n in names}
    row.update({"bonica.cid": "7", "contributor.type": "I", "amount.2016": "12.5",
                "most.recent.transaction.date": "2016-1-5",
                "most.recent.contributor.name": '"Pé"', "contributor.gender": r"\N"})
    gz(tmp_path / "c.csv.gz", ",".join(names) + "\n" + ",".join(row.values()) + "\n", "latin-1")
    r = datasets.read_contributors(spark, str(tmp_path / "c.csv.gz")).first()
    assert (r["bonica_cid"], r["amount_2016"], r["most_recent_contributor_name"]) == (
        7, 12.5, "Pé")
    assert str(r["most_recent_transaction_date"]) == "2016-01-05"
    assert r["contributor_gender"] is None and r["is_corp"] is None
    assert schema_problems(schemas.CONTRIBUTORS, schemas.CONTRIBUTORS) == []
    assert len(schema_problems(StructType(schemas.CONTRIBUTORS.fields[1:]),
                               schemas.CONTRIBUTORS)) == 1


def test_register_and_parts(spark, tmp_path):
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "a.json").write_text(
        '{"cik": "1", "name": "A",\n "sic": "", "sicDescription": "x", "more": [1]}')
    (folder / "b.json").write_text('{"cik": "2", "sic": "10"}')
    (folder / "c.json").write_text('{"cik": ')
    rows = datasets.read_register_json(spark, str(folder)).collect()
    assert [(r["cik"], r["real_name"], r["sic"]) for r in rows] == [(1, "A", None)]
    parts = tmp_path / "parts"
    datasets.write_table(spark.range(10).select(F.col("id")), str(parts), records_per_file=4)
    (parts / "stray.txt").write_text("x")
    (parts / "left.parquet.tmp").write_text("x")
    assert datasets.read_parts(spark, str(parts)).count() == 10


def test_events_are_staged(spark, tmp_path):
    (tmp_path / "f_1996.csv").write_text('a,b\n1,"x\n2,y"\n3,z\n')
    events = quote_events(repair_lines(read_lines(spark, str(tmp_path))), 2)
    assert [r["kind"] for r in events.orderBy("seq").collect()] == ["O", "K"]
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()


def test_files_do_not_grow_in_number(spark, tmp_path):
    rows = [(k, 1, 1.0, datetime.datetime(1996, 5, 1), "1-URGENT") for k in range(1, 9_000_000, 9_000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, "
                          "o_orderdate timestamp, o_orderpriority string").write.parquet(
        str(tmp_path / "orders.parquet"))
    files = spark.read.format("binaryFile").load(write_dirty_orders(spark, str(tmp_path)))
    assert 1 < files.select("path").count() <= 6
