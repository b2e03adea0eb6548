import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import SMALLEST as SF, compare, connect
from tallyweave.operators.quality import CheckFailed, enforce, report, row_checks
from tallyweave.operators.joins import keep_members
from tallyweave.operators.linkage import accepted, build_register, keep_accepted
from tallyweave.operators.scoring import dynamic_score
from tallyweave.plans.bindings import (ENGINEER, MANAGER, TYPES, company_names, contributions,
                                       crosswalk, donations, register_rows)
from tallyweave.plans import storage_queries
from tallyweave.plans.panel import build_panel, cycles_needed
from tallyweave.plans.storage_queries import ORDERS_SCHEMA
from tallyweave import session
from tallyweave.session import written
from tallyweave.sources.datasets import write_by_cycle
from tallyweave.streaming.ingest import (latest_scores, running_scores, stream_contributions,
                                         write_updates)

# One query or more of every family; the whole list runs in tests/check_oracle.py.
CHECKED = ("dynamic_score", "dynamic_score_range_window", "local_means", "interpolate_scores",
           "normalize_names", "fuzzy_match", "threshold_sweep", "industry_parse_text",
           "industry_crosswalk", "box_stats", "density_grid", "ols_multi", "ols_interaction",
           "levene", "icc", "entity_sample", "null_patterns", "group_shares", "expectations",
           "ingest_repair", "typed_casts", "partition_roundtrip", "panel",
           "contributors_processed", "stream_scores", "stream_ingest", "threshold_review",
           "long_names", "icc_reml", "random_slope", "mixed_performance", "mixed_interaction",
           "ols_p_values", "industry_files", "schema_check")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["donor_id", "cycle", "weighted_sum", "weight", "dynamic_score"]
    assert df.count() > 0


def test_every_oracle_parses():
    con = connect(SF)
    for name, sql in entry.oracle_sql().items():
        con.execute(f"explain {sql}")
        assert name in entry.queries()
    assert isinstance(con, duckdb.DuckDBPyConnection)


def test_cycles():
    assert cycles_needed((2016, 2020, 2024)) == [2014, 2016, 2018, 2020, 2022, 2024]


def test_scan_is_pruned(spark):
    d = donations(spark, SF).groupBy("donor_id").agg(F.sum("amount"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "o_totalprice" not in plan and "s_name" not in plan


def small_panel(spark, crosswalk_rows, register=None):
    names = company_names(spark, SF)
    return build_panel(contributions(spark, SF), register or build_register(register_rows(names)),
                       crosswalk_rows, targets=(1998, 2002), types=TYPES, engineer=ENGINEER,
                       manager=MANAGER)


def test_a_join_that_multiplies_donations_stops_the_panel(spark):
    once = crosswalk(spark, SF)
    with pytest.raises(CheckFailed, match="as often as their employer"):
        small_panel(spark, once.unionByName(once))
    reg = build_register(register_rows(company_names(spark, SF)))
    with pytest.raises(CheckFailed, match="more than one match"):
        small_panel(spark, once, reg.unionByName(reg.withColumn("real_name", F.lit("other"))))


def test_rows_without_an_accepted_name_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.concat(
            F.lit("name "), F.col("id").cast("string"))).alias("employer"))
        matches = written(rows.where("id % 50 = 1").select(
            F.col("employer").alias("employer_raw"), F.lit("auto_accept").alias("status"),
            F.lit("x").alias("matched_name")).where("employer_raw is not null"), "matches")
        out = keep_accepted(rows, matches, "employer")
        plan = out._jdf.queryExecution().executedPlan().toString()
        # the filter comes before the exchange of the rows
        assert "SortMergeJoin" in plan and plan.index("Exchange hashpartitioning") < plan.index(
            "getbit")
        kept = keep_members(rows, "employer", accepted(matches).withColumnRenamed(
            "employer_raw", "employer"))
        n = matches.count()
        assert n <= kept.count() <= 1.2 * n and out.count() == n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_table_is_not_mixed_from_two_schemas(spark, tmp_path):
    root = str(tmp_path / "table")
    one = spark.createDataFrame([(1, "a", 2016)], "x int, y string, cycle bigint")
    write_by_cycle(one, root)
    write_by_cycle(one, root)
    for other in (one.withColumn("x", F.col("x").cast("string")), one.drop("y"),
                  one.withColumn("z", F.lit(1))):
        with pytest.raises(CheckFailed, match="column"):
            write_by_cycle(other, root)


def test_streamed_files_are_converted_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    head = "transaction.id,amount,date,bonica.cid,cycle,contributor.employer,contributor.memo\n"
    for i in range(5):
        text = head + f'{i},1.5,2016-01-01,7,2016,"Café","two\n{i},lines,x,y,z,a,b"\n'
        (src / f"f{i}_2016.csv.gz").write_bytes(gzip.compress(
            text.encode("latin-1" if i % 2 else "utf-8")))
    root, ledger, check = (str(tmp_path / x) for x in ("out", "ledger", "check"))

    def run(checkpoint):
        stream_contributions(spark, str(src / "*.gz"), root, ledger, checkpoint, ORDERS_SCHEMA,
                             files_per_batch=2).awaitTermination()
        rows = spark.read.parquet(root).collect()
        assert sorted(r["transaction_id"] for r in rows) == [str(i) for i in range(len(rows))]
        assert {r["contributor_employer"] for r in rows} == {"Café"}
        return len(rows), spark.read.parquet(ledger).count()

    assert run(check) == (5, 5)
    (src / "f5_2016.csv.gz").write_bytes(gzip.compress((head + "5,1,2016-01-01,7,2016,Café,m\n")
                                                       .encode()))
    assert run(check) == (6, 6)
    assert run(str(tmp_path / "lost")) == (6, 6)  # all batches again: the ledger leaves them out


def test_current_scores_are_one_row_per_key(spark, tmp_path):
    schema = "donor_id bigint, cycle bigint, amount double, candidate_score double, " \
             "transaction_type string"
    rows = [(i % 7, 2014 + 2 * (i % 3), 50.0 * i, (i % 11) / 7 - 1, "15") for i in range(90)]
    src = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(
            str(src))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    write_updates(running_scores(stream), out, str(tmp_path / "check"), buckets=4
                  ).awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == stored.select("donor_id", "cycle").distinct().count()
    got = {(r["donor_id"], r["cycle"]): r["dynamic_score"] for r in latest_scores(
        spark, out).collect()}
    want = dynamic_score(spark.createDataFrame(rows, schema))
    assert got == {(r["donor_id"], r["cycle"]): r["dynamic_score"] for r in want.collect()}


def test_running_sums_are_kept_once_and_carried_when_read(spark, tmp_path):
    schema = "donor_id bigint, cycle bigint, amount double, candidate_score double, " \
             "transaction_type string"
    rows = [(i % 40, 2014 + 4 * (i % 2), 50.0 * i, (i % 11) / 7 - 1, "15") for i in range(200)]
    rows += [(None, 2014, 100.0, 1.0, "15"), (1, None, 100.0, 1.0, "15"),
             (2, 2016, None, 1.0, "15"), (3, 2016, 100.0, None, "15")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):
        spark.createDataFrame(rows[part::2], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = write_updates(running_scores(stream), out, str(tmp_path / "check"), buckets=4)
    query.awaitTermination()
    own = {r[:2] for r in rows if None not in r[:2]}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == len(own)
    assert {(r["donor_id"], r["cycle"]) for r in spark.read.parquet(out).collect()} == own
    parts = sorted((tmp_path / "out").glob("bucket=*"))
    assert len(parts) == 4 and all(len(list(p.glob("*.parquet"))) == 1 for p in parts)
    want = dynamic_score(spark.createDataFrame(rows, schema))
    assert sorted(latest_scores(spark, out).collect()) == sorted(want.collect())


def test_arriving_files_grow_in_number_and_batches_do_not(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage_queries, "ARRIVING_ROWS", 100)
    items = spark.range(2000).selectExpr("id as l_orderkey", "id % 3 as l_suppkey")
    path = str(tmp_path / "arriving")
    assert storage_queries.write_arriving(items, path) == 5
    assert len(list((tmp_path / "arriving").glob("*.parquet"))) == 20
    assert spark.read.parquet(path).count() == 2000


def test_scratch_tables_can_be_dropped(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    (tmp_path / "other").mkdir()
    kept = str(tmp_path / "result")
    table = written(spark.range(5), "five")
    table.write.parquet(kept)
    session.drop_scratch(spark)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["other", "result"]
    assert spark.read.parquet(kept).count() == 5
    assert written(spark.range(3), "three").count() == 3


def test_fail_mode(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    checks = report([row_checks(df, {"missing": F.col("a").isNull()})], "fail")
    assert checks.first()["violations"] == 1
    with pytest.raises(CheckFailed, match="missing: 1"):
        enforce(checks)


def test_accepted_names_are_matched_once(spark, con):
    df = entry.queries()["accepted_matches"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEval" not in plan and "MapInArrow" not in plan
    assert compare(df, con, entry.oracle_sql()["accepted_matches"]) is None
