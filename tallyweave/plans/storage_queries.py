"""Registered queries on ingest, layout, data quality and streams.

Files are written from the given tables to the shared folder first, then read the way outside
files would be.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, LongType, StringType, StructField,
                               StructType)

from ..functions.numeric import lenient_bigint, round_half_up
from ..operators import quality
from ..operators.scoring import carry_forward, dynamic_score
from ..operators.summaries import cell_stats, small_cells
from ..session import scratch_path, written
from ..sources import datasets
from ..sources.delimited import (cycle_of_file, logical_records, parse_records, read_lines,
                                 repair_lines, typed_projection)
from ..streaming.ingest import (latest_scores, running_scores, stream_contributions,
                                write_updates)
from .bindings import (TYPES, company_names, contributions, crosswalk, donations, donors,
                       ENGINEER, MANAGER, register_rows, table)
from ..operators.linkage import build_register
from .oracle_parts import (COMPANIES, CROSSWALK, DEFS, DON, DONORS, DYN, REGISTER,
                           matches_sql, r6)
from .panel import PANEL_COLUMNS, build_panel, process_contributors, write_panel

_FIELDS = (("transaction.id", StringType()), ("amount", DoubleType()), ("date", DateType()),
           ("bonica.cid", LongType()), ("contributor.employer", StringType()),
           ("contributor.memo", StringType()))
ORDERS_SCHEMA = StructType([StructField(n.replace(".", "_"), t, True, {"source_name": n})
                            for n, t in _FIELDS])
#: A line of text inside a memo that has the shape of a record.
_LIKE_A_RECORD = "1,2.5,1996-01-01,3,1996,someone,plain"
#: Keys in a file of damaged orders, at least, and most key ranges: files grow with the table, so
#: that neither their number nor that of a stream's batches does.
FILE_KEYS, KEY_RANGES = 50_000, 6
#: Batches of the stream of line items, and rows of one of its files, about.
BATCHES, ARRIVING_ROWS = 4, 1_000_000
_HEADER = "transaction.id,amount,date,bonica.cid,cycle,contributor.employer,contributor.memo"


def write_dirty_orders(spark, sf):
    """Orders as damaged gzip CSV files, one folder per cycle and key range; returns a pattern.

    Null marks, text in number columns, decimal ids, torn cycles, short rows, doubled quotes,
    quoted line breaks, quoted lines that look like records, backslashes at line ends, and Latin-1
    bytes in one cycle.
    """
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    last = o.agg(F.max(k)).first()[0] or 0
    keys = max(FILE_KEYS, -(-(last + 1) // KEY_RANGES))
    o = o.withColumn("c", F.col("year") + F.col("year") % 2)

    def every(n):
        return k % n == 0

    amount = (F.when(every(11), F.lit(r"\N")).when(every(13), F.lit("n/a"))
              .otherwise(F.col("o_totalprice").cast("string")))
    donor = F.when(every(7), F.concat(F.col("o_custkey").cast("string"), F.lit(".6"))).otherwise(
        F.col("o_custkey").cast("string"))
    cycle = F.when(every(19), F.lit("x")).otherwise(F.col("c").cast("string"))
    employer = F.when(every(17), F.lit("")).otherwise(
        F.concat(F.lit('"Café, '), F.col("o_orderpriority"), F.lit('"')))
    memo = (F.when(every(31), F.lit(f'"before\n{_LIKE_A_RECORD}\nafter"'))
            .when(every(5), F.lit('"first line\nsecond, line"')).when(
        every(3), F.lit('"says ""hi"""\\')).otherwise(F.lit("plain\\")))
    line = F.concat_ws(",", k.cast("string"), amount, F.date_format("o_orderdate", "yyyy-MM-dd"),
                       donor, cycle, employer)
    line = F.when(every(23), line).otherwise(F.concat_ws(",", line, memo))
    line = F.when(F.col("c") == 1998, F.encode(line, "ISO-8859-1").cast("string")).otherwise(line)
    rows = o.select(F.concat(F.lit("orders_"), F.col("c").cast("string"), F.lit("-"),
                             F.floor(k / keys).cast("string")).alias("file"),
                    F.lit(1).alias("pos"), k.alias("key"), line.alias("value"))
    heads = rows.select("file").distinct().select("file", F.lit(0).alias("pos"),
                                                  F.lit(-1).alias("key"),
                                                  F.lit(_HEADER).alias("value"))
    root = scratch_path(spark, "dirty")
    (rows.unionByName(heads).repartition("file").sortWithinPartitions("file", "pos", "key")
     .select("file", "value").write.partitionBy("file").option("compression", "gzip").text(root))
    return f"{root}/file=*/*.gz"


def ingest_repair(spark, sf):
    pattern = write_dirty_orders(spark, sf)
    root, ledger = scratch_path(spark, "contributions"), scratch_path(spark, "ledger")
    datasets.ingest_contributions(spark, pattern, root, ledger, ORDERS_SCHEMA)
    stored = StructType([*ORDERS_SCHEMA.fields, StructField("cycle", LongType())])
    return datasets.read_by_cycle(spark, root, stored)


def ingest_late_files(spark, sf):
    """The same files in two runs: later files of a cycle add to the earlier ones' rows."""
    pattern = write_dirty_orders(spark, sf)
    root, ledger = scratch_path(spark, "contributions"), scratch_path(spark, "ledger")
    for files in (pattern.replace("file=*", "file=*-0"), pattern):
        datasets.ingest_contributions(spark, files, root, ledger, ORDERS_SCHEMA)
    stored = StructType([*ORDERS_SCHEMA.fields, StructField("cycle", LongType())])
    return datasets.read_by_cycle(spark, root, stored)


_DIRTY = """o as (select *, o_orderkey as k, cast(year(o_orderdate) + year(o_orderdate) % 2
  as bigint) as c from orders)"""

_INGEST_SQL = f"""with {_DIRTY}
select cast(k as varchar) as transaction_id,
  case when k % 11 <> 0 and k % 13 <> 0 then o_totalprice end as amount,
  cast(o_orderdate as date) as date,
  case when k % 7 = 0 then o_custkey + 1 else o_custkey end as bonica_cid,
  case when k % 17 = 0 then '' else 'Café, ' || o_orderpriority end as contributor_employer,
  case when k % 23 = 0 then null
       when k % 31 = 0 then concat_ws(chr(10), 'before', '{_LIKE_A_RECORD}', 'after')
       when k % 5 = 0 then 'first line' || chr(10) || 'second, line'
       when k % 3 = 0 then 'says "hi"' else 'plain' end as contributor_memo,
  c as cycle
from o where k % 19 <> 0"""


def ingest_ledger(spark, sf):
    """Ledger of an ingest, per cycle; running the ingest again converts nothing."""
    pattern = write_dirty_orders(spark, sf)
    root, path = scratch_path(spark, "contributions"), scratch_path(spark, "ledger")
    for _ in range(2):
        ledger = datasets.ingest_contributions(spark, pattern, root, path, ORDERS_SCHEMA)
    return ledger.groupBy("cycle", "transcoded", "status").agg(
        F.sum("n_lines").alias("n_lines"), F.sum("n_written").alias("n_written"),
        F.sum("n_torn").alias("n_torn"), F.sum("n_wrong_cycle").alias("n_wrong_cycle"))


_LEDGER_SQL = f"""with {_DIRTY}
select c as cycle, c = 1998 as transcoded, 'converted' as status,
  cast(sum(case when k % 23 = 0 then 1 when k % 31 = 0 then 3 when k % 5 = 0 then 2 else 1 end)
    as bigint) as n_lines,
  count(*) filter (where k % 19 <> 0) as n_written,
  count(*) filter (where k % 19 = 0) as n_torn, cast(0 as bigint) as n_wrong_cycle
from o group by c"""


def reconcile_query(spark, sf):
    """Row counts of source and converted table per cycle; torn rows make the difference."""
    out = ingest_repair(spark, sf)
    o = table(spark, sf, "orders")
    source = o.select((F.year("o_orderdate") + F.year("o_orderdate") % 2).cast("bigint")
                      .alias("cycle"))
    return quality.reconcile(source, out, "cycle")


_RECONCILE_SQL = f"""with {_DIRTY} select c as cycle, count(*) as n_source,
  count(*) filter (where k % 19 <> 0) as n_output, count(*) filter (where k % 19 = 0) = 0
  as complete from o group by c"""


_CONTRIBUTOR_COLUMNS = StructType([
    StructField("bonica_cid", LongType(), True, {"source_name": "bonica.cid"}),
    StructField("contributor_type", StringType(), True, {"source_name": "contributor.type"}),
    StructField("name", StringType(), True, {"source_name": "name"}),
    StructField("contributor_cfscore", DoubleType(), True,
                {"source_name": "contributor.cfscore"})])


def contributor_ingest(spark, sf):
    """Latin-1 donors file: null mark and empty text are both NULL."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    line = F.concat_ws(
        ",", k.cast("string"), F.when(k % 4 == 0, F.lit("")).otherwise(F.lit("I")),
        F.concat(F.lit('"é '), F.col("c_name"), F.lit('"')),
        F.when(k % 6 == 0, F.lit(r"\N")).otherwise(F.col("c_acctbal").cast("string")))
    header = ["bonica.cid", "contributor.type", "name", "contributor.cfscore"]
    root = scratch_path(spark, "contributors")
    c.select(F.encode(line, "ISO-8859-1").cast("string")).write.text(root)
    lines = written(repair_lines(read_lines(spark, root)), "lines")
    parsed = parse_records(logical_records(lines, len(header)), header)
    return typed_projection(parsed, _CONTRIBUTOR_COLUMNS, empty_is_null=True)


_CONTRIBUTOR_SQL = """select c_custkey as bonica_cid,
  case when c_custkey % 4 <> 0 then 'I' end as contributor_type, 'é ' || c_name as name,
  case when c_custkey % 6 <> 0 then c_acctbal end as contributor_cfscore from customer"""


def contributors_read(spark, sf):
    """A compressed Latin-1 donors file with its header, read by the library's reader."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    root = scratch_path(spark, "contributors")
    (c.select(k.cast("string").alias("bonica.cid"),
              F.when(k % 4 == 0, F.lit("")).otherwise(F.lit("I")).alias("contributor.type"),
              F.concat(F.lit("é "), F.col("c_name")).alias("name"),
              F.when(k % 6 == 0, F.lit(r"\N")).otherwise(F.col("c_acctbal").cast("string"))
              .alias("contributor.cfscore"))
     .write.option("header", True).option("encoding", "ISO-8859-1")
     .option("compression", "gzip").csv(root))
    return datasets.read_contributors(spark, root, _CONTRIBUTOR_COLUMNS)


def typed_casts(spark, sf):
    """Text to numbers and dates, NULL where the text does not fit."""
    k = F.col("o_orderkey")
    text = (F.when(k % 5 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit("."),
                                        (k % 10).cast("string")))
            .when(k % 5 == 1, F.concat(F.lit("-"), F.col("o_custkey").cast("string"),
                                       F.lit(".5")))
            .when(k % 5 == 2, F.concat(F.col("o_custkey").cast("string"), F.lit("e2")))
            .when(k % 5 == 3, F.concat(F.col("o_custkey").cast("string"), F.lit("x")))
            .otherwise(F.col("o_custkey").cast("string")))
    day = F.date_format("o_orderdate", "yyyy-M-d")
    day = F.when(k % 3 == 0, F.concat(day, F.lit("?"))).otherwise(day)
    o = table(spark, sf, "orders").select(k.alias("k"), text.alias("t"), day.alias("d"))
    return o.select(F.col("k").alias("o_orderkey"), lenient_bigint(F.col("t")).alias("whole"),
                    F.col("t").try_cast("double").alias("number"),
                    F.col("d").try_cast("date").alias("day"))


_CASTS_SQL = """with o as (select o_orderkey, case o_orderkey % 5
    when 0 then o_custkey || '.' || (o_orderkey % 10) when 1 then '-' || o_custkey || '.5'
    when 2 then o_custkey || 'e2' when 3 then o_custkey || 'x' else o_custkey || '' end as t,
  strftime(o_orderdate, '%Y-%-m-%-d') || case when o_orderkey % 3 = 0 then '?' else '' end as d
  from orders)
select o_orderkey, try_cast(t as bigint) as whole, try_cast(t as double) as number,
  try_cast(d as date) as day from o"""


def partition_roundtrip(spark, sf):
    """Written by cycle and read back with the partition column as bigint."""
    root = scratch_path(spark, "by_cycle")
    d = donations(spark, sf).select("donor_id", "recipient_id", "transaction_type", "cycle")
    datasets.write_by_cycle(d, root)
    back = datasets.read_by_cycle(spark, root, d.schema)
    return back.where(F.col("cycle").isin(1998, 2000)).groupBy("cycle", "transaction_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("donor_id").alias("n_donors"),
        F.max(F.typeof("cycle")).alias("cycle_type"))


_ROUNDTRIP_SQL = f"""with {DON} select cycle, transaction_type, count(*) as n,
  count(distinct donor_id) as n_donors, 'bigint' as cycle_type
from don where cycle in (1998, 2000) group by all"""


def register_json(spark, sf):
    """Register written as JSON lines, some of them broken, and read back."""
    r = register_rows(company_names(spark, sf)).select(
        F.col("cik").cast("string").alias("cik"),
        F.when(F.col("cik") % 10 != 0, F.col("real_name")).alias("name"),
        F.coalesce("sic", F.lit("")).alias("sic"),
        F.col("sic_description").alias("sicDescription"))
    text = F.to_json(F.struct(*r.columns))
    text = F.when(F.col("cik").cast("int") % 7 == 0, F.concat(F.lit("{broken "), text))
    root = scratch_path(spark, "register")
    whole = F.coalesce(text, F.to_json(F.struct(*r.columns)))
    r.select(whole).write.text(root)
    return datasets.read_register_json(spark, root, one_per_file=False)


_JSON_SQL = f"""with {COMPANIES} select cast(p_partkey as int) as cik, real_name,
  case when p_size <> 50 then lpad(cast(code as varchar), 4, '0') end as sic,
  p_type as sic_description
from companies where p_partkey % 10 <> 0 and p_partkey % 7 <> 0"""


def crosswalk_files(spark, sf):
    """Crosswalk to CSV and back; codes keep their zeros."""
    x = crosswalk(spark, sf)
    root = scratch_path(spark, "crosswalk")
    datasets.write_crosswalk(x, root)
    back = datasets.read_crosswalk_csv(spark, f"{root}/csv", x.schema)
    return back.where("in_sec").select("sic", "sic_int", "sec_title", "ff12", "ff49_abbr")


_FILES_SQL = f"""with {COMPANIES}, {DEFS}, {CROSSWALK}
select sic, sic_int, sec_title, ff12, ff49_abbr from crosswalk where in_sec"""


def expectations(spark, sf):
    """Missing values, outliers, small cells and multiplicity as one report."""
    j = donations(spark, sf).join(donors(spark, sf), "donor_id")
    rows = quality.row_checks(j, {
        "missing_city": F.col("city").isNull(),
        "missing_value": F.col("city").isNull() | F.col("priority").isNull(),
        "score_out_of_range": quality.out_of_range(F.col("static_score"), -1, 0.9),
        "cycle_out_of_range": ~F.col("cycle").between(1979, 2024)})
    cells = small_cells(j, ["city", "recipient_id"])
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("cycle"))
    twice = carry_forward(o).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return quality.report([rows, quality.set_check("small_cells", cells),
                           quality.set_check("not_twice", twice.where(F.col("n") != 2))])


_EXPECT_SQL = f"""with {DON}, {DONORS}, j as (select * from don join donors using (donor_id)),
v as (
  select 'missing_city' as name, count(*) filter (where city is null) as violations from j
  union all select 'missing_value', count(*) filter (where city is null or priority is null)
  from j
  union all select 'score_out_of_range', count(*) filter (
    where static_score < -1 or static_score > 0.9) from j
  union all select 'cycle_out_of_range', count(*) filter (where cycle < 1979 or cycle > 2024)
  from j
  union all select 'small_cells', count(*) from (
    select 1 from j group by city, recipient_id having count(*) < 20)
  union all select 'not_twice', 0)
select name, 'warn' as severity, violations, violations = 0 as passed from v"""


def outliers(spark, sf):
    d = donors(spark, sf)
    return d.where(quality.out_of_range(F.col("static_score"), -1, 0.5)).select(
        "donor_id", round_half_up(F.col("static_score")).alias("static_score"))


_OUTLIER_SQL = f"""with {DONORS} select donor_id, {r6('static_score')} as static_score
from donors where static_score < -1 or static_score > 0.5"""


def panel(spark, sf):
    """The whole panel plan on the given tables."""
    out = build_panel(contributions(spark, sf),
                      build_register(register_rows(company_names(spark, sf))),
                      crosswalk(spark, sf), targets=(1998, 2002), types=TYPES,
                      engineer=ENGINEER, manager=MANAGER)
    doubles = [f.name for f in out.schema if isinstance(f.dataType, DoubleType)]
    return out.select(*[round_half_up(F.col(c)).alias(c) if c in doubles else F.col(c)
                        for c in PANEL_COLUMNS])


def panel_written(spark, sf):
    """The panel written by cycle and read back."""
    out, root = panel(spark, sf), scratch_path(spark, "panel")
    write_panel(out, root)
    return datasets.read_by_cycle(spark, root, out.schema)


def schema_check(spark, sf):
    """What a table of line items lacks against an expected schema, with the rows concerned."""
    li = table(spark, sf, "lineitem")
    expected = StructType([StructField("l_orderkey", StringType()),
                           StructField("l_quantity", li.schema["l_quantity"].dataType),
                           StructField("l_currency", StringType()),
                           StructField("l_returnflag", StringType())])
    problems = [(p,) for p in quality.schema_problems(li.schema, expected)]
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows")).join(
        F.broadcast(spark.createDataFrame(problems, "problem string")))


_SCHEMA_SQL = """with c as (select column_name as c, lower(column_type) as t
                from (describe lineitem)),
p as (select 'missing column l_currency' as problem
      where not exists (select 1 from c where c = 'l_currency')
      union all select 'column l_orderkey: ' || t || ' instead of string' from c
      where c = 'l_orderkey' and t <> 'varchar')
select l_returnflag, problem, count(*) as n_rows from lineitem, p group by all"""


def part_files(spark, sf):
    """Orders written in files of bounded length and row groups; stray files are not read."""
    root = scratch_path(spark, "parts")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    datasets.write_table(o, root, records_per_file=5000, block_bytes=1 << 20)
    o.limit(1).write.mode("append").option("header", True).csv(root)
    return datasets.read_parts(spark, root).select(o.columns)


_PARTS_SQL = "select o_orderkey, o_orderstatus, o_totalprice from orders"


def _mean(value, keys):
    return r6(f"case when {keys[0]} is not null then avg({value}) over (partition by "
              f"{', '.join(keys)}) end")


_PANEL_SQL = f"""with {COMPANIES}, {REGISTER}, all_don as (select * from ({DON[8:-1]})),
{DONORS},
c as (select d.*, city, zip, static_score, segment, employer,
        nullif(lower(priority), '5-low') as occupation
      from all_don d join donors using (donor_id) join companies on part_id = p_partkey
      where cycle in (1996, 1998, 2000, 2002) and status <> 'P'),
{matches_sql(0.03, 0.06)}, {DEFS}, {CROSSWALK},
don as (select c.*, matched_name, x.ff49_name, x.ff49_abbr, x.ff12_name
        from c join matches on employer = employer_raw and matches.status = 'auto_accept'
        left join (select * from crosswalk where in_sec) x on x.sic = matches.sic),
{DYN},
p as (select don.*, dyn.dynamic_score from don
      join dyn on don.donor_id = dyn.donor_id and don.cycle = dyn.cycle)
select donor_id as bonica_cid, cycle, employer as contributor_employer,
  matched_name as contributor_employer_matched, occupation as contributor_occupation,
  case when regexp_matches(occupation, 'urgent|high') then 'manager'
    when regexp_matches(occupation, 'medium|not') then 'engineer'
    when occupation is not null then 'other' end as occupation_std,
  ff49_name, ff49_abbr, ff12_name,
  coalesce(ff49_abbr in ('Softw', 'Hardw', 'Chips'), false) as ff49_is_tech,
  city as contributor_city, zip as contributor_zipcode,
  {r6('static_score')} as contributor_cfscore, segment as contributor_gender,
  {r6('dynamic_score')} as cfscore_dyn_cycle,
  {_mean('static_score', ['city'])} as mean_cfscore_per_city,
  {_mean('static_score', ['zip'])} as mean_cfscore_per_zipcode,
  {_mean('dynamic_score', ['zip', 'cycle'])} as mean_dyn_cfscore_zipcode_cycle,
  {_mean('dynamic_score', ['city', 'cycle'])} as mean_dyn_cfscore_city_cycle
from p"""


def contributors_processed(spark, sf):
    """Parts' makers as contributors: match, industry, occupation and local means."""
    names = company_names(spark, sf)
    c = names.select(
        F.col("p_partkey").alias("bonica_cid"),
        F.when(F.col("p_type") == "PROMO", "C").otherwise("I").alias("contributor_type"),
        F.col("employer").alias("most_recent_contributor_employer"),
        F.nullif(F.lower("p_type"), F.lit("small")).alias("most_recent_contributor_occupation"),
        F.nullif("p_size", F.lit(9)).alias("most_recent_contributor_city"),
        F.concat_ws("-", "p_size", "p_type").alias("most_recent_contributor_zipcode"),
        (F.pmod("p_partkey", F.lit(601)) / 100 - 3).alias("contributor_cfscore"))
    out = process_contributors(c, build_register(register_rows(names)), crosswalk(spark, sf),
                               engineer=("medium", "large"), manager=("standard", "larg"))
    return out.select("bonica_cid", "status", "match_type", "cik", "ff12", "ff49_is_tech",
                      "engineer", "manager", "other", "occupation",
                      round_half_up(F.col("mean_cfscore_per_city"))
                      .alias("mean_cfscore_per_city"),
                      round_half_up(F.col("mean_cfscore_per_zipcode"))
                      .alias("mean_cfscore_per_zipcode"))


_CONTRIBUTORS_SQL = f"""with {COMPANIES}, {REGISTER}, {matches_sql(0.05, 0.10)}, {DEFS},
{CROSSWALK},
c as (select p_partkey as bonica_cid, p_type, employer, nullif(lower(p_type), 'small') as occ,
        nullif(p_size, 9) as city, concat_ws('-', p_size, p_type) as zip,
        p_partkey % 601 / 100 - 3 as score from companies),
k as (select c.*, status, match_type, cik, ff12, ff49_abbr from c
      join matches on employer = employer_raw and status = 'auto_accept'
      left join crosswalk x on x.sic = matches.sic where p_type <> 'PROMO')
select bonica_cid, status, match_type, cik, ff12,
  coalesce(ff49_abbr in ('Softw', 'Hardw', 'Chips'), false) as ff49_is_tech,
  regexp_matches(occ, 'medium|large') as engineer, regexp_matches(occ, 'standard|larg')
  as manager, not regexp_matches(occ, 'medium|large') and not
  regexp_matches(occ, 'standard|larg') and occ is not null as other,
  case when regexp_matches(occ, 'standard|larg') then 'manager'
    when regexp_matches(occ, 'medium|large') then 'engineer'
    when occ is not null then 'other' end as occupation,
  {_mean('score', ['city'])} as mean_cfscore_per_city,
  {_mean('score', ['zip'])} as mean_cfscore_per_zipcode
from k"""


def write_arriving(items, path):
    """Line items as files to arrive in four batches; returns the files of a batch.

    Files grow in number with the table, batches do not.
    """
    files = max(1, -(-items.count() // (BATCHES * ARRIVING_ROWS)))
    items.repartition(BATCHES * files, "l_suppkey", "l_orderkey").write.parquet(path)
    return files


def stream_scores(spark, sf):
    """Line items arriving in four batches, against static orders and suppliers; the latest
    score per donor after updates from every batch."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice",
                                             "l_returnflag")
    arriving = scratch_path(spark, "arriving")
    files = write_arriving(li, arriving)
    stream = (spark.readStream.schema(li.schema).option("maxFilesPerTrigger", files)
              .parquet(arriving))
    o, s = table(spark, sf, "orders"), table(spark, sf, "supplier")
    year = F.year("o_orderdate").cast("bigint")
    d = (stream.join(o, stream.l_orderkey == o.o_orderkey)
         .join(s, stream.l_suppkey == s.s_suppkey)
         .select(F.col("o_custkey").alias("donor_id"), (year + year % 2).alias("cycle"),
                 (F.col("l_extendedprice") / 10 - 500).alias("amount"),
                 F.col("l_returnflag").alias("transaction_type"),
                 (F.col("s_acctbal") / 5000 - 1).alias("candidate_score")))
    out = scratch_path(spark, "updates")
    write_updates(running_scores(d, TYPES), out, scratch_path(spark, "chk"),
                  buckets=8).awaitTermination()
    return latest_scores(spark, out).select(
        "donor_id", "cycle", round_half_up(F.col("weighted_sum")).alias("weighted_sum"), "weight",
        round_half_up(F.col("dynamic_score")).alias("dynamic_score"))


_STREAM_SQL = f"""with {DON}, {DYN}
select donor_id, cycle, {r6('weighted_sum')} as weighted_sum, weight,
  {r6('dynamic_score')} as dynamic_score from dyn"""


def stream_ingest(spark, sf):
    """The damaged files picked up as a stream, two to a batch; a second run finds only the files
    that have come since."""
    pattern = write_dirty_orders(spark, sf)
    root, ledger = scratch_path(spark, "stored"), scratch_path(spark, "ledger")
    checkpoint = scratch_path(spark, "chk")
    for files in (pattern.replace("file=*", "file=*6-*"), pattern):
        stream_contributions(spark, files, root, ledger, checkpoint, ORDERS_SCHEMA,
                             files_per_batch=2).awaitTermination()
    stored = StructType([*ORDERS_SCHEMA.fields, StructField("cycle", LongType())])
    return datasets.read_by_cycle(spark, root, stored)


QUERIES = {
    "ingest_repair": (ingest_repair, _INGEST_SQL),
    "ingest_late_files": (ingest_late_files, _INGEST_SQL),
    "ingest_ledger": (ingest_ledger, _LEDGER_SQL),
    "reconcile": (reconcile_query, _RECONCILE_SQL),
    "contributor_ingest": (contributor_ingest, _CONTRIBUTOR_SQL),
    "contributors_read": (contributors_read, _CONTRIBUTOR_SQL),
    "part_files": (part_files, _PARTS_SQL),
    "schema_check": (schema_check, _SCHEMA_SQL),
    "panel_written": (panel_written, _PANEL_SQL),
    "typed_casts": (typed_casts, _CASTS_SQL),
    "partition_roundtrip": (partition_roundtrip, _ROUNDTRIP_SQL),
    "register_json": (register_json, _JSON_SQL),
    "crosswalk_files": (crosswalk_files, _FILES_SQL),
    "expectations": (expectations, _EXPECT_SQL),
    "outliers": (outliers, _OUTLIER_SQL),
    "panel": (panel, _PANEL_SQL),
    "contributors_processed": (contributors_processed, _CONTRIBUTORS_SQL),
    "stream_scores": (stream_scores, _STREAM_SQL),
    "stream_ingest": (stream_ingest, _INGEST_SQL),
}
