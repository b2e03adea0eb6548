"""Registered queries on scores, means and interpolation: name -> (query, oracle SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import normalize_amount, round_half_up
from ..operators.scoring import (carry_forward, cycle_totals, densify, dynamic_score,
                                 dynamic_score_framed, group_means, interpolate, local_means,
                                 multiplicity)
from ..session import written
from .bindings import TYPES, donations, donors, table
from .oracle_parts import BUCKET, DON, DONORS, DYN, r6

_SCORE_SQL = f"""with {DON}, {DYN}
select donor_id, cycle, {r6('weighted_sum')} as weighted_sum, weight,
  {r6('dynamic_score')} as dynamic_score from dyn"""


def _scored(df):
    return df.select("donor_id", "cycle", round_half_up(F.col("weighted_sum"))
                     .alias("weighted_sum"), "weight",
                     round_half_up(F.col("dynamic_score")).alias("dynamic_score"))


def dynamic_score_query(spark, sf):
    return _scored(dynamic_score(donations(spark, sf), TYPES))


def dynamic_score_framed_query(spark, sf):
    return _scored(dynamic_score_framed(donations(spark, sf), TYPES))


def amount_buckets(spark, sf):
    d = donations(spark, sf).select(normalize_amount(F.col("amount")).alias("bucket"))
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


_BUCKET_SQL = f"""with {DON} select bucket, count(*) as n
from (select {BUCKET} as bucket from don) group by bucket"""


def carried_donations(spark, sf):
    d = carry_forward(donations(spark, sf).select("cycle", "amount", "transaction_type"))
    return d.groupBy("cycle", "transaction_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount") > 0).alias("n_positive"))


_CARRIED_SQL = f"""with {DON}, both_rows as (
  select cycle, amount, transaction_type from don
  union all select cycle + 2, amount, transaction_type from don)
select cycle, transaction_type, count(*) as n, count(*) filter (where amount > 0) as n_positive
from both_rows group by all"""


def multiplicity_query(spark, sf):
    """Order and line number together are not unique in the source, so some keys are reported."""
    li = table(spark, sf, "lineitem")
    keyed = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
                      F.year("l_shipdate").alias("cycle"))
    return multiplicity(carry_forward(keyed), "transaction_id", 2)


_MULTIPLICITY_SQL = """with t as (
  select l_orderkey * 10 + l_linenumber as transaction_id from lineitem)
select transaction_id, count(*) as n from (select * from t union all select * from t)
group by transaction_id having count(*) <> 2"""


def multiplicity_orders(spark, sf):
    """Order keys are unique: no key is reported."""
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("cycle"))
    return multiplicity(carry_forward(o), "o_orderkey", 2)


_MULTIPLICITY_ORDERS_SQL = """select o_orderkey, count(*) as n
from (select o_orderkey from orders union all select o_orderkey from orders)
group by o_orderkey having count(*) <> 2"""


def own_cycle_totals(spark, sf):
    return cycle_totals(donations(spark, sf), TYPES).withColumn(
        "weighted_sum", round_half_up(F.col("weighted_sum")))


_TOTALS_SQL = f"""with {DON}, w as (
  select donor_id, cycle, candidate_score as s,
         case when transaction_type in ('A', 'N') then {BUCKET} else 0 end as w from don)
select donor_id, cycle, {r6('coalesce(sum(s * w), 0)')} as weighted_sum,
       cast(sum(w) as bigint) as weight from w group by all"""

_MEANS = {"mean_static_city": ("static_score", ["city"]),
          "mean_static_zip": ("static_score", ["zip"]),
          "mean_dynamic_city_cycle": ("dynamic_score", ["city", "cycle"]),
          "mean_dynamic_zip_cycle": ("dynamic_score", ["zip", "cycle"])}


def local_means_query(spark, sf):
    """The four local means at donor-cycle grain, joined on place and cycle."""
    s = dynamic_score(donations(spark, sf), TYPES).select("donor_id", "cycle", "dynamic_score")
    rows = written(s.join(donors(spark, sf), "donor_id"), "scored")
    out = local_means(rows, _MEANS)
    return out.select("donor_id", "cycle", "city", "zip",
                      *[round_half_up(F.col(c)).alias(c) for c in _MEANS])


def _mean_over(value: str, keys: str, guard: str) -> str:
    return r6(f"case when {guard} is not null then avg({value}) over (partition by {keys}) end")


_LOCAL_SQL = f"""with {DON}, {DYN}, {DONORS},
j as (select d.donor_id, d.cycle, d.dynamic_score, o.city, o.zip, o.static_score
      from dyn d join donors o on d.donor_id = o.donor_id)
select donor_id, cycle, city, zip,
  {_mean_over('static_score', 'city', 'city')} as mean_static_city,
  {_mean_over('static_score', 'zip', 'zip')} as mean_static_zip,
  {_mean_over('dynamic_score', 'city, cycle', 'city')} as mean_dynamic_city_cycle,
  {_mean_over('dynamic_score', 'zip, cycle', 'zip')} as mean_dynamic_zip_cycle
from j"""


def local_means_by_cycle(spark, sf):
    """Mean dynamic score per place and cycle as a table of its own."""
    s = dynamic_score(donations(spark, sf), TYPES).select("donor_id", "cycle", "dynamic_score")
    rows = s.join(donors(spark, sf), "donor_id")
    out = group_means(rows, "dynamic_score", ["city", "cycle"], "mean_dynamic")
    return out.select("city", "cycle", round_half_up(F.col("mean_dynamic")).alias("mean_dynamic"))


_BY_CYCLE_SQL = f"""with {DON}, {DYN}, {DONORS}
select city, cycle, {r6('avg(dynamic_score)')} as mean_dynamic
from dyn join donors using (donor_id) group by all"""


def interpolate_scores(spark, sf):
    """Every donor with a score in every cycle, gaps filled."""
    s = dynamic_score(donations(spark, sf), TYPES).select("donor_id", "cycle", "dynamic_score")
    s = written(s, "scores")
    cycles = sorted(r["cycle"] for r in s.select("cycle").distinct().collect())
    dense = densify(s, "donor_id", cycles)
    out = interpolate(dense, "donor_id", "dynamic_score")
    return out.select("donor_id", "cycle",
                      round_half_up(F.col("interpolated")).alias("interpolated"))


_INTERPOLATE_SQL = f"""with {DON}, {DYN},
grid as (select donor_id, cycle from (select distinct donor_id from dyn)
         cross join (select distinct cycle from dyn) v),
f as (select g.donor_id, cast(g.cycle as bigint) as cycle, d.dynamic_score as v,
        case when d.dynamic_score is not null then g.cycle end as c
      from grid g left join dyn d on g.donor_id = d.donor_id and g.cycle = d.cycle),
e as (select donor_id, cycle,
        last_value(v ignore nulls) over p as v0, last_value(c ignore nulls) over p as c0,
        first_value(v ignore nulls) over n as v1, first_value(c ignore nulls) over n as c1
      from f window
        p as (partition by donor_id order by cycle rows unbounded preceding),
        n as (partition by donor_id order by cycle rows between current row
              and unbounded following))
select donor_id, cycle, {r6('''case when c0 is null then v1 when c1 is null then v0
  when c0 = c1 then v0
  else v0 + (v1 - v0) * cast(cycle - c0 as double) / cast(c1 - c0 as double) end''')}
  as interpolated from e where coalesce(v0, v1) is not null"""


def static_vs_dynamic(spark, sf):
    """Mean static and dynamic score per cycle, their correlation and spread."""
    s = dynamic_score(donations(spark, sf), TYPES).select("donor_id", "cycle", "dynamic_score")
    j = s.join(donors(spark, sf), "donor_id")
    return j.groupBy("cycle").agg(
        F.count(F.lit(1)).alias("n"),
        round_half_up(F.avg("static_score")).alias("mean_static"),
        round_half_up(F.avg("dynamic_score")).alias("mean_dynamic"),
        round_half_up(F.corr("static_score", "dynamic_score")).alias("correlation"),
        round_half_up(F.stddev_samp("dynamic_score")).alias("sd_dynamic"))


_STATIC_SQL = f"""with {DON}, {DYN}, {DONORS}
select cycle, count(*) as n, {r6('avg(static_score)')} as mean_static,
       {r6('avg(dynamic_score)')} as mean_dynamic,
       {r6('corr(static_score, dynamic_score)')} as correlation,
       {r6('stddev_samp(dynamic_score)')} as sd_dynamic
from dyn join donors using (donor_id) group by cycle"""


def partition_filter(spark, sf):
    """Key list on the cycle, individuals only, columns pruned to what is counted."""
    d = donations(spark, sf)
    kept = d.where(F.col("cycle").isin(1998, 2002) & (F.col("status") != "P"))
    return kept.groupBy("cycle", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("donor_id").alias("n_donors"))


_FILTER_SQL = f"""with {DON} select cycle, status, count(*) as n,
  count(distinct donor_id) as n_donors
from don where cycle in (1998, 2002) and status <> 'P' group by all"""

QUERIES = {
    "dynamic_score": (dynamic_score_query, _SCORE_SQL),
    "dynamic_score_range_window": (dynamic_score_framed_query, _SCORE_SQL),
    "own_cycle_totals": (own_cycle_totals, _TOTALS_SQL),
    "normalize_amount_hist": (amount_buckets, _BUCKET_SQL),
    "carry_forward": (carried_donations, _CARRIED_SQL),
    "multiplicity": (multiplicity_query, _MULTIPLICITY_SQL),
    "multiplicity_orders": (multiplicity_orders, _MULTIPLICITY_ORDERS_SQL),
    "local_means": (local_means_query, _LOCAL_SQL),
    "local_means_by_cycle": (local_means_by_cycle, _BY_CYCLE_SQL),
    "interpolate_scores": (interpolate_scores, _INTERPOLATE_SQL),
    "static_vs_dynamic": (static_vs_dynamic, _STATIC_SQL),
    "partition_filter": (partition_filter, _FILTER_SQL),
}
