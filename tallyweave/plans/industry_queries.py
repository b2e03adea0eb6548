"""Registered queries on industry definitions and the crosswalk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_up, zero_pad
from ..operators.crosswalk import (SCHEMES, attach_industry, is_tech_12, is_tech_49,
                                   parse_definitions, read_definition_lines, residual_counts)
from ..operators.quality import crosswalk_checks, report
from ..session import scratch_path
from .bindings import company_names, crosswalk, industry_lines
from .oracle_parts import COMPANIES, CROSSWALK, DEFS, r6

_CTE = f"with {COMPANIES}, {DEFS}, {CROSSWALK}"


def industry_parse(spark, sf):
    return parse_definitions(industry_lines(spark, sf)).select(
        "scheme", "ff_num", "ff_abbr", "ff_name", "sic_from", "sic_to", "range_desc")


def industry_files(spark, sf):
    """The definitions written as one text file per scheme, read back and parsed."""
    lines, paths = industry_lines(spark, sf), {}
    for scheme in SCHEMES:
        paths[scheme] = scratch_path(spark, f"definitions{scheme}")
        (lines.where(F.col("scheme") == scheme).repartition(1).sortWithinPartitions("line_no")
         .select("line").write.text(paths[scheme]))
    return parse_definitions(read_definition_lines(spark, paths)).select(
        "scheme", "ff_num", "ff_abbr", "ff_name", "sic_from", "sic_to", "range_desc")


def industry_crosswalk(spark, sf):
    return crosswalk(spark, sf)


def _coded(spark, sf):
    names = company_names(spark, sf).withColumn("sic", zero_pad(F.col("code") + 89))
    return attach_industry(names, crosswalk(spark, sf))


def industry_attach(spark, sf):
    """Codes shifted so that some are not listed: those get no industry."""
    j = _coded(spark, sf)
    return j.select("p_partkey", "sic", "in_sec", "ff12", "ff48_abbr", "ff49_abbr", "sic_detail",
                    is_tech_49(F.col("ff49_abbr")).alias("ff49_is_tech"),
                    is_tech_12(F.col("ff12")).alias("ff12_is_tech"))


_ATTACHED = f"""{_CTE}, coded as (
  select p_partkey, p_type, lpad(cast(code + 89 as varchar), 4, '0') as sic from companies),
j as (select c.p_partkey, c.p_type, c.sic, x.* exclude (sic) from coded c
      left join (select * from crosswalk where in_sec) x using (sic))"""

_ATTACH_SQL = f"""{_ATTACHED}
select p_partkey, sic, in_sec, ff12, ff48_abbr, ff49_abbr, sic_detail,
       coalesce(ff49_abbr in ('Softw', 'Hardw', 'Chips'), false) as ff49_is_tech,
       ff12 = 6 as ff12_is_tech from j"""


def tech_share(spark, sf):
    j = _coded(spark, sf)
    tech = is_tech_49(F.col("ff49_abbr"))
    return j.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(tech).alias("n_tech"),
        round_half_up(F.avg(tech.cast("double"))).alias("share_tech"),
        round_half_up(F.avg(is_tech_12(F.col("ff12")).cast("double"))).alias("share_tech_12"))


_TECH_SQL = f"""{_ATTACHED}
select p_type, count(*) as n,
  count(*) filter (where ff49_abbr in ('Softw', 'Hardw', 'Chips')) as n_tech,
  {r6('''avg(case when coalesce(ff49_abbr in ('Softw', 'Hardw', 'Chips'), false)
        then 1.0::double else 0.0 end)''')} as share_tech,
  {r6('avg(cast(cast(ff12 = 6 as int) as double))')} as share_tech_12
from j group by p_type"""


def residual_query(spark, sf):
    return residual_counts(crosswalk(spark, sf))


_RESIDUAL_SQL = f"""{_CTE}
select count(*) filter (where not ff12_explicit) as ff12_explicit,
       count(*) filter (where not ff48_explicit) as ff48_explicit,
       count(*) filter (where not ff49_explicit) as ff49_explicit from crosswalk where in_sec"""


def crosswalk_invariants(spark, sf):
    return report([crosswalk_checks(crosswalk(spark, sf), 9900)], "fail")


_INVARIANT_SQL = f"""{_CTE}, m as (
  select abs(count(*) - 9900) as a,
         count(*) filter (where ff12 is null or ff48 is null or ff49 is null) as b,
         abs(count(distinct ff12) - 12) as c, greatest(count(distinct ff49) - 49, 0) as d
  from crosswalk),
v as (select 'row_count' as name, a as violations from m union all select 'null_class', b from m
      union all select 'industries_12', c from m union all select 'industries_49', d from m)
select name, 'fail' as severity, cast(violations as bigint) as violations,
       violations = 0 as passed from v"""

QUERIES = {
    "industry_parse_text": (industry_parse, f"with {DEFS} select * from defs"),
    "industry_files": (industry_files, f"with {DEFS} select * from defs"),
    "industry_crosswalk": (industry_crosswalk, f"{_CTE} select * from crosswalk"),
    "industry_attach": (industry_attach, _ATTACH_SQL),
    "tech_share": (tech_share, _TECH_SQL),
    "residual_counts": (residual_query, _RESIDUAL_SQL),
    "crosswalk_invariants": (crosswalk_invariants, _INVARIANT_SQL),
}
