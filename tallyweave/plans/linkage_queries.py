"""Registered queries on names: normalisation, matching, coverage, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.text import non_empty, normalize_name, occupation_class
from ..operators.linkage import (build_register, coverage_by_name, coverage_share, match_names,
                                 keep_accepted, review_queue, similar_pairs,
                                 threshold_sweep)
from ..session import written
from .bindings import (ENGINEER, MANAGER, company_names, register_rows, table)
from .oracle_parts import COMPANIES, NAMES_TO_PARTS, REGISTER, matches_sql, norm_sql, r6

_BASE = f"with {COMPANIES}, {REGISTER}"
_MATCH = f"{_BASE}, {matches_sql(0.03, 0.06)}"


def normalize_names(spark, sf):
    """Every document's whole text as if it were a name."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", normalize_name(F.col("text")).alias("norm"))


def register_query(spark, sf):
    return build_register(register_rows(company_names(spark, sf))).select(
        "norm", "real_name", "cik", "sic", "sic_description")


def _matches(spark, sf, strict=0.03, loose=0.06):
    names = company_names(spark, sf)
    return names, match_names(names, build_register(register_rows(names)), "employer", strict,
                              loose)


def fuzzy_match(spark, sf):
    _, m = _matches(spark, sf)
    return m.withColumn("distance", round_half_up(F.col("distance")))


def fuzzy_match_wide(spark, sf):
    """The wider default thresholds."""
    _, m = _matches(spark, sf, 0.05, 0.10)
    return m.withColumn("distance", round_half_up(F.col("distance")))


def _match_select(cte: str) -> str:
    return (f"{cte} select employer_raw, {r6('distance')} as distance, match_type, status, cik, "
            "matched_name, sic, sic_description from matches")


def similar_names(spark, sf):
    """All pairs of register names within 0.04 of each other."""
    reg = register_query(spark, sf).select("norm").distinct()
    q = reg.withColumnRenamed("norm", "query_norm")
    pairs = similar_pairs(q, reg, 0.04).where(F.col("query_norm") < F.col("norm"))
    return pairs.select("query_norm", "norm", round_half_up(F.col("distance")).alias("distance"))


_SIMILAR_SQL = f"""{_BASE}
select a.norm as query_norm, b.norm, {r6('1 - jaro_similarity(b.norm, a.norm)')} as distance
from register a join register b on a.norm < b.norm
where 1 - jaro_similarity(b.norm, a.norm) <= 0.04"""


def match_coverage_query(spark, sf):
    names, m = _matches(spark, sf)
    return coverage_by_name(names, m, "employer")


_COVERAGE_SQL = f"""{_MATCH}
select status, match_type, count(*) as n
from companies left join matches on employer = employer_raw group by all"""


def accepted_parts(spark, sf):
    """Inner join to accepted matches; each row at most once."""
    names, m = _matches(spark, sf)
    kept = keep_accepted(names, written(m, "matches"), "employer")
    return kept.select("p_partkey", "employer", "matched_name", "cik", "sic")


_ACCEPTED_SQL = f"""{_MATCH}
select p_partkey, employer, matched_name, cik, sic from {NAMES_TO_PARTS}
where status = 'auto_accept' and employer <> ''"""


def review_queue_query(spark, sf):
    """Weighted by the line items that carry the employer."""
    names, m = _matches(spark, sf)
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(
        names.select("p_partkey", "employer"), "p_partkey")
    return review_queue(rows, m, "employer").withColumn(
        "distance", round_half_up(F.col("distance")))


_REVIEW_SQL = f"""{_MATCH}
select employer_raw, matched_name, match_type, {r6('any_value(distance)')} as distance,
       count(*) as n_rows
from {NAMES_TO_PARTS} join lineitem on l_partkey = p_partkey
where status = 'needs_review' group by employer_raw, matched_name, match_type
order by n_rows desc, employer_raw limit 50"""


def coverage_share_query(spark, sf):
    names, m = _matches(spark, sf)
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(
        names.select("p_partkey", "employer"), "p_partkey")
    out = coverage_share(rows, m, "employer", 0.2)
    return out.withColumn("match_propensity", round_half_up(F.col("match_propensity")))


_SHARE_SQL = f"""{_MATCH}
select count(*) as n_rows, count(*) filter (where status = 'auto_accept') as n_matched,
       {r6("cast(count(*) filter (where status = 'auto_accept') as double) / count(*)")}
         as match_propensity, cast(0.2 as double) as real_share_approx
from lineitem join companies on l_partkey = p_partkey
left join matches on employer = employer_raw"""

_THRESHOLDS = (0.01, 0.02, 0.03, 0.04, 0.05)


def threshold_sweep_query(spark, sf):
    """Label: the text was made from the matched name (for unmatched ones: it was not reversed)."""
    names, m = _matches(spark, sf, 0.05, 0.05)
    truth = names.where(F.col("employer").isNotNull()).groupBy("employer").agg(
        F.min("real_name").alias("truth"), F.max(F.pmod("p_partkey", F.lit(8))).alias("v"))
    labels = m.join(truth, F.col("employer_raw") == F.col("employer")).select(
        "employer_raw", F.when(F.col("matched_name").isNotNull(),
                               F.col("matched_name") == F.col("truth"))
        .otherwise(F.col("v") != 6).alias("is_true"))
    out = threshold_sweep(m, _THRESHOLDS, labels)
    return out.select("strict_dist", "n", "n_accepted", *[
        round_half_up(F.col(c)).alias(c)
        for c in ("match_share", "false_positive_share", "false_negative_share")])


_SWEEP_SQL = f"""{_BASE}, {matches_sql(0.05, 0.05)},
truth as (select employer, min(real_name) as truth, max(p_partkey % 8) as v from companies
          where employer is not null group by employer),
labelled as (
  select m.*, case when matched_name is not null then matched_name = truth else v <> 6 end as ok
  from matches m join truth on employer_raw = employer),
t as (select unnest([0.01, 0.02, 0.03, 0.04, 0.05]::double[]) as strict_dist)
select strict_dist, count(*) as n, count(*) filter (where distance <= strict_dist) as n_accepted,
  {r6('cast(count(*) filter (where distance <= strict_dist) as double) / count(*)')}
    as match_share,
  {r6('''cast(count(*) filter (where distance <= strict_dist and match_type = 'fuzzy'
        and not ok) as double) / nullif(count(*) filter (
        where distance <= strict_dist and match_type = 'fuzzy'), 0)''')}
    as false_positive_share,
  {r6('''cast(count(*) filter (where coalesce(distance > strict_dist, true) and ok) as double)
        / nullif(count(*) filter (where coalesce(distance > strict_dist, true)), 0)''')}
    as false_negative_share
from labelled cross join t group by strict_dist"""


def threshold_review(spark, sf):
    """Names that the strict threshold rejects, with the nearest register name at any distance."""
    _, m = _matches(spark, sf, 0.05, 1.0)
    return m.where(F.col("status") != "auto_accept").select(
        "employer_raw", "matched_name", "match_type", "cik",
        round_half_up(F.col("distance")).alias("distance"))


_REVIEW_ALL_SQL = f"""{_BASE}, {matches_sql(0.05, 1.0)}
select employer_raw, matched_name, match_type, cik, {r6('distance')} as distance from matches
where status <> 'auto_accept'"""


def _long_name(c: str) -> str:
    return f"""concat_ws(' ', p_name, p_type, p_brand, reverse(p_name), 'of size',
      cast(p_size as {c}), 'and', reverse(p_brand))"""


def long_names(spark, sf):
    """Names of 40 letters and more that are alike within 0.05."""
    p = table(spark, sf, "part").select(normalize_name(F.expr(_long_name("string"))).alias("norm"))
    p = p.where(F.length("norm") >= 40).distinct()
    pairs = similar_pairs(p.withColumnRenamed("norm", "query_norm"), p, 0.05, ordered=True)
    return pairs.select(
        "query_norm", "norm", round_half_up(F.col("distance")).alias("distance"))


_LONG_SQL = f"""with n as (select distinct norm from (
  select {norm_sql(_long_name('varchar'))} as norm from part) where length(norm) >= 40)
select a.norm as query_norm, b.norm, {r6('1 - jaro_similarity(b.norm, a.norm)')} as distance
from n a join n b on a.norm < b.norm where 1 - jaro_similarity(b.norm, a.norm) <= 0.05"""


def occupation_class_query(spark, sf):
    """Order priorities as occupations; one priority counts as unknown."""
    o = table(spark, sf, "orders").select(
        F.nullif(F.lower("o_orderpriority"), F.lit("5-low")).alias("occupation"))
    o = o.withColumn("occupation_std", occupation_class(F.col("occupation"), ENGINEER, MANAGER))
    return o.groupBy("occupation", "occupation_std").agg(F.count(F.lit(1)).alias("n"))


_OCCUPATION_SQL = """with o as (
  select nullif(lower(o_orderpriority), '5-low') as occupation from orders)
select occupation, case when regexp_matches(occupation, 'urgent|high') then 'manager'
  when regexp_matches(occupation, 'medium|not') then 'engineer'
  when occupation is not null then 'other' end as occupation_std, count(*) as n
from o group by all"""


def document_classes(spark, sf):
    """Substring classes over whole documents, case-sensitive."""
    d = table(spark, sf, "documents")
    c = occupation_class(F.col("text"), ("therent", "ingthe"), ("eux", "Th"))
    return d.select("doc_id", c.alias("class"))


_DOCUMENT_SQL = """select doc_id, case when regexp_matches(text, 'eux|Th') then 'manager'
  when regexp_matches(text, 'therent|ingthe') then 'engineer'
  when text is not null then 'other' end as "class" from documents"""


def tech_spot_check(spark, sf):
    """Are companies that are known to be technology firms coded as such?"""
    known = spark.createDataFrame([(f"{a} {b}",) for a in ("hot", "cold", "new")
                                   for b in ("gear", "widget", "gizmo")], "p_name string")
    names = company_names(spark, sf)
    flagged = names.withColumn("is_tech", F.regexp_extract("p_brand", r"(\d+)", 1)
                               .isin("17", "3", "8"))
    return (flagged.where(non_empty(F.col("p_name"))).join(known, "p_name", "left_semi")
            .groupBy("p_name").agg(F.count(F.lit(1)).alias("n"),
                                   F.count_if("is_tech").alias("n_tech")))


_SPOT_SQL = """select p_name, count(*) as n,
  count(*) filter (where regexp_extract(p_brand, '([0-9]+)', 1) in ('17', '3', '8')) as n_tech
from part where p_name in (select a || ' ' || b from (values ('hot'), ('cold'), ('new')) x(a),
                           (values ('gear'), ('widget'), ('gizmo')) y(b))
group by p_name"""

QUERIES = {
    "normalize_names": (normalize_names,
                        f"select doc_id, {norm_sql('text')} as norm from documents"),
    "register_build": (register_query, f"{_BASE} select norm, real_name, cik, sic, "
                                       "sic_description from register"),
    "similar_names": (similar_names, _SIMILAR_SQL),
    "fuzzy_match": (fuzzy_match, _match_select(_MATCH)),
    "fuzzy_match_wide": (fuzzy_match_wide,
                         _match_select(f"{_BASE}, {matches_sql(0.05, 0.10)}")),
    "match_coverage": (match_coverage_query, _COVERAGE_SQL),
    "accepted_matches": (accepted_parts, _ACCEPTED_SQL),
    "review_queue": (review_queue_query, _REVIEW_SQL),
    "coverage_share": (coverage_share_query, _SHARE_SQL),
    "threshold_sweep": (threshold_sweep_query, _SWEEP_SQL),
    "long_names": (long_names, _LONG_SQL),
    "threshold_review": (threshold_review, _REVIEW_ALL_SQL),
    "occupation_class": (occupation_class_query, _OCCUPATION_SQL),
    "document_classes": (document_classes, _DOCUMENT_SQL),
    "tech_spot_check": (tech_spot_check, _SPOT_SQL),
}
