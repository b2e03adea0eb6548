"""Registered queries on descriptive and inferential statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..operators import mixed, regression as reg
from ..operators.quantiles import box_stats
from ..operators.rows import (count_sorted, first_per_key, last_per_key, sample_entities,
                              sample_rows)
from ..operators.summaries import (cell_stats, common_sample, common_sample_summary, density,
                                   group_shares, null_counts, null_patterns, rows_with_missing,
                                   small_cells)
from .bindings import donors, table
from .mixed_oracle import (chi2_upper_sql, covariances, f_upper_sql, fit_ctes, performance_sql,
                           t_both_sides_sql)
from .oracle_parts import DONORS, r6

# Line items as the modelling table: price in thousands, two factors, two numeric columns.
_MODEL = """m as (
  select l_extendedprice / 1000 as y, l_returnflag as flag, l_linestatus as line,
         l_quantity as qty, l_discount as disc, l_suppkey as supp from lineitem)"""


def _model(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line"), F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"), F.col("l_suppkey").alias("supp"))


def _rounded(df, *cols, digits=6):
    return df.select(*[round_half_up(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _r(x, digits):
    s = f"{10 ** digits}.0"
    return f"floor(({x}) * {s} + 0.5000001) / {s}"


def cell_stats_query(spark, sf):
    ev = table(spark, sf, "events").withColumn("user_group", F.pmod("user_id", F.lit(50)))
    return _rounded(cell_stats(ev, "value", ["event_type", "user_group"]), "mean", "sd", digits=4)


_CELL_SQL = f"""select event_type, user_id % 50 as user_group, count(*) as n,
  {_r('avg(value)', 4)} as mean, {_r('stddev_samp(value)', 4)} as sd
from events group by all"""


def small_cells_query(spark, sf):
    return small_cells(table(spark, sf, "events"), ["event_type", "user_id"])


_SMALL_SQL = """select event_type, user_id, count(*) as n from events group by all
having count(*) < 20"""


def group_shares_query(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"))
    return _rounded(group_shares(c, ["nation"], "segment"), "share")


_SHARES_SQL = f"""select nation, segment, count(*) as n,
  {r6('cast(count(*) as double) / sum(count(*)) over (partition by nation)')} as share
from (select c_nationkey as nation, nullif(c_mktsegment, 'MACHINERY') as segment from customer)
group by nation, segment"""


def _with_nulls(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.when(F.col("o_totalprice") > 20000, F.col("o_totalprice")).alias("price"),
        F.nullif(F.pmod("o_custkey", F.lit(9)), F.lit(0)).alias("grp"))


_NULLS = """o as (
  select o_orderkey, nullif(o_orderstatus, 'P') as status,
    nullif(o_orderpriority, '5-LOW') as priority,
    case when o_totalprice > 20000 then o_totalprice end as price,
    nullif(o_custkey % 9, 0) as grp from orders)"""
_NULL_COLUMNS = ("status", "priority", "price", "grp")


def null_patterns_query(spark, sf):
    return null_patterns(_with_nulls(spark, sf), _NULL_COLUMNS)


_PATTERN_SQL = f"""with {_NULLS} select status is null as na_status, priority is null as na_priority,
  price is null as na_price, grp is null as na_grp, count(*) as n from o group by all"""


def null_counts_query(spark, sf):
    return null_counts(_with_nulls(spark, sf), _NULL_COLUMNS)


_NULL_COUNT_SQL = f"""with {_NULLS} """ + " union all ".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as n_null from o"
    for c in _NULL_COLUMNS)


def missing_rows(spark, sf):
    return rows_with_missing(_with_nulls(spark, sf)).select("o_orderkey", *_NULL_COLUMNS)


_MISSING_SQL = f"""with {_NULLS} select o_orderkey, status, priority, price, grp from o
where status is null or priority is null or price is null or grp is null"""


def common_sample_query(spark, sf):
    return _rounded(common_sample_summary(_with_nulls(spark, sf), _NULL_COLUMNS), "pct_omitted")


_COMMON_SQL = f"""with {_NULLS}, t as (select count(*) as a, count(*) filter (
  where status is not null and priority is not null and price is not null and grp is not null)
  as b from o)
select a as n_total, b as n_complete, a - b as n_omitted,
  {r6('100.0::double * (a - b) / a')} as pct_omitted from t"""


def common_rows(spark, sf):
    return common_sample(_with_nulls(spark, sf), _NULL_COLUMNS).groupBy("status", "grp").agg(
        F.count(F.lit(1)).alias("n"))


_COMMON_ROWS_SQL = f"""with {_NULLS} select status, grp, count(*) as n from o
where status is not null and priority is not null and price is not null and grp is not null
group by all"""


def box_stats_query(spark, sf):
    out = box_stats(table(spark, sf, "events"), "value", ["event_type"])
    return _rounded(out, "q1", "median", "q3")


_BOX_SQL = f"""with q as (
  select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
         quantile_cont(value, 0.75) as q3 from events group by event_type),
j as (select e.*, q1, median, q3,
        value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
      from events e join q using (event_type))
select event_type, count(*) as n, min(value) as min, {r6('any_value(q1)')} as q1,
  {r6('any_value(median)')} as median, {r6('any_value(q3)')} as q3, max(value) as max,
  min(value) filter (where inside) as whisker_low, max(value) filter (where inside)
  as whisker_high, count(*) filter (where not inside) as n_outliers
from j group by event_type"""


def box_by_supplier(spark, sf):
    """Many groups with ties."""
    out = box_stats(table(spark, sf, "lineitem"), "l_quantity", ["l_suppkey"])
    return _rounded(out, "q1", "median", "q3")


_BOX_SUPPLIER_SQL = (_BOX_SQL.replace("event_type", "l_suppkey").replace("value", "l_quantity")
                     .replace("any_l_quantity", "any_value").replace("events", "lineitem"))


def density_query(spark, sf):
    out = density(table(spark, sf, "events"), "value", "event_type")
    return out.select("event_type", "point", round_half_up(F.col("x"), 4).alias("x"),
                      round_half_up(F.col("density"), 8).alias("density"))


_DENSITY_SQL = f"""with s as (
  select event_type, count(*) as n, stddev_samp(value) as sd,
    (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34 as iqr
  from events group by event_type),
b as (select *, 0.9 * least(sd, iqr) * pow(n, -0.2) as bw,
        (select min(value) from events) as x0, (select max(value) from events) as x1 from s),
g as (select *, x0 - 4 * bw as lo, (x1 - x0 + 8 * bw) / 511 as step from b),
p as (select g.event_type, (value - lo) / step as pos from events join g using (event_type)),
w as (select event_type, bin, sum(wt) as wt from (
        select event_type, cast(floor(pos) as int) as bin, 1 - (pos - floor(pos)) as wt from p
        union all select event_type, cast(floor(pos) as int) + 1, pos - floor(pos) from p)
      group by all),
grid as (select unnest(generate_series(0, 511)) as i),
k as (select g.event_type, i, sum(wt * exp(-0.5 * pow((i - bin) * step / bw, 2)))
        / (any_value(n) * any_value(bw) * sqrt(2 * pi())) as d
      from g join w using (event_type) cross join grid group by all),
o as (select event_type, i as point, x0 + (x1 - x0) * i / 511 as x,
        (x0 + (x1 - x0) * i / 511 - lo) / step as spot from g cross join grid)
select o.event_type, cast(o.point as int) as point, {_r('x', 4)} as x,
  {_r('a.d + (b.d - a.d) * (spot - floor(spot))', 8)} as density
from o join k a on a.event_type = o.event_type and a.i = floor(spot)
join k b on b.event_type = o.event_type and b.i = floor(spot) + 1"""


def ols_numeric(spark, sf):
    out = reg.simple_regression(_model(spark, sf), "y", "qty", ["flag"])
    return _rounded(out, "intercept", "slope", "r2", digits=5)


_NUMERIC_SQL = f"""with {_MODEL} select flag, regr_count(y, qty)::bigint as n,
  {_r('regr_intercept(y, qty)', 5)} as intercept, {_r('regr_slope(y, qty)', 5)} as slope,
  {_r('regr_r2(y, qty)', 5)} as r2 from m group by flag"""

_COEF = ("estimate", "std_error", "t_value", "r2", "adj_r2")


def _coefs(df):
    cols = [c for c in df.columns if c not in ("p_value",)]
    return _rounded(df.select(*cols), *_COEF, digits=5)


def ols_factor(spark, sf):
    return _coefs(reg.ols(_model(spark, sf), "y", ["flag"]))


def ols_ordered(spark, sf):
    """The same factor with its levels in a given order; the first is the base."""
    return _coefs(reg.ols(_model(spark, sf), "y", ["flag"], levels={"flag": ("R", "N", "A")}))


_FACTOR_SQL = f"""with {_MODEL}, g as (
  select flag, count(*) as n, avg(y) as mu, sum(y) as s, sum(y * y) as ss from m group by flag),
t as (select sum(n) as n, count(*) as k, sum(ss) - sum(s * s / n) as rss,
             sum(ss) - sum(s) * sum(s) / sum(n) as tss from g),
base as (select * from g order by flag limit 1),
c as (
  select '(Intercept)' as term, b.mu as estimate, sqrt(rss / (t.n - k) / b.n) as std_error
  from base b, t
  union all
  select 'flag[' || g.flag || ']', g.mu - b.mu, sqrt(rss / (t.n - k) * (1.0 / g.n + 1.0 / b.n))
  from g, base b, t where g.flag <> b.flag)
select term, {_r('estimate', 5)} as estimate, {_r('std_error', 5)} as std_error,
  {_r('estimate / std_error', 5)} as t_value, n::bigint as n, (n - k)::bigint as df_residual,
  {_r('1 - rss / tss', 5)} as r2,
  {_r('1 - rss / tss * (n - 1) / (n - k)', 5)} as adj_r2 from c, t"""


_ORDERED_SQL = _FACTOR_SQL.replace("order by flag limit 1", "where flag = 'R'")


def ols_multi(spark, sf):
    """A factor and a numeric column."""
    return _coefs(reg.ols(_model(spark, sf), "y", ["flag", "qty"]))


# The slope comes from deviations within groups, the group effects from adjusted means.
_WITHIN = """g as (
  select flag, count(*) as n, avg(y) as my, avg(qty) as mx, var_pop(qty) * count(*) as sxx,
         covar_pop(y, qty) * count(*) as sxy, var_pop(y) * count(*) as syy
  from m group by flag),
t as (select sum(n) as n, count(*) + 1 as p, sum(sxy) / sum(sxx) as b, sum(sxx) as sxx,
             sum(syy) - sum(sxy) * sum(sxy) / sum(sxx) as rss,
             (select var_pop(y) * count(*) from m) as tss from g),
base as (select * from g order by flag limit 1)"""

_MULTI_SQL = f"""with {_MODEL}, {_WITHIN}, c as (
  select 'qty' as term, b as estimate, sqrt(rss / (n - p) / sxx) as std_error from t
  union all
  select '(Intercept)', a.my - b * a.mx,
         sqrt(rss / (t.n - p) * (1.0 / a.n + a.mx * a.mx / t.sxx)) from base a, t
  union all
  select 'flag[' || g.flag || ']', g.my - a.my - b * (g.mx - a.mx),
         sqrt(rss / (t.n - p) * (1.0 / g.n + 1.0 / a.n + pow(g.mx - a.mx, 2) / t.sxx))
  from g, base a, t where g.flag <> a.flag)
select term, {_r('estimate', 5)} as estimate, {_r('std_error', 5)} as std_error,
  {_r('estimate / std_error', 5)} as t_value, n::bigint as n, (n - p)::bigint as df_residual,
  {_r('1 - rss / tss', 5)} as r2,
  {_r('1 - rss / tss * (n - 1) / (n - p)', 5)} as adj_r2 from c, t"""


def ols_interaction(spark, sf):
    """Two factors with interaction: the cells' means."""
    out = reg.ols(_model(spark, sf), "y", ["flag*line"])
    return _rounded(out.select("term", "estimate", "std_error", "n", "df_residual", "r2"),
                    "estimate", "std_error", "r2", digits=5)


_INTERACTION_SQL = f"""with {_MODEL}, g as (
  select flag, line, count(*) as n, avg(y) as mu, sum(y) as s, sum(y * y) as ss
  from m group by all),
t as (select sum(n) as n, count(*) as k, sum(ss) - sum(s * s / n) as rss,
             sum(ss) - sum(s) * sum(s) / sum(n) as tss from g),
b as (select * from g where flag = 'A' and line = 'F'), c as (
  select '(Intercept)' as term, b.mu as estimate, 1.0 / b.n as v from b
  union all select 'flag[' || g.flag || ']', g.mu - b.mu, 1.0 / g.n + 1.0 / b.n from g, b
  where g.flag <> 'A' and g.line = 'F'
  union all select 'line[' || g.line || ']', g.mu - b.mu, 1.0 / g.n + 1.0 / b.n from g, b
  where g.flag = 'A' and g.line <> 'F'
  union all
  select 'flag[' || g.flag || ']:line[' || g.line || ']', g.mu - x.mu - z.mu + b.mu,
         1.0 / g.n + 1.0 / x.n + 1.0 / z.n + 1.0 / b.n
  from g join g x on x.flag = g.flag and x.line = 'F' join g z on z.flag = 'A' and
       z.line = g.line, b where g.flag <> 'A' and g.line <> 'F')
select term, {_r('estimate', 5)} as estimate, {_r('sqrt(v * rss / (n - k))', 5)} as std_error,
  n::bigint as n, (n - k)::bigint as df_residual, {_r('1 - rss / tss', 5)} as r2 from c, t"""


def ols_by_group(spark, sf):
    """One model per stratum from a single aggregation."""
    out = reg.ols(_model(spark, sf), "y", ["line"], by=["flag"])
    return _rounded(out.select("flag", "term", "estimate", "n", "r2"), "estimate", "r2", digits=5)


_BY_GROUP_SQL = f"""with {_MODEL}, g as (
  select flag, line, count(*) as n, avg(y) as mu, sum(y) as s, sum(y * y) as ss
  from m group by all),
t as (select flag, sum(n)::bigint as n, 1 - (sum(ss) - sum(s * s / n))
        / (sum(ss) - sum(s) * sum(s) / sum(n)) as r2 from g group by flag)
select flag, case when line = 'F' then '(Intercept)' else 'line[' || line || ']' end as term,
  {_r('''case when line = 'F' then mu else mu - (select x.mu from g x
        where x.flag = g.flag and x.line = 'F') end''', 5)} as estimate,
  t.n, {_r('r2', 5)} as r2 from g join t using (flag)"""


def model_predictions(spark, sf):
    """Adjusted predictions per level, the numeric column at its mean."""
    fit, = reg.fit_ols(_model(spark, sf), "y", ["flag", "qty"])
    return _rounded(reg.predictions(spark, fit, "flag"), "predicted", "std_error", digits=5)


_PREDICTION_SQL = f"""with {_MODEL}, {_WITHIN}, mean as (select avg(qty) as q from m)
select flag as level, {_r('my + b * (q - mx)', 5)} as predicted,
  {_r('sqrt(rss / (t.n - p) * (1.0 / g.n + pow(q - mx, 2) / t.sxx))', 5)} as std_error
from g, t, mean"""


def model_residuals(spark, sf):
    """Fitted values and residuals, summed up per group."""
    m = _model(spark, sf)
    fit, = reg.fit_ols(m, "y", ["flag", "qty"])
    out = reg.with_residuals(m, "y", fit).groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fitted").alias("mean_fitted"),
        F.sum(F.col("residual") * F.col("residual")).alias("rss"),
        F.max(F.abs("residual")).alias("largest"))
    return _rounded(out, "mean_fitted", "rss", "largest", digits=4)


_RESIDUAL_SQL = f"""with {_MODEL}, {_WITHIN}, f as (
  select m.flag, my + b * (qty - mx) as fitted, y - my - b * (qty - mx) as residual
  from m join g using (flag), t)
select flag, count(*) as n, {_r('avg(fitted)', 4)} as mean_fitted,
  {_r('sum(residual * residual)', 4)} as rss, {_r('max(abs(residual))', 4)} as largest
from f group by flag"""


def model_comparison(spark, sf):
    """Fit statistics of nested models on the same rows."""
    m = _model(spark, sf)
    fits = {"flag": reg.fit_ols(m, "y", ["flag"])[0],
            "flag_qty": reg.fit_ols(m, "y", ["flag", "qty"])[0]}
    out = reg.compare_models(spark, fits)
    return _rounded(out.select("model", "n", "n_parameters", "rss", "loglik", "aic", "bic",
                               "f_value"), "rss", "loglik", "aic", "bic", "f_value", digits=3)


_COMPARISON_SQL = f"""with {_MODEL}, {_WITHIN},
r as (select 'flag' as model, n, p - 1 as p, (select sum(syy) from g) as rss,
             null::double as f from t
      union all select 'flag_qty', n, p, rss,
             ((select sum(syy) from g) - rss) / (rss / (n - p)) from t),
l as (select *, -n / 2 * (ln(2 * pi()) + ln(rss / n) + 1) as ll from r)
select model, n::bigint as n, p::bigint as n_parameters, {_r('rss', 3)} as rss,
  {_r('ll', 3)} as loglik, {_r('-2 * ll + 2 * (p + 1)', 3)} as aic,
  {_r('-2 * ll + ln(n) * (p + 1)', 3)} as bic, {_r('f', 3)} as f_value from l"""


def coefficient_comparison(spark, sf):
    m = _model(spark, sf)
    fits = {"small": reg.fit_ols(m, "y", ["flag"])[0],
            "large": reg.fit_ols(m, "y", ["flag", "qty"])[0]}
    return _rounded(reg.side_by_side(spark, fits), "small", "large", digits=5)


_SIDE_SQL = f"""with {_MODEL}, {_WITHIN}
select '(Intercept)' as term, {_r('my', 5)} as small, {_r('my - b * mx', 5)} as large
from base, t
union all select 'flag[' || g.flag || ']', {_r('g.my - a.my', 5)},
  {_r('g.my - a.my - b * (g.mx - a.mx)', 5)} from g, base a, t where g.flag <> a.flag
union all select 'qty', null, {_r('b', 5)} from t"""


def levene_query(spark, sf):
    out = reg.levene(table(spark, sf, "events"), "value", "event_type")
    out = out.withColumn("p_value", F.lit(reg.levene_p_value(out)))
    return _rounded(out, "f_value", "p_value", digits=5)


_LEVENE_SQL = f"""with z as (
  select event_type, abs(value - median(value) over (partition by event_type)) as z from events),
g as (select event_type, count(*) as n, sum(z) as s, sum(z * z) as ss from z group by all),
t as (select count(*) as k, sum(n) as n, sum(s) as s, sum(ss) as ss, sum(s * s / n) as b from g),
f as (select *, (b - s * s / n) / (k - 1) / ((ss - b) / (n - k)) as f_value from t)
select {_r('f_value', 5)} as f_value, (k - 1)::bigint as df1, (n - k)::bigint as df2,
  n::bigint as n, {_r(f_upper_sql('f_value', '(k - 1)', '(n - k)'), 5)} as p_value from f"""


def icc_query(spark, sf):
    out = mixed.anova_icc(_model(spark, sf), "y", "supp")
    return _rounded(out, "ms_between", "ms_within", "icc", digits=5)


_ICC_SQL = f"""with {_MODEL}, g as (
  select supp, count(*)::double as n, sum(y) as s, sum(y * y) as ss from m group by supp),
t as (select count(*) as k, sum(n) as nn, (sum(s * s / n) - sum(s) * sum(s) / sum(n))
        / (count(*) - 1) as msb, (sum(ss) - sum(s * s / n)) / (sum(n) - count(*)) as msw,
        (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) as n0 from g)
select k as n_groups, nn::bigint as n, {_r('msb', 5)} as ms_between, {_r('msw', 5)} as ms_within,
  {_r('(msb - msw) / (msb + (n0 - 1) * msw)', 5)} as icc from t"""


def random_intercept(spark, sf):
    """Donor scores with a random intercept per nation."""
    c = donors(spark, sf).select("static_score", "segment", "donor_id",
                                 F.coalesce("city", F.lit(7)).alias("city"))
    fit = mixed.random_intercept(c, "static_score", ["segment"], "city")
    out = mixed.fixed_effects(spark, fit).withColumn("converged", F.lit(fit.converged))
    return _rounded(out, "estimate", "std_error", "t_value", digits=4)


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_INTERCEPT_SQL = f"""with recursive {DONORS}, src as (
  select static_score as y, segment, coalesce(city, 7) as g from donors
  where static_score is not null and segment is not null),
{fit_ctes('f', 'src', ['1', *[f"segment = '{s}'" for s in _SEGMENTS[1:]]], 1, True)}
select term, {_r('e', 4)} as estimate, {_r('se', 4)} as std_error, {_r('e / se', 4)} as t_value,
  true as converged
from (select unnest(['(Intercept)', {', '.join(f"'segment[{s}]'" for s in _SEGMENTS[1:])}]) as term,
        unnest(list_transform(range(5), lambda i: sw[i * 6 + 6])) as e,
        unnest(list_transform(range(5), lambda i: sqrt(sigma2 * sw[i * 7 + 1]))) as se from f)"""


def _by_depot(spark, sf):
    """Line items in 40 groups of suppliers, whose level and whose effect of the line status
    differ."""
    d = F.pmod("l_suppkey", F.lit(40))
    y = (F.col("l_discount") * 10 + F.pmod(d * 17, F.lit(13)) / 5
         + F.when(F.col("l_linestatus") == "O", F.pmod(d * 29, F.lit(11)) / 7).otherwise(0.0))
    return table(spark, sf, "lineitem").select(
        y.alias("y"), F.col("l_linestatus").alias("line"), F.col("l_quantity").alias("qty"),
        F.concat(F.lit("d"), d.cast("string")).alias("depot"))


_DEPOT = """m as (select l_discount * 10 + (l_suppkey % 40 * 17 % 13) / 5
    + case when l_linestatus = 'O' then (l_suppkey % 40 * 29 % 11) / 7 else 0 end as y,
  l_linestatus as line, l_quantity as qty, 'd' || l_suppkey % 40 as g from lineitem)"""
_O = "line = 'O'"


def icc_reml(spark, sf):
    """Variance between and within groups and their intraclass correlation, by REML."""
    fit = mixed.random_intercept(_by_depot(spark, sf), "y", [], "depot")
    out = mixed.performance(spark, {"null": fit}).withColumn(
        "var_group", F.lit(float(fit.random_cov[0, 0])))
    return _rounded(out.select("n", "n_groups", "var_group", "sigma2", "icc", "converged"),
                    "var_group", "sigma2", "icc", digits=4)


_ICC_REML_SQL = f"""with recursive {_DEPOT}, {fit_ctes('f', 'm', ['1'], 1, True)},
v as (select *, {covariances(1)[0]} as r from f)
select n, n_groups, {_r('r * sigma2', 4)} as var_group, {_r('sigma2', 4)} as sigma2,
  {_r('r / (1 + r)', 4)} as icc, true as converged from v"""


def random_slope(spark, sf):
    """Intercept and status effect varying by group of suppliers."""
    fit = mixed.random_slope(_by_depot(spark, sf), "y", ["line", "qty"], "depot", "line")
    out = mixed.variance_components(spark, fit).withColumn("converged", F.lit(fit.converged))
    return _rounded(out, "covariance", digits=3)


_SLOPE_SQL = f"""with recursive {_DEPOT}, {fit_ctes('f', 'm', ['1', _O, 'qty'], 2, True)}
select unnest(['(Intercept)', 'line[O]', 'line[O]', 'Residual']) as effect,
  unnest(['(Intercept)', '(Intercept)', 'line[O]', 'Residual']) as with_effect,
  unnest([{', '.join(_r(f'{c} * sigma2', 3) for c in covariances(2))}, {_r('sigma2', 3)}])
    as covariance, true as converged from f"""


def mixed_performance(spark, sf):
    """Maximum-likelihood fits of growing models with likelihood-ratio tests."""
    m = _by_depot(spark, sf)
    fits = {
        "null": mixed.random_intercept(m, "y", [], "depot", reml=False),
        "line": mixed.random_intercept(m, "y", ["line"], "depot", reml=False),
        "line_slope": mixed.random_slope(m, "y", ["line"], "depot", "line", reml=False),
        "line_qty_slope": mixed.random_slope(m, "y", ["line", "qty"], "depot", "line",
                                             reml=False)}
    out = mixed.performance(spark, fits).drop("singular")
    out = _rounded(out, "loglik", "aic", "bic", "chi_sq", digits=2)
    return _rounded(out, "icc", "r2_marginal", "r2_conditional", "sigma2", "p_value", digits=4)


def _performance_sql():
    models = (("null", ["1"], 1), ("line", ["1", _O], 1), ("line_slope", ["1", _O], 2),
              ("line_qty_slope", ["1", _O, "qty"], 2))
    fits = ",\n".join(fit_ctes(f"f{i}", "m", x, q, False) for i, (_, x, q) in enumerate(models))
    rows = " union all ".join(f"select {i} as no, '{name}' as model, * from "
                              f"({performance_sql(f'f{i}', len(x), q)})"
                              for i, (name, x, q) in enumerate(models))
    two = ", ".join(f"{_r(c, 2)} as {c}" for c in ("loglik", "aic", "bic", "chi_sq"))
    four = ", ".join(f"{_r(c, 4)} as {c}"
                     for c in ("icc", "r2_marginal", "r2_conditional", "sigma2"))
    return f"""with recursive {_DEPOT}, {fits},
rows as ({rows}),
tests as (select *, case when no > 0 then greatest(0, 2 * (loglik - lag(loglik)
    over (order by no))) end as chi_sq,
  n_parameters - lag(n_parameters) over (order by no) as df from rows)
select model, n, n_groups, n_parameters::bigint as n_parameters, {two}, {four},
  true as converged, {_r(chi2_upper_sql('chi_sq', 'df'), 4)} as p_value from tests"""


def mixed_interaction(spark, sf):
    """Status, group of suppliers and their interaction in the fixed part of a mixed model."""
    fit = mixed.fit_absorbed(_by_depot(spark, sf), "y", "line", "depot", ["qty"])
    out = fit.cells.withColumns({
        "qty_estimate": F.lit(float(fit.coef[0])), "qty_error": F.lit(float(fit.cov[0, 0] ** 0.5)),
        "sigma2": F.lit(fit.sigma2), "loglik": F.lit(fit.loglik)})
    out = _rounded(out, "effect", "qty_estimate", "qty_error", "sigma2", digits=6)
    return _rounded(out, "loglik", digits=3)


_MIXED_INTERACTION_SQL = f"""with {_DEPOT},
c as (select g, line, count(*) as n, avg(y) as ym, avg(qty) as xm, sum(qty * qty) as xx,
        sum(qty * y) as xy, sum(y * y) as yy from m group by g, line),
t as (select sum(n) as n, count(*) as k, sum(xx - n * xm * xm) as xx, sum(xy - n * xm * ym) as xy,
        sum(yy - n * ym * ym) as yy, sum(ln(n)) as ld from c),
f as (select *, xy / xx as b, (yy - xy * xy / xx) / (n - k - 1) as s2 from t)
select g as depot, line, c.n, {_r('ym - b * xm', 6)} as effect, {_r('b', 6)} as qty_estimate,
  {_r('sqrt(s2 / f.xx)', 6)} as qty_error, {_r('s2', 6)} as sigma2,
  {_r('-((f.n - k - 1) * (ln(2 * pi() * s2) + 1) + ld + ln(f.xx)) / 2', 3)} as loglik from c, f"""


def ols_p_values(spark, sf):
    """t and p values of the coefficients of a model that explains little."""
    out = reg.ols(_model(spark, sf), "disc", ["flag", "qty"])
    return _rounded(out.select("term", "t_value", "p_value"), "t_value", "p_value", digits=5)


_P_VALUE_SQL = f"""with {_MODEL}, f as (select 1.0::double as x0, (flag = 'N')::int::double as x1,
  (flag = 'R')::int::double as x2, qty::double as x3, disc::double as y from m),
e as (select [x0, x1, x2, x3, y] as v from f),
s as (select p, sum(v[p // 5 + 1] * v[p % 5 + 1]) as s from e, range(25) as t(p) group by p),
a as (select list_reduce([[0.0::double], [1.0::double], [2.0::double], [3.0::double]],
  lambda a, v: list_transform(range(25), lambda e: case
    when e // 5 = v[1]::bigint and e % 5 = v[1]::bigint then 1 / a[v[1]::bigint * 6 + 1]
    when e // 5 = v[1]::bigint then a[e + 1] / a[v[1]::bigint * 6 + 1]
    when e % 5 = v[1]::bigint then -a[e + 1] / a[v[1]::bigint * 6 + 1]
    else a[e + 1] - a[(e // 5) * 5 + v[1]::bigint + 1] * a[v[1]::bigint * 5 + e % 5 + 1]
      / a[v[1]::bigint * 6 + 1] end), list(s order by p)) as w, max(s) filter (where p = 0) as n
  from s),
b as (select unnest(['(Intercept)', 'flag[N]', 'flag[R]', 'qty']) as term, n - 4 as df,
        unnest(list_transform(range(4), lambda i: w[i * 5 + 5] / sqrt(w[i * 6 + 1] * w[25]
          / (n - 4)))) as t_value from a)
select term, {_r('t_value', 5)} as t_value, {_r(t_both_sides_sql('t_value', 'df'), 5)} as p_value
from b"""


def entity_sample(spark, sf):
    """All orders of 200 customers."""
    o = table(spark, sf, "orders")
    return sample_entities(o, "o_custkey", 200, 123).select("o_orderkey", "o_custkey")


_SCRAMBLE = """(cast(floor({once} / 65536) as bigint) * 40503 + {once} * 31) % 4294967296"""
_ONCE = "((({key} + 123) % 2147483648) * 2654435761 % 4294967296)"


def _scramble_sql(key: str) -> str:
    return _SCRAMBLE.format(once=_ONCE.format(key=key))


_ENTITY_SQL = f"""select o_orderkey, o_custkey from orders where o_custkey in (
  select o_custkey from (select distinct o_custkey from orders)
  order by {_scramble_sql('o_custkey')}, o_custkey limit 200)"""


def row_sample(spark, sf):
    return sample_rows(table(spark, sf, "events"), "event_id", 250, 123).select(
        "event_id", "user_id", "event_type")


_ROW_SAMPLE_SQL = f"""select event_id, user_id, event_type from events
order by {_scramble_sql('event_id')}, event_id limit 250"""


def most_frequent(spark, sf):
    return count_sorted(table(spark, sf, "orders"), ["o_custkey"], 50)


def first_order(spark, sf):
    """First order of each customer by date, then key."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey",
                                          "o_orderpriority")
    return first_per_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select(
        "o_custkey", "o_orderkey", "o_orderpriority")


_FIRST_SQL = """select o_custkey, o_orderkey, o_orderpriority from (
  select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn
  from orders) where rn = 1"""


def largest_line(spark, sf):
    """Line item with the highest price per supplier; the part key settles equal prices."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_partkey")
    return last_per_key(li, ["l_suppkey"], F.struct("l_extendedprice", "l_partkey"))


_LARGEST_SQL = """select l_suppkey, l_extendedprice, l_partkey from (
  select *, row_number() over (partition by l_suppkey
    order by l_extendedprice desc, l_partkey desc) as rn from lineitem) where rn = 1"""

QUERIES = {
    "cell_stats": (cell_stats_query, _CELL_SQL),
    "small_cells": (small_cells_query, _SMALL_SQL),
    "group_shares": (group_shares_query, _SHARES_SQL),
    "null_patterns": (null_patterns_query, _PATTERN_SQL),
    "null_counts": (null_counts_query, _NULL_COUNT_SQL),
    "missing_rows": (missing_rows, _MISSING_SQL),
    "common_sample": (common_sample_query, _COMMON_SQL),
    "common_sample_rows": (common_rows, _COMMON_ROWS_SQL),
    "box_stats": (box_stats_query, _BOX_SQL),
    "box_stats_by_supplier": (box_by_supplier, _BOX_SUPPLIER_SQL),
    "density_grid": (density_query, _DENSITY_SQL),
    "ols_numeric": (ols_numeric, _NUMERIC_SQL),
    "ols_factor": (ols_factor, _FACTOR_SQL),
    "ols_ordered": (ols_ordered, _ORDERED_SQL),
    "ols_multi": (ols_multi, _MULTI_SQL),
    "ols_interaction": (ols_interaction, _INTERACTION_SQL),
    "ols_by_group": (ols_by_group, _BY_GROUP_SQL),
    "model_predictions": (model_predictions, _PREDICTION_SQL),
    "model_residuals": (model_residuals, _RESIDUAL_SQL),
    "model_comparison": (model_comparison, _COMPARISON_SQL),
    "coefficient_comparison": (coefficient_comparison, _SIDE_SQL),
    "levene": (levene_query, _LEVENE_SQL),
    "icc": (icc_query, _ICC_SQL),
    "icc_reml": (icc_reml, _ICC_REML_SQL),
    "random_intercept": (random_intercept, _INTERCEPT_SQL),
    "random_slope": (random_slope, _SLOPE_SQL),
    "mixed_performance": (mixed_performance, _performance_sql()),
    "mixed_interaction": (mixed_interaction, _MIXED_INTERACTION_SQL),
    "ols_p_values": (ols_p_values, _P_VALUE_SQL),
    "entity_sample": (entity_sample, _ENTITY_SQL),
    "row_sample": (row_sample, _ROW_SAMPLE_SQL),
    "most_frequent": (most_frequent, """select o_custkey, count(*) as n from orders
group by o_custkey order by n desc, o_custkey limit 50"""),
    "first_per_key": (first_order, _FIRST_SQL),
    "last_per_key": (largest_line, _LARGEST_SQL),
}
