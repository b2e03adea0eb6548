"""Mixed models as plain SQL: sums per group, a sweep of the cross products, a pattern search.

The SQL shares no step with the operator: it looks for the least deviance without derivatives, by
trying all neighbours of the best point so far at ever smaller distances.
"""

from __future__ import annotations

from collections.abc import Sequence


def fit_ctes(name: str, source: str, x: Sequence[str], random: int, reml: bool) -> str:
    """CTEs that end in ``{name}`` with one row: n, n_groups, theta, sw (swept cross products),
    rss, m, dev, for ``y ~ x`` with the first ``random`` columns (1 or 2) varying by ``g``.

    ``source`` has columns g, y and those of the expressions ``x``, whose first is the constant.
    The list ``sw`` holds the inverse of X'V^-1X with the coefficients in its last column, row by
    row, and the log determinant behind it.
    """
    k, p, q = len(x) + 1, len(x), random
    m = q * (q + 1) // 2
    vector = ", ".join(f"cast({c} as double)" for c in (*x, "y"))
    offsets = ", ".join(f"(values (-1), (0), (1)) as o{i}(d{i})" for i in range(m))
    offset = ", ".join(f"d{i}" for i in range(m))
    center = " and ".join(f"d{i} = 0" for i in range(m))

    def w(line: int, at: str) -> str:
        return f"w[{line * k} + {at} + 1]"

    if q == 1:
        det = f"(1 + x[1] * x[1] * {w(0, '0')})"
        loss = f"x[1] * x[1] * {w(0, 'r')} * {w(0, 'c')} / {det}"
    else:
        l11, l12, l22 = "x[1] * x[1]", "x[1] * x[2]", "(x[2] * x[2] + x[3] * x[3])"
        g11, g12, g22 = w(0, "0"), w(0, "1"), w(1, "1")
        m11, m12 = f"(1 + {l11} * {g11} + {l12} * {g12})", f"({l11} * {g12} + {l12} * {g22})"
        m21, m22 = f"({l12} * {g11} + {l22} * {g12})", f"(1 + {l12} * {g12} + {l22} * {g22})"
        det = f"({m11} * {m22} - {m12} * {m21})"
        loss = (f"(({m22} * {l11} - {m12} * {l12}) * {w(0, 'r')} * {w(0, 'c')}"
                f" + ({m22} * {l12} - {m12} * {l22}) * ({w(0, 'r')} * {w(1, 'c')}"
                f" + {w(1, 'r')} * {w(0, 'c')})"
                f" + ({m11} * {l22} - {m21} * {l12}) * {w(1, 'r')} * {w(1, 'c')}) / {det}")

    def at(line: str, col: str) -> str:
        return f"a[({line}) * {k} + ({col}) + 1]"

    pivot = "cast(v[1] as bigint)"
    d = at(pivot, pivot)
    step = f"""list_transform(range({k * k + 1}), lambda e: case
      when e = {k * k} then a[{k * k + 1}] + ln({d})
      when e // {k} = {pivot} and e % {k} = {pivot} then 1 / {d}
      when e // {k} = {pivot} then a[e + 1] / {d}
      when e % {k} = {pivot} then -a[e + 1] / {d}
      else a[e + 1] - {at(f'e // {k}', pivot)} * {at(pivot, f'e % {k}')} / {d} end)"""
    pivots = ", ".join(f"[{i}.0::double]" for i in range(p))

    def judged(points: str) -> str:
        return f"""select *, mm * ln(2 * pi() * sw[{k * k}] / mm) + mm + ld
        {f'+ sw[{k * k + 1}]' if reml else ''} as dev
      from (select i, h, x, center, ld, all_n, all_n - {p if reml else 0} as mm,
              list_reduce([{pivots}], lambda a, v: {step}, s || [0.0::double]) as sw
            from (select i, h, x, center, list(sv order by p) as s, sum(ld) as ld,
                    any_value(all_n) as all_n
                  from (select i, h, x, center, p, any_value(t[p + 1]) - sum({loss}) as sv,
                          any_value(t[1]) as all_n,
                          sum(case when p = 0 then ln({det}) else 0 end) as ld
                        from ({points}), {name}_w, {name}_pos, {name}_t
                        group by i, h, x, center, p)
                  group by i, h, x, center))"""

    start = ", ".join("1.0" if i in (0, 2) else "0.0" for i in range(m))
    return f"""{name}_pos as (select p, p // {k} as r, p % {k} as c from range({k * k}) as t(p)),
{name}_s as (select g, p, sum(v[r + 1] * v[c + 1]) as s
  from (select g, [{vector}] as v from {source}), {name}_pos group by g, p),
{name}_t as (select list(s order by p) as t from (
  select p, sum(s) as s from {name}_s group by p)),
{name}_w as (select g, list(s order by p) as w from {name}_s where p < {q * k} group by g),
{name}_it as (
  select 0 as i, [{start}]::double[] as x, 0.5::double as h
  union all
  select i + 1, case when min(dev) < max(case when center then dev end) then arg_min(x, dev)
      else any_value(x) filter (where center) end,
    case when min(dev) < max(case when center then dev end) then any_value(h)
      else any_value(h) / 2 end
  from ({judged(f'''select i, h, center,
          list_transform(range({m}), lambda e: x[e + 1] + h * o[e + 1]) as x
        from (select i, h, x, [{offset}] as o, {center} as center from {name}_it, {offsets}
              where h > 1e-8 and i < 500)''')}) group by i),
{name} as (select cast(all_n as bigint) as n, (select count(*) from {name}_w) as n_groups,
    x as theta, sw, sw[{k * k}] as rss, mm as m, dev, sw[{k * k}] / mm as sigma2,
    {name}_t.t as t
  from ({judged(f'select i, h, x, true as center from {name}_it order by i desc limit 1')}), {name}_t)"""


def covariances(random: int, theta: str = "theta") -> tuple[str, ...]:
    """Relative covariances of the random effects: one, or (1,1), (2,1), (2,2)."""
    x = theta
    if random == 1:
        return (f"{x}[1] * {x}[1]",)
    return (f"{x}[1] * {x}[1]", f"{x}[1] * {x}[2]", f"({x}[2] * {x}[2] + {x}[3] * {x}[3])")


def performance_sql(name: str, fixed: int, random: int) -> str:
    """One row of figures of a fit: n, n_groups, n_parameters, loglik, aic, bic, icc, R2s, sigma2."""
    k = fixed + 1
    cov = covariances(random)
    spread = f"{cov[0]} * t[1]" if random == 1 else (
        f"({cov[0]} * t[1] + 2 * {cov[1]} * t[2] + {cov[2]} * t[{k + 2}])")
    beta = "sw[(e // {0}) * {1} + {1}] * sw[(e % {0}) * {1} + {1}]".format(fixed, k)
    product = ("(t[(e // {0}) * {1} + e % {0} + 1] - t[e // {0} + 1] * t[e % {0} + 1] / t[1])"
               .format(fixed, k))
    return f"""select *, -dev / 2 as loglik, dev + 2 * n_parameters as aic,
      dev + ln(n) * n_parameters as bic, vr / (vr + sigma2) as icc,
      vf / (vf + vr + sigma2) as r2_marginal, (vf + vr) / (vf + vr + sigma2) as r2_conditional
    from (select n, n_groups, {fixed + len(cov) + 1} as n_parameters, dev, sigma2,
            sigma2 * {spread} / t[1] as vr, list_sum(list_transform(range({fixed * fixed}),
              lambda e: {beta} * {product})) / (t[1] - 1) as vf from {name})"""


def chi2_upper_sql(x: str, df: str) -> str:
    """Upper tail of the chi-square distribution with one or two degrees of freedom."""
    z = f"sqrt({x} / 2)"
    # erf(z) = 2 / sqrt(pi) * exp(-z^2) * sum of 2^k z^(2k + 1) / (1 * 3 * ... * (2k + 1))
    erf = (f"2 / sqrt(pi()) * list_sum(list_transform(range(400), lambda j: exp(j * ln(2) + (2 * j + 1)"
           f" * ln({z}) - {x} / 2 - (lgamma(2 * j + 2) - j * ln(2) - lgamma(j + 1)))))")
    return (f"case when {df} is null then null when {df} = 2 then exp(-({x}) / 2) when {x} <= 0 then 1 when {x} > 200 then 0 "
            f"else 1 - {erf} end")


def t_both_sides_sql(t: str, df: str, steps: int = 4000) -> str:
    """Both tails of Student's t: one minus Simpson's rule over the density."""
    h = f"(abs({t}) / {steps})"
    weight = f"case when j = 0 or j = {steps} then 1 when j % 2 = 1 then 4 else 2 end"
    area = (f"list_sum(list_transform(range({steps + 1}), lambda j: {weight} * exp(-({df} + 1) / 2.0"
            f" * ln(1 + j * {h} * j * {h} / {df})))) * {h} / 3")
    front = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi())"
    return f"greatest(0, 1 - 2 * {front} * {area})"


def f_upper_sql(x: str, df1: str, df2: str, steps: int = 4000) -> str:
    """Upper tail of F for df1 >= 2: one minus Simpson's rule over the density of the beta
    variate df1 x / (df1 x + df2)."""
    end = f"({df1} * {x} / ({df1} * {x} + {df2}))"
    h = f"({end} / {steps})"
    weight = f"case when j = 0 or j = {steps} then 1 when j % 2 = 1 then 4 else 2 end"
    value = (f"case when j = 0 and {df1} > 2 then 0 else pow(j * {h}, {df1} / 2.0 - 1) "
             f"* pow(1 - j * {h}, {df2} / 2.0 - 1) end")
    area = f"list_sum(list_transform(range({steps + 1}), lambda j: {weight} * {value})) * {h} / 3"
    front = f"exp(lgamma(({df1} + {df2}) / 2.0) - lgamma({df1} / 2.0) - lgamma({df2} / 2.0))"
    return f"greatest(0, 1 - {front} * {area})"
