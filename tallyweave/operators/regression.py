"""Linear models from cross-product sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tails import f_upper, t_two_sided
from ..session import written
from .joins import join_per_group
from .moments import (INTERCEPT, Y, Terms, as_matrix, collect_bounded, cross_products,
                      ordered_terms, read_terms)
from .quantiles import group_median


@dataclass
class OlsFit:
    """One fitted model. ``coef`` is NaN for a term that the others already determine."""

    terms: Terms
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    means: dict[str, float]
    n: int
    rank: int
    rss: float
    tss: float
    stratum: tuple = ()
    levels: dict[str, list[str]] = field(default_factory=dict)

    @property
    def df_residual(self) -> int:
        return self.n - self.rank

    @property
    def sigma2(self) -> float:
        return self.rss / self.df_residual if self.df_residual > 0 else math.nan

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss > 0 else math.nan

    @property
    def adj_r2(self) -> float:
        if self.df_residual <= 0:
            return math.nan
        return 1 - (1 - self.r2) * (self.n - 1) / self.df_residual

    @property
    def loglik(self) -> float:
        return -self.n / 2 * (math.log(2 * math.pi) + math.log(self.rss / self.n) + 1)

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * (self.rank + 1)

    @property
    def bic(self) -> float:
        return -2 * self.loglik + math.log(self.n) * (self.rank + 1)

    def rows(self) -> list[tuple]:
        out = []
        for i, name in enumerate(self.names):
            b = float(self.coef[i])
            if math.isnan(b):
                out.append((name, None, None, None, None))
                continue
            se = math.sqrt(max(self.cov[i, i], 0.0)) if self.df_residual > 0 else math.nan
            t = b / se if se > 0 else math.nan
            out.append((name, b, se, t, t_two_sided(t, self.df_residual)))
        return out


def _solve(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients, inverse and rank; columns that depend on earlier ones get NaN."""
    k = len(g)
    low = np.zeros((k, k))
    keep = []
    for j in range(k):
        row = low[j, :len(keep)]
        for c, i in enumerate(keep):
            row[c] = (g[j, i] - low[j, :c] @ low[i, :c]) / low[i, c]
        left = g[j, j] - row @ row
        if left > 1e-9 * max(g[j, j], 1e-300):
            low[j, len(keep)] = math.sqrt(left)
            keep.append(j)
    idx = np.array(keep)
    inv = np.linalg.inv(g[np.ix_(idx, idx)])
    coef = np.full(k, np.nan)
    coef[idx] = inv @ h[idx]
    full = np.full((k, k), np.nan)
    full[np.ix_(idx, idx)] = inv
    return coef, full, len(keep)


def fit_from_entries(entries: dict[tuple[str, str], float], terms: Terms,
                     stratum: tuple = ()) -> OlsFit:
    names = {a for a, _ in entries} | {b for _, b in entries}
    order = ordered_terms(names, terms)
    m = as_matrix(entries, [*order, Y])
    g, h, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    # Centre on the intercept before solving: keeps digits when a mean is far from zero.
    n = g[0, 0]
    gc = g - np.outer(g[0], g[0]) / n
    hc = h - g[0] * h[0] / n
    tss = yy - h[0] ** 2 / n
    coef = np.full(len(order), np.nan)
    cov = np.full((len(order), len(order)), np.nan)
    if len(order) > 1:
        b, inv, rank = _solve(gc[1:, 1:], hc[1:])
        ok = ~np.isnan(b)
        bb = np.where(ok, b, 0.0)
        rss = tss - bb @ hc[1:]
        inv0 = np.where(np.isnan(inv), 0.0, inv)
        xbar = g[0, 1:] / n
        coef[1:] = b
        coef[0] = h[0] / n - xbar @ bb
        cov[1:, 1:] = inv
        cov[0, 0] = 1 / n + xbar @ inv0 @ xbar
        cov[0, 1:] = cov[1:, 0] = -inv0 @ xbar
    else:
        rank, rss = 0, tss
        coef[0], cov[0, 0] = h[0] / n, 1 / n
    rank += 1
    rss = max(rss, 0.0)
    sigma2 = rss / (n - rank) if n > rank else math.nan
    levels = {f: terms.level_names(f, names) for f in terms.factors}
    means = {c: g[0, order.index(c)] / n for c in terms.numerics}
    return OlsFit(terms, order, coef, cov * sigma2, means, int(round(n)), rank, float(rss),
                  float(tss), stratum, levels)


def fit_ols(df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str] = (),
            levels: dict[str, Sequence[str]] | None = None) -> list[OlsFit]:
    """One fit per stratum of ``by``, all from the same aggregation; ``levels`` as in
    ``read_terms``."""
    parsed = read_terms(df, terms, levels)
    rows = collect_bounded(cross_products(df, y, parsed, by), "cross products")
    strata: dict[tuple, dict] = {}
    for r in rows:
        strata.setdefault(tuple(r[c] for c in by), {})[(r["a"], r["b"])] = r["v"]
    return [fit_from_entries(e, parsed, s)
            for s, e in sorted(strata.items(), key=lambda kv: tuple(map(str, kv[0])))]


_COEF_SCHEMA = ("term string, estimate double, std_error double, t_value double, p_value double, "
                "n bigint, df_residual bigint, r2 double, adj_r2 double")


def coefficient_table(spark: SparkSession, fits: Sequence[OlsFit],
                      by: Sequence[str] = ()) -> DataFrame:
    """Tidy coefficients; ``by`` names the stratum columns (as text)."""
    data = [(*[None if s is None else str(s) for s in f.stratum], *row, f.n, f.df_residual,
             f.r2, f.adj_r2) for f in fits for row in f.rows()]
    head = "".join(f"`{c}` string, " for c in by)
    return spark.createDataFrame(data, head + _COEF_SCHEMA)


def ols(df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str] = (),
        levels: dict[str, Sequence[str]] | None = None) -> DataFrame:
    return coefficient_table(df.sparkSession, fit_ols(df, y, terms, by, levels), by)


def compare_models(spark: SparkSession, fits: dict[str, OlsFit]) -> DataFrame:
    """Fit statistics side by side, with the F test against the previous model where nested."""
    data, prev = [], None
    for name, f in fits.items():
        row = [name, f.n, f.rank, f.rss, f.r2, f.adj_r2, f.loglik, f.aic, f.bic]
        nested = (prev is not None and prev.n == f.n and set(prev.names) < set(f.names)
                  and f.rank > prev.rank and f.df_residual > 0)
        if nested:
            d1 = f.rank - prev.rank
            stat = (prev.rss - f.rss) / d1 / f.sigma2
            row += [stat, f_upper(stat, d1, f.df_residual)]
        else:
            row += [None, None]
        data.append(tuple(row))
        prev = f
    return spark.createDataFrame(
        data, "model string, n bigint, n_parameters bigint, rss double, r2 double, "
        "adj_r2 double, loglik double, aic double, bic double, f_value double, p_value double")


def side_by_side(spark: SparkSession, fits: dict[str, OlsFit]) -> DataFrame:
    """One row per term, one estimate column per model."""
    terms = list(dict.fromkeys(n for f in fits.values() for n in f.names))
    data = []
    for t in terms:
        row = [t]
        for f in fits.values():
            b = float(f.coef[f.names.index(t)]) if t in f.names else math.nan
            row.append(None if math.isnan(b) else b)
        data.append(tuple(row))
    cols = ", ".join(f"`{m}` double" for m in fits)
    return spark.createDataFrame(data, f"term string, {cols}")


def predictions(spark: SparkSession, fit: OlsFit, factor: str) -> DataFrame:
    """Predicted value per level of ``factor``, other factors at base, numerics at their mean."""
    data = []
    coef = np.where(np.isnan(fit.coef), 0.0, fit.coef)
    cov = np.where(np.isnan(fit.cov), 0.0, fit.cov)
    for level in fit.levels[factor]:
        x = np.array([1.0 if n == INTERCEPT or n == level else fit.means.get(n, 0.0)
                      for n in fit.names])
        data.append((level[len(factor) + 1:-1], float(x @ coef),
                     math.sqrt(max(float(x @ cov @ x), 0.0))))
    return spark.createDataFrame(data, "level string, predicted double, std_error double")


def with_residuals(df: DataFrame, y: str, fit: OlsFit) -> DataFrame:
    """Add ``fitted`` and ``residual``; rows with a NULL model column get NULL."""
    coef = {n: 0.0 if math.isnan(b) else float(b) for n, b in zip(fit.names, fit.coef)}
    pred = F.lit(coef[INTERCEPT])

    def lookup(prefix: str, key):
        pairs = [(n, b) for n, b in coef.items() if n.startswith(prefix)]
        if not pairs:
            return F.lit(0.0)
        m = F.create_map(*[F.lit(v) for p in pairs for v in p])
        return F.coalesce(F.try_element_at(m, key), F.lit(0.0))

    def level(f: str):
        return F.concat(F.lit(f"{f}["), F.col(f).cast("string"), F.lit("]"))

    known = F.col(y).isNotNull()
    for c in fit.terms.columns:
        known = known & F.col(c).isNotNull()
    for f in fit.terms.factors:
        pred = pred + lookup(f"{f}[", level(f))
    for a, b in fit.terms.crossed:
        pred = pred + lookup(f"{a}[", F.concat(level(a), F.lit(":"), level(b)))
    for c in fit.terms.numerics:
        pred = pred + F.lit(coef[c]) * F.col(c)
    return (df.withColumn("fitted", F.when(known, pred))
            .withColumn("residual", F.col(y) - F.col("fitted")))


def simple_regression(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Intercept, slope and R^2 of y on one numeric column, by built-in aggregates."""
    aggs = [F.regr_count(y, x).alias("n"), F.regr_intercept(y, x).alias("intercept"),
            F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Levene's test around the median: one row (f_value, df1, df2, n). Rows meet the medians where
    they lie, or spread over many places (:func:`join_per_group`)."""
    data = df.dropna(subset=[value, group]).select(group, F.col(value).cast("double").alias("_v"))
    med = written(group_median(data, "_v", [group], "_med"), "medians")
    far = F.abs(F.col("_v") - F.col("_med"))
    z = (join_per_group(data, med, [group], F.col("_v")).groupBy(group)
         .agg(F.count(F.lit(1)).alias("n"), F.sum(far).alias("s"), F.sum(far * far).alias("ss")))
    t = z.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"),
              F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("ss") - F.col("b")
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return t.select((between / df1 / (within / df2)).alias("f_value"), df1.alias("df1"),
                    df2.alias("df2"), "n")


def levene_p_value(result: DataFrame) -> float:
    r = result.first()
    return f_upper(r["f_value"], r["df1"], r["df2"])
