"""Linear mixed models with one grouping factor, from sums per group.

y = Xb + Zu_g + e, where Z is the intercept, or the intercept and the dummies of one factor. With
L L' = var(u) / var(e), all that is needed of a group is Z'[X y]: the weighted cross products are
S = [X y]'[X y] - sum over groups of (Z'[X y])' B (Z'[X y]) with B = L (I + L'Z'ZL)^-1 L', and
log|V| is a sum over groups too. So every group is one array row of a written table, and the
deviance at several trial points, with its gradient, is one aggregate over that table. Groups may
be as many as there are places; what reaches the driver hangs on the number of terms only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tails import chi2_upper
from ..session import written
from .moments import (INTERCEPT, Y, Terms, as_matrix, collect_bounded, cross_products,
                      ordered_terms, read_terms)

#: Quasi-Newton steps before a fit is given back as not converged, and the fall of the deviance
#: that a further step must promise.
MAX_STEPS, LEAST_FALL = 200, 1e-10


@dataclass
class MixedFit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    random_names: list[str]
    random_cov: np.ndarray
    sigma2: float
    loglik: float
    n: int
    n_groups: int
    reml: bool
    singular: bool
    var_fixed: float
    var_random: float
    converged: bool = True

    @property
    def n_parameters(self) -> int:
        q = len(self.random_names)
        return len(self.names) + q * (q + 1) // 2 + 1

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.n_parameters

    @property
    def bic(self) -> float:
        return -2 * self.loglik + math.log(self.n) * self.n_parameters

    @property
    def icc(self) -> float:
        return self.var_random / (self.var_random + self.sigma2)

    @property
    def r2_marginal(self) -> float:
        return self.var_fixed / (self.var_fixed + self.var_random + self.sigma2)

    @property
    def r2_conditional(self) -> float:
        return ((self.var_fixed + self.var_random)
                / (self.var_fixed + self.var_random + self.sigma2))


def _drop_dependent(g: np.ndarray, order: list[str]) -> list[str]:
    """Columns that earlier ones do not determine."""
    keep: list[int] = []
    for j in range(len(order)):
        trial = [*keep, j]
        sub = g[np.ix_(trial, trial)]
        d = 1 / np.sqrt(np.maximum(np.diag(sub), 1e-300))
        if np.linalg.eigvalsh(sub * np.outer(d, d))[0] > 1e-10:
            keep = trial
    return [order[i] for i in keep]


def _profile(s: np.ndarray, logdet: float, n: float, reml: bool):
    """Deviance and estimates from S = [X y]' V^-1 [X y] and log|V| (V in units of var(e))."""
    a, c, yy = s[:-1, :-1], s[:-1, -1], s[-1, -1]
    b = np.linalg.solve(a, c)
    rss = max(yy - b @ c, 1e-300)
    p = len(b)
    m = n - p if reml else n
    sigma2 = rss / m
    dev = m * (math.log(2 * math.pi * sigma2) + 1) + logdet
    if reml:
        dev += np.linalg.slogdet(a)[1]
    return dev, b, sigma2, np.linalg.inv(a) * sigma2


def _fixed_variance(g: np.ndarray, b: np.ndarray) -> float:
    n = g[0, 0]
    cov = (g[:-1, :-1] - np.outer(g[0, :-1], g[0, :-1]) / n) / (n - 1)
    return float(b @ cov @ b)


def _group_rows(products: DataFrame, group: str, order: Sequence[str],
                z: Sequence[str]) -> DataFrame:
    """(group, at, v): Z'[X y] of every group as positions in a len(z) x len(order) matrix.

    One row per group, as long as the model has terms.
    """
    k = len(order)
    column = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
    line = F.create_map(*[x for i, c in enumerate(z) for x in (F.lit(c), F.lit(i * k))])
    both = products.select(group, "a", "b", "v").unionByName(
        products.where(F.col("a") != F.col("b")).select(
            group, F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    at = (line[F.col("a")] + column[F.col("b")]).cast("int")
    return (both.select(group, at.alias("at"), "v").where(F.col("at").isNotNull())
            .groupBy(group).agg(F.collect_list("at").alias("at"), F.collect_list("v").alias("v")))


class GroupMoments:
    """S, log|V| and their derivatives in the lower triangle of L, summed over all groups."""

    def __init__(self, rows: DataFrame, total: np.ndarray, zi: Sequence[int]):
        self.rows, self.total, self.zi = rows.select("at", "v"), total, list(zi)
        self.tri = np.tril_indices(len(self.zi))

    def __call__(self, thetas: Sequence[np.ndarray]) -> list[tuple]:
        """For each trial point: (S, log|V|, dS, dlog|V|), by one aggregate over the groups."""
        k, zi, tri = len(self.total), self.zi, self.tri
        q, m = len(zi), len(tri[0])
        points = []
        for theta in thetas:
            low = np.zeros((q, q))
            low[tri] = theta
            points.append(low)

        def run(batches):
            loss = np.zeros((len(points), k, k))
            slope = np.zeros((len(points), m, k, k))
            logdet, turn = np.zeros(len(points)), np.zeros((len(points), m))
            for batch in batches:
                at, v = batch.column(0), batch.column(1)
                size = np.diff(at.offsets.to_numpy())
                w = np.zeros((batch.num_rows, q * k))
                w[np.repeat(np.arange(len(size)), size), at.flatten().to_numpy()] = \
                    v.flatten().to_numpy()
                w = w.reshape(-1, q, k)
                zz = w[:, :, zi]
                for t, low in enumerate(points):
                    # P = (I + Z'Z LL')^-1, B = LL' P, H = P Z'Z
                    rel = low @ low.T
                    inverse = np.linalg.inv(np.eye(q) + zz @ rel)
                    y = inverse @ w
                    u = low.T @ y
                    loss[t] += np.einsum("gak,gal->kl", w, rel @ y)
                    logdet[t] += np.linalg.slogdet(np.eye(q) + zz @ rel)[1].sum()
                    h = (inverse @ zz).sum(axis=0) @ low
                    for p, (i, j) in enumerate(zip(*tri)):
                        part = y[:, i, :].T @ u[:, j, :]
                        slope[t, p] += part + part.T
                        turn[t, p] += 2 * h[i, j]
            flat = np.concatenate([loss.reshape(len(points), -1), slope.reshape(len(points), -1),
                                   logdet[:, None], turn], axis=1)
            trial, pos = np.indices(flat.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(trial.ravel().astype(np.int32)), pa.array(pos.ravel().astype(np.int32)),
                 pa.array(flat.ravel())], ["trial", "pos", "v"])

        sums = (self.rows.mapInArrow(run, "trial int, pos int, v double")
                .groupBy("trial", "pos").agg(F.sum("v").alias("v")).toPandas())
        flat = np.zeros((len(points), k * k * (m + 1) + m + 1))
        flat[sums["trial"], sums["pos"]] = sums["v"]
        return [(self.total - f[:k * k].reshape(k, k), f[k * k * (m + 1)],
                 -f[k * k:k * k * (m + 1)].reshape(m, k, k), f[k * k * (m + 1) + 1:])
                for f in flat]


def _deviance(moments: tuple, n: float, reml: bool) -> tuple[float, np.ndarray]:
    """Profiled deviance and its gradient."""
    s, logdet, ds, dlogdet = moments
    try:
        dev, b, sigma2, _ = _profile(s, logdet, n, reml)
    except np.linalg.LinAlgError:
        return math.inf, np.zeros(len(dlogdet))
    residual = np.append(-b, 1.0)
    grad = np.einsum("k,mkl,l->m", residual, ds, residual) / sigma2 + dlogdet
    if reml:
        grad = grad + np.einsum("kl,mlk->m", np.linalg.inv(s[:-1, :-1]), ds[:, :-1, :-1])
    return dev, grad


def _minimise(f: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], x: np.ndarray,
              curvature: float) -> tuple[np.ndarray, bool]:
    """Minimum of f by quasi-Newton steps (BFGS); every job of f looks at several step lengths."""
    lengths = np.array([1.0, 0.3, 0.08, 0.02, 3.0])
    (value, grad), = f([x])
    h = fresh = None
    for _ in range(MAX_STEPS):
        if h is None:  # first steps are no longer than the unit
            h, fresh = np.eye(len(x)) / max(curvature, float(np.abs(grad).max())), True
        step = -h @ grad
        if -0.5 * (grad @ step) <= LEAST_FALL:
            return x, True
        scale = 1.0
        while scale > 1e-8:
            tried = f([x + scale * c * step for c in lengths])
            best = int(np.argmin([t[0] for t in tried]))
            if tried[best][0] < value:
                break
            scale *= 0.005
        else:
            if fresh:  # no fall along the gradient itself: as low as doubles can tell, or stuck
                return x, bool(-0.5 * (grad @ step) <= 1e-9 * (1 + abs(value)))
            h = None
            continue
        move, turn = scale * lengths[best] * step, tried[best][1] - grad
        x, (value, grad) = x + move, tried[best]
        bend = move @ turn
        if bend > 0:
            if fresh:
                h = np.eye(len(x)) * (bend / (turn @ turn))
            left = np.eye(len(x)) - np.outer(move, turn) / bend
            h = left @ h @ left.T + np.outer(move, move) / bend
            fresh = False
    return x, False


def fit_mixed(df: DataFrame, y: str, fixed: Sequence[str], group: str, slope: str | None = None,
              reml: bool = True) -> MixedFit:
    """Random intercept, and with ``slope`` random effects of that factor too, by (restricted)
    maximum likelihood.

    ``converged`` says whether the steps came to rest; a variance of 0 is found as such
    (``singular``). If the grouping factor is a fixed factor too, nothing is left for its
    intercepts, and their variance is 0; see :func:`fit_absorbed` for many such groups.
    """
    terms = read_terms(df, fixed)
    if slope is not None and slope not in terms.factors:
        raise ValueError(f"{slope} must be a fixed factor too")
    data = df.where(F.col(group).isNotNull())
    products = written(cross_products(data, y, terms, [group]), "products")
    totals = collect_bounded(products.groupBy("a", "b").agg(F.sum("v").alias("v")),
                             "cross products")
    entries = {(r["a"], r["b"]): r["v"] for r in totals}
    names = {a for a, _ in entries} | {b for _, b in entries}
    order = ordered_terms(names, terms)
    order = _drop_dependent(as_matrix(entries, order), order)
    z = [INTERCEPT]
    if slope is not None:
        z += [c for c in terms.level_names(slope, names) if c in order]
    full = [*order, Y]
    total = as_matrix(entries, full)
    n, q = total[0, 0], len(z)
    zi = [full.index(c) for c in z]
    n_groups = products.where((F.col("a") == INTERCEPT) & (F.col("b") == INTERCEPT)).count()
    if group in terms.factors and slope is None:
        theta, converged = np.zeros(1), True
        s, logdet = total, 0.0
    else:
        moments = GroupMoments(written(_group_rows(products, group, full, z), "groups"), total, zi)

        def dev(thetas):
            return [_deviance(x, n, reml) for x in moments(thetas)]

        tri = np.tril_indices(q)
        scales = 10.0 ** np.arange(-2, 4)
        starts = [c * np.eye(q)[tri] for c in scales]
        first = int(np.argmin([v for v, _ in dev(starts)]))
        # in units of the best start, so that steps fit whatever the ratio's size
        unit = scales[first]

        def scaled(points):
            return [(v, g * unit) for v, g in dev([unit * x for x in points])]

        theta, converged = _minimise(scaled, np.eye(q)[tri], 2.0 * max(n_groups, 1))
        theta = unit * theta
        (s, logdet, _, _), = moments([theta])
    d, b, sigma2, cov = _profile(s, logdet, n, reml)
    low = np.zeros((q, q))
    low[np.tril_indices(q)] = theta
    rel = low @ low.T
    rcov = rel * sigma2
    # mean over the rows of z' T z: what the random part explains on average
    var_random = float(np.trace(rcov @ total[np.ix_(zi, zi)]) / n)
    eig = np.linalg.eigvalsh(rel)
    return MixedFit(order, b, cov, z, rcov, float(sigma2), float(-d / 2), int(round(n)), n_groups,
                    reml, bool(eig[0] <= 1e-8 * max(1.0, eig[-1])), _fixed_variance(total, b),
                    var_random, converged)


def random_intercept(df: DataFrame, y: str, fixed: Sequence[str], group: str,
                     reml: bool = True) -> MixedFit:
    """Fit with a random intercept per group."""
    return fit_mixed(df, y, fixed, group, None, reml)


def random_slope(df: DataFrame, y: str, fixed: Sequence[str], group: str, slope: str,
                 reml: bool = True) -> MixedFit:
    """Random intercept and random effects of factor ``slope`` (which must be in ``fixed``)."""
    return fit_mixed(df, y, fixed, group, slope, reml)


@dataclass
class AbsorbedFit:
    """A fit whose fixed part holds a factor, the grouping factor and all their interactions.

    ``cells``: (group, factor, n, effect) table, the fitted mean of each cell of both factors where
    the other columns are 0; ``names``, ``coef``, ``cov``: the other columns.
    """

    cells: DataFrame
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    sigma2: float
    loglik: float
    n: int
    n_groups: int
    n_cells: int
    reml: bool


def fit_absorbed(df: DataFrame, y: str, factor: str, group: str, others: Sequence[str] = (),
                 reml: bool = True) -> AbsorbedFit:
    """Mixed model ``y ~ factor * group + others + (1 | group)``.

    Dummies of the group in the fixed part leave nothing for random intercepts (nor for random
    slopes of ``factor``): their variance is 0. Every cell of both factors has a coefficient of
    its own, so cells are swept out of the cross products one by one, each by its own sums, and
    only the other columns are solved for on the driver. Groups may be as many as there are
    places. Columns that cells and earlier columns determine get no coefficient.
    """
    terms = read_terms(df, others)
    by = [group, factor]
    data = df.dropna(subset=by)
    products = written(cross_products(data, y, terms, by), "products")
    own = (F.col("a") == INTERCEPT) | (F.col("b") == INTERCEPT)
    name = F.when(F.col("a") == INTERCEPT, F.col("b")).otherwise(F.col("a"))
    sums = written(products.where(own).select(*by, name.alias("t"), "v").groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("s")), "cells")
    size = F.col("s")[INTERCEPT]
    # what cells explain: products of a cell's sums, also of columns that never meet in a row
    left = sums.select(size.alias("size"), "s", F.explode("s").alias("a", "x"))
    between = (left.select("size", "a", "x", F.explode("s").alias("b", "y"))
               .where(F.col("a") <= F.col("b")).groupBy("a", "b")
               .agg(F.sum(F.col("x") * F.col("y") / F.col("size")).alias("v")))
    raw, explained = ({tuple(sorted((r["a"], r["b"]))): r["v"] for r in collect_bounded(t, "terms")}
                      for t in (products.groupBy("a", "b").agg(F.sum("v").alias("v")), between))
    entries = {k: raw.get(k, 0.0) - explained.get(k, 0.0) for k in {*raw, *explained}}
    names = {c for pair in entries for c in pair}
    order = [c for c in ordered_terms(names, terms)[1:]
             if entries.get((c, c), 0.0) > 1e-10 * raw.get((c, c), 0.0)]
    if order:
        order = _drop_dependent(as_matrix(entries, order), order)
    s = as_matrix(entries, [*order, Y])
    counts = sums.agg(F.sum(size), F.count(F.lit(1)), F.count_distinct(group)).first()
    n, n_cells, n_groups = counts[0] or 0.0, counts[1], counts[2]
    a, c = s[:-1, :-1], s[:-1, -1]
    b = np.linalg.solve(a, c) if order else np.zeros(0)
    rss = max(float(s[-1, -1] - b @ c), 1e-300)
    free = n - n_cells - len(order)
    sigma2 = rss / (free if reml else n)
    m = free if reml else n
    dev = m * (math.log(2 * math.pi * sigma2) + 1)
    if reml:
        dev += sums.agg(F.sum(F.log(size))).first()[0] or 0.0
        dev += np.linalg.slogdet(a)[1] if order else 0.0
    effect = F.col("s")[Y] / size
    for col, value in zip(order, b):
        effect = effect - F.lit(float(value)) * F.coalesce(F.col("s")[col], F.lit(0.0)) / size
    cells = sums.select(*by, size.cast("bigint").alias("n"), effect.alias("effect"))
    return AbsorbedFit(cells, order, b, np.linalg.inv(a) * sigma2 if order else np.zeros((0, 0)),
                       sigma2, -dev / 2, int(round(n)), n_groups, n_cells, reml)


def anova_icc(df: DataFrame, y: str, group: str) -> DataFrame:
    """Intraclass correlation from the one-way analysis of variance, on the cluster alone."""
    g = (df.dropna(subset=[y, group]).groupBy(group)
         .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"),
              F.sum(F.col(y) * F.col(y)).alias("ss")))
    t = g.agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("nn"),
              F.sum("s").alias("s"), F.sum("ss").alias("ss"),
              F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"),
              F.sum(F.col("n") * F.col("n")).alias("n2"))
    msb = (F.col("b") - F.col("s") * F.col("s") / F.col("nn")) / (F.col("k") - 1)
    msw = (F.col("ss") - F.col("b")) / (F.col("nn") - F.col("k"))
    n0 = (F.col("nn") - F.col("n2") / F.col("nn")) / (F.col("k") - 1)
    return t.select(F.col("k").cast("bigint").alias("n_groups"),
                    F.col("nn").cast("bigint").alias("n"), msb.alias("ms_between"),
                    msw.alias("ms_within"), ((msb - msw) / (msb + (n0 - 1) * msw)).alias("icc"))


def fixed_effects(spark: SparkSession, fit: MixedFit) -> DataFrame:
    data = [(c, float(b), math.sqrt(v), float(b) / math.sqrt(v))
            for c, b, v in zip(fit.names, fit.coef, np.diag(fit.cov))]
    return spark.createDataFrame(data, "term string, estimate double, std_error double, "
                                       "t_value double")


def variance_components(spark: SparkSession, fit: MixedFit) -> DataFrame:
    data = [(fit.random_names[i], fit.random_names[j], float(fit.random_cov[i, j]))
            for i in range(len(fit.random_names)) for j in range(i + 1)]
    data.append(("Residual", "Residual", float(fit.sigma2)))
    return spark.createDataFrame(data, "effect string, with_effect string, covariance double")


def performance(spark: SparkSession, fits: dict[str, MixedFit]) -> DataFrame:
    """AIC, BIC, ICC, R^2 per model and the likelihood-ratio test against the one before.

    The test wants ML fits (``reml=False``) when fixed effects differ.
    """
    data, prev = [], None
    for name, f in fits.items():
        row = [name, f.n, f.n_groups, f.n_parameters, f.loglik, f.aic, f.bic, f.icc,
               f.r2_marginal, f.r2_conditional, f.sigma2, f.singular, f.converged]
        if (prev is not None and prev.n == f.n and f.n_parameters > prev.n_parameters
                and set(prev.names) <= set(f.names)
                and set(prev.random_names) <= set(f.random_names)):
            stat = max(2 * (f.loglik - prev.loglik), 0.0)
            row += [stat, chi2_upper(stat, f.n_parameters - prev.n_parameters)]
        else:
            row += [None, None]
        data.append(tuple(row))
        prev = f
    return spark.createDataFrame(
        data, "model string, n bigint, n_groups bigint, n_parameters bigint, loglik double, "
        "aic double, bic double, icc double, r2_marginal double, r2_conditional double, "
        "sigma2 double, singular boolean, converged boolean, chi_sq double, p_value double")
