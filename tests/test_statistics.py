import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyweave.operators import mixed, regression as reg
from tallyweave.operators.quantiles import box_stats, group_quantiles
from tallyweave.operators.rows import (bottom_n, count_sorted, first_per_key, last_per_key,
                                       sample_entities, sample_rows, scramble)
from tallyweave.operators.summaries import (cell_stats, common_sample_summary, density,
                                            group_shares)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        g = rng.choice("aaabcdefgh")
        f, h = rng.choice(["x", "y", "z"]), rng.random() < 0.4
        x = rng.uniform(-1, 3)
        y = 1 + ord(g) % 5 * 0.7 + 0.5 * x + (f == "y") * 2 - (f == "z" and h) + rng.gauss(0, 1)
        rows.append((i, g, f, h, x, y))
    df = spark.createDataFrame(rows, "id int, g string, f string, h boolean, x double, y double")
    return df.cache(), rows


def design(rows):
    x = np.array([[1, r[2] == "y", r[2] == "z", r[3], r[4]] for r in rows], dtype=float)
    return x, np.array([r[5] for r in rows])


def test_box(spark):
    df = spark.createDataFrame([("k", v) for v in (1.0, 2.0, 3.0, 4.0, 10.0)] + [("k", None)],
                               "g string, v double")
    r = box_stats(df, "v", ["g"]).first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"],
            r["n_outliers"]) == (2, 3, 4, 1, 4, 1)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "q", None]),
                          st.one_of(st.just(7.0), st.floats(-1e6, 1e6))),
                min_size=1, max_size=400))
def test_quantiles_are_exact(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.5, 0.93, 1.0]
    out = group_quantiles(df, "v", ["g"], probs, list("abcde"))
    for r in out.collect():
        want = np.quantile([v for g, v in rows if g == r["g"]], probs)
        assert [r[c] for c in "abcde"] == pytest.approx(list(want), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("few", [0, 3])
def test_refined_histograms(spark, monkeypatch, few):
    from tallyweave.operators import quantiles
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 4)
    rng = random.Random(few)
    rows = [("a", rng.gauss(0, 1) ** 9) for _ in range(300)]
    rows += [("b", v) for v in (1e308, -1e308, 5e-324, 0.0, 1e-323, float("inf"), -1e-5, 3.0)]
    rows += [(None, float(v % 3)) for v in range(50)] + [("c", 2.5), ("c", float("nan")),
                                                         ("d", None)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    out = group_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v",
                          ["g"], probs, list("abcdef")).collect()
    assert {r["g"] for r in out} == {"a", "b", "c", None}
    for r in out:
        v = sorted(x for g, x in rows if g == r["g"] and x is not None and x == x)
        for p, c in zip(probs, "abcdef"):
            x = (len(v) - 1) * p
            lo, hi = v[int(np.floor(x))], v[int(np.ceil(x))]
            assert r[c] == (lo if lo == hi else lo + (hi - lo) * (x - np.floor(x)))


def test_no_row_is_shuffled_by_group_alone(spark):
    df = spark.range(30_000).select(F.lit("one").alias("g"), F.rand(1).alias("v"))
    for out in (group_quantiles(df, "v", ["g"], [0.5], ["m"]), box_stats(df, "v", ["g"]),
                reg.levene(df, "v", "g")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        physical = out._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Range (0, 30000") <= 1, plan  # the last pass; others are written
        assert "SortMergeJoin" not in physical
        if "Range (0, 30000" in physical:  # rows meet values of their group in a broadcast join
            assert "BroadcastHashJoin" in physical


def test_ols_against_least_squares(data):
    df, rows = data
    fit, = reg.fit_ols(df, "y", ["f", "h", "x"])
    x, y = design(rows)
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    res = y - x @ b
    assert fit.names == ["(Intercept)", "f[y]", "f[z]", "h[true]", "x"]
    assert list(fit.coef) == pytest.approx(list(b))
    cov = np.linalg.inv(x.T @ x) * (res @ res) / (len(y) - 5)
    assert np.sqrt(np.diag(fit.cov)) == pytest.approx(np.sqrt(np.diag(cov)))
    assert fit.rss == pytest.approx(res @ res)
    out = reg.with_residuals(df, "y", fit).agg(F.sum("residual"), F.sum("fitted")).first()
    assert out[0] == pytest.approx(0, abs=1e-8) and out[1] == pytest.approx(sum(y))


def test_known_factor_fit(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 5.0), ("b", 6.5), ("c", 9.0), ("c", 9.5),
            ("c", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, y double")
    t = {r["term"]: r for r in reg.ols(df, "y", ["g"]).collect()}
    assert t["(Intercept)"]["estimate"] == pytest.approx(1.5)
    assert t["g[c]"]["estimate"] == pytest.approx(7.75)
    assert t["g[b]"]["estimate"] == pytest.approx(3.6667, abs=1e-4)
    assert t["g[b]"]["r2"] == pytest.approx(0.9407, abs=1e-4) and t["g[b]"]["n"] == 7


def test_aliased_term_and_interaction(data, spark):
    df, _ = data
    twice = df.withColumn("x2", F.col("x") * 2)
    fit, = reg.fit_ols(twice, "y", ["x", "x2"])
    assert np.isnan(fit.coef[2]) and fit.rank == 2
    inter, = reg.fit_ols(df, "y", ["f*h"])
    cell = df.where("f = 'z' and h").agg(F.avg("y")).first()[0]
    c = dict(zip(inter.names, inter.coef))
    assert c["(Intercept)"] + c["f[z]"] + c["h[true]"] + c["f[z]:h[true]"] == pytest.approx(cell)
    out = reg.with_residuals(df, "y", inter).where("f = 'z' and h").first()
    assert out["fitted"] == pytest.approx(cell)
    small, = reg.fit_ols(df, "y", ["f"])
    cmp = {r["model"]: r for r in reg.compare_models(
        spark, {"small": small, "inter": inter}).collect()}
    assert cmp["small"]["f_value"] is None and cmp["inter"]["p_value"] < 0.05
    assert cmp["inter"]["aic"] < cmp["small"]["aic"]


def test_strata_come_from_one_pass(data):
    df, rows = data
    fits = reg.fit_ols(df, "y", ["x"], by=["f"])
    assert [f.stratum for f in fits] == [("x",), ("y",), ("z",)]
    one, = reg.fit_ols(df.where("f = 'y'"), "y", ["x"])
    assert list(fits[1].coef) == pytest.approx(list(one.coef))


def test_levene(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", v) for v in (1.0, 5.0, 9.0, 20.0)]
    out = reg.levene(spark.createDataFrame(rows, "g string, v double"), "v", "g")
    za, zb = np.abs(np.array([1, 2, 3, 4]) - 2.5), np.abs(np.array([1, 5, 9, 20]) - 7)
    grand = np.mean([*za, *zb])
    between = 4 * ((za.mean() - grand) ** 2 + (zb.mean() - grand) ** 2)
    within = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    assert out.first()["f_value"] == pytest.approx(between / (within / 6))
    assert 0 < reg.levene_p_value(out) < 1


def dense_deviance(rows, rel, zcols, reml):
    """Deviance from the full covariance matrix, sigma^2 profiled out."""
    x, y = design(rows)
    z = x[:, zcols]
    same = np.array([[a[1] == b[1] for b in rows] for a in rows])
    v = np.eye(len(y)) + np.where(same, z @ rel @ z.T, 0)
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    b = np.linalg.solve(a, x.T @ vi @ y)
    r = y - x @ b
    m = len(y) - x.shape[1] if reml else len(y)
    s2 = r @ vi @ r / m
    dev = m * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(v)[1]
    return dev + (np.linalg.slogdet(a)[1] if reml else 0), b, s2


@pytest.mark.parametrize("reml", [True, False])
def test_random_intercept_is_the_optimum(data, reml):
    df, rows = data
    fit = mixed.random_intercept(df, "y", ["f", "h", "x"], "g", reml)
    ratio = fit.random_cov[0, 0] / fit.sigma2
    at = [dense_deviance(rows, np.array([[r]]), [0], reml)
          for r in (ratio, ratio * 1.05, ratio / 1.05)]
    assert -2 * fit.loglik == pytest.approx(at[0][0])
    assert at[0][0] <= min(at[1][0], at[2][0])
    assert list(fit.coef) == pytest.approx(list(at[0][1])) and fit.sigma2 == pytest.approx(at[0][2])
    assert 0 < fit.icc < 1 and fit.r2_marginal < fit.r2_conditional
    assert fit.converged and not fit.singular


def test_random_slope_is_the_optimum(data):
    df, rows = data
    fit = mixed.random_slope(df, "y", ["f", "h", "x"], "g", "f")
    rel = fit.random_cov / fit.sigma2
    dev, b, s2 = dense_deviance(rows, rel, [0, 1, 2], True)
    assert -2 * fit.loglik == pytest.approx(dev)
    assert fit.sigma2 == pytest.approx(s2) and fit.converged
    base = mixed.random_intercept(df, "y", ["f", "h", "x"], "g")
    assert fit.loglik >= base.loglik - 1e-6
    rng = np.random.default_rng(0)
    for _ in range(20):
        d = rng.normal(scale=0.02, size=(3, 3))
        other = (np.eye(3) + d) @ rel @ (np.eye(3) + d).T
        assert dense_deviance(rows, other, [0, 1, 2], True)[0] >= dev - 1e-4


def test_gradient(data):
    df, _ = data
    from tallyweave.operators.moments import INTERCEPT, Y, as_matrix, cross_products, read_terms
    products = cross_products(df, "y", read_terms(df, ["f", "x"]), ["g"])
    order = [INTERCEPT, "f[y]", "f[z]", "x", Y]
    entries = {(r["a"], r["b"]): r["v"] for r in products.groupBy("a", "b").agg(
        F.sum("v").alias("v")).collect()}
    total = as_matrix(entries, order)
    moments = mixed.GroupMoments(mixed._group_rows(products, "g", order, order[:2]), total, [0, 1])
    theta = np.array([0.7, -0.2, 0.4])
    steps = 1e-5 * np.eye(3)
    for reml in (True, False):
        points = [theta, *(theta + steps), *(theta - steps)]
        got = [mixed._deviance(x, total[0, 0], reml) for x in moments(points)]
        numeric = [(got[1 + i][0] - got[4 + i][0]) / 2e-5 for i in range(3)]
        assert list(got[0][1]) == pytest.approx(numeric, rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("size", [1e-4, 1.0, 1e4])
def test_any_ratio_of_variances(spark, size):
    rng = np.random.default_rng(3)
    effect = rng.normal(size=60) * size
    rows = [(f"g{g}", float(effect[g] + rng.normal())) for g in range(60) for _ in range(20)]
    fit = mixed.random_intercept(spark.createDataFrame(rows, "g string, y double"), "y", [], "g")
    sums = np.array([sum(y for k, y in rows if k == f"g{g}") for g in range(60)])
    ss = sum(y * y for _, y in rows)
    between = 20 * ((sums / 20 - sums.mean() / 20) ** 2).sum() / 59  # balanced: closed form
    within = (ss - (sums ** 2).sum() / 20) / (60 * 19)
    assert fit.converged
    if between > within:
        assert fit.sigma2 == pytest.approx(within, rel=1e-4)
        assert fit.random_cov[0, 0] == pytest.approx((between - within) / 20, rel=1e-4)
    else:
        assert fit.singular and fit.random_cov[0, 0] < 1e-6


def test_many_groups_stay_on_the_cluster(spark):
    df = spark.range(60_000).select(
        F.pmod("id", F.lit(20_000)).alias("g"), (F.pmod(F.col("id") * 7919, F.lit(101)) / 10
                                                 + F.pmod("id", F.lit(20_000)) % 13).alias("y"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("f"))
    fit = mixed.random_slope(df, "y", ["f"], "g", "f")
    assert fit.n_groups == 20_000 and fit.converged and 0 < fit.r2_conditional < 1


def test_absorbed_cells_against_dummies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        g, f, h = rng.integers(6), rng.choice(["a", "b", "c"]), rng.choice(["u", "v", "w"])
        if g == 2 and f == "b":
            continue  # an empty cell
        x = rng.normal() + g
        rows.append((f"g{g}", f, h, float(x), float(g * x * 0 + 2 * x + (f == "b") * g
                                                    + (h == "v") + rng.normal())))
    df = spark.createDataFrame(rows, "g string, f string, h string, x double, y double")
    df = df.withColumn("same", F.length("g") * 2.0)  # a column that the cells determine
    fit = mixed.fit_absorbed(df, "y", "f", "g", ["h", "x", "same"])
    cells = sorted({(r[0], r[1]) for r in rows})
    x = np.array([[float((r[0], r[1]) == c) for c in cells]
                  + [float(r[2] == "v"), float(r[2] == "w"), r[3]] for r in rows])
    y = np.array([r[4] for r in rows])
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = ((y - x @ b) ** 2).sum()
    assert fit.names == ["h[v]", "h[w]", "x"] and fit.n_cells == len(cells) == 17
    assert list(fit.coef) == pytest.approx(list(b[-3:]))
    assert fit.sigma2 == pytest.approx(rss / (len(y) - 20))
    cov = np.linalg.inv(x.T @ x) * fit.sigma2
    assert np.diag(fit.cov) == pytest.approx(np.diag(cov)[-3:])
    got = {(r["g"], r["f"]): (r["n"], r["effect"]) for r in fit.cells.collect()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx(dict(zip(cells, b[:-3])))
    m = len(y) - 20
    dev = m * (np.log(2 * np.pi * fit.sigma2) + 1) + np.linalg.slogdet(x.T @ x)[1]
    assert -2 * fit.loglik == pytest.approx(dev)
    assert mixed.fit_absorbed(df, "y", "f", "g", reml=False).names == []


def test_group_in_the_fixed_part_is_singular(data):
    df, _ = data
    fit = mixed.random_intercept(df, "y", ["g", "x"], "g")
    assert fit.singular and fit.random_cov[0, 0] == 0


def test_icc(data):
    df, rows = data
    r = mixed.anova_icc(df, "y", "g").first()
    assert r["n"] == 400 and r["n_groups"] == 8 and 0 < r["icc"] < 1


def test_density_integrates_to_one(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(300)] + [("b", rng.gauss(2, 0.5))
                                                           for _ in range(50)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = density(df, "v", "g").toPandas()
    assert set(out["g"]) == {"a", "b"} and len(out) == 1024
    for g, part in out.groupby("g"):
        part = part.sort_values("point")
        v = np.array([x for k, x in rows if k == g])
        q = np.quantile(v, [0.25, 0.75])
        bw = 0.9 * min(v.std(ddof=1), (q[1] - q[0]) / 1.34) * len(v) ** -0.2
        want = np.exp(-0.5 * ((part["x"].to_numpy()[:, None] - v) / bw) ** 2).sum(axis=1) / (
            len(v) * bw * np.sqrt(2 * np.pi))
        assert part["density"].to_numpy() == pytest.approx(want, abs=2e-3)
        assert 0.9 < np.trapezoid(part["density"], part["x"]) <= 1.001


def test_rows(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 7)) for i in range(100)],
                               "id bigint, k bigint, v double")
    assert first_per_key(df, ["k"], [F.col("v"), F.col("id")]).count() == 3
    assert {r["id"] for r in last_per_key(df, ["k"], F.struct("v", "id")).collect()} == {
        97, 90, 83}
    got = {r["id"] for r in sample_rows(df, "id", 10, 1).collect()}
    assert len(got) == 10 and got == {r["id"] for r in sample_rows(
        df.repartition(7), "id", 10, 1).collect()}
    want = {r["id"] for r in df.orderBy(scramble(F.col("id"), 1), "id").limit(10).collect()}
    assert got == want
    assert sample_rows(df, "id", 1000, 1).count() == 100
    picked = sample_entities(df, "k", 2, 9)
    assert picked.select("k").distinct().count() == 2 and picked.count() in (66, 67)
    assert bottom_n(df, F.lit(0), 5, [F.col("id")]).count() == 5
    assert [r["n"] for r in count_sorted(df, ["k"], 2).collect()] == [34, 33]


def test_shares_and_cells(data, spark):
    df, _ = data
    total = group_shares(df, ["g"], "f").groupBy("g").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in total)
    assert cell_stats(df.limit(1), "y", ["g"]).first()["sd"] is None
    s = common_sample_summary(spark.createDataFrame([(1, None), (1, 2)], "a int, b int"),
                              ["a", "b"]).first()
    assert (s["n_omitted"], s["pct_omitted"]) == (1, 50.0)
